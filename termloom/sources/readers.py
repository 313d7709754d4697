"""Scans: contract-checked CSV, XML trees, OBO text, ODS sheets, JSON and YAML."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def csv_contract(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file or a folder of them; every file's header must equal the schema's names.
    A byte-order mark is allowed, bad rows and bad UTF-8 fail the read."""
    heads = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    heads = heads.where("at = 0").groupBy("file").agg(F.first("value").alias("head"))  # a row per file; a file's first block begins with its header
    names = F.transform(F.split(F.regexp_replace(F.regexp_replace("head", "^\ufeff", ""), "\r$", ""), ","), lambda n: F.btrim(F.trim(n), F.lit('"')))
    bad = heads.where(names != F.array(*map(F.lit, schema.names))).select("file", "head").head(1)
    if bad:
        raise ValueError(f"header {bad[0]['head']!r} of {bad[0]['file']} is not {schema.names}")
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST", encoding="UTF-8", multiLine=True)


def strict_utf8(df: DataFrame, column: str) -> DataFrame:
    """Rows of a binary column that decode; anything else raises when read."""
    return df.withColumn(column, F.validate_utf8(F.col(column).cast("string")))


OPEN, CLOSE = "\ue000", "\ue001"  # private characters around a title's optional words


def _walk(el: ET.Element, path: list[str], tags: dict[str, str]):
    title = el.find(tags["title"])
    if title is not None:
        for optional in title.iter(tags["optional"]):
            optional.text, optional.tail = OPEN + (optional.text or ""), CLOSE + (optional.tail or "")
        path = [*path, "".join(title.itertext())]
    code, see = el.findtext(tags["code"]), el.findtext(tags["see"])
    if code or see:
        yield path, code, see
    for child in el.findall(tags["child"]):
        yield from _walk(child, path, tags)


def xml_terms(spark: SparkSession, path: str, main: str = "mainTerm", title: str = "title", code: str = "code", see: str = "see", child: str = "term", optional: str = "nemod") -> DataFrame:
    """(path, code, see, nemod) of index trees of any depth; nemod is the last title's
    non-essential modifiers, which no path shows. Files are the unit of work: each is
    walked as a stream, and each main element is freed after use."""
    tags = {"title": title, "code": code, "see": see, "child": child, "optional": optional}

    def walk(batches):
        for b in batches:
            for content in b["content"]:
                out = []
                for _, el in ET.iterparse(io.BytesIO(content)):
                    if el.tag == main:
                        out += _walk(el, [], tags)
                        el.clear()
                yield pd.DataFrame(out, columns=["path", "code", "see"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(walk, "path array<string>, code string, see string")
    squeezed = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    plain = F.transform("path", lambda t: squeezed(F.regexp_replace(t, f"{OPEN}[^{CLOSE}]*{CLOSE}", "")))
    extra = F.transform(F.regexp_extract_all(F.element_at("path", -1), F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1)), lambda t: F.btrim(t, F.lit(" ()")))
    return rows.select(plain.alias("path"), "code", "see", F.array_join(extra, " ").alias("nemod"))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: StructType, keep: DataFrame | None = None, key: str = "") -> DataFrame:
    """Records of a flat XML file; with keep, only those whose key is wanted."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return df.join(keep, key, "left_semi") if keep is not None else df


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, xrefs, synonyms) of the live terms of an OBO file."""
    t = spark.read.text(path, lineSep="\n[Term]\n").withColumn("b", F.concat(F.lit("\n"), "value"))
    one = lambda f: F.nullif(F.regexp_extract("b", f"\n{f}: ([^\n]*)", 1), F.lit(""))
    every = lambda f: F.regexp_extract_all("b", F.lit(f"\n{f}: ([^\n]*)"), F.lit(1))
    live = t.where(F.col("b").rlike("\nid: ") & ~F.col("b").rlike("\nis_obsolete: true"))
    return live.select(one("id").alias("id"), one("name").alias("name"), every("xref").alias("xrefs"), F.regexp_extract_all("b", F.lit('\nsynonym: "([^"]*)"'), F.lit(1)).alias("synonyms"))


_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def ods_cells(content: bytes, sheet: str | None = None, most_repeats: int = 30):
    """Rows of cells of an ODS workbook; repeated columns are spelled out up to a limit."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("content.xml"))
    for table in root.iter(f"{_TABLE}table"):
        if sheet and table.get(f"{_TABLE}name") != sheet:
            continue
        for n, row in enumerate(table.iter(f"{_TABLE}table-row")):
            cells: list[str] = []
            for c in row.iter(f"{_TABLE}table-cell"):
                text = "\n".join("".join(p.itertext()) for p in c.iter(f"{_TEXT}p"))
                cells += [text] * min(int(c.get(f"{_TABLE}number-columns-repeated", "1")), most_repeats)
            if any(cells):
                yield table.get(f"{_TABLE}name"), n, cells


def ods_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(file, sheet, row, cells) of workbooks, or of workbooks inside zip files."""

    def read(batches):
        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                books = [content]
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inner = [n for n in z.namelist() if n.endswith(".ods")]
                    if inner:
                        books = [z.read(n) for n in inner]
                yield pd.DataFrame([(file, *r) for book in books for r in ods_cells(book, sheet)], columns=["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, sheet string, row int, cells array<string>")


def json_table(spark: SparkSession, path: str, schema: StructType, multiline: bool = True) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multiline, mode="FAILFAST")


def curated(spark: SparkSession, path: str) -> DataFrame:
    """Curation files: lists of flow mappings, one ``- {term: .., codes: [..], ..}`` a line."""
    t = spark.read.text(path).where(F.col("value").rlike(r"^\s*- \{"))
    field = lambda f: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("value", rf"[{{,]\s*{f}:\s*(\"[^\"]*\"|'[^']*'|\[[^\]]*\]|[^,}}]*)", 1), r"^[\"'\[]|[\"'\]]$", "")), F.lit(""))
    codes = F.filter(F.transform(F.split(F.coalesce(field("codes"), F.lit("")), ","), lambda c: F.trim(c)), lambda x: x != "")
    return t.select(field("term").alias("term"), codes.alias("codes"), field("expand").alias("expand"), field("note").alias("note"), (field("approved") == "true").alias("approved"))


def sparql_rows(spark: SparkSession, path: str) -> DataFrame:
    """Landed SPARQL JSON results as (prop, kind, item, code, text, lang)."""
    cell = "struct<value:string,`xml:lang`:string>"
    names = ["prop", "kind", "item", "code", "text"]
    schema = "results struct<bindings array<struct<" + ",".join(f"{n}:{cell}" for n in names) + ">>>"
    b = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results.bindings").alias("b"))
    return b.select(*(F.col(f"b.{n}.value").alias(n) for n in names), F.col("b.text.`xml:lang`").alias("lang"))
