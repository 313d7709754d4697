"""Composite views: a code's page, batch coding, missed queries, sampled test sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import codes as C, rules as R, text as X, values as V
from . import notes as N
from .hierarchy import ancestors, parents, prefix_join, top_rows
from .index import Index
from .search import search


def containing(codes: DataFrame, needle: str) -> DataFrame:
    """Codes whose code or names contain a text, whatever its case."""
    low = needle.lower()
    return codes.where(F.lower("code").contains(low) | F.lower("zh").contains(low) | F.lower("en").contains(low))


def garbled(codes: DataFrame, known: DataFrame) -> DataFrame:
    """Names with lost characters that are not among the known ones."""
    return codes.where(X.is_garbled(F.col("zh"))).join(known, "code", "left_anti")


def code_page(codes: DataFrame, terms: DataFrame, chapters: DataFrame, notes: DataFrame, olds: DataFrame, most_terms: int = 40) -> DataFrame:
    """One row per code: path up, children, descendants, terms by source, chapter,
    inherited notes and old codes. Each part is an aggregate by code, joined by code."""
    up = ancestors(codes).where("dist > 0").join(codes.select(F.col("code").alias("anc")), "anc", "left_semi")
    path = up.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("anc").alias("n"), "anc"))), lambda x: x["anc"]).alias("path"))
    kids = parents(codes).where("parent is not null").groupBy(F.col("parent").alias("code")).agg(F.array_sort(F.collect_list("code")).alias("children"))
    below = prefix_join(codes.select(F.col("code").alias("root")), "root", codes.select("code"), "code").where("root <> code").groupBy(F.col("root").alias("code")).agg(F.count("*").alias("n_below"))
    shown = top_rows(terms, ["code", "src_id"], [F.asc("ord")], most_terms, "n").groupBy("code", "src_id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    by_source = shown.groupBy("code").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src_id", "texts")))).alias("terms"))
    stem = F.substring("code", 1, 3)
    placed = codes.join(F.broadcast(chapters), (stem >= F.col("first")) & (stem <= F.col("last")), "left").select("code", "chapter")
    told = N.merged(codes.select("code"), notes).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("dist", "pos", "kind", "text"))).alias("notes"))
    out = codes
    for part in (path, kids, below, by_source, placed, told, olds):
        out = out.join(part, "code", "left")
    return out


def misses(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Queries without result, or whose first result neither is mapped nor shows half
    of the query."""
    first = results.where("rank = 1").select("qid", "atm", F.concat_ws(" ", "zh", "en").alias("shown"))
    j = queries.join(first, "qid", "left")
    return j.where(F.col("shown").isNull() | (~F.col("atm") & (R.coverage("raw", F.coalesce("shown", F.lit(""))) < 0.5))).select("qid", "raw")


def batch_coding(texts: DataFrame, ix: Index, notes: DataFrame, most_lines: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pasted texts (batch, text) to the best code of each line, the reminders of the
    picked codes, and the pairs that exclude each other."""
    lines = texts.select("batch", F.posexplode(F.split("text", r"\r?\n|[;；]")).alias("line", "raw")).withColumn("t", R.line_text(F.col("raw")))
    lines = lines.select("batch", "line", R.line_body(F.col("t")).alias("raw"), R.line_tag(F.col("t")).alias("tag")).where("raw <> ''")
    lines = top_rows(lines, ["batch"], [F.asc("line")], most_lines, "pos").withColumn("qid", F.xxhash64("batch", "line"))
    found = search(lines.select("qid", "raw"), ix, 5).where("rank = 1").select("qid", "code", "score")
    picked = lines.join(found, "qid", "left").select("batch", "pos", "raw", "tag", "code", "score")
    coded = picked.where("code is not null")
    inherited = N.merged(coded.select("code").distinct(), notes)
    rem = N.satisfied(coded.select("batch", "code").distinct().join(N.reminders(inherited), "code"), coded)
    return picked, rem, N.conflicts(coded, inherited)


def hash_sample(items: DataFrame, by: str, q: str, n: int) -> DataFrame:
    """n items of each set, by the hash of their text: the same ones every time."""
    w = Window.partitionBy(by).orderBy(*R.hash_sample_order(F.col(q)))
    return items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def linked(text: str = "text") -> Column:
    """Codes named in a text, in order, for links."""
    return F.regexp_extract_all(F.col(text), F.lit(f"({C.CODE})"), F.lit(1))


def route(link: Column) -> Column:
    """A link's view and decoded argument; unknown ones go home."""
    path = F.regexp_replace(link, "^#?/?", "")
    kind = F.substring_index(path, "/", 1)
    views = F.create_map(*[F.lit(x) for pair in V.ROUTES.items() for x in pair])
    view = F.coalesce(F.try_element_at(views, kind), F.lit("home"))
    return F.struct(view.alias("view"), F.when(~view.isin(V.PLAIN_VIEWS), F.url_decode(F.regexp_replace(path, "^[^/]*/?", ""))).alias("arg"))


def link(kind: Column, arg: Column) -> Column:
    return F.concat(F.lit("#/"), kind, F.lit("/"), F.replace(F.url_encode(arg), F.lit("+"), F.lit("%20")))


def label(kind: Column, labels: dict[str, str]) -> Column:
    """What a kind is called; unknown ones are called what they are."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(names, kind), kind)
