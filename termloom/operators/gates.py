"""Fail-closed data gates: every gate is one row, all are evaluated, and promotion
refuses unless each passed or was overridden by number."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import codes as C, text as X
from .hierarchy import below_roots, parents, prefixes


def gate(df: DataFrame, number: int, name: str, bad: Column, message: str = "bad rows") -> DataFrame:
    """A gate that passes if no row of df is bad."""
    n = F.coalesce(F.count_if(bad), F.lit(0))
    return df.agg(n.alias("n")).select(F.lit(number).alias("id"), F.lit(name).alias("name"), (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(f" {message}")).alias("message"))


def value_gate(df: DataFrame, number: int, name: str, ok: Column, message: Column) -> DataFrame:
    """A gate on a one-row table."""
    return df.select(F.lit(number).alias("id"), F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed"), message.cast("string").alias("message"))


def missing(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return rows.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def report(gates: list[DataFrame], overrides: list[int] = ()) -> DataFrame:
    """All gates as one table; an override is recorded, the verdict stays."""
    out = reduce(DataFrame.unionByName, gates)
    return out.withColumn("overridden", ~F.col("passed") & F.col("id").isin(list(overrides)) if overrides else F.lit(False))


def require(gates: DataFrame) -> None:
    """Raise if a gate neither passed nor was overridden."""
    bad = gates.where("not passed and not overridden").select("id", "name", "message").collect()  # a row per gate
    if bad:
        raise ValueError("gates failed: " + "; ".join(f"{r['id']} {r['name']}: {r['message']}" for r in bad))


def header_gate(spark: SparkSession, number: int, got: list[str], want: list[str]) -> DataFrame:
    one = spark.range(1)
    return value_gate(one, number, "header", F.lit(got == want), F.lit(",".join(got)))


def ratio_gate(mains: DataFrame, roots: DataFrame, number: int, name: str, share: float = 0.97) -> DataFrame:
    """At least ``share`` of the default codes (code, use) can be billed; those at or
    below a root whose seventh character the coder adds are exempt."""
    exempt = below_roots(mains.where("use <> 1").select("code").distinct(), roots).withColumn("exempt", F.lit(True))
    told = mains.join(exempt, "code", "left").agg(F.count("*").alias("n"), F.count_if((F.col("use") != 1) & F.col("exempt").isNull()).alias("bad"))
    return value_gate(told, number, name, 1 - F.col("bad") / F.greatest(F.col("n"), F.lit(1)) >= share, F.concat_ws(" of ", F.col("bad").cast("string"), F.col("n").cast("string")))


def drift(now: DataFrame, before: DataFrame, share: float = 0.02) -> DataFrame:
    """(source, rows, rows_before, within) for counts per source of two runs."""
    j = now.join(before.withColumnRenamed("n_rows", "rows_before"), "source", "full_outer")
    return j.withColumn("within", F.coalesce(F.abs(F.col("n_rows") - F.col("rows_before")) <= share * F.col("rows_before"), F.lit(False)))


def fingerprint(files: DataFrame, path: str = "path", digest: str = "sha") -> DataFrame:
    """16 hex digits over the sorted path:digest pairs."""
    line = F.concat_ws(":", path, digest)
    return files.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256), 1, 16).alias("fingerprint"))


@dataclass
class Release:
    """What a release is judged by; each field is a table unless said otherwise."""

    headers: DataFrame  # source, got, want
    counts: DataFrame  # source, n_rows, rows_before (null in a first run), least
    codes: DataFrame  # code, zh, en, use
    chapters: DataFrame  # first, last
    orphans_allowed: DataFrame  # code
    canaries: DataFrame  # code, must_contain
    garbled: DataFrame  # code: names known to be garbled
    edges: DataFrame  # old, new (null: no target)
    catastrophic: DataFrame  # code, cat, cat_name
    favourites: DataFrame  # code, once per listing
    terms: DataFrame  # code, text
    mains: DataFrame  # code, use: default codes of main terms
    seventh: DataFrame  # code: roots whose seventh character the coder adds
    sources: DataFrame  # source, version
    files: DataFrame  # path, sha
    fingerprint: str = ""  # what the release says of its files
    terms_before: int | None = None
    least_terms: int = 0
    least_favourites: int = 30


def standard_gates(r: Release) -> list[DataFrame]:
    """The sixteen gates of a release, each one row; none stops the others."""
    known, always = r.codes.select("code").distinct(), F.lit(True)
    moved = F.coalesce(F.abs(F.col("n_rows") - F.col("rows_before")) > 0.02 * F.col("rows_before"), F.lit(False))
    twice = r.codes.groupBy("code").agg(F.count("*").alias("n"))
    tops = r.codes.join(parents(r.codes).where("parent is null").select("code"), "code", "left_semi").where("length(code) > 3")
    stems = known.select(F.substring("code", 1, 3).alias("stem")).distinct()
    inside = stems.join(F.broadcast(r.chapters.select("first", "last").limit(10_000)), F.col("stem").between(F.col("first"), F.col("last")), "left_semi")
    loose = tops.select("code").join(r.orphans_allowed, "code", "left_anti").union(stems.join(inside, "stem", "left_anti"))
    canaries = r.canaries.join(r.codes.select("code", "zh"), "code", "left")
    listed = r.favourites.groupBy("code").agg(F.count("*").alias("n")).join(r.codes.select("code", "use"), "code", "left")
    few = r.favourites.agg(F.count("*").alias("all")).where(F.col("all") < r.least_favourites).select(F.lit("too few").alias("code"), F.lit(2).alias("n"), F.lit(0).alias("use"))
    lost = missing(r.catastrophic.select("code"), "code", known, "code").union(r.catastrophic.where("cat_name is null").select("code"))
    size = r.terms.agg(F.count("*").alias("n"))
    enough = (F.col("n") >= r.least_terms) & (F.lit(True) if r.terms_before is None else F.col("n") >= 0.9 * r.terms_before)
    mark = fingerprint(r.files)
    garbled = r.codes.where(X.is_garbled(F.col("zh"))).select("code").join(r.garbled, "code", "left_anti")
    return [
        gate(r.headers, 1, "headers", ~F.col("got").eqNullSafe(F.col("want"))),
        gate(r.counts, 2, "row counts", moved | (F.col("n_rows") < F.col("least"))),
        gate(twice, 3, "code format", (F.col("n") > 1) | ~(C.is_diagnosis(F.col("code")) | C.is_procedure(F.col("code")))),
        gate(loose, 4, "hierarchy and chapters", always),
        gate(r.codes, 5, "compatibility characters", X.compatibility_count(F.col("zh")) > 0),
        gate(canaries, 6, "canaries", ~F.coalesce(F.col("zh").contains(F.col("must_contain")), F.lit(False))),
        gate(missing(r.edges.where("new is not null").select("new"), "new", known, "code"), 7, "crosswalk targets", always),
        gate(lost, 8, "catastrophic list", always),
        gate(listed.unionByName(few), 9, "favourites", (F.col("n") > 1) | ~F.col("use").eqNullSafe(1)),
        gate(missing(r.terms.select("code"), "code", prefixes(r.codes), "prefix"), 10, "term targets", always),
        value_gate(size, 11, "vocabulary size", enough, F.concat(F.col("n").cast("string"), F.lit(" terms"))),
        ratio_gate(r.mains, r.seventh, 12, "default codes"),
        gate(r.sources, 13, "source versions", F.coalesce(F.trim("version"), F.lit("")) == ""),
        gate(r.files, 14, "file names", ~F.col("path").rlike("^[A-Za-z0-9_./-]+$")),
        value_gate(mark, 15, "fingerprint", F.col("fingerprint") == r.fingerprint, F.col("fingerprint")),
        gate(garbled, 16, "garbled names", always),
    ]
