"""Sinks: sharded output, gated promotion, run snapshots, bundles and lists."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StringType

from ..functions.codes import shard_key
from ..operators.gates import fingerprint, require


def write_sharded(df: DataFrame, path: str, code: str = "code", files: int | None = None) -> None:
    """Parquet partitioned by the code's first character, sorted by code, so readers
    prune by shard and by row-group range. Shards are dealt by (shard, hash of code):
    one shard with most of the rows is written by many tasks."""
    d = df.withColumn("shard", shard_key(F.col(code)))
    d = d.repartition(files, "shard", F.pmod(F.xxhash64(code), F.lit(16))) if files else d.repartition("shard", F.pmod(F.xxhash64(code), F.lit(16)))
    d.sortWithinPartitions("shard", code).write.mode("overwrite").partitionBy("shard").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def promote(spark: SparkSession, staging: str, live: str, gates: DataFrame) -> None:
    """Swap a staged directory into place if every gate passed or was overridden; the
    old one is kept beside it until the swap is done."""
    require(gates)
    fs, new = _fs(spark, staging)
    _, cur = _fs(spark, live)
    _, old = _fs(spark, live.rstrip("/") + ".old")
    fs.delete(old, True)
    if fs.exists(cur) and not fs.rename(cur, old):
        raise OSError(f"could not move {live}")
    if not fs.rename(new, cur):
        fs.rename(old, cur)
        raise OSError(f"could not move {staging}")
    fs.delete(old, True)


def snapshot(spark: SparkSession, path: str, run_at: str, counts: DataFrame, files: DataFrame, gates: DataFrame) -> None:
    """Append a run: rows per source, the data's fingerprint, the gates."""
    rows = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n_rows")))).alias("n_rows"))
    told = gates.agg(F.array_sort(F.collect_list(F.struct("id", "name", "passed", "message", "overridden"))).alias("gates"))
    one = F.lit(1)
    run = rows.withColumn("k", one).join(fingerprint(files).withColumn("k", one), "k").join(told.withColumn("k", one), "k").drop("k")
    run.withColumn("run_at", F.lit(run_at)).write.mode("append").parquet(path)


@F.pandas_udf(BinaryType())
def gzipped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: gzip.compress(x.encode(), mtime=0), na_action="ignore")


def bundle(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, payload): documents gzipped and base64-coded for a single-file bundle."""
    return docs.select(path, F.base64(gzipped(content)).alias("payload"))


@F.pandas_udf(StringType())
def gunzipped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: gzip.decompress(x).decode(), na_action="ignore")


def unbundle(packed: DataFrame, path: str = "path") -> DataFrame:
    """(path, content) of a bundle."""
    return packed.select(path, gunzipped(F.unbase64("payload")).alias("content"))


def bundle_report(live: DataFrame, packed: DataFrame, manifest: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row: does the bundle hold what is live? manifest has one row (fingerprint,
    files). Compared are the fingerprints of both, the manifest's, and the file counts."""
    mark = lambda df: fingerprint(df.select(path, F.sha1(content).alias("sha")), path)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = F.lit(1)
    j = manifest.withColumn("k", one)
    for part in (mark(live).withColumnRenamed("fingerprint", "of_live"), mark(unbundle(packed, path)).withColumnRenamed("fingerprint", "of_bundle"), count(live, "n_live"), count(packed, "n_bundle")):
        j = j.join(part.withColumn("k", one), "k")
    same = (F.col("of_live") == F.col("of_bundle")) & (F.col("fingerprint") == F.col("of_live"))
    return j.select("of_live", "of_bundle", same.alias("same_data"), ((F.col("n_live") == F.col("n_bundle")) & (F.col("files") == F.col("n_live"))).alias("same_files"))


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file in any store that Spark writes to."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def unsafe_tokens(df: DataFrame, content: str = "content") -> DataFrame:
    """Documents that would end or open a script inside a bundle."""
    return df.where(F.lower(content).rlike(r"</script|<!--|<script"))


def tsv(df: DataFrame, columns: list[str]) -> DataFrame:
    safe = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in columns]
    return df.select(F.concat_ws("\t", *safe).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


LIST_MARK = "CODELIST1:"  # heads an exported list of codes


def export_list(codes: DataFrame, order: str) -> DataFrame:
    got = F.transform(F.array_sort(F.collect_list(F.struct(order, "code"))), lambda x: x["code"])
    return codes.agg(F.concat(F.lit(LIST_MARK), F.array_join(got, ",")).alias("value"))


def import_list(lists: DataFrame, codes: DataFrame, value: str = "value") -> DataFrame:
    """Known codes of exported lists, each once."""
    names = F.transform(F.split(F.regexp_replace(value, f"^{LIST_MARK}", ""), ","), lambda c: F.trim(c))
    return lists.where(F.col(value).startswith(LIST_MARK)).select(F.explode(names).alias("code")).distinct().join(codes.select("code"), "code", "left_semi")
