"""Hilbert-curve sharding.

Metadata (language, source, size) is quantised to a grid, rows are sorted by the
index of their cell on a Hilbert curve and the order is cut into runs of equal
row counts (law ``rows``: counts differ by one at most). Neighbours on the curve
are neighbours in all dimensions, so a file's ranges of the quantised columns
are narrow in each and a reader can prune files by any of them.

Copies (equal texts) form a group: they take the group's least language and
source, and the text's hash follows the index in the sort, so a group stands in
one run of the order and spans as few shards as its size allows.

One pass reads the texts and writes narrow digests; all later work is on those.
Global positions come from range partitions, sorted locally, plus the counts of
earlier partitions: no task holds more than its range, whatever the groups.
Null text: size 16, checksum 0; null language or source: a cell of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from .common import prepare, read, table

BITS = 6


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (n x d integers below 2**bits);
    Skilling's transpose form, worked on whole columns."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.pandas_udf(LongType())
def _hilbert(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c], axis=1), BITS))


def positions(spark: SparkSession, df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with ``position``, from 0, in the global order, and the number of rows."""
    spread = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
        .checkpoint()
    )
    counts = sorted((r["_p"], r["n"]) for r in spread.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row per partition
    rows, n = [], 0
    for p, k in counts:
        rows.append((p, n))
        n += k
    if not rows:
        return spread.withColumn("position", F.lit(0).cast("long")).drop("_p", "_i"), 0
    base = spark.createDataFrame(rows, "_p int, _base long")
    return spread.join(F.broadcast(base), "_p").withColumn("position", F.col("_i") + F.col("_base")).drop("_p", "_i", "_base"), n


def shard(spark: SparkSession, docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs(doc_id, text, lang, source) dealt to shards by equal row counts."""
    prepare(spark)
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    side = 1 << BITS
    digests = table(
        spark,
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(raw) + 16).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(raw).alias("text_hash"),
            F.pmod(F.xxhash64(F.coalesce("lang", F.lit("\0"))), F.lit(side)).alias("lang_cell"),
            F.pmod(F.xxhash64(F.coalesce("source", F.lit("\0"))), F.lit(side)).alias("source_cell"),
        ),
        "digests",
    )
    group = ["text_hash", "text_crc32", "size"]
    shared = digests.groupBy(*group).agg(F.min("lang_cell").alias("lang_cell"), F.min("source_cell").alias("source_cell"))
    placed = digests.drop("lang_cell", "source_cell").join(shared, group)
    placed = placed.withColumn("size_cell", F.least(F.lit(side - 1), F.floor(F.log2("size") * 2)).cast("long"))
    placed = placed.withColumn("hilbert", _hilbert("source_cell", "lang_cell", "size_cell"))
    ordered, n = positions(spark, placed, ["hilbert", "text_hash", "doc_id"])
    k = F.expr(f"position * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return (
        ordered.withColumn("shard", k.cast("int"))
        .withColumn("slot", (F.col("position") - first).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "source_cell", "lang_cell", "size_cell")
    )


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, read(spark, sf_dir, "documents"), 40)
