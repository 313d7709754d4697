"""Bounded per-user state and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .hierarchy import top_rows


def most_recent(events: DataFrame, user: str, item: str, at: str, most: int) -> DataFrame:
    """Each user's distinct items, newest first, at most ``most``."""
    last = events.groupBy(user, item).agg(F.max(at).alias("last"))
    return top_rows(last, [user], [F.desc("last"), F.asc(item)], most)


def changed(now: DataFrame, before: DataFrame, key: str = "source", digest: str = "sha") -> DataFrame:
    """Sources whose digest is new."""
    return now.join(before.select(key, digest).distinct(), [key, digest], "left_anti")


def newly_seen(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.select(before.columns).exceptAll(before).distinct()


def encode_notes(rows: DataFrame, note: str, order: str) -> DataFrame:
    """rows with a dictionary number per distinct note, by first appearance. Notes are
    dealt by ranges of their first appearance; a range's numbers begin where the ranges
    before it end, so no task sees all of them."""
    firsts = rows.groupBy(note).agg(F.min(order).alias("_first"))
    spread = firsts.repartitionByRange("_first").sortWithinPartitions("_first").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)).checkpoint()
    sizes = spread.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()  # a row per partition
    start, before = [], 0
    for r in sizes:
        start += [F.lit(r["_p"]), F.lit(before)]
        before += r["n"]
    base = F.create_map(*start)[F.col("_p")] if start else F.lit(0)
    ids = spread.select(note, (F.col("_i") + base).cast("int").alias("note_id"))
    return rows.join(ids, note, "left")
