"""Structured Streaming over events: additions that batch operators do not need.

Timestamps without zone are cast first, because watermarks need an instant.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

STATE = "items array<string>, at array<timestamp>"
RECENT = "user_id long, items string"


def read_events(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A file stream over the Parquet table folder/name, one file or many."""
    path = f"{folder}/{name}"
    schema = schema or spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    many = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    r = spark.readStream.schema(schema)
    e = r.parquet(path) if many else r.option("pathGlobFilter", name).parquet(folder)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per tumbling window and type, late rows counted up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def recent_items(events: DataFrame, most: int = 12) -> DataFrame:
    """Each user's distinct event types, newest first, kept as bounded state."""

    def update(key, frames, state):
        items, at = state.get if state.exists else ([], [])
        seen = dict(zip(items, at))
        for f in frames:
            for e, t in zip(f["event_type"], f["ts"]):
                if e not in seen or t > pd.Timestamp(seen[e]):
                    seen[e] = t
        best = sorted(seen.items(), key=lambda x: (-pd.Timestamp(x[1]).value, x[0]))[:most]
        state.update(([k for k, _ in best], [pd.Timestamp(v).to_pydatetime() for _, v in best]))
        yield pd.DataFrame([(key[0], ",".join(k for k, _ in best))], columns=["user_id", "items"])

    return events.groupBy("user_id").applyInPandasWithState(update, RECENT, STATE, "update", GroupStateTimeout.NoTimeout)


def new_only(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def enrich(events: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """A stream joined with a static table; never by broadcast, since by the size of its
    files Spark takes a table for small that fills the driver's memory."""
    return events.join(static.hint("merge"), on, "left")


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and stop; the result as a table. Rows that are
    only added go to files beside the checkpoint, since there are as many as events;
    the other modes keep a row per group in the driver's memory."""
    spark, out = df.sparkSession, f"{checkpoint}-rows"
    w = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.format("parquet").start(out) if mode == "append" else w.format("memory").start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(df.schema).parquet(out) if mode == "append" else spark.table(name)
