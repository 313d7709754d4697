"""Version-to-version code mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NO_TARGET = ["", "NoDx", "NoPCS"]  # fixed values: marks of a code without target


def edges(raw: DataFrame) -> DataFrame:
    """(old, new, st_old, st_new) without identity rows that carry no status; a code
    without target keeps one row whose new is null."""
    new = F.when(~F.col("new").isin(NO_TARGET), F.col("new"))
    e = raw.select("old", new.alias("new"), "st_old", "st_new").distinct()
    plain = (F.col("old") == F.col("new")) & (F.coalesce("st_old", F.lit("")) == "") & (F.coalesce("st_new", F.lit("")) == "")
    return e.where(F.col("new").isNull() | ~plain)


def reverse(e: DataFrame) -> DataFrame:
    """(new, olds): the sorted old codes of each target."""
    return e.where("new is not null").groupBy("new").agg(F.array_sort(F.collect_set("old")).alias("olds"))


def old_names(raw: DataFrame, code: str, name: str) -> DataFrame:
    return raw.groupBy(code).agg(F.array_sort(F.collect_set(name)).alias("names"))


def lookup(asked: DataFrame, codes: DataFrame, e: DataFrame) -> DataFrame:
    """Each asked code: itself if current, else its targets, else deleted or unknown."""
    now = codes.select("code").distinct().withColumn("current", F.lit(True))
    targets = e.groupBy("old").agg(F.array_sort(F.collect_set("new")).alias("targets"))
    j = asked.join(now, "code", "left").join(targets, F.col("code") == F.col("old"), "left")
    how = F.when(F.col("current"), "current").when(F.size("targets") > 0, "mapped").when(F.col("targets").isNotNull(), "deleted").otherwise("unknown")
    return j.select("code", how.alias("how"), F.when(F.col("current"), F.array("code")).otherwise(F.coalesce("targets", F.array().cast("array<string>"))).alias("targets"))
