"""Retrieval quality: ranks of gold answers, Hit@k, MRR, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import rules as R


def gold_ranks(items: DataFrame, results: DataFrame) -> DataFrame:
    """items (qid, gold) with the rank of the first result that hits; null if none."""
    hits = results.join(items.select("qid", "gold"), "qid").where(R.gold_hit(F.col("code"), F.col("gold")))
    first = hits.groupBy("qid").agg(F.min("rank").alias("hit_rank"))
    n = results.groupBy("qid").agg(F.count("*").alias("n_results"))
    return items.join(first, "qid", "left").join(n, "qid", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Per cent of Hit@1, 5, 10, MRR x 100 and queries without result."""
    pct = lambda c: F.round(F.avg(F.when(c, 100.0).otherwise(0.0)), 4)
    r = F.col("hit_rank")
    at = lambda k: F.coalesce(r <= k, F.lit(False))
    return ranks.groupBy(*by).agg(
        F.count("*").alias("n"),
        pct(at(1)).alias("hit1"),
        pct(at(5)).alias("hit5"),
        pct(at(10)).alias("hit10"),
        F.round(F.avg(F.coalesce(F.lit(100.0) / r, F.lit(0.0))), 4).alias("mrr"),
        pct(F.col("n_results") == 0).alias("zero"),
    )


def nearest_rank(df: DataFrame, value: str, by: list[str], share: float) -> DataFrame:
    """Exact percentile: the value at position floor(n * share) of the sorted values.
    Equal values are counted first; then values are dealt by ranges, ranges before give
    their counts, and only the range that holds the position is looked into."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    spread = n.repartitionByRange(*by, value).sortWithinPartitions(*by, value).withColumn("_p", F.spark_partition_id()).checkpoint()
    per = spread.groupBy(*by, "_p").agg(F.sum("_n").alias("_m"))  # groups times partitions
    w = Window.partitionBy(*by)
    upto = F.sum("_m").over(w.orderBy("_p"))
    target = F.least(F.floor(F.sum("_m").over(w) * share), F.sum("_m").over(w) - 1)
    at = per.withColumn("_before", upto - F.col("_m")).withColumn("_at", target).where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_m")))
    inside = spread.join(at.drop("_m"), [*by, "_p"])
    run = F.col("_before") + F.sum("_n").over(w.orderBy(value))
    return inside.withColumn("_run", run).where(F.col("_run") > F.col("_at")).groupBy(*by).agg(F.min(value).alias("percentile"))


def regressions(now: DataFrame, before: DataFrame, by: str, most: float = 1.0) -> DataFrame:
    """Sets whose hit1, hit5 or mrr sank by more than ``most`` points."""
    names = ["hit1", "hit5", "mrr"]
    j = now.join(before.select(by, *(F.col(c).alias(f"{c}_before") for c in names)), by)
    worse = F.lit(False)
    for c in names:
        worse = worse | (F.col(f"{c}_before") - F.col(c) > most)
    return j.where(worse).select(by, *names, *(f"{c}_before" for c in names))


def newly_failing(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.where("hit_rank is null").select("qid").join(before.where("hit_rank is null").select("qid"), "qid", "left_anti")


def shared_gold(items: DataFrame) -> DataFrame:
    """All answers of items whose texts have one phrase key."""
    return items.groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("gold"))
