"""Facets over result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules as R


def with_facets(items: DataFrame, en: str = "en", use: str = "use") -> DataFrame:
    f = R.facets(F.col(en), F.col(use))
    return items.withColumns({f"f_{k}": c for k, c in f.items()})


def facet_counts(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, facet, value, n) for facets that divide a result: two values or more, or
    one value that some rows lack."""
    names = ["use", "lat", "enc", "acu", "cmp", "fx", "dsp"]
    pairs = ", ".join(f"'{n}', f_{n}" for n in names)
    long = with_facets(items).selectExpr(*by, f"stack({len(names)}, {pairs}) as (facet, value)")
    # each (group, facet) has the group's rows; a second, small aggregate finds the totals
    n = long.groupBy(*by, "facet", "value").agg(F.count("*").alias("n"))
    totals = n.groupBy(*by, "facet").agg(F.sum("n").alias("rows"), F.count("value").alias("kinds"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("most"))
    keep = totals.where("kinds >= 2 or (kinds = 1 and most < rows)").select(*by, "facet")
    return n.where("value is not null").join(keep, [*by, "facet"], "left_semi")


def apply_facets(items: DataFrame, chosen: dict[str, str]) -> DataFrame:
    out = with_facets(items)
    for k, v in chosen.items():
        if v:
            out = out.where(F.col(f"f_{k}") == v)
    return out


def quick_pick(items: DataFrame, by: str) -> DataFrame:
    """Groups worth a picker: more than 8 billable rows and a facet of two values."""
    billable = items.where("use = 1")
    large = billable.groupBy(by).agg(F.count("*").alias("n")).where("n > 8")
    divided = facet_counts(billable, [by]).where("facet <> 'use'").groupBy(by, "facet").agg(F.count("*").alias("k")).where("k >= 2").select(by).distinct()
    return large.join(divided, by, "left_semi")
