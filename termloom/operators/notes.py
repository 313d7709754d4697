"""Coding rules attached to codes: inheritance, reminders, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import codes as C
from .hierarchy import ancestors


def merged(codes: DataFrame, notes: DataFrame) -> DataFrame:
    """(code, kind, from_code, dist, pos, text, specs): notes of a code and of every
    code above it, nearest first. notes has (code, kind, pos, text)."""
    up = ancestors(codes)
    n = notes.select(F.col("code").alias("anc"), "kind", "pos", "text")
    return up.join(n, "anc").select("code", "kind", F.col("anc").alias("from_code"), "dist", "pos", "text", C.specs(F.col("text")).alias("specs"))


def reminders(notes: DataFrame) -> DataFrame:
    """(code, kind, seq, text, specs): an opening line that ends in a colon takes the
    lines of the same source after it; an opening without lines is dropped."""
    n = notes.where(F.col("kind").isin("codeFirst", "useAdd", "codeAlso"))
    lead = (F.size("specs") == 0) & F.col("text").rlike(r":\s*$")
    # a group begins at each opening; after it, lines of its source belong to it
    w = Window.partitionBy("code", "kind").orderBy("dist", "pos")
    marked = n.withColumn("lead", lead).withColumn("opening", F.last(F.when(F.col("lead"), F.struct("dist", "pos", "from_code")), ignorenulls=True).over(w))
    inside = F.col("opening").isNotNull() & (F.col("opening.from_code") == F.col("from_code"))
    keyed = marked.withColumn("g", F.when(F.col("lead") | inside, F.col("opening")).otherwise(F.struct("dist", "pos", "from_code")))
    g = keyed.groupBy("code", "kind", "g").agg(
        F.max(F.when(F.col("lead"), F.regexp_replace("text", r":\s*$", ""))).alias("head"),
        F.array_sort(F.collect_list(F.when(~F.col("lead"), F.struct("dist", "pos", "text", "specs")))).alias("items"),
    )
    body = F.array_join(F.transform("items", lambda x: x["text"]), "／")
    out = g.where(F.size("items") > 0)
    return out.select(
        "code", "kind", F.col("g.dist").alias("dist"), F.col("g.pos").alias("pos"), F.when(F.col("head").isNotNull(), F.concat("head", F.lit("："), body)).otherwise(body).alias("text"), F.flatten(F.transform("items", lambda x: x["specs"])).alias("specs")
    )


def satisfied(rem: DataFrame, picked: DataFrame) -> DataFrame:
    """Reminders, each with whether a code picked in the same batch meets it."""
    one = rem.select("batch", "code", "kind", "dist", "pos", F.explode("specs").alias("spec"))
    hit = one.join(picked.select("batch", F.col("code").alias("other")), "batch").where(C.matches(F.col("other"), F.col("spec")))
    keys = ["batch", "code", "kind", "dist", "pos"]
    met = hit.select(*keys).distinct().withColumn("met", F.lit(True))
    return rem.join(met, keys, "left").withColumn("met", F.coalesce("met", F.lit(False)))


def conflicts(picked: DataFrame, notes: DataFrame) -> DataFrame:
    """(batch, a, b, text): pairs picked together although one excludes the other; the
    first matching note, of the earlier code if both have one."""
    excl = notes.where("kind = 'excl1'").select("code", "dist", "pos", "text", F.explode("specs").alias("spec"))
    p = picked.select("batch", "pos", "code")
    owner = p.select("batch", F.col("pos").alias("own_pos"), "code").join(excl, "code")
    pairs = owner.join(p.select("batch", F.col("pos").alias("other_pos"), F.col("code").alias("other")), "batch")
    hit = pairs.where((F.col("own_pos") != F.col("other_pos")) & C.matches(F.col("other"), F.col("spec")))
    first = F.col("own_pos") < F.col("other_pos")
    h = hit.select(
        "batch",
        F.least("own_pos", "other_pos").alias("i"),
        F.greatest("own_pos", "other_pos").alias("j"),
        F.when(first, F.col("code")).otherwise(F.col("other")).alias("a"),
        F.when(first, F.col("other")).otherwise(F.col("code")).alias("b"),
        F.struct(F.when(first, 0).otherwise(1).alias("o"), "dist", "pos").alias("order"),
        "text",
    )
    return h.groupBy("batch", "i", "j", "a", "b").agg(F.min_by("text", "order").alias("text")).drop("i", "j")
