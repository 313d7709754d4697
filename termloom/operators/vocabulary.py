"""Building and curating the term vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import codes as C, text as X


def dedup_terms(terms: DataFrame, key: str = "key") -> DataFrame:
    """One row per (key, code): the least source, the first text, the first row's
    incomplete bit, and held out only if every source holds it out."""
    first = lambda c: F.min_by(c, "ord")
    return terms.groupBy(key, "code").agg(
        F.min("src_id").alias("src_id"),
        first("text").alias("text"),
        first(F.col("flags").bitwiseAND(1)).alias("incomplete"),
        F.bit_and(F.shiftright(F.col("flags").bitwiseAND(2), 1)).alias("held_out"),
    )


def override(terms: DataFrame, curated: DataFrame, keep_src: int) -> DataFrame:
    """Approved terms replace rows of the same key that point elsewhere, unless those
    are curated themselves."""
    approved = curated.where("approved")
    names = approved.select("key", F.col("code").alias("keep"))
    kept_codes = names.groupBy("key").agg(F.collect_set("keep").alias("keep"))
    rest = terms.join(kept_codes, "key", "left").where(F.col("keep").isNull() | (F.col("src_id") >= keep_src) | F.array_contains("keep", F.col("code"))).drop("keep")
    return rest.unionByName(approved.drop("approved"), allowMissingColumns=True)


def resolve(raw: DataFrame, codes: DataFrame, code: str = "raw") -> DataFrame:
    """Raw codes to known ones: as written, else without dot and trailing marks."""
    exact = codes.select(F.col("code").alias("by_code")).distinct()
    bare = codes.groupBy(C.undotted(F.col("code")).alias("bare")).agg(F.min("code").alias("by_bare"))
    out = raw.join(exact, F.col(code) == F.col("by_code"), "left").join(bare, C.undotted(F.col(code)) == F.col("bare"), "left")
    return out.withColumn("code", F.coalesce("by_code", "by_bare")).withColumn("incomplete", F.col(code).endswith("-")).drop("by_code", "by_bare", "bare")


def bridge(left: DataFrame, links: DataFrame, right: DataFrame, on_left: str, on_right: str) -> DataFrame:
    """Distinct pairs of left and right rows that some link ties."""
    return left.join(links, on_left).join(right, on_right).distinct()


def drop_superseded(rows: DataFrame, better: DataFrame, key: str) -> DataFrame:
    return rows.join(better.select(key).distinct(), key, "left_anti")


def glossary(terms: DataFrame, names: DataFrame) -> DataFrame:
    """English glossary to codes by the title's core (two computed-key joins)."""
    a = terms.withColumn("core", X.core_title(F.col("en")))
    b = names.select("code", X.core_title(F.col("en")).alias("core"))
    return a.join(b, "core").select("code", "zh", "core")


def glossary_index(index: DataFrame, names: DataFrame) -> DataFrame:
    """Main terms (term, code) of an index to a glossary's Chinese (en, zh), by the name."""
    a = index.where("code is not null").select("code", F.lower(F.trim("term")).alias("core"))
    b = names.select(F.lower(F.trim("en")).alias("core"), "zh")
    return a.join(b, "core").select("code", "zh", "core")


def see_targets(see: DataFrame, paths: DataFrame) -> DataFrame:
    """See-references (src, target path) to codes: the exact path, else one level up,
    else nothing; a path of several codes gives its common prefix."""
    clean = F.trim(F.regexp_replace(F.lower("target"), r"^see( also)?\s+", ""))
    asked = see.withColumn("at", clean).withColumn("up", F.regexp_replace(clean, r",[^,]*$", ""))
    known = paths.groupBy("path").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).withColumn("code", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.regexp_replace(C.common_prefix(F.col("lo"), F.col("hi")), r"\.$", "")))
    exact = known.select(F.col("path").alias("at"), F.col("code").alias("exact"))
    above = known.select(F.col("path").alias("up"), F.col("code").alias("above"))
    out = asked.join(exact, "at", "left").join(above, "up", "left")
    return out.select("src", "target", F.coalesce("exact", "above").alias("code"), F.when(F.col("exact").isNotNull(), "node").when(F.col("above").isNotNull(), "ancestor").otherwise("none").alias("how"))


def neoplasm_terms(table: DataFrame, columns: list[str]) -> DataFrame:
    """A site table (site, one code column per behaviour) to terms, a row per cell."""
    cells = ", ".join(f"'{c.replace('_', ' ')}', `{c}`" for c in columns)
    long = table.selectExpr("site", f"stack({len(columns)}, {cells}) as (kind, code)").where("code is not null and code <> ''")
    return long.select(F.concat(F.lit("neoplasm "), F.lower("site"), F.lit(" "), "kind").alias("text"), "code")


def merge_sources(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def source_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("src_id").agg(F.count("*").alias("n"))


def code_report(raw: DataFrame, known_status: list[str]) -> DataFrame:
    """Counters of a raw code table: rows, kept, billable, bad, repeated, odd status."""
    first = F.row_number().over(Window.partitionBy("code").orderBy("ord")) == 1
    r = raw.withColumn("ok", C.is_diagnosis(F.col("code"))).withColumn("first", first)
    return r.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("ok") & F.col("first")).alias("kept"),
        F.count_if(F.col("ok") & F.col("first") & (F.col("use") == 1)).alias("billable"),
        F.count_if(~F.col("ok")).alias("bad"),
        F.count_if(F.col("ok") & ~F.col("first")).alias("repeated"),
        F.count_if(~F.col("status").isin(known_status)).alias("odd_status"),
    )
