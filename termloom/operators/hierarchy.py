"""Operators on the code tree: parents, descendants, ranges, common ancestors.

A prefix join is never a bare ``startswith``: the first three characters, which
every code has, are an equi-key, and the prefix test is the residual condition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import codes as C
from ..session import stage

RANGES = 10_000  # ranges that are broadcast; each is two short strings and a name
PAIRS = 1 << 22  # pairs of a join that one task is to make
TASKS = 2_048  # tasks from which on each makes more, 16 times that at most
RUN = 256  # right rows that a left row is joined to at a time


def prefix_join(left: DataFrame, prefix: str, right: DataFrame, code: str, how: str = "inner") -> DataFrame:
    """Rows of left with all rows of right whose code begins with left's prefix
    (three characters at least); an equi-join on the three-character stem."""
    a = left.withColumn("_stem", F.substring(prefix, 1, 3))
    b = right.withColumn("_stem_r", F.substring(code, 1, 3))
    on = (F.col("_stem") == F.col("_stem_r")) & F.col(code).startswith(F.col(prefix)) & (F.length(prefix) >= 3)
    return a.join(b, on, how).drop("_stem", "_stem_r")


def ancestors(codes: DataFrame, code: str = "code") -> DataFrame:
    """(code, anc, dist): each code with its lineage, itself first at 0."""
    return codes.select(F.col(code).alias("_c")).select(F.col("_c").alias("code"), F.posexplode(C.lineage(F.col("_c"))).alias("dist", "anc"))


def parents(codes: DataFrame) -> DataFrame:
    """(code, parent): the longest proper prefix that is itself a code."""
    up = ancestors(codes).where("dist > 0")
    known = codes.select(F.col("code").alias("anc")).distinct()
    nearest = up.join(known, "anc", "left_semi").groupBy("code").agg(F.max_by("anc", F.length("anc")).alias("parent"))
    return codes.select("code").join(nearest, "code", "left")


def headers(codes: DataFrame) -> DataFrame:
    """Codes below which there are others."""
    below = ancestors(codes).where("dist > 0").select(F.col("anc").alias("code")).distinct()
    return codes.join(below, "code", "left_semi")


def descendants(codes: DataFrame, roots: DataFrame, root: str = "root") -> DataFrame:
    """(root, code): codes below each root, itself excluded."""
    return prefix_join(roots.select(root), root, codes.select("code"), "code").where(F.col("code") != F.col(root))


def by_range(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Codes in each (first, last), descendants of last included. Ranges are few
    (a query's, or the chapters'): up to ``RANGES`` of them are the broadcast side. More
    are spelled out by first character, which makes an equi-join with a residual test."""
    within = C.in_range(F.col("code"), F.col("first"), F.col("last"))
    if ranges.limit(RANGES + 1).count() <= RANGES:
        return codes.join(F.broadcast(ranges), within)
    return codes.withColumn("_h", F.ascii("code")).join(_by_head(ranges), "_h").where(within).drop("_h")


def range_join(codes: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each code with the chapter whose three-character range holds its stem; up to
    ``RANGES`` chapters are broadcast."""
    stem = F.substring("code", 1, 3)
    within = (stem >= F.col("first")) & (stem <= F.col("last"))
    if chapters.limit(RANGES + 1).count() <= RANGES:
        return codes.join(F.broadcast(chapters), within, "left")
    stems = codes.select(stem.alias("_stem")).distinct()
    found = stems.withColumn("_h", F.ascii("_stem")).join(_by_head(chapters), "_h").where((F.col("_stem") >= F.col("first")) & (F.col("_stem") <= F.col("last"))).drop("_h")
    return codes.withColumn("_stem", stem).join(found, "_stem", "left").drop("_stem")


def _by_head(ranges: DataFrame) -> DataFrame:
    """Ranges once for each first character they reach."""
    heads = F.sequence(F.ascii("first"), F.greatest(F.ascii("first"), F.ascii("last")))
    return ranges.withColumn("_h", F.explode(heads))


def cluster(df: DataFrame, code: str = "code", files: int | None = None) -> DataFrame:
    """Rows in code order over range partitions, so that a written table's files and
    row groups hold narrow code ranges and a lookup reads few of them."""
    spread = df.repartitionByRange(files, code) if files else df.repartitionByRange(code)
    return spread.sortWithinPartitions(code)


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """(key, n) in order of size, the largest first, ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key))


def prefixes(codes: DataFrame, widths: tuple[int, ...] = (3, 4), code: str = "code") -> DataFrame:
    """The set of codes and of their first characters, as many as widths say."""
    every = F.array(F.col(code), *[F.substring(code, 1, w) for w in widths])
    return codes.select(F.explode(every).alias("prefix")).distinct()


def below_roots(codes: DataFrame, roots: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose code is one of the roots or below one; their first three characters agree."""
    r = roots.select(F.col("code").alias("_root")).distinct()
    chain = codes.select(F.col(code).alias("_c")).distinct().withColumn("_root", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.length("_c"), F.lit(3))), lambda i: F.substring(F.col("_c"), F.lit(1), i))))
    known = chain.join(r, "_root", "left_semi").select(F.col("_c").alias(code)).distinct()
    return codes.join(known, code, "left_semi")


def lca(members: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """(key, lca): the deepest existing code over all of a group's codes. The common
    prefix of a set is that of its least and greatest member."""
    ends = members.groupBy(key).agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    common = ends.withColumn("common", F.regexp_replace(C.common_prefix(F.col("lo"), F.col("hi")), r"\.$", "")).where(F.length("common") >= 3)
    chain = common.select(key, F.explode(C.lineage(F.col("common"))).alias("code"))
    found = chain.join(codes.select("code").distinct(), "code", "left_semi").groupBy(key).agg(F.max_by("code", F.length("code")).alias("lca"))
    return ends.select(key).join(found, key, "left")


def default_child(codes: DataFrame) -> DataFrame:
    """(header, child): ``header.9`` (or ``header9``) if it can be billed, else the
    shortest direct child whose title says unspecified, the first in file order."""
    kids = codes.join(parents(codes).where("parent is not null"), "code").select(F.col("parent").alias("header"), "code", "en", "use", "ord")
    nine = F.when(F.length("header") == 3, F.concat("header", F.lit(".9"))).otherwise(F.concat("header", F.lit("9")))
    rated = kids.withColumn("rate", F.when((F.col("code") == nine) & (F.col("use") == 1), 0).when(F.lower("en").contains("unspecified"), 1)).where("rate is not null")
    return rated.groupBy("header").agg(F.min_by("code", F.struct("rate", F.length("code"), "ord")).alias("child"))


def path_codes(paths: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """(prefix, codes): all codes at or below every prefix of a heading path."""
    steps = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(F.col(path), F.lit(1), i), " > "))
    return paths.select(F.explode(steps).alias("prefix"), code).withColumnRenamed(code, "code").groupBy("prefix").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def siblings(codes: DataFrame, width: int = 4, most: int = 80) -> DataFrame:
    """(code, sibling): codes that share the first ``width`` characters, the first
    ``most``. Only a stem's first ``most`` + 1 codes can be anyone's, so a stem of any
    size meets that many and not itself."""
    a = codes.select("code", F.substring("code", 1, width).alias("stem"))
    few = top_rows(a.distinct(), ["stem"], [F.asc("code")], most + 1, "n").select("stem", F.col("code").alias("sibling"), "n")
    mine = a.distinct().join(few, "stem").where("code <> sibling")
    own = few.select(F.col("sibling").alias("code"), F.col("n").alias("own"))
    return mine.join(own, "code", "left").where((F.col("n") <= most) | F.col("own").isNotNull() & (F.col("own") <= most)).select("code", "sibling")


def first_rows(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in file order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pairs_by_key(left: DataFrame, right: DataFrame, key: str, pairs: int = PAIRS) -> DataFrame:
    """The inner join on a key that few values share out, so that there are many more pairs
    than rows. Tasks are dealt by the pairs they make and not by the rows they read: a key's
    rows go to blocks, and each left block meets each right one in a group of its own. Blocks
    are sent as arrays, so that a row is sent once for each block of the other side. All left
    rows of a block run through one slice of the right block, then through the next: what
    is held stays small, and the written columns repeat within a page of Parquet."""
    spark = left.sparkSession
    left, right = stage(spark, left, "pairs-left"), stage(spark, right, "pairs-right")
    n = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    n = stage(spark, n, "pair-groups")
    made = n.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    pairs = max(pairs, min(16 * pairs, made // TASKS))
    side = math.isqrt(pairs)
    slices = math.ceil(side / RUN)
    n = n.select(key, F.ceil(F.col("_l") / side).alias("_nl"), F.ceil(F.col("_r") / side).alias("_nr"))

    def blocks(df: DataFrame, own: str) -> DataFrame:
        # equal rows need not share a block, so it is their place in the staged files that decides
        rows = df.withColumn("_b", F.xxhash64(F.monotonically_increasing_id())).join(n, key)
        rows = rows.groupBy(key, F.pmod("_b", own).alias("_b"), "_nl", "_nr")
        return rows.agg(F.collect_list(F.struct(*[c for c in df.columns if c != key])).alias("_rows"))

    def dealt(df: DataFrame, other: str, group: str, rows: Column) -> DataFrame:
        df = df.select("*", rows.alias("_sent")).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return df.select(key, F.expr(group).alias("_g"), "_sent").repartition(1 + made // pairs, key, "_g")

    n_rows = 8 * F.ceil(F.size("_rows") / (8 * slices)).cast("int")
    sliced = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.slice("_rows", i * n_rows + 1, n_rows))
    a = dealt(blocks(left, "_nl"), "_nr", "_b * _nr + _o", F.col("_rows"))
    b = dealt(blocks(right, "_nr"), "_nl", "_o * _nr + _b", sliced).withColumnRenamed("_sent", "_slices")
    a = a.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(key, "_g", "_s", F.explode("_sent").alias("_x"))
    # the merge join sorts left rows: without that, all pairs of two blocks are held at once
    both = a.join(b.hint("merge"), [key, "_g"]).select(key, "_x.*", F.explode(F.get("_slices", "_s")).alias("_y"))
    return both.select(key, *[c for c in left.columns if c != key], "_y.*")


def top_rows(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)
