"""Tables that several queries share, for Spark and as SQL text for the oracle."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import BRITISH, STOP_WORDS
from ..operators.hierarchy import headers
from ..session import ship


def registry(queries: dict, oracles: dict[str, str]):
    """A decorator that registers a query (spark, sf_dir), with its oracle if it has one."""

    def query(sql: str | None = None):
        def add(f):
            @functools.wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(ship(spark), sf_dir)

            queries[f.__name__] = run
            if sql:
                oracles[f.__name__] = sql
            return run

        return add

    return query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, code, name, kind): a code for each part, three levels deep at most."""
    r = "p_partkey div 208"
    code = f"concat(chr(65 + p_partkey % 26), lpad(cast((p_partkey div 26) % 8 as string), 2, '0'), case when {r} = 0 then '' else concat('.', {r}) end)"
    return read(spark, sf_dir, "part").selectExpr("p_partkey as ord", f"{code} as code", "p_name as zh", "concat(p_type, ' ', p_name) as en", "p_size")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, code, zh, en, use); codes above others cannot be billed."""
    c = part_codes(spark, sf_dir).drop("p_size")
    up = headers(c).select("code", F.lit(0).alias("_use"))
    return c.join(up, "code", "left").select("ord", "code", "zh", "en", F.coalesce("_use", F.lit(1)).alias("use"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, code, src_id, flags, ord)."""
    return part_codes(spark, sf_dir).selectExpr("zh as text", "code", "p_size % 18 as src_id", "p_size % 4 as flags", "ord")


CODES0 = """
codes0 AS (
  SELECT p_partkey AS ord, p_name AS zh, p_type || ' ' || p_name AS en, p_size,
         chr(CAST(65 + p_partkey % 26 AS INTEGER)) || lpad(CAST((p_partkey // 26) % 8 AS VARCHAR), 2, '0')
         || CASE WHEN p_partkey // 208 = 0 THEN '' ELSE '.' || CAST(p_partkey // 208 AS VARCHAR) END AS code
  FROM part)"""
CODES = (
    CODES0
    + """,
above AS (SELECT DISTINCT a.code FROM codes0 a JOIN codes0 b ON left(a.code, 3) = left(b.code, 3) AND a.code <> b.code AND starts_with(b.code, a.code)),
codes AS (SELECT ord, code, zh, en, CASE WHEN code IN (SELECT code FROM above) THEN 0 ELSE 1 END AS use FROM codes0)"""
)
# each code with the prefixes above it
UP = """up AS (SELECT code, regexp_replace(left(code, CAST(n AS INTEGER)), '\\.$', '') AS anc, length(code) - n AS d
  FROM (SELECT code, unnest(generate_series(3, length(code))) AS n FROM codes0)),
chain AS (SELECT DISTINCT code, anc FROM up)"""
TERMS = "terms AS (SELECT zh AS text, code, p_size % 18 AS src_id, p_size % 4 AS flags, ord FROM codes0)"

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def stem_sql(w: str) -> str:
    return (
        f"(CASE WHEN length({w}) <= 3 OR regexp_matches({w}, '[0-9]') THEN {w}"
        f" WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y'"
        f" WHEN regexp_matches({w}, '(ss|us|is|as|os)$') THEN {w}"
        f" WHEN regexp_matches({w}, '(ch|sh|x|z)es$') THEN left({w}, length({w}) - 2)"
        f" WHEN ends_with({w}, 's') THEN left({w}, length({w}) - 1) ELSE {w} END)"
    )


def normalise_sql(s: str) -> str:
    """The normaliser for texts without Chinese; look-behinds become placeholders."""
    t = f"regexp_replace(lower({s}), '[''’]s\\b', '', 'g')"
    for british, us in BRITISH:
        if british.startswith("(?<!angi)"):
            t = f"replace(replace(replace({t}, 'angioedema', '~'), 'oedema', 'edema'), '~', 'angioedema')"
        else:
            t = f"replace({t}, '{british}', '{us}')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\s.]', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(^|[^0-9])\\.', '\\1 ', 'g'), '\\.([^0-9]|$)', ' \\1', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def words_sql(t: str) -> str:
    """Stemmed words of a normalised text without stop words."""
    return f"list_transform(list_filter(string_split({t}, ' '), lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w)), lambda w: {stem_sql('w')})"


def key_sql(t: str) -> str:
    return f"array_to_string(list_sort(list_distinct({words_sql(t)})), ' ')"
