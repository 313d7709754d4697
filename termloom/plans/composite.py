"""Queries on composite views, term rules and sampled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codes as C, rules as R, text as X, values as V
from ..operators import facets as FA, views as VW
from ..operators.search import search
from . import tables as T
from .relational import CHAPTERS, NOTES, UP
from .retrieval import part_index, search_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = T.registry(QUERIES, ORACLES)


@query(f"""WITH {T.CODES}, {T.TERMS}, {UP}, p AS (SELECT code, string_agg(anc, '/' ORDER BY length(anc)) AS path FROM chain WHERE anc <> code AND anc IN (SELECT code FROM codes0) GROUP BY code),
near AS (SELECT code, max_by(anc, length(anc)) AS parent FROM chain WHERE anc <> code AND anc IN (SELECT code FROM codes0) GROUP BY code),
k AS (SELECT parent AS code, string_agg(code, '/' ORDER BY code) AS children FROM near GROUP BY parent),
b AS (SELECT a.code, count(*) AS n_below FROM codes0 a JOIN codes0 x ON left(a.code, 3) = left(x.code, 3) AND a.code <> x.code AND starts_with(x.code, a.code) GROUP BY a.code),
t AS (SELECT code, count(DISTINCT src_id) AS n_sources FROM terms GROUP BY code)
SELECT c.code, use, path, children, n_below, n_sources, chapter FROM codes c LEFT JOIN p USING (code) LEFT JOIN k USING (code) LEFT JOIN b USING (code) LEFT JOIN t USING (code) LEFT JOIN {CHAPTERS} ON left(c.code, 3) BETWEEN first AND last""")
def code_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.codes(spark, sf_dir)
    olds = c.select("code", F.array("zh").alias("olds"))
    page = VW.code_page(c, T.terms(spark, sf_dir), spark.sql(f"SELECT * FROM {CHAPTERS}"), spark.sql(f"SELECT * FROM {NOTES}"), olds)
    return page.select("code", "use", F.array_join("path", "/").alias("path"), F.array_join("children", "/").alias("children"), "n_below", F.size(F.map_keys("terms")).cast("long").alias("n_sources"), "chapter")


@query(f"WITH {T.CODES0} SELECT code FROM codes0 WHERE contains(lower(code), 'anvil') OR contains(lower(zh), 'anvil') OR contains(lower(en), 'anvil')")
def name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VW.containing(T.part_codes(spark, sf_dir), "ANVIL").select("code")


@query("""WITH r AS (SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CAST('0x' || left(sha1(k), 2) AS INTEGER), k) AS n FROM (SELECT *, p_name || p_partkey AS k FROM part))
SELECT p_brand, p_partkey FROM r WHERE n <= 5""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part").withColumn("k", F.concat("p_name", F.col("p_partkey").cast("string")))
    return VW.hash_sample(p, "p_brand", "k", 5).select("p_brand", "p_partkey")


@query("""WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws FROM part), l AS (SELECT *, list_max(list_transform(ws, lambda x: {'n': length(x), 'w': x})).w AS w FROM w),
a AS (SELECT *, CAST(greatest(2, p_partkey % greatest(length(w) - 2, 1) + 2) AS INTEGER) AS i, (p_partkey >> 3) % 3 AS k FROM l),
b AS (SELECT *, left(w, i - 1) AS head, substring(w, i, 1) AS here, substring(w, i + 1) AS tail FROM a)
SELECT p_partkey, p_name, CASE WHEN length(w) < 4 THEN p_name ELSE array_to_string(list_transform(ws, lambda x: CASE WHEN x = w THEN CASE k WHEN 0 THEN head || tail WHEN 1 THEN head || left(tail, 1) || here || substring(tail, 2) ELSE head || here || here || tail END ELSE x END), ' ') END AS q FROM b""")
def typo_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part")
    return p.select("p_partkey", "p_name", R.typo(F.col("p_name"), F.col("p_partkey")).alias("q"))


RAW_TERMS = "(VALUES (1, ' asthma ;'), (2, ''), (3, 'AD'), (4, 'Asthma (disorder)'), (5, ',;'), (6, 'Eczema, unspecified'), (7, 'DVT9')) AS t(id, s)"


@query(f"""SELECT id, trim(s, ' ,;') AS trimmed, length(trim(s, ' ,;')) BETWEEN 1 AND 200 AS ok, regexp_full_match(s, '[A-Z]{{2,5}}') AS abbreviation,
trim(regexp_replace(s, '(?i)\\s*\\((disorder|finding|morphologic abnormality|procedure|situation|event|qualifier value)\\)$', '')) AS untailed, lower(trim(regexp_replace(s, '(?i)(,? (unspecified|not elsewhere classified|NEC|NOS))+$', ''))) AS core FROM {RAW_TERMS}""")
def term_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = spark.sql(f"SELECT * FROM {RAW_TERMS}"), F.col("s")
    return t.select("id", X.trim_term(s).alias("trimmed"), X.term_ok(s).alias("ok"), X.is_abbreviation(s).alias("abbreviation"), X.strip_snomed_tail(s).alias("untailed"), X.core_title(s).alias("core"))


HEADINGS = "(VALUES ('Infections (A00-B99)'), ('Neoplasms (C00-D49) and (E00-E10)'), ('none')) AS t(s)"


@query(f"""SELECT s, nullif(regexp_extract(s, '\\(([A-Z0-9]{{3}})-([A-Z0-9]{{3}})\\)', 1), '') AS first, nullif(regexp_extract(s, '\\(([A-Z0-9]{{3}})-([A-Z0-9]{{3}})\\)', 2), '') AS last FROM {HEADINGS}""")
def chapter_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {HEADINGS}").select("s", C.chapter_range(F.col("s")).alias("r")).select("s", "r.first", "r.last")


@query("SELECT o_orderkey, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS days, DATE '1999-01-01' - CAST(o_orderdate AS DATE) > 21 AS stale FROM orders")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.freshness(F.to_date("o_orderdate"), F.to_date(F.lit("1999-01-01"))).alias("f")).select("o_orderkey", "f.days", "f.stale")


PICK_SIDE = "CASE p_partkey % 3 WHEN 0 THEN 'left knee' WHEN 1 THEN 'right knee' ELSE 'knee, initial encounter' END"


@query(f"""WITH p AS (SELECT p_brand AS cat, p_type || ' ' || {PICK_SIDE} AS en, p_size > 5 AS use FROM part), b AS (SELECT * FROM p WHERE use),
f AS (SELECT cat, {", ".join("CASE " + " ".join(f"WHEN regexp_matches(en, '(?i){chr(92)}b{q}{chr(92)}b') THEN '{v}'" for q, v in V.FACETS[k]) + f" END AS f_{k}" for k in V.FACETS)} FROM b),
k AS (SELECT cat, greatest({", ".join(f"count(DISTINCT f_{k})" for k in V.FACETS)}) AS most FROM f GROUP BY cat)
SELECT cat, count(*) AS n FROM b JOIN k USING (cat) WHERE most >= 2 GROUP BY cat HAVING count(*) > 8""")
def quick_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part").selectExpr("p_brand as cat", f"concat(p_type, ' ', {PICK_SIDE}) as en", "cast(p_size > 5 as int) as use")
    return FA.quick_pick(p, "cat")


LINES = "(VALUES (1, 'blue anvil'), (2, 'cold widget'), (3, 'B02.1'), (4, 'A00')) AS t(qid, raw)"


@query(f"""WITH found AS ({search_sql(LINES)}), lines AS (SELECT * FROM (VALUES (1, 1, 1, 'blue anvil', NULL), (2, 1, 2, 'cold widget', 'r/o'), (3, 1, 3, 'B02.1', NULL), (4, 2, 1, 'A00', NULL)) AS t(qid, batch, pos, raw, tag))
SELECT batch, pos, raw, tag, code, score FROM lines LEFT JOIN (SELECT * FROM found WHERE rank = 1) USING (qid)""")
def batch_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.sql("SELECT * FROM (VALUES (1, '1. blue anvil\n2) r/o cold widget; B02.1'), (2, 'Dx: A00')) AS t(batch, text)")
    picked, _, _ = VW.batch_coding(texts, part_index(spark, sf_dir), spark.sql(f"SELECT * FROM {NOTES}"))
    return picked


WANTED = "(VALUES (1, 'zzqqx wwkk'), (2, 'cold widget'), (3, 'A00')) AS t(qid, raw)"


@query(f"""WITH found AS ({search_sql(WANTED)}), {T.CODES0}, first AS (SELECT qid, atm, lower(zh || ' ' || en) AS shown FROM found JOIN codes0 USING (code) WHERE rank = 1), w AS (SELECT qid, unnest(string_split(lower(raw), ' ')) AS w FROM {WANTED}),
c AS (SELECT qid, sum(CASE WHEN contains(shown, CASE WHEN length(w) >= 6 THEN left(w, length(w) - 2) ELSE w END) THEN length(w) ELSE 0 END) / sum(length(w)) AS cov FROM w JOIN first USING (qid) GROUP BY qid)
SELECT CAST(qid AS BIGINT) AS qid, raw FROM {WANTED} LEFT JOIN first USING (qid) LEFT JOIN c USING (qid) WHERE shown IS NULL OR (NOT atm AND cov < 0.5)""")
def missed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql("SELECT * FROM (VALUES (1L, 'zzqqx wwkk'), (2L, 'cold widget'), (3L, 'A00')) AS t(qid, raw)")
    return VW.misses(asked, search(asked, part_index(spark, sf_dir), 5))
