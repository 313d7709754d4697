"""Queries on codes, vocabulary, crosswalks, rules, gates and state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codes as C, rules as R, text as X, values as V
from ..operators import crosswalk as W, evaluate as E, facets as FA, gates as G, hierarchy as H, notes as N, state as ST, vocabulary as VO
from ..session import shared_dir
from ..streaming import windows as SW
from . import tables as T
from .retrieval import TITLES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


query = T.registry(QUERIES, ORACLES)


# --- codes ---------------------------------------------------------------------
RAW_CODES = "(VALUES (1, 'L400'), (2, 'l40.0'), (3, 'S72001A'), (4, 'C4A'), (5, ' e11 22 '), (6, '12345'), (7, 'E1')) AS t(id, raw)"
_CLEAN = "regexp_replace(upper(trim(raw)), '\\s+', '', 'g')"


@query(f"""SELECT id, CASE WHEN regexp_full_match({_CLEAN}, '[A-Z][0-9][0-9A-Z](\\.?[0-9A-Z]{{1,4}})?') THEN
 CASE WHEN length(replace({_CLEAN}, '.', '')) > 3 THEN left({_CLEAN}, 3) || '.' || substring(replace({_CLEAN}, '.', ''), 4) ELSE {_CLEAN} END END AS code,
 CASE WHEN length(upper(trim(raw))) <= 3 OR contains(raw, '.') THEN upper(trim(raw)) ELSE left(upper(trim(raw)), 3) || '.' || substring(upper(trim(raw)), 4) END AS dotted FROM {RAW_CODES}""")
def code_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(f"SELECT * FROM {RAW_CODES}")
    return t.select("id", C.canonical(F.col("raw")).alias("code"), C.dotted(F.col("raw")).alias("dotted"))


UP = T.UP


@query(f"WITH {T.CODES0}, {UP}, near AS (SELECT code, max_by(anc, length(anc)) AS parent FROM chain WHERE anc <> code AND anc IN (SELECT code FROM codes0) GROUP BY code) SELECT c.code, parent FROM codes0 c LEFT JOIN near USING (code)")
def code_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.parents(T.part_codes(spark, sf_dir))


@query(f"WITH {T.CODES0}, {UP} SELECT code, anc, CAST(row_number() OVER (PARTITION BY code ORDER BY length(anc) DESC) - 1 AS INTEGER) AS dist FROM chain")
def code_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.ancestors(T.part_codes(spark, sf_dir))


@query(f"WITH {T.CODES0} SELECT a.code AS root, b.code FROM codes0 a JOIN codes0 b ON left(a.code, 3) = left(b.code, 3) AND starts_with(b.code, a.code) AND a.code <> b.code")
def code_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.part_codes(spark, sf_dir)
    return H.descendants(c, c.select(F.col("code").alias("root")))


RANGES = "(VALUES (1, 'A00', 'B03'), (2, 'C01.2', 'C05'), (3, 'Z00', 'Z99')) AS t(id, first, last)"


@query(f"WITH {T.CODES0} SELECT id, code FROM codes0 JOIN {RANGES} ON code >= first AND (code <= last OR starts_with(code, last))")
def code_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.by_range(T.part_codes(spark, sf_dir), spark.sql(f"SELECT * FROM {RANGES}")).select("id", "code")


CHAPTERS = "(VALUES (1, 'A00', 'B99'), (2, 'C00', 'D49'), (3, 'E00', 'M07'), (4, 'N00', 'X05')) AS t(chapter, first, last)"


@query(f"WITH {T.CODES0} SELECT code, chapter FROM codes0 LEFT JOIN {CHAPTERS} ON left(code, 3) >= first AND left(code, 3) <= last")
def chapter_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.range_join(T.part_codes(spark, sf_dir), spark.sql(f"SELECT * FROM {CHAPTERS}")).select("code", "chapter")


@query(f"""WITH {T.CODES0}, m AS (SELECT l_orderkey AS k, code FROM lineitem JOIN codes0 ON l_partkey = ord),
ends AS (SELECT k, min(code) AS lo, max(code) AS hi FROM m GROUP BY k),
common AS (SELECT k, (SELECT coalesce(max(n), 0) FROM generate_series(1, 12) g(n) WHERE n <= least(length(lo), length(hi)) AND left(lo, CAST(n AS INTEGER)) = left(hi, CAST(n AS INTEGER))) AS n, lo FROM ends),
pre AS (SELECT k, left(lo, CAST(n AS INTEGER)) AS p FROM common),
found AS (SELECT k, max_by(code, length(code)) AS lca FROM pre JOIN codes0 ON left(code, 3) = left(p, 3) AND length(p) >= 3 AND starts_with(p, code) GROUP BY k)
SELECT k, lca FROM ends LEFT JOIN found USING (k)""")
def lca_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.part_codes(spark, sf_dir)
    m = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("ord")).join(c.select("ord", "code"), "ord")
    return H.lca(m, c, "k")


@query(f"""WITH {T.CODES}, {UP}, near AS (SELECT code, max_by(anc, length(anc)) AS header FROM chain WHERE anc <> code AND anc IN (SELECT code FROM codes0) GROUP BY code),
rated AS (SELECT header, c.code, c.ord, CASE WHEN c.code = header || CASE WHEN length(header) = 3 THEN '.9' ELSE '9' END AND use = 1 THEN 0 WHEN contains(lower(en), 'unspecified') THEN 1 END AS rate FROM near JOIN codes c USING (code))
SELECT header, min_by(code, (rate, length(code), ord)) AS child FROM rated WHERE rate IS NOT NULL GROUP BY header""")
def default_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.default_child(T.codes(spark, sf_dir))


@query(f"""WITH {T.CODES0}, p AS (SELECT a.code, b.code AS sibling, row_number() OVER (PARTITION BY a.code ORDER BY b.code) AS n FROM codes0 a JOIN codes0 b ON left(a.code, 3) = left(b.code, 3) AND a.code <> b.code)
SELECT code, sibling FROM p WHERE n <= 80""")
def sibling_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.siblings(T.part_codes(spark, sf_dir), 3)


@query("""WITH paths AS (SELECT [r_name, n_name] AS path, CAST(s_suppkey AS VARCHAR) AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT prefix, count(DISTINCT code) AS n, min(code) AS first FROM (SELECT unnest([path[1], path[1] || ' > ' || path[2]]) AS prefix, code FROM paths) GROUP BY prefix""")
def path_code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (T.read(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    p = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.array("r_name", "n_name").alias("path"), F.col("s_suppkey").cast("string").alias("code"))
    return H.path_codes(p).select("prefix", F.size("codes").cast("long").alias("n"), F.element_at("codes", 1).alias("first"))


# --- vocabulary ----------------------------------------------------------------
@query(f"""WITH {T.CODES0}, {T.TERMS}, k AS (SELECT *, lower(text) AS key, left(code, 3) AS c3 FROM terms)
SELECT key, c3 AS code, min(src_id) AS src_id, min_by(text, ord) AS text, CAST(min_by(flags & 1, ord) AS INTEGER) AS incomplete, CAST(bit_and((flags & 2) >> 1) AS INTEGER) AS held_out FROM k GROUP BY key, c3""")
def vocab_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.terms(spark, sf_dir).withColumn("key", F.lower("text")).withColumn("code", F.substring("code", 1, 3))
    return VO.dedup_terms(t)


CURATED = "(VALUES (1, 'X00', true), (3, 'X03', true), (5, 'X05', false)) AS t(n, code, approved)"


@query(f"""WITH {T.CODES0}, {T.TERMS}, k AS (SELECT lower(text) AS key, code, src_id FROM terms), names AS (SELECT ord, lower(zh) AS key FROM codes0),
cur AS (SELECT key, c.code FROM {CURATED.replace(' AS t(', ' AS c(')} JOIN names ON ord = n WHERE approved), keep AS (SELECT key, list(code) AS keep FROM cur GROUP BY key)
SELECT k.key, k.code, k.src_id FROM k LEFT JOIN keep USING (key) WHERE keep IS NULL OR src_id >= 11 OR list_contains(keep, k.code) UNION ALL SELECT key, code, 11 FROM cur""")
def vocab_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = T.terms(spark, sf_dir).select(F.lower("text").alias("key"), "code", "src_id")
    names = T.part_codes(spark, sf_dir).select(F.col("ord").alias("n"), F.lower("zh").alias("key"))
    cur = spark.sql(f"SELECT * FROM {CURATED}").join(names, "n").select("key", "code", F.lit(11).alias("src_id"), "approved")
    return VO.override(k, cur, 11)


@query(f"""WITH {T.CODES0}, raw AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN replace(code, '.', '') WHEN ord % 3 = 1 THEN code ELSE code || '.-' END AS raw FROM codes0 UNION ALL SELECT -1, 'Q99.9'),
bare AS (SELECT replace(code, '.', '') AS b, min(code) AS c FROM codes0 GROUP BY ALL)
SELECT r.ord, raw, coalesce(e.code, c) AS code, ends_with(raw, '-') AS incomplete FROM raw r LEFT JOIN (SELECT DISTINCT code FROM codes0) e ON raw = e.code LEFT JOIN bare ON replace(regexp_replace(raw, '[-.]+$', ''), '.', '') = b""")
def resolve_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.part_codes(spark, sf_dir)
    raw = c.selectExpr("ord", "case when ord % 3 = 0 then replace(code, '.', '') when ord % 3 = 1 then code else concat(code, '.-') end as raw").union(spark.sql("SELECT -1L, 'Q99.9'"))
    return VO.resolve(raw, c).select("ord", "raw", "code", "incomplete")


@query("SELECT DISTINCT p_brand, o_orderpriority FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey")
def bridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    li = T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return p.join(li, "p_partkey").select("p_brand", "l_orderkey").distinct().join(o, "l_orderkey").select("p_brand", "o_orderpriority").distinct()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def drop_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return VO.drop_superseded(T.read(spark, sf_dir, "customer"), o, "c_custkey").select("c_custkey", "c_mktsegment")


@query(f"WITH {T.CODES0}, {T.TERMS} SELECT src_id, count(*) AS n FROM terms GROUP BY src_id")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.source_counts(T.terms(spark, sf_dir))


@query("""WITH raw AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber = 3 THEN 'bad' ELSE chr(CAST(65 + l_partkey % 26 AS INTEGER)) || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') || '.' || CAST(l_suppkey % 1000 AS VARCHAR) END AS code,
 l_shipdate, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS use, l_linestatus AS status, l_quantity, l_extendedprice FROM lineitem),
r AS (SELECT *, regexp_full_match(code, '[A-Z][0-9][0-9A-Z](\\.[0-9A-Z]{1,4})?') AS ok, row_number() OVER (PARTITION BY code ORDER BY ord, l_shipdate, l_quantity, l_extendedprice) = 1 AS f FROM raw)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE ok AND f) AS kept, count(*) FILTER (WHERE NOT ok) AS bad, count(*) FILTER (WHERE ok AND NOT f) AS repeated, count(*) FILTER (WHERE status <> 'O') AS odd_status FROM r""")
def code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "case when l_linenumber = 3 then 'bad' else concat(chr(65 + l_partkey % 26), lpad(cast(l_partkey % 100 as string), 2, '0'), '.', cast(l_suppkey % 1000 as string)) end"
    raw = T.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as ord", f"{code} as code", "case when l_returnflag = 'N' then 1 else 0 end as use", "l_linestatus as status")
    return VO.code_report(raw, ["O"]).drop("billable")


SEE = "(VALUES ('a', 'see also gear, steel'), ('b', 'gear, steel, large'), ('c', 'nothing, at all'), ('d', 'see bolt')) AS t(src, target)"
PATHS = "(VALUES ('gear, steel', 'A01.1'), ('gear, steel', 'A01.2'), ('bolt', 'B02')) AS t(path, code)"


@query(f"""WITH k AS (SELECT path, min(code) AS lo, max(code) AS hi FROM {PATHS} GROUP BY path), known AS (SELECT path, CASE WHEN lo = hi THEN lo ELSE regexp_replace(left(lo, CAST(list_max(list_filter(generate_series(1, length(lo)), lambda n: left(lo, CAST(n AS INTEGER)) = left(hi, CAST(n AS INTEGER)))) AS INTEGER)), '\\.$', '') END AS code FROM k),
a AS (SELECT src, target, trim(regexp_replace(lower(target), '^see( also)?\\s+', '')) AS at_ FROM {SEE})
SELECT src, target, coalesce(e.code, u.code) AS code, CASE WHEN e.code IS NOT NULL THEN 'node' WHEN u.code IS NOT NULL THEN 'ancestor' ELSE 'none' END AS how FROM a LEFT JOIN known e ON at_ = e.path LEFT JOIN known u ON regexp_replace(at_, ',[^,]*$', '') = u.path""")
def see_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.see_targets(spark.sql(f"SELECT * FROM {SEE}"), spark.sql(f"SELECT * FROM {PATHS}"))


SITE_TABLE = "(VALUES ('Skin', 'C44', 'D04', ''), ('Lung', 'C34', NULL, 'D14')) AS t(site, malignant_primary, in_situ, benign)"


@query(f"""SELECT 'neoplasm ' || lower(site) || ' ' || kind AS text, code FROM (SELECT site, unnest(['malignant primary', 'in situ', 'benign']) AS kind, unnest([malignant_primary, in_situ, benign]) AS code FROM {SITE_TABLE}) WHERE code <> ''""")
def neoplasm_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.neoplasm_terms(spark.sql(f"SELECT * FROM {SITE_TABLE}"), ["malignant_primary", "in_situ", "benign"])


# --- crosswalk -----------------------------------------------------------------
RAW_MAP = "SELECT CAST(l_partkey AS VARCHAR) AS old, CASE WHEN l_returnflag = 'R' THEN 'NoDx' ELSE CAST(l_suppkey AS VARCHAR) END AS new, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'del' END AS st_old, '' AS st_new FROM lineitem"
EDGES = f"""raw AS ({RAW_MAP}), edges AS (SELECT DISTINCT old, CASE WHEN new NOT IN ('', 'NoDx', 'NoPCS') THEN new END AS new, st_old, st_new FROM raw
 WHERE new IN ('', 'NoDx', 'NoPCS') OR NOT (old = new AND st_old = '' AND st_new = ''))"""


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = T.read(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_partkey as string) as old", "case when l_returnflag = 'R' then 'NoDx' else cast(l_suppkey as string) end as new", "case when l_linestatus = 'O' then '' else 'del' end as st_old", "'' as st_new"
    )
    return W.edges(raw)


@query(f"WITH {EDGES} SELECT * FROM edges")
def crosswalk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosswalk(spark, sf_dir)


@query(f"WITH {EDGES} SELECT new, array_to_string(list_sort(list(DISTINCT old)), ',') AS olds FROM edges WHERE new IS NOT NULL GROUP BY new")
def crosswalk_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.reverse(crosswalk(spark, sf_dir)).select("new", F.array_join("olds", ",").alias("olds"))


@query(f"""WITH {EDGES}, now AS (SELECT CAST(s_suppkey AS VARCHAR) AS code FROM supplier), asked AS (SELECT CAST(p_partkey AS VARCHAR) AS code FROM part UNION ALL SELECT 'none'),
t AS (SELECT old, list_sort(list(DISTINCT new) FILTER (WHERE new IS NOT NULL)) AS targets FROM edges GROUP BY old)
SELECT a.code, CASE WHEN n.code IS NOT NULL THEN 'current' WHEN len(targets) > 0 THEN 'mapped' WHEN old IS NOT NULL THEN 'deleted' ELSE 'unknown' END AS how,
CASE WHEN n.code IS NOT NULL THEN a.code ELSE coalesce(array_to_string(targets, ','), '') END AS targets FROM asked a LEFT JOIN now n ON a.code = n.code LEFT JOIN t ON a.code = old""")
def crosswalk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("code"))
    asked = T.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("code")).union(spark.sql("SELECT 'none'"))
    return W.lookup(asked, now, crosswalk(spark, sf_dir)).select("code", "how", F.array_join("targets", ",").alias("targets"))


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_shipmode)), ',') AS names FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY l_partkey")
def old_names_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = T.read(spark, sf_dir, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("name"))
    return W.old_names(raw, "l_partkey", "name").select("l_partkey", F.array_join("names", ",").alias("names"))


FLAGS = "(VALUES ('00000'), ('10000'), ('10111'), ('11000'), ('01000')) AS t(flag)"


@query(f"""SELECT flag, concat_ws(', ', CASE WHEN flag[2] = '1' THEN 'no map' END, CASE WHEN flag[1] = '1' THEN 'approximate' ELSE 'exact' END, CASE WHEN flag[3] = '1' THEN 'combination ' || flag[4] || '/' || flag[5] END) AS meaning FROM {FLAGS}""")
def gem_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {FLAGS}").select("flag", C.gem_flag(F.col("flag")).alias("meaning"))


# --- facets --------------------------------------------------------------------
def _facet_sql(name: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(en, '(?i)\\b{p}\\b') THEN '{v}'" for p, v in V.FACETS[name])
    return f"CASE {rules} END"


FACETED = "SELECT code, en, use, CASE WHEN use = 1 THEN '{}' ELSE '{}' END AS f_use, {} FROM {}".format(V.BILLABLE, V.TITLE_ONLY, ", ".join(f"{_facet_sql(k)} AS f_{k}" for k in V.FACETS), TITLES)


def titles(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT code, en, use FROM {TITLES}")


@query(FACETED)
def facet_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.with_facets(titles(spark))


_ALL = ["use", *V.FACETS]


@query(f"""WITH f AS ({FACETED}), l AS (SELECT unnest([{", ".join(f"'{k}'" for k in _ALL)}]) AS facet, unnest([{", ".join(f"f_{k}" for k in _ALL)}]) AS value FROM f),
n AS (SELECT facet, value, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT facet FROM n GROUP BY facet HAVING count(value) >= 2 OR (count(value) = 1 AND max(n) FILTER (WHERE value IS NOT NULL) < sum(n)))
SELECT 1 AS g, facet, value, n FROM n WHERE value IS NOT NULL AND facet IN (SELECT facet FROM k)""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.facet_counts(titles(spark).withColumn("g", F.lit(1)), ["g"])


@query(f"SELECT code FROM ({FACETED}) WHERE f_use = '{V.BILLABLE}' AND f_lat = '{V.RIGHT}'")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.apply_facets(titles(spark), {"use": V.BILLABLE, "lat": V.RIGHT, "enc": ""}).select("code")


# --- notes ---------------------------------------------------------------------
NOTES = """(VALUES ('E11', 'useAdd', 0, 'Use additional code to identify control using:'), ('E11', 'useAdd', 1, 'insulin (Z79.4)'), ('E11', 'useAdd', 2, 'oral antidiabetic drugs (Z79.84)'),
('E11', 'excl1', 0, 'type 1 diabetes (E10.-)'), ('E11.22', 'useAdd', 0, 'Use additional code to identify stage (N18.1-N18.6)'), ('N18', 'codeFirst', 0, 'Code first any associated: diabetes (E08.22, E09.22)'),
('E10', 'excl1', 0, 'gestational diabetes (O24.4-)'), ('I10', 'excl1', 0, 'neoplasms (C00-C96)')) AS t(code, kind, pos, text)"""
_CODE = r"[A-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{0,4})?"


SPECS = f"""n AS (SELECT * FROM {NOTES}), inner_ AS (SELECT code, kind, pos, text, unnest(list_transform(string_split(regexp_extract(text, '\\(([^)]*)\\)', 1), ','), lambda x: trim(x))) AS x FROM n),
specs AS (SELECT code, kind, pos, text, CASE WHEN regexp_matches(x, '-[A-Z]') THEN split_part(x, '-', 1) END AS first, CASE WHEN regexp_matches(x, '-[A-Z]') THEN split_part(x, '-', 2) END AS last, CASE WHEN NOT regexp_matches(x, '-[A-Z]') THEN regexp_replace(x, '\\.?-$', '') END AS prefix FROM inner_ WHERE regexp_matches(x, '^[A-Z][0-9][0-9A-Z]'))"""


@query(f"WITH {SPECS} SELECT text, first, last, prefix FROM specs")
def notes_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.sql(f"SELECT * FROM {NOTES}")
    return n.select("text", F.explode(C.specs(F.col("text"))).alias("s")).select("text", "s.first", "s.last", "s.prefix")


PICKED = "(VALUES (1, 0, 'E11.9'), (1, 1, 'E10.9'), (1, 2, 'I10'), (2, 0, 'E11.22'), (2, 1, 'N18.30'), (3, 0, 'C34.1'), (3, 1, 'I10')) AS t(batch, pos, code)"


def picked_notes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    p = spark.sql(f"SELECT * FROM {PICKED}")
    return p, N.merged(p.select("code").distinct(), spark.sql(f"SELECT * FROM {NOTES}"))


MEETS = "(starts_with(b.code, coalesce(prefix, '~')) OR (b.code >= first AND (b.code <= last OR starts_with(b.code, last))))"


@query(f"""WITH {SPECS}, p AS (SELECT * FROM {PICKED}) SELECT DISTINCT a.batch, CASE WHEN a.pos < b.pos THEN a.code ELSE b.code END AS a, CASE WHEN a.pos < b.pos THEN b.code ELSE a.code END AS b, text FROM p a JOIN (SELECT code AS of_code, kind, text, first, last, prefix FROM specs) s ON starts_with(a.code, of_code) AND kind = 'excl1' JOIN p b ON a.batch = b.batch AND a.code <> b.code AND {MEETS}""")
def excludes_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.conflicts(*picked_notes(spark))


@query(f"""WITH {SPECS}, p AS (SELECT * FROM {PICKED}), m AS (SELECT *, ends_with(text, ':') AND NOT contains(text, '(') AS head FROM n WHERE kind IN ('codeFirst', 'useAdd', 'codeAlso')),
g AS (SELECT *, max(CASE WHEN head THEN pos END) OVER (PARTITION BY code, kind ORDER BY pos) AS h FROM m),
r AS (SELECT code, kind, coalesce(h, pos) AS grp, CASE WHEN any_value(h) IS NULL THEN any_value(text) ELSE rtrim(max(CASE WHEN head THEN text END), ':') || '：' || string_agg(CASE WHEN NOT head THEN text END, '／' ORDER BY pos) END AS text, list(pos) AS poss FROM g GROUP BY code, kind, coalesce(h, pos) HAVING count(*) FILTER (WHERE NOT head) > 0)
SELECT a.batch, a.code, r.kind, r.text, EXISTS (SELECT 1 FROM specs s JOIN p b ON b.batch = a.batch AND b.code <> a.code AND {MEETS} WHERE s.code = r.code AND s.kind = r.kind AND list_contains(poss, s.pos)) AS met FROM p a JOIN r ON starts_with(a.code, r.code)""")
def reminder_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, notes = picked_notes(spark)
    return N.satisfied(p.select("batch", "code").join(N.reminders(notes), "code"), p).select("batch", "code", "kind", "text", "met")


# --- lines, PII, dates ---------------------------------------------------------
_LEADSQL = R.LEAD.replace("'", "''")


@query(f"""WITH l AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\\r?\\n|[;；]')) AS raw, generate_subscripts(string_split_regex(text, '\\r?\\n|[;；]'), 1) - 1 AS pos FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id, turn, pos, regexp_replace(regexp_replace(regexp_replace(trim(raw), '{R.DX}', ''), '{_LEADSQL}', ''), '{R.DX}', '') AS t FROM l)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(t, '{R.TAG}', '')) AS text, CASE WHEN lower(regexp_extract(t, '{R.TAG}', 1)) = 's/p' THEN 's/p' WHEN regexp_extract(t, '{R.TAG}', 1) <> '' THEN 'r/o' END AS tag FROM t WHERE trim(regexp_replace(t, '{R.TAG}', '')) <> ''""")
def batch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.read(spark, sf_dir, "conversations").where("role = 'user'")
    t = c.select("conv_id", "turn", F.posexplode(F.split("text", r"\r?\n|[;；]")).alias("pos", "raw")).withColumn("t", R.line_text(F.col("raw")))
    return t.select("conv_id", "turn", "pos", R.line_body(F.col("t")).alias("text"), R.line_tag(F.col("t")).alias("tag")).where("text <> ''")


# fixed values: predicates of the pre-publication scan that need no look-around
SCANS = {"national_id": "[A-Z][12][0-9]{8}", "api_key": "(ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})", "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}"}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {k}" for k, p in SCANS.items()) + " FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in SCANS.values()))
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = {k: F.col("text").rlike(p) for k, p in SCANS.items()}
    found = T.read(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in hits.items()))
    return found.where(" or ".join(SCANS))


DATES = "(VALUES (1, '115/6/1', '115/6/1 and 112/12/31, again 115/6/1'), (2, '1150601', 'none'), (3, '20260601', '99/1/2'), (4, '9991231', ''), (5, '115/2/31', '115/13/1')) AS t(id, d, text)"


def _roc_sql(y: str, m: str, d: str, plus: int) -> str:
    return f"try_cast(concat_ws('-', CAST({y} AS INTEGER) + {plus}, lpad({m}, 2, '0'), lpad({d}, 2, '0')) AS DATE)"


_SLASHED = _roc_sql("split_part(x, '/', 1)", "split_part(x, '/', 2)", "split_part(x, '/', 3)", 1911)


@query(f"""WITH t AS (SELECT *, d AS x FROM {DATES}) SELECT id, CASE WHEN d = '9991231' THEN NULL WHEN contains(d, '/') THEN {_SLASHED} WHEN length(d) = 7 THEN {_roc_sql("left(d, 3)", "substring(d, 4, 2)", "substring(d, 6, 2)", 1911)} ELSE {_roc_sql("left(d, 4)", "substring(d, 5, 2)", "substring(d, 7, 2)", 0)} END AS day,
array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[0-9]{{2,3}}/[0-9]{{1,2}}/[0-9]{{1,2}}'), lambda x: CAST({_SLASHED} AS VARCHAR)), lambda x: x IS NOT NULL))), ',') AS days FROM t""")
def revision_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(f"SELECT * FROM {DATES}")
    days = F.transform(C.revision_dates(F.col("text")), lambda d: d.cast("string"))
    return t.select("id", C.roc_date(F.col("d")).alias("day"), F.array_join(days, ",").alias("days"))


# --- gates and runs ------------------------------------------------------------
@query("""SELECT * FROM (SELECT 1 AS id, 'header' AS name, true AS passed, 'r_regionkey,r_name' AS message, false AS overridden UNION ALL
SELECT 2, 'keys known', count(*) = 0, count(*) || ' bad rows', false FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL
SELECT 3, 'quantities', count(*) FILTER (WHERE l_quantity <= 0) = 0, count(*) FILTER (WHERE l_quantity <= 0) || ' bad rows', false FROM lineitem UNION ALL
SELECT 4, 'line keys unique', count(*) = 0, count(*) || ' bad rows', count(*) > 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
SELECT 5, 'billable share', avg(CASE WHEN p_size > 0 THEN 1.0 ELSE 0 END) >= 0.97, 'share', false FROM part)""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, li, part = (T.read(spark, sf_dir, x) for x in ("region", "lineitem", "part"))
    lost = G.missing(li.select("l_partkey"), "l_partkey", part, "p_partkey")
    twice = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    share = part.agg(F.avg(F.when(F.col("p_size") > 0, 1.0).otherwise(0.0)).alias("share"))
    return G.report(
        [
            G.header_gate(spark, 1, region.columns, ["r_regionkey", "r_name"]),
            G.gate(lost, 2, "keys known", F.lit(True)),
            G.gate(li, 3, "quantities", F.col("l_quantity") <= 0),
            G.gate(twice, 4, "line keys unique", F.col("n") > 1),
            G.value_gate(share, 5, "billable share", F.col("share") >= 0.97, F.lit("share")),
        ],
        [4],
    )


@query("""WITH a AS (SELECT o_orderpriority AS source, count(*) AS n_rows FROM orders GROUP BY ALL), b AS (SELECT o_orderpriority AS source, count(*) AS rows_before FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY ALL)
SELECT source, n_rows, rows_before, abs(n_rows - rows_before) <= 0.02 * rows_before AS within FROM a JOIN b USING (source)""")
def drift_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders")
    count = lambda df: df.groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n_rows"))
    return G.drift(count(o), count(o.where("o_orderkey % 50 <> 0")))


BEFORE = "(VALUES ('a', 90.0, 95.0, 92.0), ('b', 80.0, 85.0, 82.0), ('c', 70.0, 75.0, 72.0)) AS t(set, hit1, hit5, mrr)"
NOW = "(VALUES ('a', 89.5, 95.0, 92.0), ('b', 78.0, 85.0, 81.5), ('c', 71.0, 73.5, 72.0)) AS t(set, hit1, hit5, mrr)"


@query(f"""SELECT n.set, n.hit1, n.hit5, n.mrr, b.hit1 AS hit1_before, b.hit5 AS hit5_before, b.mrr AS mrr_before FROM (SELECT * FROM {NOW}) n JOIN (SELECT * FROM {BEFORE}) b USING (set) WHERE b.hit1 - n.hit1 > 1 OR b.hit5 - n.hit5 > 1 OR b.mrr - n.mrr > 1""")
def regression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.regressions(spark.sql(f"SELECT * FROM {NOW}"), spark.sql(f"SELECT * FROM {BEFORE}"), "set")


@query("SELECT left(sha256(string_agg(n_name || ':' || sha1(n_name), '' ORDER BY n_name || ':' || sha1(n_name))), 16) AS fingerprint FROM nation")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.read(spark, sf_dir, "nation")
    return G.fingerprint(n.select(F.col("n_name").alias("path"), F.sha1("n_name").alias("sha")))


@query("SELECT c_custkey AS source, sha1(c_name || c_mktsegment) AS sha FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.read(spark, sf_dir, "customer")
    now = c.select(F.col("c_custkey").alias("source"), F.sha1(F.concat("c_name", "c_mktsegment")).alias("sha"))
    old = F.when(F.col("c_custkey") % 7 == 0, "gone").otherwise(F.sha1(F.concat("c_name", "c_mktsegment")))
    return ST.changed(now, c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("source"), old.alias("sha")))


@query("""WITH l AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS rank FROM l)
SELECT user_id, event_type, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def mru_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.most_recent(T.read(spark, sf_dir, "events"), "user_id", "event_type", "ts", 3).select("user_id", "event_type", "rank")


@query("SELECT c_mktsegment AS category, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderstatus, o_orderkey, n FROM r WHERE rn <= 500""")
def status_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    n = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return H.top_rows(o, ["o_orderstatus"], [F.asc("o_orderkey")], 500).join(F.broadcast(n), "o_orderstatus").select("o_orderstatus", "o_orderkey", "n")


@query("""WITH f AS (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY p_type), d AS (SELECT p_type, row_number() OVER (ORDER BY first) - 1 AS note_id FROM f) SELECT p_partkey, CAST(note_id AS INTEGER) AS note_id FROM part JOIN d USING (p_type)""")
def note_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.encode_notes(T.read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey").select("p_partkey", "note_id")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value AS percentile FROM r WHERE pos = least(floor(n * 0.95), n - 1)""")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nearest_rank(T.read(spark, sf_dir, "events"), "value", ["event_type"], 0.95)


@query(f"""WITH k AS (SELECT {T.key_sql(T.normalise_sql('p_name'))} AS key, p_brand AS code FROM part) SELECT key, array_to_string(list_sort(list(DISTINCT code)), ',') AS gold FROM k GROUP BY key""")
def shared_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part").select(X.phrase_key(X.normalise(F.col("p_name"))).alias("key"), F.col("p_brand").alias("code"))
    return E.shared_gold(p).select("key", F.array_join("gold", ",").alias("gold"))


# --- streaming additions -------------------------------------------------------
@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = SW.read_events(spark, sf_dir, "events.parquet")
    out = SW.drain(SW.window_counts(e), "stream_window_counts", "complete", _checkpoint(spark))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS rank FROM l)
SELECT user_id, string_agg(event_type, ',' ORDER BY rank) AS items FROM r WHERE rank <= 3 GROUP BY user_id""")
def stream_mru(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = SW.read_events(spark, sf_dir, "events.parquet")
    return SW.drain(SW.recent_items(e, 3), "stream_mru", "update", _checkpoint(spark))


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
