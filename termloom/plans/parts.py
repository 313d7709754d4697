"""Queries that run single components: sources, sinks, row functions, small joins."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as ST

from ..functions import codes as C, rules as R, text as X, values as V
from ..operators import gates as G, hierarchy as H, index as I, search as S, views as VW, vocabulary as VO
from ..session import shared_dir
from ..sources import readers as SR, sinks as SK
from ..streaming import windows as SW
from . import tables as T
from .retrieval import ASKED, DOC_WORDS, document_words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = T.registry(QUERIES, ORACLES)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources: written to the shared folder in their format, then read -------------
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = _folder(spark, "csv")
    n.repartition(3).write.csv(path, header=True)
    return SR.csv_contract(spark, path, n.schema)


@query("""SELECT 'R' || r_regionkey AS code, r_name AS path, NULL AS see, 'part ' || r_regionkey AS nemod FROM region
UNION ALL SELECT 'N' || n_nationkey, r_name || '/' || n_name, NULL, '' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT NULL, r_name || '/' || n_name || '/old', 'see ' || n_name, 'x y' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def source_xml_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = T.read(spark, sf_dir, "nation"), T.read(spark, sf_dir, "region")
    term = "concat('<term><title>', n_name, '</title><code>N', n_nationkey, '</code><term><title><nemod>(x)</nemod>old <nemod>(y)</nemod></title><see>see ', n_name, '</see></term></term>')"
    kids = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.collect_list(F.expr(term)), "").alias("kids"))
    main = "concat('<mainTerm><title>', r_name, ' <nemod>(part ', r_regionkey, ')</nemod></title><code>R', r_regionkey, '</code>', kids, '</mainTerm>')"
    doc = r.join(kids, "r_regionkey").agg(F.concat(F.lit("<r>"), F.array_join(F.collect_list(F.expr(main)), "\n"), F.lit("</r>")).alias("value"))  # a row per region
    path = _folder(spark, "xml")
    doc.write.text(path)
    return SR.xml_terms(spark, path).select("code", F.array_join("path", "/").alias("path"), "see", "nemod")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def source_xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "xml-rows")
    T.read(spark, sf_dir, "supplier").write.format("xml").option("rowTag", "supplier").save(path)
    keep = T.read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    schema = ST.StructType([ST.StructField("s_suppkey", ST.LongType()), ST.StructField("s_name", ST.StringType()), ST.StructField("s_nationkey", ST.IntegerType())])
    return SR.xml_rows(spark, path, "supplier", schema, keep, "s_nationkey").select("s_suppkey", "s_name")


@query("SELECT 'N:' || n_nationkey AS id, n_name AS name, 'ICD:' || n_regionkey AS xref, lower(n_name) AS synonym FROM nation WHERE n_nationkey % 4 <> 3")
def source_obo(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.read(spark, sf_dir, "nation")
    gone = "if(n_nationkey % 4 = 3, '\\nis_obsolete: true', '')"
    value = F.expr(f"concat('[Term]\\nid: N:', n_nationkey, '\\nname: ', n_name, '\\nsynonym: \"', lower(n_name), '\" EXACT []\\nxref: ICD:', n_regionkey, {gone}, '\\n')")
    path = _folder(spark, "obo")
    spark.range(1).select(F.lit("format-version: 1.2\n").alias("value")).unionAll(n.select(value)).coalesce(1).write.text(path)
    return SR.obo_terms(spark, path).select("id", "name", F.element_at("xrefs", 1).alias("xref"), F.element_at("synonyms", 1).alias("synonym"))


_ODS = '<office:document-content xmlns:office="o" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0">{}</office:document-content>'


@query("""SELECT 'regions' AS sheet, CAST(r_regionkey AS INTEGER) AS "row", r_regionkey || '/' || r_name || '/-/-' AS cells, z.zipped FROM region, (SELECT unnest([true, false]) AS zipped) z""")
def source_ods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r["r_regionkey"], r["r_name"]) for r in T.read(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # the workbook: five rows
    cell = "<table:table-cell{}><text:p>{}</text:p></table:table-cell>"
    body = "".join(f"<table:table-row>{cell.format('', k)}{cell.format('', n)}{cell.format(' table:number-columns-repeated=\"2\"', '-')}</table:table-row>" for k, n in rows)
    book, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("content.xml", _ODS.format(f'<table:table table:name="regions">{body}</table:table><table:table table:name="other">{body}</table:table>'))
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in/book.ods", book.getvalue())
    path = _folder(spark, "ods")
    SK.put(spark, f"{path}/a.ods", book.getvalue())
    SK.put(spark, f"{path}/b.zip", outer.getvalue())
    return SR.ods_rows(spark, path, "regions").select("sheet", "row", F.array_join("cells", "/").alias("cells"), F.col("file").endswith("zip").alias("zipped"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = _folder(spark, "json")
    s.write.json(path)
    return SR.json_table(spark, path, s.schema, multiline=False)


@query(f"WITH {T.CODES0} SELECT zh AS term, code || ',' || left(code, 3) AS codes, CASE WHEN ord % 2 = 0 THEN 'all of ' || zh END AS expand, ord % 3 <> 0 AS approved FROM codes0")
def source_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = """concat('  - {term: "', zh, '", codes: [', code, ', ', left(code, 3), ']', if(ord % 2 = 0, concat(', expand: ', "'all of ", zh, "'"), ''), ', approved: ', if(ord % 3 <> 0, 'true', 'false'), '}')"""
    path = _folder(spark, "yaml")
    T.part_codes(spark, sf_dir).select(F.expr(line).alias("value")).write.text(path)
    return SR.curated(spark, path).select("term", F.array_join("codes", ",").alias("codes"), "expand", "approved")


@query("SELECT 'P494' AS prop, 'exact' AS kind, 'Q' || n_nationkey AS item, CAST(n_nationkey AS VARCHAR) AS code, n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'zh-tw' ELSE 'zh' END AS lang FROM nation")
def source_sparql(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda x: f"named_struct('value', {x})"
    lang = "if(n_nationkey % 2 = 0, 'zh-tw', 'zh')"
    b = f"""named_struct('prop', {v("'P494'")}, 'kind', {v("'exact'")}, 'item', {v("concat('Q', n_nationkey)")}, 'code', {v("cast(n_nationkey as string)")}, 'text', named_struct('value', n_name, 'xml:lang', {lang}))"""
    path = _folder(spark, "sparql")
    T.read(spark, sf_dir, "nation").agg(F.struct(F.collect_list(F.expr(b)).alias("bindings")).alias("results")).write.json(path)
    return SR.sparql_rows(spark, path)


# --- sinks ------------------------------------------------------------------------
@query(f"WITH {T.CODES0} SELECT ord, code, left(code, 1) AS shard FROM codes0")
def sink_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "sharded")
    SK.write_sharded(T.part_codes(spark, sf_dir).select("ord", "code"), path)
    return spark.read.parquet(path).select("ord", "code", F.col("shard").cast("string").alias("shard"))


@query("SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def sink_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, base = T.read(spark, sf_dir, "region").select("r_regionkey", "r_name"), _folder(spark, "site")
    passed = G.report([G.gate(r, 1, "named", F.col("r_name").isNull())])
    r.write.parquet(f"{base}/live")
    r.withColumn("r_name", F.upper("r_name")).write.parquet(f"{base}/staging")
    SK.promote(spark, f"{base}/staging", f"{base}/live", passed)
    return spark.read.parquet(f"{base}/live")


@query("""WITH f AS (SELECT left(sha256(string_agg(n_name || ':' || sha1(n_name), '' ORDER BY n_name || ':' || sha1(n_name))), 16) AS fingerprint FROM nation),
c AS (SELECT string_agg(s || '=' || n, ',' ORDER BY s) AS n_rows FROM (SELECT o_orderpriority AS s, count(*) AS n FROM orders GROUP BY ALL))
SELECT run_at, n_rows, fingerprint, '1 named true' AS gates FROM f, c, (SELECT unnest(['2023-01-01', '2023-02-01']) AS run_at)""")
def sink_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.read(spark, sf_dir, "nation")
    files = n.select(F.col("n_name").alias("path"), F.sha1("n_name").alias("sha"))
    counts = T.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n_rows"))
    gates, path = G.report([G.gate(n, 1, "named", F.col("n_name").isNull())]), _folder(spark, "runs")
    for day in ("2023-01-01", "2023-02-01"):
        SK.snapshot(spark, path, day, counts, files, gates)
    rows = F.transform(F.map_entries("n_rows"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    told = F.transform("gates", lambda g: F.concat_ws(" ", g["id"].cast("string"), g["name"], g["passed"].cast("string")))
    return spark.read.parquet(path).select("run_at", F.array_join(F.array_sort(rows), ",").alias("n_rows"), "fingerprint", F.array_join(told, ",").alias("gates"))


@query("SELECT page_id, md5(html) AS digest FROM pages")
def sink_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "pages")
    packed = SK.bundle(p, "page_id", "html")
    return SK.unbundle(packed, "page_id").select("page_id", F.md5("content").alias("digest"))


@query("""WITH f AS (SELECT left(sha256(string_agg(p, '' ORDER BY p)), 16) AS of_live, count(*) AS n FROM (SELECT url || ':' || sha1(html) AS p FROM pages))
SELECT of_live, of_live AS of_bundle, fresh AS same_data, fresh AS same_files, fresh FROM f, (SELECT unnest([true, false]) AS fresh)""")
def bundle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    packed = SK.bundle(p)
    mark = G.fingerprint(p.select("path", F.sha1("content").alias("sha")))
    fresh = mark.join(p.agg(F.count("*").alias("files")), F.lit(True))
    stale = fresh.select(F.reverse("fingerprint").alias("fingerprint"), (F.col("files") - 1).alias("files"))
    return SK.bundle_report(p, packed, fresh).withColumn("fresh", F.lit(True)).union(SK.bundle_report(p, packed, stale).withColumn("fresh", F.lit(False)))


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(html), '</script|<!--|<script')")
def bundle_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SK.unsafe_tokens(T.read(spark, sf_dir, "pages"), "html").select("page_id")


@query("SELECT concat_ws(chr(9), CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), regexp_replace(coalesce(text, ''), '[\\t\\r\\n]+', ' ', 'g')) AS value FROM conversations")
def sink_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SK.tsv(T.read(spark, sf_dir, "conversations"), ["conv_id", "turn", "text"])


@query("SELECT CAST(to_json(struct_pack(n_nationkey := n_nationkey, n_name := n_name, n_regionkey := n_regionkey)) AS VARCHAR) AS value FROM nation")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SK.json_lines(T.read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query(f"WITH {T.CODES0} SELECT DISTINCT code FROM codes0 WHERE p_size > 10")
def list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.part_codes(spark, sf_dir)
    out = SK.export_list(c.where("p_size > 10"), "ord")
    more = spark.sql("SELECT 'other:X00' AS value UNION ALL SELECT 'CODELIST1: Z99.9,nothing'")
    return SK.import_list(out.union(more), c)


# --- row functions ----------------------------------------------------------------
@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'en' WHEN 2 THEN 'zh' END AS st FROM orders")
def status_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case o_orderkey % 5 when 0 then '代碼新增' when 1 then ' 英文名稱修改' when 2 then '中文名稱修改' when 3 then '' else 'else' end")
    return T.read(spark, sf_dir, "orders").select("o_orderkey", C.status(raw).alias("st"))


NAMES = "(VALUES ('A00', '霍亂', 'Cholera'), ('K60.3', '肛門?管', 'Anal Fistula'), ('K60.4', '直腸?管', 'Rectal stricture'), ('L20', '異位性皮膚炎', 'Atopic dermatitis'), ('L40', '乾癬�', 'Psoriasis'), ('N82', '女性生殖道廔管', 'Fistulae')) AS t(code, zh, en)"


@query(f"SELECT qid, code, 1.0::DOUBLE AS score FROM {NAMES}, (VALUES (1, '皮'), (2, '管'), (3, '無')) AS q(qid, c) WHERE contains(zh, c)")
def single_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = I.Index(spark.sql(f"SELECT * FROM {NAMES}"), None, None, None, None, None, None, None, None)
    return S.prefixless_scan(spark.sql("SELECT * FROM (VALUES (1, '皮'), (2, '管'), (3, '無')) AS q(qid, text)"), ix).select("qid", "code", "score")


@query(f"SELECT code, CASE WHEN contains(zh, '?管') AND contains(lower(en), 'fistula') THEN replace(zh, '?管', '廔管') ELSE zh END AS zh, contains(zh, '?') OR contains(zh, chr(65533)) AS garbled FROM {NAMES}")
def garble_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {NAMES}").select("code", X.repair_garbled(F.col("zh"), F.col("en")).alias("zh"), X.is_garbled(F.col("zh")).alias("garbled"))


@query(f"SELECT code FROM {NAMES} WHERE (contains(zh, '?') OR contains(zh, chr(65533))) AND code <> 'K60.4'")
def garble_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VW.garbled(spark.sql(f"SELECT * FROM {NAMES}"), spark.sql("SELECT 'K60.4' AS code")).select("code")


@query("SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(X.clean(F.col("text"))).alias("digest"))


COMPAT = "(VALUES (1, '\uf900\uf901'), (2, '病豈'), (3, ''), (4, 'a\uf90eb')) AS t(id, s)"  # U+8C48 is no compatibility character


@query(f"SELECT id, CAST(len(regexp_extract_all(s, '[\\x{{F900}}-\\x{{FAFF}}]')) AS INTEGER) AS n FROM {COMPAT}")
def compatibility_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {COMPAT}").select("id", X.compatibility_count(F.col("s")).alias("n"))


SPACED = "regexp_replace(s, '[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}]+', ' ', 'g')"
MIXED = "(VALUES (1, 'hsv感染症 of warts'), (2, 'ige 病'), (3, 'vitamin b12 缺乏 anemias')) AS t(id, s)"


@query(f"SELECT id, array_to_string({T.words_sql(SPACED)}, '/') AS words, array_to_string(regexp_extract_all(s, '[\\x{{3400}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]+'), '/') AS runs FROM {MIXED}")
def word_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(f"SELECT * FROM {MIXED}")
    return t.select("id", F.array_join(X.english(F.col("s")), "/").alias("words"), F.array_join(X.han_runs(F.col("s")), "/").alias("runs"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_type, p_name] ELSE [p_name] END AS path FROM part)
SELECT p_partkey, array_to_string(CASE WHEN len(path) = 2 THEN [path[1] || ', ' || path[2], path[2] || ' ' || path[1]] ELSE path END, '|') AS forms FROM p""")
def term_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("if(p_size % 2 = 0, array(p_type, p_name), array(p_name))")
    return T.read(spark, sf_dir, "part").select("p_partkey", F.array_join(X.term_variants(path), "|").alias("forms"))


LINKED = "(VALUES (1, 'see L40.0 and (E10.-), not 123'), (2, 'N18.1-N18.6'), (3, '')) AS t(id, s)"


@query(f"SELECT id, array_to_string(regexp_extract_all(s, '[A-Z][0-9][0-9A-Z](\\.[0-9A-Z]{{0,4}}-?)?'), ' ') AS codes FROM {LINKED.replace('N18.1-N18.6', 'N18.1 - N18.6')}")
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(f"SELECT * FROM {LINKED.replace('N18.1-N18.6', 'N18.1 - N18.6')}")
    return t.select("id", F.array_join(VW.linked("s"), " ").alias("codes"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(upper(left(c, 1)), '[0-9A-Z]') THEN upper(left(c, 1)) ELSE '_' END AS shard FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '-' || p_name WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS c FROM part)")
def shard_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("case p_size % 4 when 0 then concat('-', p_name) when 1 then cast(p_size as string) else p_name end")
    return T.read(spark, sf_dir, "part").select("p_partkey", C.shard_key(c).alias("shard"))


ROUTES = "(VALUES (1, '#/q/left%20knee%2Fhip'), (2, '#/c/L40.0'), (3, 'cat/7'), (4, '#/about'), (5, '#/'), (6, '#/nowhere/x'), (7, '#/derm')) AS t(id, h)"
_KINDS = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ROUTES.items()) + " ELSE 'home' END"


@query(f"""WITH s AS (SELECT id, regexp_replace(h, '^#?/?', '') AS p FROM {ROUTES}), r AS (SELECT id, split_part(p, '/', 1) AS k, url_decode(regexp_replace(p, '^[^/]*/?', '')) AS a FROM s),
v AS (SELECT id, {_KINDS} AS view, a FROM r) SELECT id, view, CASE WHEN view NOT IN ('home', 'about', 'changes', 'fav', 'batch') THEN a END AS arg FROM v""")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {ROUTES}").select("id", VW.route(F.col("h")).alias("r")).select("id", "r.view", "r.arg")


@query("SELECT p_partkey, CASE p_size % 5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(list(V.NOTE_LABELS.values())[:4])) + " ELSE 'other' END AS label FROM part")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = list(V.NOTE_LABELS)[:4] + ["other"]
    return T.read(spark, sf_dir, "part").select("p_partkey", VW.label(F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_size") % 5 + 1).cast("int")), V.NOTE_LABELS).alias("label"))


# --- joins, sets and orders -------------------------------------------------------
GLOSSARY = "(VALUES ('cholera', '霍亂'), ('Atopic Dermatitis', '異位性皮膚炎'), ('eczema', '濕疹'), ('Eczema', '皮膚濕疹')) AS t(en, zh)"
TITLED = "(VALUES ('A00.9', 'Cholera, unspecified'), ('L20', 'Atopic dermatitis'), ('L30.9', 'Eczema NEC'), ('L40', 'Psoriasis')) AS t(code, en)"
INDEXED = "(VALUES ('Cholera', 'A00.9'), (' eczema ', 'L30.9'), ('Gout', 'M10'), ('Atopic dermatitis', NULL)) AS t(term, code)"


@query(f"SELECT code, zh FROM (SELECT lower(en) AS core, zh FROM {GLOSSARY}) JOIN (SELECT code, lower(trim(regexp_replace(en, '(?i)(,? (unspecified|not elsewhere classified|NEC|NOS))+$', ''))) AS core FROM {TITLED}) USING (core)")
def glossary_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.glossary(spark.sql(f"SELECT * FROM {GLOSSARY}"), spark.sql(f"SELECT * FROM {TITLED}")).select("code", "zh")


@query(f"SELECT code, zh FROM (SELECT lower(en) AS core, zh FROM {GLOSSARY}) JOIN (SELECT code, lower(trim(term)) AS core FROM {INDEXED} WHERE code IS NOT NULL) USING (core)")
def glossary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.glossary_index(spark.sql(f"SELECT * FROM {INDEXED}"), spark.sql(f"SELECT * FROM {GLOSSARY}")).select("code", "zh")


@query("""WITH a AS (SELECT p_name AS key, p_brand AS code, 0 AS src_id, p_partkey AS ord FROM part UNION ALL SELECT p_type, p_brand, 3, p_partkey FROM part UNION ALL SELECT p_name, p_brand, 5, -p_partkey FROM part)
SELECT key, code, min(src_id) AS src_id, min(ord) AS first FROM a GROUP BY ALL""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part")
    row = lambda key, src, ord_: p.select(F.col(key).alias("key"), F.col(key).alias("text"), F.col("p_brand").alias("code"), F.lit(src).alias("src_id"), ord_.alias("ord"))
    some = row("p_type", 3, F.col("p_partkey")).withColumn("flags", F.lit(1))
    every = VO.merge_sources(row("p_name", 0, F.col("p_partkey")), some, row("p_name", 5, -F.col("p_partkey")))
    kept = VO.dedup_terms(every.withColumn("flags", F.coalesce("flags", F.lit(0)))).select("key", "code", "src_id")
    return kept.join(every.groupBy("key", "code").agg(F.min("ord").alias("first")), ["key", "code"])


@query(f"WITH {T.CODES0} SELECT DISTINCT unnest([code, left(code, 3), left(code, 4)]) AS prefix FROM codes0")
def prefix_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.prefixes(T.part_codes(spark, sf_dir))


@query(f"WITH {T.CODES0} SELECT ord, code FROM codes0 WHERE code >= 'C' AND code < 'F'")
def code_order_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "clustered")
    H.cluster(T.part_codes(spark, sf_dir).select("ord", "code"), files=4).write.parquet(path)
    return spark.read.parquet(path).where("code >= 'C' and code < 'F'")


@query("SELECT p_type AS key, n, row_number() OVER (ORDER BY n DESC, p_type) AS place FROM (SELECT p_type, count(*) AS n FROM part GROUP BY ALL)")
def groups_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = H.group_sizes(T.read(spark, sf_dir, "part"), "p_type").withColumnRenamed("p_type", "key")
    return sized.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)  # one row a group, already in order


MAINS = f"""{T.CODES}, {T.TERMS}, roots AS (SELECT DISTINCT code FROM codes0 WHERE ord % 3 = 1 AND length(code) <= 5),
mains AS (SELECT t.code, use FROM terms t JOIN (SELECT DISTINCT code, use FROM codes) c USING (code) WHERE src_id = 2 AND flags & 1 = 0),
told AS (SELECT m.*, EXISTS (SELECT 1 FROM roots r WHERE left(r.code, 3) = left(m.code, 3) AND starts_with(m.code, r.code)) AS exempt FROM mains m)"""


def _mains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = T.codes(spark, sf_dir)
    roots = c.where("ord % 3 = 1 and length(code) <= 5").select("code")
    return T.terms(spark, sf_dir).where("src_id = 2 and flags & 1 = 0").join(c.select("code", "use").distinct(), "code").select("code", "use"), roots


@query(f"WITH {MAINS} SELECT code, count(*) AS n FROM told WHERE exempt GROUP BY code")
def seventh_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    mains, roots = _mains(spark, sf_dir)
    return H.below_roots(mains, roots).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {MAINS} SELECT 12 AS id, 'default codes' AS name, 1 - count(*) FILTER (WHERE use <> 1 AND NOT exempt) / greatest(count(*), 1) >= 0.97 AS passed, count(*) FILTER (WHERE use <> 1 AND NOT exempt) || ' of ' || count(*) AS message FROM told")
def ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mains, roots = _mains(spark, sf_dir)
    return G.ratio_gate(mains, roots, 12, "default codes")


@query(f"""WITH {DOC_WORDS}, neg AS (SELECT * FROM (VALUES (1, 'idiot'), (2, 'apache'), (4, 'loser')) AS t(qid, w)),
cand AS (SELECT DISTINCT qid, doc_id FROM (SELECT qid, unnest(string_split(lower(raw), ' ')) AS w FROM {ASKED}) JOIN words ON token = w)
SELECT CAST(qid AS BIGINT) AS qid, CAST(doc_id AS VARCHAR) AS code FROM cand c WHERE NOT EXISTS (SELECT 1 FROM neg n JOIN words x ON x.token = n.w WHERE n.qid = c.qid AND x.doc_id = c.doc_id)""")
def excluded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = document_words(spark, sf_dir).select("token", F.col("doc_id").cast("string").alias("code"), F.lit(False).alias("gap")).distinct()
    asked = spark.sql(f"SELECT CAST(qid AS BIGINT) AS qid, raw FROM {ASKED}")
    cand = asked.select("qid", F.explode(F.split(F.lower("raw"), " ")).alias("token")).join(words, "token").select("qid", "code").distinct()
    q = spark.sql("SELECT CAST(qid AS BIGINT) AS qid, neg FROM (VALUES (1, array('idiots')), (2, array('Apache')), (3, array()), (4, array('loser', 'zzz'))) AS t(qid, neg)")
    return S.drop_negated(cand, q, I.Index(None, words, None, None, None, None, None, None, None))



@query(f"""WITH {MAINS}, bad AS (SELECT 1 AS id, 'headers' AS name, 0 AS n UNION ALL SELECT 2, 'row counts', CAST(abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM orders WHERE o_orderkey % 50 <> 0)) > 0.02 * (SELECT count(*) FROM orders WHERE o_orderkey % 50 <> 0) AS INTEGER) + 1
UNION ALL SELECT 3, 'code format', count(*) FILTER (WHERE n > 1 OR NOT regexp_full_match(code, '[A-Z][0-9][0-9A-Z](\\.[0-9A-Z]{{1,4}})?')) FROM (SELECT code, count(*) AS n FROM codes GROUP BY code)
UNION ALL SELECT 4, 'hierarchy and chapters', (SELECT count(*) FROM codes c WHERE length(code) > 3 AND NOT EXISTS (SELECT 1 FROM codes p WHERE left(p.code, 3) = left(c.code, 3) AND p.code <> c.code AND starts_with(c.code, p.code))) + (SELECT count(DISTINCT left(code, 3)) FROM codes WHERE left(code, 3) > 'M99')
UNION ALL SELECT 5, 'compatibility characters', 0 UNION ALL SELECT 6, 'canaries', count(*) FILTER (WHERE coalesce(NOT contains(zh, 'anvil'), true)) FROM (VALUES ('A00'), ('A01'), ('Q99')) AS t(code) LEFT JOIN codes USING (code)
UNION ALL SELECT 7, 'crosswalk targets', count(*) FROM supplier WHERE s_suppkey % 3 <> 0 AND 'A' || lpad(CAST(s_suppkey % 12 AS VARCHAR), 2, '0') NOT IN (SELECT code FROM codes)
UNION ALL SELECT 8, 'catastrophic list', (SELECT count(*) FROM codes WHERE ord % 40 = 0 AND ord % 3 = 0) + 1 UNION ALL SELECT 9, 'favourites', count(*) FILTER (WHERE use <> 1) FROM codes WHERE ord % 5 = 0
UNION ALL SELECT 10, 'term targets', (SELECT count(*) FROM terms WHERE ord % 100 = 7) UNION ALL SELECT 13, 'source versions', 1 UNION ALL SELECT 14, 'file names', count(*) FILTER (WHERE NOT regexp_full_match(n_name, '[A-Za-z0-9_./-]+')) FROM nation UNION ALL SELECT 16, 'garbled names', 1),
g AS (SELECT id, name, n = 0 AS passed, n || ' bad rows' AS message FROM bad UNION ALL SELECT 11, 'vocabulary size', count(*) >= 100, count(*) || ' terms' FROM terms
UNION ALL SELECT 12, 'default codes', 1 - count(*) FILTER (WHERE use <> 1 AND NOT exempt) / greatest(count(*), 1) >= 0.97, count(*) FILTER (WHERE use <> 1 AND NOT exempt) || ' of ' || count(*) FROM told
UNION ALL SELECT 15, 'fingerprint', false, left(sha256(string_agg(n_name || ':' || sha1(n_name), '' ORDER BY n_name || ':' || sha1(n_name))), 16) FROM nation)
SELECT id, name, passed, message, NOT passed AND id IN (4, 15) AS overridden FROM g""")
def validation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t, o, n = T.codes(spark, sf_dir), T.terms(spark, sf_dir), T.read(spark, sf_dir, "orders"), T.read(spark, sf_dir, "nation")
    mains, roots = _mains(spark, sf_dir)
    rows = lambda df, source: df.agg(F.lit(source).alias("source"), F.count("*").alias("n_rows"))
    before = rows(o.where("o_orderkey % 50 <> 0"), "orders").withColumnRenamed("n_rows", "rows_before")
    counts = rows(o, "orders").union(rows(n, "nation")).join(before, "source", "left").withColumn("least", F.when(F.col("source") == "nation", 90_000).otherwise(1))
    lost = F.when(F.col("ord") % 3 == 0, F.concat("code", F.lit("x"))).otherwise(F.col("code"))
    listed = c.where("ord % 40 = 0").select(lost.alias("code"), F.lit(1).alias("cat"), F.lit("named").alias("cat_name")).union(spark.sql("SELECT 'A00', 2, CAST(NULL AS STRING)"))
    names = c.withColumn("zh", F.when(F.col("code").isin("A00.1", "A01"), F.concat("zh", F.lit("?"))).otherwise(F.col("zh")))
    aimed = F.when(F.col("ord") % 100 == 7, F.lit("Z99.Z")).otherwise(F.col("code"))
    target = F.expr("if(s_suppkey % 3 = 0, null, concat('A', lpad(cast(s_suppkey % 12 as string), 2, '0')))")
    release = G.Release(
        headers=spark.sql("SELECT 'cm' AS source, 'code,use' AS got, 'code,use' AS want"),
        counts=counts,
        codes=names.select("code", "zh", "en", "use"),
        chapters=spark.sql("SELECT * FROM (VALUES ('A00', 'B99'), ('C00', 'M99')) AS t(first, last)"),
        orphans_allowed=spark.sql("SELECT 'none' AS code"),
        canaries=spark.sql("SELECT code, 'anvil' AS must_contain FROM (VALUES ('A00'), ('A01'), ('Q99')) AS t(code)"),
        garbled=spark.sql("SELECT 'A00.1' AS code"),
        edges=T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("old"), target.alias("new")),
        catastrophic=listed,
        favourites=c.where("ord % 5 = 0").select("code"),
        terms=t.withColumn("code", aimed),
        mains=mains,
        seventh=roots,
        sources=spark.sql("SELECT * FROM (VALUES ('mesh', '2023'), ('doid', ' ')) AS t(source, version)"),
        files=n.select(F.col("n_name").alias("path"), F.sha1("n_name").alias("sha")),
        fingerprint="0" * 16,
        least_terms=100,
    )
    return G.report(G.standard_gates(release), [4, 15])


# --- search steps -----------------------------------------------------------------
TYPED = "(VALUES (1, 'A00'), (2, 'b02.1 pain'), (3, 'A00-B03'), (4, 'nothing here'), (5, 'C05 D06')) AS t(qid, raw)"


@query(f"""WITH {T.CODES0}, w AS (SELECT qid, unnest(string_split(upper(raw), ' ')) AS w FROM {TYPED} WHERE qid <> 3), one AS (SELECT qid, w AS asked FROM w WHERE regexp_full_match(w, '[A-Z][0-9][0-9A-Z](\\.?[0-9A-Z]{{1,4}})?')),
hit AS (SELECT qid, code, {V.CODE_EXACT}::DOUBLE AS s, 'code' AS kind FROM one JOIN codes0 ON code = asked
 UNION ALL SELECT qid, code, {V.CODE_PREFIX} - length(code), 'code-prefix' FROM one JOIN codes0 ON left(code, 3) = left(asked, 3) AND starts_with(code, asked) AND code <> asked
 UNION ALL SELECT 3, code, {V.CODE_RANGE}, 'code-range' FROM codes0 WHERE code >= 'A00' AND (code <= 'B03' OR starts_with(code, 'B03')))
SELECT qid, code, s, kind FROM hit""")
def typed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.sql(f"SELECT * FROM {TYPED}").select("qid", R.parsed(F.col("raw")).alias("p")).select("qid", "p.codes")
    return S.code_hits(q, T.part_codes(spark, sf_dir)).select("qid", "code", F.col("s").cast("double").alias("s"), "kind")


RAW = """(VALUES (1, 'asthma "status x" -acute [noexp]'), (2, '9:E800.0'), (3, '14: L400 old'), (4, 'A00-B03.1'), (5, '696.1'), (6, 'knee [mh] l40.0'), (7, '')) AS t(id, raw)"""


@query(f"""WITH m AS (SELECT id, raw, trim(regexp_replace(raw, '(?i)\\[(mh|noexp|code)\\]', ' ', 'g')) AS q FROM {RAW}), n AS (SELECT *, CASE regexp_extract(q, '^(14|9)\\s*:', 1) WHEN '9' THEN 'icd9' WHEN '14' THEN 'icd14' END AS ns, regexp_replace(q, '^(14|9)\\s*:\\s*', '') AS r FROM m),
w AS (SELECT *, list_filter(string_split_regex(replace(r, '"', ' '), '\\s+'), lambda x: x <> '') AS ws FROM n), k AS (SELECT *, list_filter(ws, lambda x: NOT (starts_with(x, '-') AND length(x) > 1)) AS pos FROM w),
c AS (SELECT *, array_to_string(pos, ' ') AS t FROM k), d AS (SELECT *, regexp_full_match(t, '[A-Z][0-9][0-9A-Z](\\.?[0-9A-Z]{{1,4}})?\\s*-\\s*[A-Z][0-9][0-9A-Z](\\.?[0-9A-Z]{{1,4}})?') AS rng, coalesce(ns = 'icd9', false) OR regexp_full_match(t, '[0-9]{{3}}(\\.[0-9]{{1,2}})?') AS old FROM c)
SELECT id, CASE WHEN rng OR old THEN '' ELSE array_to_string(list_filter(pos, lambda x: NOT regexp_full_match(upper(x), '[A-Z][0-9][0-9A-Z](\\.?[0-9A-Z]{{1,4}})?')), ' ') END AS text,
CASE WHEN rng THEN 'range ' || replace(t, '-', ' ') WHEN old THEN 'icd9 ' || t ELSE array_to_string(list_transform(list_filter(pos, lambda x: regexp_full_match(upper(x), '[A-Z][0-9][0-9A-Z](\\.?[0-9A-Z]{{1,4}})?')), lambda x: coalesce(ns, 'cm') || ' ' || left(upper(x), 3) || '.' || substring(replace(upper(x), '.', ''), 4)), ',') END AS codes,
array_to_string(list_transform(list_filter(ws, lambda x: starts_with(x, '-') AND length(x) > 1), lambda x: substring(x, 2)), ',') AS neg, nullif(regexp_extract(raw, '"([^"]+)"', 1), '') AS phrase, contains(raw, '[mh]') AS mh, contains(raw, '[noexp]') AS noexp, ns FROM d""")
def parsed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(f"SELECT * FROM {RAW}").select("id", R.parsed(F.col("raw")).alias("p"))
    codes = F.array_join(F.transform("p.codes", lambda c: F.concat_ws(" ", c["kind"], c["code"], c["last"])), ",")
    return p.select("id", "p.text", codes.alias("codes"), F.array_join("p.neg", ",").alias("neg"), F.try_element_at("p.phrases", F.lit(1)).alias("phrase"), "p.mh", "p.noexp", "p.ns")


@query(f"""WITH {DOC_WORDS}, asked AS (SELECT * FROM (VALUES (1, ['the', 'ant']), (2, ['ant', 'zzqx']), (3, ['li'])) AS t(qid, ws)), lasts AS (SELECT qid, ws[len(ws)] AS root, len(ws) AS n FROM asked),
grown AS (SELECT DISTINCT root, token, dense_rank() OVER (PARTITION BY root ORDER BY token) AS place FROM lasts JOIN tokens ON starts_with(token, root) AND token <> root AND length(root) >= {V.PREFIX_MIN} WHERE root NOT IN (SELECT token FROM tokens))
SELECT qid, token FROM lasts JOIN grown USING (root) WHERE place <= {V.PREFIX_MOST} UNION ALL SELECT qid, root FROM lasts WHERE root IN (SELECT token FROM tokens) UNION ALL SELECT 2, token FROM tokens WHERE token = 'ant'""")
def prefix_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = document_words(spark, sf_dir).select("token").distinct()
    q = spark.sql("SELECT CAST(qid AS INT) AS qid, text FROM (VALUES (1, 'the ant'), (2, 'ant zzqx'), (3, 'li')) AS t(qid, text)")
    alts, _ = S.query_tokens(q, I.Index(None, None, tokens, None, None, None, None, None, None))
    return alts.select("qid", F.col("alt").alias("token"))


def _greedy_sql(source: str) -> str:
    """Chinese words of (id, tok, low): the longest pieces of two characters or more, left to right."""
    return f"""cut(id, tok, low, i, piece) AS (SELECT id, tok, low, 1, NULL::VARCHAR FROM {source} UNION ALL
 SELECT id, tok, low, i + greatest(1, coalesce(n, 0)), CASE WHEN n IS NOT NULL THEN substring(tok, i, n) END
 FROM (SELECT *, list_max(list_filter(generate_series(2, length(tok) - i + 1), lambda n: contains(low, substring(tok, i, CAST(n AS INTEGER))))) AS n FROM cut WHERE i <= length(tok)))"""


COVERED = "(VALUES (1, 'qwxz怪皮病zz', '皮病'), (2, 'cellulitis of leg', 'Cellulitis of left lower limb'), (3, 'asthma', 'asthma'), (4, '', 'x'), (5, '膝退化關節炎 left', '左膝退化性關節炎')) AS t(id, q, target)"


@query(f"""WITH RECURSIVE toks AS (SELECT id, unnest(list_filter(string_split_regex(lower(q), '[\\s,;/()]+'), lambda x: x <> '')) AS tok, lower(target) AS low FROM {COVERED}), han AS (SELECT * FROM toks WHERE regexp_matches(tok, '[㐀-鿿]')), {_greedy_sql('han')},
hits AS (SELECT id, sum(length(piece)) AS h FROM cut GROUP BY id UNION ALL SELECT id, sum(length(tok)) FROM toks WHERE NOT regexp_matches(tok, '[㐀-鿿]') AND contains(low, CASE WHEN length(tok) >= 6 THEN left(tok, length(tok) - 2) ELSE tok END) GROUP BY id),
n AS (SELECT id, sum(length(tok)) AS n FROM toks GROUP BY id), s AS (SELECT id, sum(h) AS h FROM hits GROUP BY id)
SELECT id, round(CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(h, 0) / n END::DOUBLE, 6) AS coverage FROM {COVERED} LEFT JOIN n USING (id) LEFT JOIN s USING (id)""")
def query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {COVERED}").select("id", F.round(R.coverage("q", "target"), 6).alias("coverage"))


SHOWN = "(VALUES (1, 'Cellulitis of left leg', 'left leg'), (2, '左膝退化性關節炎', '膝退化關節炎'), (3, 'ab cd abx', 'ab b x')) AS t(id, s, q)"


@query(f"""WITH RECURSIVE toks AS (SELECT id, unnest(list_filter(string_split_regex(lower(q), '[\\s,;/()]+'), lambda x: x <> '')) AS tok, lower(s) AS low FROM {SHOWN}), han AS (SELECT * FROM toks WHERE regexp_matches(tok, '[㐀-鿿]')), {_greedy_sql('han')},
pieces AS (SELECT DISTINCT id, low, piece FROM cut WHERE piece IS NOT NULL UNION SELECT id, low, tok FROM toks WHERE NOT regexp_matches(tok, '[㐀-鿿]') AND length(tok) >= 2),
places AS (SELECT id, low, piece, unnest(generate_series(1, length(low))) AS i FROM pieces), chars AS (SELECT DISTINCT id, unnest(generate_series(i - 1, i - 2 + length(piece))) AS c FROM places WHERE substring(low, CAST(i AS INTEGER), length(piece)) = piece),
runs AS (SELECT id, c, c - row_number() OVER (PARTITION BY id ORDER BY c) AS g FROM chars) SELECT id, CAST(min(c) AS INTEGER) AS start, CAST(max(c) + 1 AS INTEGER) AS "end" FROM runs GROUP BY id, g""")
def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {SHOWN}").select("id", F.explode(R.highlights("s", "q")).alias("h")).select("id", "h.start", "h.end")


# --- streams ----------------------------------------------------------------------
@query("SELECT event_id, event_type, user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = SW.read_events(spark, sf_dir, "events.parquet")
    twice = e.unionAll(e)  # every event arrives two times
    return SW.drain(SW.new_only(twice).select("event_id", "event_type", "user_id"), f"stream_dedup_{uuid.uuid4().hex}", "append", _folder(spark, "stream"))


@query("SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = SW.read_events(spark, sf_dir, "events.parquet")
    c = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return SW.drain(SW.enrich(e, c, "user_id").select("event_id", "c_mktsegment"), f"stream_enrich_{uuid.uuid4().hex}", "append", _folder(spark, "stream"))
