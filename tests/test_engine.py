"""Search, gates, sources, sinks on small fixtures."""

from __future__ import annotations

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F, types as T

from termloom.operators import gates as G, index as I, search as S
from termloom.operators.hierarchy import lca, pairs_by_key, prefix_join
from termloom.plans import retrieval
from termloom.sources import readers, sinks


@pytest.fixture(scope="module")
def ix(spark):
    codes = spark.createDataFrame(
        [
            (0, "L20", "異位性皮膚炎", "Atopic dermatitis", 0),
            (1, "L20.9", "異位性皮膚炎", "Atopic dermatitis, unspecified", 1),
            (2, "L03", "蜂窩組織炎", "Cellulitis and acute lymphangitis", 0),
            (3, "L03.90", "蜂窩組織炎", "Cellulitis, unspecified", 1),
            (4, "L03.115", "右側下肢蜂窩組織炎", "Cellulitis of right lower limb", 1),
            (5, "L03.116", "左側下肢蜂窩組織炎", "Cellulitis of left lower limb", 1),
            (6, "R65.20", "未伴有敗血性休克", "Severe sepsis without septic shock", 1),
            (7, "R65.21", "伴有敗血性休克", "Severe sepsis with septic shock", 1),
            (8, "J45", "氣喘", "Asthma", 1),
        ],
        "ord long, code string, zh string, en string, use int",
    )
    terms = spark.createDataFrame(
        [("Dermatitis, atopic", "L20.9", 1, 0, 0), ("Cellulitis of leg", "L03.90", 1, 0, 1), ("Eczema", "L20", 7, 0, 2), ("AD", "L20.9", 12, 0, 3)], "text string, code string, src_id int, flags int, ord long"
    )
    return I.build(spark, codes, terms, spark.createDataFrame([("ad", "atopic dermatitis")], "short string, long string"))


def test_search(spark, ix):
    asked = [
        (1, "atopic dermatitis"),
        (2, "cellulitis of left leg"),
        (3, "dermatits atopic"),
        (4, "septic shock"),
        (5, "L03"),
        (6, "asthma -asthma"),
        (7, "喘"),
        (8, ""),
        (9, None),
        (10, "L03-L20"),
        (11, "蜂窩組織炎"),
    ]
    rows = S.search(spark.createDataFrame(asked, "qid long, raw string"), ix, 5).collect()
    top = {r.qid: r.code for r in rows if r["rank"] == 1}
    assert [(r.code, r["def"]) for r in sorted(rows, key=lambda r: r["rank"]) if r.qid == 1][:2] == [("L20", False), ("L20.9", True)]
    assert top[2] == "L03.116"
    assert top[3] == "L20"
    assert top[4] == "R65.21"
    assert top[5] == "L03"
    assert top[7] == "J45"
    assert {r.code for r in rows if r.qid == 10} >= {"L03.115", "L20.9"}
    assert top[11].startswith("L03")
    assert not {6, 8, 9} & set(top)
    assert all(r.why is not None for r in rows)


def test_empty_queries(spark, ix):
    assert S.search(spark.createDataFrame([], "qid long, raw string"), ix).count() == 0


def test_prefix_join_is_an_equi_join(spark, ix):
    roots = spark.createDataFrame([("L03",), ("L03.1",)], "root string")
    joined = prefix_join(roots, "root", ix.codes.select("code"), "code")
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
    assert sorted(map(tuple, joined.collect())) == [("L03", c) for c in ("L03", "L03.115", "L03.116", "L03.90")] + [("L03.1", c) for c in ("L03.115", "L03.116")]


def test_lca(spark, ix):
    m = spark.createDataFrame([(1, "L03.115"), (1, "L03.90"), (2, "L20.9"), (3, "L03"), (3, "R65.20")], "k int, code string")
    assert dict(map(tuple, lca(m, ix.codes, "k").collect())) == {1: "L03", 2: "L20.9", 3: None}


def test_gates_fail_closed(spark, tmp_path):
    df = spark.range(3)
    good, bad = G.gate(df, 1, "good", F.col("id") < 0), G.gate(df, 2, "bad", F.col("id") > 1)
    with pytest.raises(ValueError, match="2 bad: 1 bad rows"):
        G.require(G.report([good, bad]))
    G.require(G.report([good, bad], [2]))
    df.write.parquet(f"{tmp_path}/new")
    with pytest.raises(ValueError):
        sinks.promote(spark, f"{tmp_path}/new", f"{tmp_path}/live", G.report([bad]))
    sinks.promote(spark, f"{tmp_path}/new", f"{tmp_path}/live", G.report([good]))
    assert spark.read.parquet(f"{tmp_path}/live").count() == 3
    counts = spark.createDataFrame([("a", 3)], "source string, n_rows long")
    files = spark.createDataFrame([("x", "1")], "path string, sha string")
    sinks.snapshot(spark, f"{tmp_path}/runs", "2026-01-01", counts, files, G.report([good]))
    assert spark.read.parquet(f"{tmp_path}/runs").first().n_rows == {"a": 3}


def test_sharded_sink_prunes(spark, ix, tmp_path):
    sinks.write_sharded(ix.codes.select("code", "en"), f"{tmp_path}/s", files=4)
    back = spark.read.parquet(f"{tmp_path}/s")
    plan = back.where("shard = 'L'")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and back.where("shard = 'L'").count() == 6


def test_lists(spark, ix):
    out = sinks.export_list(ix.codes.where("ord < 2"), "ord").first().value
    back = sinks.import_list(spark.createDataFrame([(out,), ("other:L20",)], "value string"), ix.codes)
    assert sorted(r.code for r in back.collect()) == ["L20", "L20.9"]


def test_csv_contract(spark, tmp_path):
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("use", T.IntegerType())])
    (tmp_path / "a.csv").write_text("﻿code,use\nL40,1\n", encoding="utf-8")
    assert readers.csv_contract(spark, f"{tmp_path}/a.csv", schema).collect()[0].use == 1
    (tmp_path / "b.csv").write_text("code,used\nL40,1\n")
    with pytest.raises(ValueError):
        readers.csv_contract(spark, f"{tmp_path}/b.csv", schema)
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "1.csv").write_text("code,use\nL40,1\n")
    (folder / "2.csv").write_text('"code","use"\r\nL41,2\r\n')
    assert sorted(r.use for r in readers.csv_contract(spark, str(folder), schema).collect()) == [1, 2]
    (folder / "3.csv").write_text("use,code\n3,L42\n")
    with pytest.raises(ValueError, match="3.csv"):
        readers.csv_contract(spark, str(folder), schema)


def test_xml_terms(spark, tmp_path):
    (tmp_path / "i.xml").write_text("<r><mainTerm><title>Gear <nemod>(cast)</nemod> <nemod>(old)</nemod></title><code>A00</code><term><title>steel</title><code>A01</code><term><title>large</title><see>Bolt</see></term></term></mainTerm></r>")
    rows = sorted(map(tuple, readers.xml_terms(spark, f"{tmp_path}/i.xml").collect()))
    assert rows == [(["Gear"], "A00", None, "cast old"), (["Gear", "steel"], "A01", None, ""), (["Gear", "steel", "large"], None, "Bolt", "")]


def test_obo(spark, tmp_path):
    (tmp_path / "d.obo").write_text('format: 1\n[Term]\nid: D:1\nname: asthma\nsynonym: "wheeze" EXACT []\nxref: X:1\n[Term]\nid: D:2\nname: old\nis_obsolete: true\n')
    rows = readers.obo_terms(spark, f"{tmp_path}/d.obo").collect()
    assert [(r.id, r.name, r.xrefs, r.synonyms) for r in rows] == [("D:1", "asthma", ["X:1"], ["wheeze"])]


def test_ods(spark, tmp_path):
    ns = 'xmlns:office="o" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = "<table:table-cell{}><text:p>{}</text:p></table:table-cell>"
    content = f'<d {ns}><table:table table:name="S"><table:table-row>{cell.format("", "a")}{cell.format(" table:number-columns-repeated=\"2\"", "b")}</table:table-row></table:table></d>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("content.xml", content)
    (tmp_path / "x.ods").write_bytes(buf.getvalue())
    assert readers.ods_rows(spark, f"{tmp_path}/x.ods").first().cells == ["a", "b", "b"]


def test_curated(spark, tmp_path):
    (tmp_path / "c.yaml").write_text('# list\n- {term: "異位", codes: [L20.9, L20], approved: true, note: x}\n- {term: AD, codes: [L20.9], expand: atopic dermatitis, approved: false}\n')
    a, b = readers.curated(spark, f"{tmp_path}/c.yaml").collect()
    assert (a.term, a.codes, a.approved) == ("異位", ["L20.9", "L20"], True) and (b.expand, b.approved) == ("atopic dermatitis", False)


def test_bundle(spark):
    df = spark.createDataFrame([("a.json", "{}"), ("b.js", "x</script>")], "path string, content string")
    assert sinks.bundle(df).count() == 2 and sinks.unsafe_tokens(df).first().path == "b.js"


def test_pairs_by_key_deals_by_pairs(spark):
    left = spark.createDataFrame([("a" if i % 10 else "b", i) for i in range(400)] + [(None, 1), ("c", 2)], "k string, x int")
    right = spark.createDataFrame([("a" if i % 10 else "b", i % 50) for i in range(300)] + [(None, 1), ("d", 2)], "k string, y int")
    got = pairs_by_key(left, right, "k", 1000)
    assert sorted(got.select("k", "x", "y").collect()) == sorted(left.join(right, "k").collect())
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < 0.2 * sum(sizes)  # "a" has nearly all of the pairs


def parts(spark, folder):
    """Parts of few names, and an id that stands twice, with two names."""
    rows = [(i, ["red bolt", "old ring"][i % 2], "T", i % 50) for i in range(600)] + [(7, "red bolt", "T", 3), (5000, None, "T", 4)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")


def by_sql(name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return con.execute(retrieval.ORACLES[name])


def test_whole_atm_merges_once_for_all_that_ask_the_same(spark, tmp_path):
    parts(spark, tmp_path)
    got = retrieval.whole_atm(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [qid" not in plan.replace("#", " ").split("Join")[0]  # no row of the result goes through an aggregate
    rel = by_sql("whole_atm", tmp_path)
    want = sorted((q, c, round(float(s), 4), n) for q, c, s, n in rel.fetchall())
    assert sorted(map(tuple, got.collect())) == want


def test_phrase_key_match_deals_by_pairs(spark, tmp_path):
    parts(spark, tmp_path)
    got = retrieval.phrase_key_match(spark, str(tmp_path))
    assert "_g" in got._jdf.queryExecution().optimizedPlan().toString()  # few names: tasks are dealt by pairs, not by name
    assert sorted(map(tuple, got.collect())) == sorted(by_sql("phrase_key_match", tmp_path).fetchall())


def sent(df):
    """Rows over all exchanges of a plan that has run."""
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        x = todo.pop()
        kind = x.getClass().getSimpleName()
        n += x.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        below = x.children()
        todo += [x.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [x.plan()] if kind.endswith("QueryStageExec") else [below.apply(i) for i in range(below.size())]
    return n


def test_pairs_by_key_sends_blocks(spark):
    left = spark.range(600).selectExpr("'a' as k", "id as x")
    right = spark.range(600).selectExpr("'a' as k", "id as y", "if(id % 3 = 0, null, 'v') as z")
    got = pairs_by_key(left, right, "k", 1024)
    assert len({(r.x, r.y) for r in got.collect() if (r.z is None) == (r.y % 3 == 0)}) == 360_000
    assert sent(got) < 3_000  # not each row to each of 352 groups


def test_pairs_by_key_parts_equal_rows(spark):
    left, right = spark.range(600).selectExpr("'a' as k", "1 as x"), spark.range(600).selectExpr("'a' as k", "2 as y")
    sizes = pairs_by_key(left, right, "k", 1024).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 360_000 and max(sizes) < 36_000


def test_pairs_by_key_of_several_slices(spark):
    left, right = spark.range(40).selectExpr("id % 2 as k", "id as x"), spark.range(1700).selectExpr("id % 2 as k", "id as y")
    got = pairs_by_key(left, right, "k", 1 << 20)  # 850 right rows in four slices
    assert {tuple(r) for r in got.collect()} == {(y % 2, x, y) for y in range(1700) for x in range(y % 2, 40, 2)} and got.count() == 34_000


def test_whole_atm_looks_up_the_beginnings_of_codes(spark, tmp_path, monkeypatch):
    parts(spark, tmp_path)
    monkeypatch.setattr(retrieval.S, "prefix_join", None)  # it tries all codes of a stem with each other
    ran = []
    monkeypatch.setattr(retrieval, "pairs_by_key", lambda a, b, k: ran.append(pairs_by_key(a, b, k, 1024)) or ran[0])
    got = retrieval.whole_atm(spark, str(tmp_path))
    want = sorted((q, c, round(float(s), 4), n) for q, c, s, n in by_sql("whole_atm", tmp_path).fetchall())
    assert sorted(map(tuple, got.collect())) == want
    assert sent(ran[0]) < 10_000  # each candidate to a group of 32 queries, not to each group
