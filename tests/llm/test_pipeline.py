"""The pipeline's stages, one after the other, against what each must do."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline as P
from termloom.llm import decontam, neardup, pii, queries

from .fixtures import documents


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_dedup", "benchmark_decontamination", "personal_data", "best_fit_packing"]
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [*queries.QUERIES]


def test_pipeline_keeps_what_it_should(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [d]
    for name, stage in P.STAGES:
        out = stage(spark, seen[-1], sf).cache()
        if name != "best_fit_packing":
            assert out.columns == P.COLUMNS
        seen.append(out)
    quality, distinct, clean, masked, packed = seen[1:]
    assert 0 < quality.count() < d.count()
    kept = {r.doc_id for r in neardup.near_duplicates(spark, quality).where("kept").collect()}
    assert {r.doc_id for r in distinct.collect()} == kept
    leaks = {r.doc_id for r in decontam.contaminated(spark, distinct, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == kept - leaks
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        assert r.text == pii.mask(before[r.doc_id], pii.find(before[r.doc_id])) and r.n_chars == len(r.text)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(before)


def test_one_row_of_each_group_stays(spark, sf):
    """Also of rows that share a doc_id or have none."""
    words = " ".join(f"w{i}" for i in range(60))
    near = words.replace("w30", "other")
    own = " ".join(f"x{i}" for i in range(60))
    rows = [(5, words, "en", "a"), (7, near, "en", "a"), (None, words, "en", "a"), (None, own, "en", "a"), (None, own, "en", "a"), (9, own + " y", "en", "a"), (9, "another text", "en", "a"), (9, "another text", "en", "a"), (None, None, "en", "a"), (11, "", "en", "a")]
    got = sorted(((r.doc_id, r.text) for r in P.keep_distinct(spark, documents(spark, rows).select(*P.COLUMNS), sf).collect()), key=str)
    of_own = [x for x in got if x[1] and x[1].startswith("x0")]
    assert len(of_own) == 1 and of_own[0] in [(None, own), (9, own + " y")]
    assert sorted([x for x in got if x not in of_own], key=str) == sorted([(5, words), (9, "another text"), (None, None), (11, "")], key=str)


def test_stages_on_odd_rows(spark, sf):
    docs = documents(spark).select(*P.COLUMNS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(want)
