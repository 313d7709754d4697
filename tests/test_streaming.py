from __future__ import annotations

from termloom.streaming import windows as W


def test_new_only_drops_repeats(spark, tmp_path):
    rows = "SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2024-01-01 00:00:00', 7L, 'a', 1.0D), (1L, TIMESTAMP_NTZ'2024-01-01 00:00:00', 7L, 'a', 1.0D), (2L, TIMESTAMP_NTZ'2024-01-01 01:00:00', 7L, 'b', 2.0D) AS t(event_id, ts, user_id, event_type, value)"
    spark.sql(rows).coalesce(1).write.parquet(f"{tmp_path}/in/e.parquet")
    e = W.read_events(spark, f"{tmp_path}/in", "e.parquet")
    assert W.drain(W.new_only(e), "new_only", "append", f"{tmp_path}/ck").count() == 2


def test_enrich_joins_static(spark, tmp_path):
    spark.sql("SELECT 1L AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, 7L AS user_id, 'a' AS event_type, 1.0D AS value").write.parquet(f"{tmp_path}/in/e.parquet")
    e = W.read_events(spark, f"{tmp_path}/in", "e.parquet")
    static = spark.createDataFrame([("a", "alpha")], "event_type string, label string")
    assert W.drain(W.enrich(e, static, "event_type"), "enriched", "append", f"{tmp_path}/ck").first().label == "alpha"


def test_appended_rows_go_to_files(spark, tmp_path):
    """The memory sink keeps all rows in the driver."""
    rows = "SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, 7L AS user_id, 'a' AS event_type, 1.0D AS value FROM range({})"
    for name, n in (("some", 1000), ("none", 0)):
        spark.sql(rows.format(n)).write.parquet(f"{tmp_path}/in/{name}.parquet")
        e = W.read_events(spark, f"{tmp_path}/in", f"{name}.parquet")
        out = W.drain(W.new_only(e.unionAll(e)), f"files_{name}", "append", f"{tmp_path}/{name}")
        assert out.count() == n and out.columns == e.columns
        assert "MemoryPlan" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert n == 0 or all(f.startswith(f"file://{tmp_path}/") for f in out.inputFiles())


def test_enriched_rows_go_to_files(spark, tmp_path):
    """Every row of the stream stays, with or without a match, and none in the driver."""
    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, id % 7 AS user_id, 'a' AS event_type, 1.0D AS value FROM range(1000)").write.parquet(f"{tmp_path}/in/e.parquet")
    static = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "user_id long, label string")
    e = W.read_events(spark, f"{tmp_path}/in", "e.parquet")
    out = W.drain(W.enrich(e, static, "user_id").select("event_id", "label"), "enriched_files", "append", f"{tmp_path}/ck")
    want = spark.range(1000).selectExpr("id AS event_id", "id % 7 AS user_id").join(static, "user_id", "left").select("event_id", "label")
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    assert out.inputFiles() and "MemoryPlan" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_enrich_does_not_broadcast(spark):
    """The static table may be as large as the stream, however small its files are."""
    events = spark.sql("SELECT id AS event_id, id % 7 AS user_id FROM range(100)")
    static = spark.sql("SELECT * FROM VALUES (1L, 'x'), (2L, 'y'), (2L, 'z') AS t(user_id, label)")
    out = W.enrich(events, static, "user_id")
    assert out.count() == 114
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
