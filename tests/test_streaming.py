from pyspark.sql import functions as F

from siltstone.streaming import incremental


def test_outbox_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(10).select(F.col("id").alias("event_id"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    rows.write.mode("append").parquet(src)
    run = lambda cp: incremental.outbox_stream(incremental.read_events(spark, src, rows), out, str(tmp_path / cp)).start().awaitTermination()
    run("a")
    rows.union(rows.select(F.col("event_id") + 5, "ts")).write.mode("append").parquet(src)
    run("a")
    run("b")  # all anew, as after a lost checkpoint
    assert spark.read.parquet(out).count() == spark.read.parquet(out).select("event_id").distinct().count() == 15


def test_latest_by_key(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = lambda *x: spark.createDataFrame(x, "k long, ts timestamp_ntz, v string")
    from datetime import datetime as d

    a = rows((1, d(2026, 1, 2), "new"), (1, d(2026, 1, 1), "old"), (2, d(2026, 1, 1), "x"))
    a.write.mode("append").parquet(src)
    run = lambda: incremental.latest_by_key(incremental.read_events(spark, src, a), "k", "ts", "v", str(tmp_path / "t"), str(tmp_path / "cp")).start().awaitTermination()
    run()
    rows((1, d(2025, 1, 1), "late"), (2, d(2026, 3, 1), "y")).write.mode("append").parquet(src)
    run()
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()} == {1: "new", 2: "y"}


def test_keyed_state_and_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(src)
    stream = incremental.read_events(spark, src, rows)
    q = incremental.run_totals(stream).writeStream.format("memory").queryName("totals").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["user_id"], r["n"], r["last_event"]) for r in spark.table("totals").collect()} == {(0, 7, 18), (1, 7, 19), (2, 6, 17)}
    q = incremental.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("windows").collect()] == [20]
