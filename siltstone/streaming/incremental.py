"""Incremental state with Structured Streaming: an append-only outbox, a deduplicated frontier, keyed state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert


def read_events(spark: SparkSession, path: str, like: DataFrame, ts_col: str = "ts") -> DataFrame:
    """A file stream of events; NTZ timestamps become timestamps, which watermarks need."""
    raw = spark.readStream.schema(like.schema).parquet(path)
    return raw.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it lies."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def outbox_stream(events: DataFrame, table: str, checkpoint: str, id_col: str = "event_id", ts_col: str = "ts"):
    """Appends each event once to the Parquet folder `table`, by day: a batch leaves out ids that its days have already.

    An event's id and time go together, so only the days that a batch touches are read. Replaying a batch after a failure finds
    its ids there and adds nothing. Events without a time share a day of their own."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([id_col]).withColumn("day", F.coalesce(F.to_date(ts_col).cast("string"), F.lit("none")))
        fs, at = _folder(spark, table)
        if fs.exists(at):
            days = [r["day"] for r in fresh.select("day").distinct().collect()]
            known = [f"{table}/day={d}" for d in days if fs.exists(_folder(spark, f"{table}/day={d}")[1])]
            if known:
                fresh = fresh.join(spark.read.schema(batch.schema).parquet(*known).select(id_col), id_col, "left_anti")
        fresh.write.mode("append").partitionBy("day").parquet(table)

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def versions(spark: SparkSession, table: str) -> list[int]:
    """Versions of a state folder that were written to their end, oldest first."""
    fs, at = _folder(spark, table)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_folder(spark, f"{table}/{n}/_SUCCESS")[1]))


def latest_by_key(events: DataFrame, key: str, ts_col: str, value: str, table: str, checkpoint: str, keep: int = 2):
    """Keeps the newest value of each key in the folder `table`, a version for each batch, so that readers never see half of one.

    A batch builds on the newest whole version before its own, whatever its number, and leaves `keep` versions behind."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max(F.struct(ts_col, value)).alias("m")).select(key, f"m.{ts_col}", f"m.{value}")
        older = [v for v in versions(spark, table) if v < epoch]
        if older:
            old = spark.read.schema(new.schema).parquet(f"{table}/v={older[-1]}")
            new = upsert.upsert(old, new, key, guard=lambda o, n: n[ts_col] >= o[ts_col])
        new.write.mode("overwrite").parquet(f"{table}/v={epoch}")
        for v in older[: max(0, len(older) + 1 - keep)]:
            fs, at = _folder(spark, f"{table}/v={v}")
            fs.delete(at, True)

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def windowed_counts(events: DataFrame, ts_col: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window, with a watermark that bounds state."""
    return events.withWatermark(ts_col, late).groupBy(F.window(ts_col, width), "event_type").agg(F.count("*").alias("n"))


def run_totals(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Running number and newest id of each key, as custom keyed state."""

    def update(k, frames, state):
        n, last = state.get if state.exists else (0, -1)
        for pdf in frames:
            n, last = n + len(pdf), max(last, int(pdf["event_id"].max()))
        state.update((n, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last_event": [last]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, last_event long", "n long, last long", "update", "NoTimeout")


def discover(edges: DataFrame, seeds: DataFrame, max_depth: int, scratch: str) -> DataFrame:
    """(url, depth) reachable over links (source_url, target_url) from seeds, least depth first.

    One join and one anti-join a level; each level is written under `scratch`, so plans stay short."""
    spark = edges.sparkSession
    base = f"{scratch}/discover-{uuid.uuid4().hex}"
    seeds.select("url").distinct().withColumn("depth", F.lit(0)).write.parquet(f"{base}/0")
    read = lambda *levels: spark.read.schema("url string, depth int").parquet(*(f"{base}/{n}" for n in levels))
    for depth in range(1, max_depth + 1):
        found = read(depth - 1).join(edges, F.col("url") == F.col("source_url")).select(F.col("target_url").alias("url")).distinct()
        found.join(read(*range(depth)).select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).write.parquet(f"{base}/{depth}")
        if not read(depth).limit(1).count():
            return read(*range(depth + 1))
    return read(*range(max_depth + 1))
