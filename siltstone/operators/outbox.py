"""The outbox: coalescing, greedy batches, delivery results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import coalesce_latest

#: Items and bytes of a batch.
BATCH_ITEMS, BATCH_MOST_ITEMS, BATCH_BYTES, ENVELOPE_BYTES = 50, 100, 2 << 20, 512


def append(outbox: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outbox with the events that are new, events whose id is known with another payload)."""
    known = outbox.select(F.col("event_id").alias("__k"), F.col("payload").alias("__p"))
    both = events.dropDuplicates(["event_id"]).join(known, F.col("event_id") == F.col("__k"), "left")
    fresh = both.where("__k IS NULL").select(*events.columns)
    return outbox.unionByName(fresh.select(*outbox.columns)), both.where("__k IS NOT NULL AND NOT (payload <=> __p)").select(*events.columns)


def plan_batches(outbox: DataFrame, items: int = BATCH_ITEMS, most_bytes: int = BATCH_BYTES, lane_col: str = "source_id") -> DataFrame:
    """(event_id, lane, batch): open events of each lane in greedy batches, newest first.

    A batch takes events while their number and bytes (with the envelope) fit;
    the first that doesn't opens the next one; an event too large for any
    batch gets batch -1. Greedy packing is a fold, so each lane is one sorted
    stream; lanes run in parallel and only running sums are held."""
    items = max(1, min(items, BATCH_MOST_ITEMS))
    open_ = coalesce_latest(outbox).where("status = 'pending' AND batch_id IS NULL").select("event_id", F.col(lane_col).alias("lane"), "created_at", "bytes")

    def pack(batches):
        lane, batch, n, size = None, 0, 0, 0
        for pdf in batches:
            out = []
            for this, b in zip(pdf["lane"], pdf["bytes"]):
                if this != lane:
                    lane, batch, n, size = this, 0, 0, ENVELOPE_BYTES
                if b + ENVELOPE_BYTES > most_bytes:
                    out.append(-1)
                    continue
                if n == items or size + b > most_bytes:
                    batch, n, size = batch + 1, 0, ENVELOPE_BYTES
                n, size = n + 1, size + b
                out.append(batch)
            yield pd.DataFrame({"event_id": pdf["event_id"], "lane": pdf["lane"], "batch": out})

    return open_.repartition("lane").sortWithinPartitions("lane", F.col("created_at").desc(), F.col("event_id").desc()).mapInPandas(pack, "event_id string, lane string, batch long")


def settle(items: DataFrame) -> DataFrame:
    """(batch_id, status): acked if all items are, failed if all are, else partial."""
    acked, failed, n = F.count_if(F.col("status") == "acked"), F.count_if(F.col("status") == "failed"), F.count("*")
    return items.groupBy("batch_id").agg(F.when(acked == n, "acked").when(failed == n, "failed").otherwise("partial").alias("status"), n.alias("items"))


def object_plan(objects: DataFrame, chunk: int = 100) -> tuple[DataFrame, DataFrame]:
    """(objects by kind and digest in chunks of requests, digests recorded with several sizes).

    Chunks count objects in the order of kind and digest. Ranks are taken within a kind and digest prefix and shifted by the
    number of objects before it, so no task orders them all; there are 256 prefixes for each kind."""
    one = objects.groupBy("kind", "sha256").agg(F.min("size").alias("size"), F.count_distinct("size").alias("sizes"))
    sure = one.where("sizes = 1").withColumn("prefix", F.substr("sha256", F.lit(1), F.lit(2)))
    before = Window.orderBy("kind", "prefix").rowsBetween(Window.unboundedPreceding, -1)
    sums = sure.groupBy("kind", "prefix").agg(F.count("*").alias("n")).select("kind", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("kind", "prefix").orderBy("sha256"))
    ranked = sure.join(sums, ["kind", "prefix"]).withColumn("chunk", F.floor((F.col("before") + rank - 1) / chunk))
    return ranked.select("kind", "sha256", "size", "chunk"), one.where("sizes > 1").select("kind", "sha256", "sizes")


def broken_payloads(events: DataFrame) -> DataFrame:
    """Events whose payload no longer has the digest recorded with it."""
    return events.where(~F.sha2("payload", 256).eqNullSafe(F.col("payload_sha256")))
