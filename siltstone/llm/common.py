"""What the operators share: scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_BASE: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary folder (tests) and any
    other master the warehouse folder, which is shared as well."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not _LOCAL_BASE:
        _LOCAL_BASE.append("file://" + tempfile.mkdtemp(prefix="siltstone-"))
    return _LOCAL_BASE[0]


_MADE: list = []


@atexit.register
def _forget() -> None:
    """Deletes what results have read from, once the driver ends; its DataFrames are gone then."""
    while _MADE:
        jvm, conf, base = _MADE.pop()
        try:
            path = jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM may have ended first
            return


class Scratch:
    """Tables of one run in the shared folder. They cut lineage and survive the loss of executors; they go when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"
        _MADE.append((spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), self.base))

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which it keeps until the driver collects its garbage."""
    for _ in range(2):  # what the first round lets go of, the second frees
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Actions in this block hand at most so many rows at once to Python.

    The JVM holds a batch outside its heap, more than once while its buffers grow by doubling, for each task: with
    whole texts, 10,000 rows are hundreds of MB beside a full heap."""
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, usual)


#: Keys that join_on_digest broadcasts, at most.
MOST_HOT = 2000


def join_on_digest(rows: DataFrame, keys: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with keys, a written table of distinct keys that says how many rows have each.

    A key that more than one in MOST_HOT of those rows have is joined where its
    rows lie, by a broadcast of at most MOST_HOT keys; no task then gathers more
    than that share of the rows under one key."""
    total = keys.agg(F.sum(count)).first()[0] or 0
    hot = keys.where(F.col(count) > max(10_000, total // MOST_HOT))
    if not hot.limit(1).count():
        return rows.join(keys, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(keys, key))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the smallest node reachable.

    Alternates large-star and small-star rounds: each is a min-aggregation and
    a join, so no neighbourhood is ever gathered in one place. Each round is
    written to the shared folder, which keeps the plan short."""
    cur = scratch.table(edges.select("a", "b").where("a != b").distinct(), f"{name}_0")
    step = 0
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a != b")
        step += 1
        mid = scratch.table(large, f"{name}_{step}")
        down = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = mid.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        step += 1
        new = scratch.table(small.select("e.a", "e.b").where("a != b").distinct(), f"{name}_{step}")
        # Done when every node points at one root and no root points anywhere.
        ends = new.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("root")), F.struct(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("root")))).alias("e"))
        open_ = ends.groupBy("e.n").agg(F.sum("e.out").alias("out"), F.max("e.root").alias("root")).where("out > 1 OR (out > 0 AND root > 0)").limit(1).count()
        scratch.drop(f"{name}_{step - 2}", f"{name}_{step - 1}")
        cur = new
        if not open_:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
