"""Mutations as new-state queries: a table and its changes give the table that follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Policy = Callable[[Column, Column], Column]


def overwrite(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def fill(old: Column, new: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.coalesce(F.nullif(new.cast("string"), F.lit("")), old.cast("string"))


def lowest(old: Column, new: Column) -> Column:
    return F.least(old, new)


def add(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def upsert(old: DataFrame, new: DataFrame, key: str, policy: dict[str, Policy] | None = None, guard: Callable[[dict[str, Column], dict[str, Column]], Column] | None = None) -> DataFrame:
    """old with the rows of new merged in by key.

    policy gives a column's value where both sides have the key (default: the
    new one); guard(old, new), if given, must hold for the new row to count at
    all. One full outer join on the key."""
    policy = policy or {}
    o = old.select(F.col(key).alias("__ok"), F.lit(True).alias("__o"), *(F.col(c).alias(f"__o_{c}") for c in old.columns if c != key))
    n = new.select(F.col(key).alias("__nk"), F.lit(True).alias("__n"), *(F.col(c).alias(f"__n_{c}") for c in old.columns if c != key))
    both = o.join(n, F.col("__ok") == F.col("__nk"), "full")
    oc, nc = ({c: F.col(f"__{p}_{c}") for c in old.columns if c != key} for p in "on")
    ok = F.coalesce(guard(oc, nc), F.lit(False)) if guard else F.lit(True)
    value = lambda c: F.when(F.col("__n").isNull(), oc[c]).when(F.col("__o").isNull(), nc[c]).when(ok, policy.get(c, overwrite)(oc[c], nc[c]).cast(old.schema[c].dataType)).otherwise(oc[c]).alias(c)
    return both.select(*(F.coalesce("__ok", "__nk").alias(key) if c == key else value(c) for c in old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it doesn't have; the first of equal new keys."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def count_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.select(key).distinct().join(old.select(key), key, "left_anti").agg(F.count("*").alias("created"))


def enqueue(frontier: DataFrame, found: DataFrame, most_attempts: int = 5, revive: bool = False) -> DataFrame:
    """frontier after found (url, source_id, depth, priority, discovered_at) is offered to it.

    New URLs are pending. A known one is revived if it failed fewer than
    most_attempts times (with `revive`, also if done or filtered by an
    incremental run); a pending one takes the higher priority."""
    f = found.groupBy("url").agg(F.max(F.struct("priority", "source_id", "depth", "discovered_at")).alias("n"))
    both = frontier.join(f.withColumnRenamed("url", "__u"), F.col("url") == F.col("__u"), "full")
    known, offered = F.col("url").isNotNull(), F.col("__u").isNotNull()
    back = (F.col("status") == "error") & (F.col("attempts") < most_attempts)
    if revive:
        back = back | (F.col("status") == "done") | ((F.col("status") == "filtered") & F.col("last_error").startswith("incremental"))
    back = F.coalesce(back, F.lit(False))
    new = {
        "url": F.coalesce("url", "__u"),
        "source_id": F.coalesce("source_id", "n.source_id"),
        "depth": F.when(~known, F.col("n.depth")).otherwise(F.col("depth")),
        "status": F.when(~known | (offered & back), "pending").otherwise(F.col("status")),
        "attempts": F.when(~known, 0).otherwise(F.col("attempts")),
        "last_error": F.when(known & ~(offered & back), F.col("last_error")),
        "discovered_at": F.coalesce("discovered_at", "n.discovered_at"),
        "priority": F.when(~known, F.col("n.priority")).when(offered & (back | (F.col("status") == "pending")), F.greatest("priority", "n.priority")).otherwise(F.col("priority")),
    }
    return both.select(*(new[c].cast(frontier.schema[c].dataType).alias(c) if c in new else F.col(c) for c in frontier.columns))


def claim(frontier: DataFrame, n: int, sources: list[str] | None = None) -> DataFrame:
    """The next n pending rows: highest priority, then least depth, then earliest. A top-n, never a full sort."""
    rows = frontier.where("status = 'pending'")
    if sources is not None:
        rows = rows.where(F.col("source_id").isin(*sources))
    return rows.orderBy(F.col("priority").desc(), "depth", "discovered_at", "url").limit(n)


def transition(frontier: DataFrame, urls: DataFrame, status: str, error: Column | None = None) -> DataFrame:
    """frontier with the URLs in a status; claiming ('processing') counts an attempt."""
    hit = frontier.join(urls.select(F.col("url").alias("__u")).distinct(), F.col("url") == F.col("__u"), "left")
    on = F.col("__u").isNotNull()
    out = {"status": F.when(on, status).otherwise(F.col("status")), "attempts": F.col("attempts") + F.when(on & F.lit(status == "processing"), 1).otherwise(0), "last_error": F.when(on, error if error is not None else F.lit(None)).otherwise(F.col("last_error"))}
    return hit.select(*(out[c].cast(frontier.schema[c].dataType).alias(c) if c in out else F.col(c) for c in frontier.columns))


def restart(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def reset_listings(frontier: DataFrame, pages: DataFrame, seeds: DataFrame, deep: int = 3) -> DataFrame:
    """For an incremental run, in this order: deep pending listings are done, shallow finished ones pending, seeds pending."""
    listing = pages.where("page_kind = 'news_listing'").select(F.col("url").alias("__l")).distinct()
    f = frontier.join(listing, F.col("url") == F.col("__l"), "left").join(seeds.select(F.col("url").alias("__s")).distinct(), F.col("url") == F.col("__s"), "left")
    is_list = F.col("__l").isNotNull()
    one = F.when(is_list & (F.col("depth") > deep) & (F.col("status") == "pending"), "done").otherwise(F.col("status"))
    two = F.when(is_list & (F.col("depth") <= deep) & one.isin("done", "error", "filtered"), "pending").otherwise(one)
    return f.withColumn("status", F.when(F.col("__s").isNotNull(), "pending").otherwise(two)).select(*frontier.columns)


def filter_frontier(frontier: DataFrame, reason: Column, priority: Column) -> DataFrame:
    """Pending rows with a reason are filtered; the others get their priority anew."""
    pending = F.col("status") == "pending"
    bad = pending & (reason != "")
    return frontier.withColumns({"status": F.when(bad, "filtered").otherwise(F.col("status")), "last_error": F.when(bad, reason).otherwise(F.col("last_error")), "priority": F.when(pending & ~bad, priority).otherwise(F.col("priority"))})


def collapse_failures(failures: DataFrame) -> DataFrame:
    """One row per URL: attempts summed onto the row of the largest id."""
    others = [c for c in failures.columns if c not in ("url", "attempts")]
    return failures.groupBy("url").agg(F.sum("attempts").alias("attempts"), F.max_by(F.struct(*others), "id").alias("r")).select("url", "attempts", *(f"r.{c}" for c in others))


def trim_excess(bridge: DataFrame, owner: str, cap: Column | int, order: list[str]) -> DataFrame:
    """Rows of each owner beyond its cap, in order."""
    w = Window.partitionBy(owner).orderBy(*order)
    return bridge.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > cap).drop("__n")
