"""Cleanup and audit flows over the archive, each as a new state or a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from . import joins, upsert


def without_blocked(articles: DataFrame, blocked_hosts: DataFrame) -> DataFrame:
    """Articles whose host is no blocked host (column host) and lies under none."""
    urls = articles.select("url", F.explode(U.host_suffixes(U.host(F.col("url")))).alias("host"))
    gone = urls.join(blocked_hosts.select("host").distinct(), "host", "left_semi").select("url").distinct()
    return articles.join(gone, "url", "left_anti")


def reassigned(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles under the source that owns their host (the longest match); those that none owns are left out."""
    return joins.route_hosts(articles, sources).where("owner IS NOT NULL").withColumn("source_id", F.col("owner")).select(*articles.columns)


def relinked_media(media: DataFrame, bridge: DataFrame, bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (url, article) that bundles give orphans back, media that stay: linked or relinked)."""
    orphans = media.join(bridge.select(F.col("image_url").alias("url")), "url", "left_anti")
    found = bundles.join(orphans.select("url"), "url", "left_semi").groupBy("url").agg(F.min("article").alias("article"))
    keep = bridge.select(F.col("image_url").alias("url")).union(found.select("url")).distinct()
    return found, media.join(keep, "url", "left_semi")


def trimmed(bridge: DataFrame, articles: DataFrame, caps: DataFrame) -> DataFrame:
    """Bridge rows within their source's cap of images for an article (caps: id, cap); sources without one keep all."""
    capped = bridge.join(articles.select("doc_id", "source_id"), "doc_id").join(caps, F.col("source_id") == F.col("id"), "left")
    over = upsert.trim_excess(capped.where("cap IS NOT NULL"), "doc_id", F.col("cap"), ["created_at", "image_url"]).select("doc_id", "image_url")
    return bridge.join(over, ["doc_id", "image_url"], "left_anti")


def dry_run(articles: DataFrame, bridge: DataFrame, media: DataFrame, blocked_hosts: DataFrame, sources: DataFrame) -> DataFrame:
    """(what, before, after): what the whole cleanup leaves of articles, bridge rows and media, without writing it.

    In order: articles of blocked hosts go, articles move to the source that
    owns their host, images beyond a source's cap (sources: cap) go, media that
    no article has any more go."""
    kept, rest, used = cleaned(articles, bridge, media, blocked_hosts, sources)
    count = lambda name, a, b: a.agg(F.count("*").alias("before")).join(b.agg(F.count("*").alias("after"))).select(F.lit(name).alias("what"), "before", "after")
    return count("articles", articles, kept).unionByName(count("bridge", bridge, rest)).unionByName(count("media", media, used))


def cleaned(articles: DataFrame, bridge: DataFrame, media: DataFrame, blocked_hosts: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, bridge rows, media) after the cleanup that dry_run counts."""
    kept = reassigned(without_blocked(articles, blocked_hosts), sources)
    mine = bridge.join(kept.select("doc_id"), "doc_id", "left_semi")
    rest = trimmed(mine, kept, sources.select("id", "cap"))
    return kept, rest, media.join(rest.select(F.col("image_url").alias("url")), "url", "left_semi")


def image_jobs(bridge: DataFrame, bundles: DataFrame) -> DataFrame:
    """(image_url, articles): what to fetch, bridge rows first, then pairs that only bundles have."""
    rows = bridge.select("image_url", "article", F.lit(0).alias("o")).unionByName(bundles.select("image_url", "article", F.lit(1).alias("o")))
    once = rows.groupBy("image_url", "article").agg(F.min("o").alias("o"))
    return once.groupBy("image_url").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "article"))), lambda x: x["article"]).alias("articles"))


def mismatch_codes(**checks: Column) -> Column:
    """Codes of the checks that fail, in the order given; a check that is null fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items())))


def issues(rows: DataFrame, codes: str, sample: str, most: int) -> DataFrame:
    """(issue, count, samples): how many rows have an issue and the first of them, at most `most`."""
    each = rows.select(F.explode(codes).alias("issue"), F.col(sample).alias("s"))
    firsts = joins.first_rows(each, ["issue"], [F.col("s")], most).groupBy("issue").agg(F.array_join(F.sort_array(F.collect_list("s")), ",").alias("samples"))
    return each.groupBy("issue").agg(F.count("*").alias("count")).join(firsts, "issue")


def set_differences(stored: Column, parsed: Column) -> Column:
    return F.struct(F.array_sort(F.array_except(parsed, stored)).alias("missing"), F.array_sort(F.array_except(stored, parsed)).alias("extra"))


def resolve(requested: DataFrame, items: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(requested with the value of the item of the same keys, those that no item has)."""
    return requested.join(items.select(*keys, value), keys), requested.join(items.select(*keys), keys, "left_anti")


def cascade(events: DataFrame, batches: DataFrame, key: str = "batch_id") -> DataFrame:
    """Events with their settled batch's status; an error counts an attempt."""
    b = batches.select(F.col(key).alias("__b"), F.col("status").alias("__s"))
    j = events.join(b, F.col(key) == F.col("__b"), "left")
    return j.select(*(F.coalesce("__s", "status").alias("status") if c == "status" else (F.col("attempts") + F.when(F.col("__s") == "failed", 1).otherwise(0)).alias(c) if c == "attempts" else F.col(c) for c in events.columns))
