"""Exact deduplication and window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import url as U


def page_keepers(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """(url, keeper, copies) of pages that share a body: the keeper owns an article if any does, then is the earliest (fetched_at, url).

    Digests with one page drop out before anything is ranked."""
    owns = pages.join(articles.select("url").distinct().withColumn("__own", F.lit(0)), "url", "left").withColumn("__own", F.coalesce("__own", F.lit(1)))
    owns = owns.where("sha256 IS NOT NULL AND sha256 <> ''")
    best = owns.groupBy("sha256").agg(F.count("*").alias("copies"), F.min(F.struct("__own", "fetched_at", "url"))["url"].alias("keeper")).where("copies > 1")
    return owns.join(best, "sha256").select("url", "keeper", "copies")


def page_duplicates(pages: DataFrame, least_chars: int = 2048) -> DataFrame:
    """(url, duplicate_of): earliest page of the same body, if the body is long enough; an article's keeper must be one as well."""
    big = pages.where(F.octet_length("body_text") >= least_chars)
    is_article = F.col("page_kind").isin(*rules.PUBLIC_KINDS)
    first = big.groupBy("sha256").agg(F.min(F.struct("fetched_at", "url")).alias("any"), F.min(F.when(is_article, F.struct("fetched_at", "url"))).alias("article"))
    keeper = F.when(is_article, F.col("article.url")).otherwise(F.col("any.url"))
    return big.join(first, "sha256").withColumn("duplicate_of", keeper).where("duplicate_of <> url").select("url", "duplicate_of")


def article_keepers(articles: DataFrame, least: int = 200) -> DataFrame:
    """(url, keeper): same source and body text, long enough; https before http, then the smaller URL."""
    long = articles.where(F.char_length("body_text") >= least).withColumn("__h", F.sha2("body_text", 256))
    best = long.groupBy("source_id", "__h").agg(F.count("*").alias("c"), F.min(F.struct((~F.col("url").startswith("https://")).alias("plain"), "url"))["url"].alias("keeper")).where("c > 1")
    return long.join(best, ["source_id", "__h"]).where("keeper <> url").select("url", "keeper")


def visible_once(articles: DataFrame) -> DataFrame:
    """One article of each source and content (its URL where the hash is empty), the smallest URL."""
    key = F.coalesce(F.nullif("content_hash", F.lit("")), F.col("url"))
    w = Window.partitionBy("source_id", key).orderBy("url")
    return articles.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def coalesce_latest(events: DataFrame) -> DataFrame:
    """events with status 'superseded' where a later pending, unbatched event of the entity exists."""
    open_ = (F.col("status") == "pending") & F.col("batch_id").isNull()
    w = Window.partitionBy("entity_key", open_).orderBy(F.col("created_at").desc(), F.col("event_id").desc())
    return events.withColumn("__r", F.row_number().over(w)).withColumn("status", F.when(open_ & (F.col("__r") > 1), "superseded").otherwise(F.col("status"))).drop("__r")


def interleave(jobs: DataFrame, priority: str = "priority", url: str = "url", order: Column | None = None) -> DataFrame:
    """jobs with place: round-robin over hosts inside each priority."""
    host = U.host(F.col(url))
    w = Window.partitionBy(priority, "__host").orderBy(order if order is not None else F.col(url))
    return jobs.withColumn("__host", host).withColumn("place", F.row_number().over(w) - 1).orderBy(priority, "place", "__host", url).drop("__host")


def ordered_distinct(items: Column) -> Column:
    """First occurrences in order, without empties."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
