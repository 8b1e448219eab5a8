"""Publication records and the life of their batches: normalised values, digests, protocol checks, release, requeue, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import url as U

#: Most characters of a record's fields, most items of a batch, most images.
MOST = {"title": 1_000, "author": 500, "category": 500, "summary": 20_000, "body_text": 5_000_000, "extraction_method": 200}
BATCH_ITEMS, MOST_IMAGES, MOST_ATTEMPTS = 100, 1_000, 5
#: States of items and events whose batch may still be released, and of batches that may be.
OPEN_ITEMS, OPEN_EVENTS, OPEN_BATCHES = ("pending", "uploading", "failed"), ("pending", "batched", "uploading", "failed"), ("failed", "uploading", "pending")
#: Form of a source id and of a digest.
SOURCE_ID, DIGEST = r"^[a-z0-9][a-z0-9._-]{0,63}$", r"^[0-9a-f]{64}$"


# ---------------------------------------------------------------- records


def values(articles: DataFrame) -> DataFrame:
    """articles with `record`: the fields that a revision is made of, sanitised, trimmed, bounded; empty optional ones are null.

    Fields stand in the order of their names, so that their JSON is canonical."""
    optional = lambda c: text.bounded(F.col(c), MOST[c])
    own = F.trim(text.sanitize(F.col("url")))
    fields = {
        "author": optional("author"),
        "bodyText": F.left(text.sanitize(F.col("body_text")), F.lit(MOST["body_text"])),
        "canonicalUrl": own,
        "category": optional("category"),
        "publishedAt": F.nullif("published_at", F.lit("")),
        "sourceId": F.trim(text.sanitize(F.col("source_id"))),
        "sourcePageUrl": F.coalesce(F.nullif(F.trim(text.sanitize(F.col("source_page_url"))), F.lit("")), own),
        "summary": optional("summary"),
        "title": F.coalesce(optional("title"), F.lit("")),
    }
    return articles.withColumn("record", F.struct(*(c.alias(n) for n, c in sorted(fields.items()))))


def revision(record: Column) -> Column:
    """Digest of a record's canonical JSON (names in order, nulls written); when it was seen is no part of it."""
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def image_sources(images: DataFrame, owner: str, url_col: str) -> DataFrame:
    """(owner, sources, collides): the images of each owner as digest -> URL in the order of digests; blank URLs are left out.

    collides: two URLs have one digest, which makes the record invalid."""
    rows = images.select(owner, F.trim(text.sanitize(F.col(url_col))).alias("u")).where("u <> ''").distinct().withColumn("d", F.sha2("u", 256))
    out = rows.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("d", "u"))).alias("e"), F.count_distinct("d").alias("n"))
    return out.select(owner, F.transform("e", lambda x: F.struct(x["d"].alias("digest"), x["u"].alias("url"))).alias("sources"), (F.size("e") > F.col("n")).alias("collides"))


def rejects(record: Column, revision_hash: Column, images: Column | None = None) -> Column:
    """Names of the protocol's rules that a record breaks, in a fixed order."""
    absolute = lambda c: c.rlike(r"^(?i:https?)://[^/?#]+") & (F.char_length(c) <= 2048)
    rules = {
        "source_id": record["sourceId"].rlike(SOURCE_ID),
        "canonical_url": absolute(record["canonicalUrl"]),
        "source_page_url": record["sourcePageUrl"].isNull() | absolute(record["sourcePageUrl"]),
        "revision_hash": revision_hash.rlike(DIGEST),
        "title": F.char_length(record["title"]).between(1, MOST["title"]),
        "published_at": record["publishedAt"].isNull() | F.try_to_timestamp(record["publishedAt"]).isNotNull(),
    }
    if images is not None:
        rules["image_sources"] = (F.size(images) <= MOST_IMAGES) & F.forall(images, lambda e: (e["digest"] == F.sha2(e["url"], 256)) & absolute(e["url"]))
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def payload_digest(items: DataFrame, batch: str = "batch_id", order: str = "event_id", payload: str = "payload") -> DataFrame:
    """(batch, items, digest): the digest of a batch's payloads in the order of their ids. A batch is bounded by protocol."""
    rows = F.sort_array(F.collect_list(F.struct(order, payload)))
    return items.groupBy(batch).agg(F.count("*").alias("items"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r[payload]), ","), F.lit("]")), 256).alias("digest"))


def replayable(items: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, replay): whether a batch, built anew from its items, has the digest recorded with it (batches: batch_id, payload_sha256)."""
    return batches.join(payload_digest(items), "batch_id", "left").select("batch_id", F.col("digest").eqNullSafe(F.col("payload_sha256")).alias("replay"))


# ---------------------------------------------------------------- batches


def memberships(items: DataFrame, events: DataFrame) -> DataFrame:
    """(batch_id, item_key, in_items, in_events, item_status, event_status) of all that either side says of a batch."""
    i = items.select(F.col("batch_id").alias("ib"), F.col("item_key").alias("ik"), F.col("status").alias("item_status"))
    e = events.where("batch_id IS NOT NULL").select(F.col("batch_id").alias("eb"), F.col("event_id").alias("ek"), F.col("status").alias("event_status"))
    both = i.join(e, (F.col("ib") == F.col("eb")) & (F.col("ik") == F.col("ek")), "full")
    return both.select(F.coalesce("ib", "eb").alias("batch_id"), F.coalesce("ik", "ek").alias("item_key"), F.col("ib").isNotNull().alias("in_items"), F.col("eb").isNotNull().alias("in_events"), "item_status", "event_status")


def releasable(items: DataFrame, events: DataFrame) -> DataFrame:
    """(batch_id, items, verdict): 'ok', or why a batch's events can't be released."""
    m = memberships(items, events).groupBy("batch_id").agg(
        F.count_if("in_items").alias("items"),
        F.count_if(~(F.col("in_items") & F.col("in_events"))).alias("odd"),
        F.count_if(F.col("in_items") & ~F.col("item_status").isin(*OPEN_ITEMS)).alias("closed_items"),
        F.count_if(F.col("in_events") & ~F.col("event_status").isin(*OPEN_EVENTS)).alias("closed_events"),
    )
    return m.select("batch_id", "items", F.when(F.col("odd") > 0, "membership").when(F.col("closed_items") > 0, "closed item").when(F.col("closed_events") > 0, "closed event").otherwise("ok").alias("verdict"))


def released(events: DataFrame, chosen: DataFrame) -> DataFrame:
    """events with those of the chosen batches (batch_id) open again; batches and items stay as a record."""
    gone = chosen.select(F.col("batch_id").alias("__b"))
    j = events.join(gone, F.col("batch_id") == F.col("__b"), "left")
    free = F.col("__b").isNotNull()
    return j.select(*(F.when(~free, F.col(c)).alias(c) if c in ("batch_id", "last_error") else F.when(free, "pending").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in events.columns))


def oversized(batches: DataFrame, items: DataFrame, events: DataFrame, most: int = BATCH_ITEMS) -> DataFrame:
    """(batch_id, verdict) of batches with more items than the protocol allows: 'ok' can be released."""
    state = batches.select("batch_id", F.col("status").alias("__s"))
    big = releasable(items, events).where(F.col("items") > most).join(state, "batch_id")
    return big.select("batch_id", F.when(~F.col("__s").isin(*OPEN_BATCHES), "batch status").otherwise(F.col("verdict")).alias("verdict"))


def requeue(batches: DataFrame, items: DataFrame, events: DataFrame, errors: tuple[str, ...], most_attempts: int = MOST_ATTEMPTS, force: bool = False) -> DataFrame:
    """(batch_id, action) of batches that failed for one of these local errors.

    'release': its events open again. 'retire': all its events live in other
    batches already. 'error': anything else that doesn't fit. With force, the
    number of attempts doesn't matter."""
    failed = batches.where((F.col("status") == "failed") & F.col("last_error").isin(*errors))
    failed = failed if force else failed.where(F.col("attempts") < most_attempts)
    asked = failed.select("batch_id").join(releasable(items, events), "batch_id", "left")
    elsewhere = items.select("batch_id", F.col("item_key")).join(events.select(F.col("event_id").alias("item_key"), F.col("batch_id").alias("now")), "item_key", "left")
    moved = elsewhere.groupBy("batch_id").agg(F.count_if(F.col("now").eqNullSafe(F.col("batch_id"))).alias("here"), F.count("*").alias("n"))
    known = items.select("batch_id", "item_key").join(events.select(F.col("event_id").alias("item_key")), "item_key", "left_anti").select("batch_id").distinct().withColumn("lost", F.lit(True))
    j = asked.join(moved, "batch_id", "left").join(known, "batch_id", "left")
    gone = (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("here", F.lit(0)) == 0) & F.col("lost").isNull()
    return j.select("batch_id", F.when(F.col("verdict") == "ok", "release").when(gone, "retire").otherwise("error").alias("action"))


def delivery_order(batches: DataFrame, most: int) -> DataFrame:
    """(batch_id, turn) of what goes out now: batches persisted already, oldest first, before newly claimed ones; `most` of them.

    Only the first `most` rows are ranked."""
    replay = F.col("status").isin("uploading", "failed").cast("int")
    first = batches.where(F.col("status").isin("pending", "uploading", "failed")).select("batch_id", (1 - replay).alias("claim"), "created_at").orderBy("claim", "created_at", "batch_id").limit(most)
    return first.select("batch_id", F.row_number().over(Window.orderBy("claim", "created_at", "batch_id")).alias("turn"))


def manifests(items: DataFrame, payload: str = "payload", key: str = "event_id") -> DataFrame:
    """(event, name, value) of the objects that a batch's payloads list."""
    return items.select(F.col(key).alias("event"), F.explode(F.from_json(payload, "map<string,string>")).alias("name", "value"))


def checked(events: DataFrame, most_bytes: int, payload: str = "payload", size: str = "bytes") -> DataFrame:
    """events with the error that keeps each out of any batch: invalid_event, event_too_large or null."""
    broken = F.try_parse_json(F.col(payload)).isNull()
    return events.withColumn("error", F.when(broken, "invalid_event").when(F.col(size) > most_bytes, "event_too_large"))


# ---------------------------------------------------------------- saving


def saved_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """pages after an upsert by URL: an empty date doesn't replace one, the source of a known page stays."""
    n = new.select(F.col("url").alias("__u"), *(F.col(c).alias(f"__n_{c}") for c in pages.columns if c != "url"))
    j = pages.join(n, F.col("url") == F.col("__u"), "full")
    fresh, known = F.col("__u").isNotNull(), F.col("url").isNotNull()

    def merged(c: str) -> Column:
        if c == "url":
            return F.coalesce("url", "__u").alias(c)
        if c == "source_id":
            return F.when(known, F.col(c)).otherwise(F.col(f"__n_{c}")).alias(c)
        if c == "published_at":
            return F.when(fresh, F.coalesce(F.nullif(F.col(f"__n_{c}"), F.lit("")), F.col(c))).otherwise(F.col(c)).alias(c)
        return F.when(fresh, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c)

    return j.select(*map(merged, pages.columns))


def without_lost_articles(articles: DataFrame, bridge: DataFrame, lost: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles left, bridge rows left, images that no article has any more) once the articles of `lost` are gone."""
    gone = lost.select(key).distinct()
    rest, detached = bridge.join(gone, key, "left_anti"), bridge.join(gone, key, "left_semi")
    return articles.join(gone, key, "left_anti"), rest, detached.select("image_url").distinct().join(rest.select("image_url"), "image_url", "left_anti")


def assets(pages: DataFrame, body: Column, content_type: Column) -> DataFrame:
    """(url, digest, status, error, extension) of stored responses that are documents and no markup; an empty body is an error."""
    target = F.coalesce(F.nullif("final_url", F.lit("")), "url")
    markup = F.lower(F.coalesce(content_type, F.lit(""))).rlike(r"^(?:text/html|application/xhtml|text/xml|application/xml|application/rss)")
    rows = pages.where("status = 200 AND coalesce(raw_path, '') <> ''").withColumns({"__body": body, "__doc": U.document_asset(target) & ~markup, "__target": target}).where("__doc")
    empty = F.octet_length("__body") == 0
    ext = F.regexp_extract(F.lower(U.path(F.col("__target"))), r"(\.[a-z0-9]{1,7})$", 1)
    return rows.select("url", F.when(empty, "").otherwise(F.sha2("__body", 256)).alias("digest"), F.when(empty, "error").otherwise("ok").alias("status"), F.when(empty, "empty response body").otherwise("").alias("error"), F.when(ext == "", ".bin").otherwise(ext).alias("extension"))


def late(published: Column, cutoff: Column, explicit: bool, depth: Column, known: Column) -> Column:
    """Why an incremental run leaves a link out by its date, or ''. Dates are compared, not times; no date, or none that is one, passes.

    An explicit cut-off always leaves out what is older; a source's own mark does so beyond depth 4 or for known URLs."""
    older = F.coalesce(F.to_date(F.try_to_timestamp(F.nullif(published, F.lit("")))) < F.to_date(F.try_to_timestamp(cutoff)), F.lit(False))
    reach = F.lit(True) if explicit else (depth > 4) | known
    return F.when(older & reach, F.lit("before cutoff")).otherwise(F.lit(""))


def undated(published: Column, depth: Column, document: Column, fresh: Column) -> Column:
    """Why an incremental run leaves out a link without a date, or ''."""
    none = F.coalesce(published, F.lit("")) == ""
    return F.when(none & (depth > 4), "undated deep link").when(none & document & ~fresh, "document without date hint").otherwise("")
