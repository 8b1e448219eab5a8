"""Queries of publication records, batch life, saving, skips and the small functions of URLs, text and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, text
from ..functions import url as U
from ..operators import cleanup, joins, records, upsert
from ..sources import web
from .model import CUTOFF, NOW, TABLES, TODAY, load, with_tables

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str):
    def wrap(fn):
        _Q[name] = lambda spark, sf_dir: fn(*load(spark, sf_dir, *tables))
        own = [t for t in tables if t in TABLES]
        _SQL[name] = with_tables(sql, *own) if own else sql
        return fn

    return wrap


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- records

_RECORD = """SELECT *, {'author': nullif(trim(author), ''), 'bodyText': body_text, 'canonicalUrl': url, 'category': nullif(trim(category), ''), 'publishedAt': nullif(published_at, ''), 'sourceId': source_id,
  'sourcePageUrl': coalesce(nullif(source_page_url, ''), url), 'summary': nullif(trim(summary), ''), 'title': coalesce(nullif(trim(title), ''), '')} AS record FROM articles"""


@query("publication_values", "articles", sql=f"SELECT doc_id, record.author AS author, record.category AS category, record.publishedAt AS published, record.sourcePageUrl AS page, record.title AS title, length(record.bodyText) AS chars FROM ({_RECORD}) r")
def publication_values(articles):
    r = records.values(articles)
    return r.select("doc_id", "record.author", "record.category", F.col("record.publishedAt").alias("published"), F.col("record.sourcePageUrl").alias("page"), "record.title", F.char_length("record.bodyText").cast("long").alias("chars"))


@query("revision_hash", "articles", sql=f"SELECT doc_id, sha256(CAST(to_json(record) AS VARCHAR)) AS revision FROM ({_RECORD}) r")
def revision_hash(articles):
    return records.values(articles).select("doc_id", records.revision(F.col("record")).alias("revision"))


@query("image_source_map", "article_media", sql="SELECT doc_id, string_agg(sha256(image_url) || '=' || image_url, ',' ORDER BY sha256(image_url)) AS sources FROM (SELECT DISTINCT doc_id, image_url FROM article_media) x GROUP BY 1")
def image_source_map(article_media):
    m = records.image_sources(article_media, "doc_id", "image_url").where("NOT collides")
    return m.select("doc_id", F.array_join(F.transform("sources", lambda e: F.concat(e["digest"], F.lit("="), e["url"])), ",").alias("sources"))


@query("protocol_rejects", "articles", sql="""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 9 = 0 THEN 'source_id' END, CASE WHEN doc_id % 10 = 0 THEN 'canonical_url' END, CASE WHEN coalesce(content_hash, '') = '' THEN 'revision_hash' END,
  CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN doc_id % 12 = 0 THEN 'published_at' END) AS rejects FROM articles""")
def protocol_rejects(articles):
    """Every ninth source id, tenth URL and twelfth date is spoilt."""
    every = lambda n: F.col("doc_id") % n == 0
    spoilt = articles.withColumns({"source_id": F.when(every(9), F.upper("source_id")).otherwise(F.col("source_id")), "source_page_url": F.col("url"), "published_at": F.when(every(12), F.lit("yesterday")).otherwise(F.col("published_at")), "url": F.when(every(10), F.lit("ftp://host/x")).otherwise(F.col("url"))})
    r = records.values(spoilt)
    return r.select("doc_id", F.array_join(records.rejects(F.col("record"), F.col("content_hash")), ",").alias("rejects"))


@query("batch_payloads", "outbox", sql="SELECT batch_id, count(*) AS items, sha256('[' || string_agg(payload, ',' ORDER BY event_id) || ']') AS digest FROM outbox WHERE batch_id IS NOT NULL GROUP BY 1")
def batch_payloads(o):
    return records.payload_digest(o.where("batch_id IS NOT NULL"))


@query("batch_replay", "outbox", sql="SELECT batch_id, NOT ends_with(batch_id, '30') AS replay FROM (SELECT DISTINCT batch_id FROM outbox WHERE batch_id IS NOT NULL) b")
def batch_replay(o):
    """The payload of batches whose number ends in 30 has changed since."""
    own = o.where("batch_id IS NOT NULL")
    recorded = records.payload_digest(own).select("batch_id", F.col("digest").alias("payload_sha256"))
    now = own.withColumn("payload", F.when(F.col("batch_id").endswith("30"), F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return records.replayable(now, recorded)


#: Batches of forty events; some items are missing, some closed.
_EVENTS = "ev AS (SELECT event_id, 'b' || CAST(CAST(substr(event_id, 2) AS BIGINT) // 40 AS VARCHAR) AS batch_id, CASE WHEN status = 'acked' AND CAST(substr(event_id, 2) AS BIGINT) // 40 % 3 = 0 THEN 'acked' ELSE 'batched' END AS status, created_at, last_error FROM outbox)"
_ITEMS = "it AS (SELECT batch_id, event_id AS item_key, 'pending' AS status FROM ev WHERE NOT (CAST(substr(batch_id, 2) AS BIGINT) % 4 = 1 AND ends_with(event_id, '7')))"


def _batches(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = F.substring("event_id", 2, 20).cast("long")
    b = F.floor(n / 40)
    events = o.select("event_id", F.concat(F.lit("b"), b.cast("string")).alias("batch_id"), F.when((F.col("status") == "acked") & (b % 3 == 0), "acked").otherwise("batched").alias("status"), "created_at", "last_error")
    lost = (F.substring("batch_id", 2, 20).try_cast("long") % 4 == 1) & F.col("event_id").endswith("7")
    return events, events.where(~lost).select("batch_id", F.col("event_id").alias("item_key"), F.lit("pending").alias("status"))


@query("batch_release", "outbox", sql=f"""WITH {_EVENTS}, {_ITEMS}, v AS (SELECT e.batch_id, CASE WHEN count(*) <> count(i.item_key) THEN 'membership' WHEN count_if(e.status = 'acked') > 0 THEN 'closed event' ELSE 'ok' END AS verdict FROM ev e LEFT JOIN it i ON i.item_key = e.event_id GROUP BY 1)
  SELECT event_id, CASE WHEN verdict = 'ok' THEN NULL ELSE ev.batch_id END AS batch_id, CASE WHEN verdict = 'ok' THEN 'pending' ELSE status END AS status FROM ev JOIN v ON v.batch_id = ev.batch_id""")
def batch_release(o):
    events, items = _batches(o)
    return records.released(events, records.releasable(items, events).where("verdict = 'ok'")).select("event_id", "batch_id", "status")


@query("batch_recover", "outbox", sql=f"""WITH {_EVENTS}, {_ITEMS}, v AS (SELECT e.batch_id, count(i.item_key) AS n, CASE WHEN count(*) <> count(i.item_key) THEN 'membership' WHEN count_if(e.status = 'acked') > 0 THEN 'closed event' ELSE 'ok' END AS verdict FROM ev e LEFT JOIN it i ON i.item_key = e.event_id GROUP BY 1)
  SELECT batch_id, CASE WHEN CAST(substr(batch_id, 2) AS BIGINT) % 5 = 0 THEN 'batch status' ELSE verdict END AS verdict FROM v WHERE n > 38""")
def batch_recover(o):
    events, items = _batches(o)
    batches = events.select("batch_id").distinct().withColumn("status", F.when(F.substring("batch_id", 2, 20).cast("long") % 5 == 0, "acked").otherwise("failed"))
    return records.oversized(batches, items, events, most=38)


@query("batch_requeue", "outbox", sql=f"""WITH {_EVENTS}, {_ITEMS}, now AS (SELECT event_id, CASE WHEN CAST(substr(batch_id, 2) AS BIGINT) % 7 = 2 THEN 'newer' ELSE batch_id END AS batch_id, status FROM ev),
  b AS (SELECT DISTINCT batch_id, CAST(substr(batch_id, 2) AS BIGINT) AS k FROM ev WHERE CAST(substr(batch_id, 2) AS BIGINT) % 2 = 0 AND CAST(substr(batch_id, 2) AS BIGINT) % 8 < 5),
  s AS (SELECT b.batch_id, b.k, count(*) AS n, count(i.item_key) AS items, count_if(e.status = 'acked') AS acked FROM b JOIN ev e ON e.batch_id = b.batch_id LEFT JOIN it i ON i.item_key = e.event_id GROUP BY 1, 2)
  SELECT batch_id, CASE WHEN k % 7 = 2 THEN CASE WHEN items > 0 THEN 'retire' ELSE 'error' END WHEN n <> items OR acked > 0 THEN 'error' ELSE 'release' END AS action FROM s""")
def batch_requeue(o):
    """Even batches failed locally, with as many attempts as their number modulo 8; those of 2 modulo 7 have moved on."""
    events, items = _batches(o)
    k = F.substring("batch_id", 2, 20).try_cast("long")
    batches = events.select("batch_id").distinct().select("batch_id", F.when(k % 2 == 0, "failed").otherwise("acked").alias("status"), F.lit("immutable_object_changed").alias("last_error"), (k % 8).alias("attempts"))
    now = events.withColumn("batch_id", F.when(k % 7 == 2, "newer").otherwise(F.col("batch_id")))
    return records.requeue(batches, items, now, ("immutable_object_changed",))


_BATCH_ROWS = "SELECT batch_id, min(created_at) AS created_at, CASE WHEN count_if(status = 'failed') > 0 THEN 'failed' ELSE 'pending' END AS status FROM outbox WHERE batch_id IS NOT NULL GROUP BY 1"


def _rows_of_batches(o: DataFrame) -> DataFrame:
    return o.where("batch_id IS NOT NULL").groupBy("batch_id").agg(F.min("created_at").alias("created_at"), F.when(F.count_if(F.col("status") == "failed") > 0, "failed").otherwise("pending").alias("status"))


@query("delivery_order", "outbox", sql=f"SELECT batch_id, CAST(row_number() OVER (ORDER BY CASE status WHEN 'failed' THEN 0 ELSE 1 END, created_at, batch_id) AS INTEGER) AS turn FROM ({_BATCH_ROWS}) b QUALIFY turn <= 6")
def delivery_order(o):
    return records.delivery_order(_rows_of_batches(o), 6)


@query("deliverable_batches", "outbox", sql=f"SELECT batch_id, created_at FROM ({_BATCH_ROWS}) b WHERE status = 'pending'")
def deliverable_batches(o):
    return _rows_of_batches(o).where(F.col("status").isin("pending", "uploading")).select("batch_id", "created_at").orderBy("created_at", "batch_id")


@query("batch_manifests", "outbox", sql="SELECT event_id AS event, 'k' AS name, json_extract_string(payload, '$.k') AS value FROM outbox WHERE batch_id IS NOT NULL")
def batch_manifests(o):
    return records.manifests(o.where("batch_id IS NOT NULL"))


@query("invalid_events", "outbox", sql="SELECT event_id, CASE WHEN ends_with(event_id, '4') THEN 'invalid_event' WHEN bytes > 9000 THEN 'event_too_large' END AS error FROM outbox")
def invalid_events(o):
    broken = o.withColumn("payload", F.when(F.col("event_id").endswith("4"), F.concat(F.lit("{"), "payload")).otherwise(F.col("payload")))
    return records.checked(broken, 9000).select("event_id", "error")


@query("publication_enqueue", "outbox", sql="SELECT event_id, NOT ends_with(event_id, '5') AS created FROM outbox")
def publication_enqueue(o):
    """Events that the outbox hasn't yet are created; here it has those whose number ends in 5."""
    known = o.where(F.col("event_id").endswith("5")).select(F.col("event_id").alias("__k"))
    return o.join(known, F.col("event_id") == F.col("__k"), "left").select("event_id", F.col("__k").isNull().alias("created"))


# ---------------------------------------------------------------- saving


@query("save_pages", "pages", sql="""SELECT url, source_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 0 THEN '2026-06-29' ELSE published_at END AS published_at, CASE WHEN doc_id % 2 = 0 THEN 304 ELSE status END AS status FROM pages""")
def save_pages(pages):
    """Every second page is fetched again, under another source, every tenth without a date."""
    new = pages.where("doc_id % 2 = 0").withColumns({"source_id": F.lit("other"), "status": F.lit(304), "published_at": F.when(F.col("doc_id") % 10 == 0, "").otherwise("2026-06-29")})
    return records.saved_pages(pages, new).select("url", "source_id", "published_at", "status")


@query("save_articles", "articles", sql="SELECT url, sha256(body_text || CASE WHEN doc_id % 2 = 0 THEN ' new' ELSE '' END) AS content_hash, first_seen, CASE WHEN doc_id % 2 = 0 THEN '2026-06-30' ELSE last_seen END AS last_seen FROM articles")
def save_articles(articles):
    """Sanitised and hashed anew, then merged by URL: what was seen first stays."""
    base = articles.withColumn("content_hash", text.content_hash(F.col("body_text"))).select("url", "content_hash", "first_seen", "last_seen")
    body = text.sanitize(F.concat("body_text", F.lit("\x01 new")))
    new = articles.where("doc_id % 2 = 0").select("url", text.content_hash(body).alias("content_hash"), F.lit(TODAY).alias("first_seen"), F.lit(TODAY).alias("last_seen"))
    both = base.join(new.select(F.col("url").alias("__u"), F.col("content_hash").alias("__h"), F.col("first_seen").alias("__f"), F.col("last_seen").alias("__l")), F.col("url") == F.col("__u"), "full")
    return both.select(F.coalesce("url", "__u").alias("url"), F.coalesce("__h", "content_hash").alias("content_hash"), F.least("first_seen", "__f").alias("first_seen"), F.greatest("last_seen", "__l").alias("last_seen"))


@query("lost_articles", "articles", "article_media", sql="SELECT (SELECT count(*) FROM articles WHERE doc_id % 5 <> 0) AS articles, (SELECT count(*) FROM article_media WHERE doc_id % 5 <> 0) AS bridge, (SELECT count(*) FROM (SELECT DISTINCT image_url FROM article_media WHERE doc_id % 5 = 0 EXCEPT SELECT image_url FROM article_media WHERE doc_id % 5 <> 0) x) AS detached")
def lost_articles(articles, article_media):
    """Pages of every fifth article no longer yield one."""
    kept, rest, loose = records.without_lost_articles(articles, article_media, articles.where("doc_id % 5 = 0").select("doc_id").union(article_media.where("doc_id % 5 = 0").select("doc_id")))
    one = [kept.agg(F.count("*").alias("articles")), rest.agg(F.count("*").alias("bridge")), loose.agg(F.count("*").alias("detached"))]
    return one[0].join(one[1]).join(one[2])  # frames of one row each


@query("save_assets", "pages", sql="""SELECT url, CASE WHEN doc_id % 6 = 0 THEN '' ELSE sha256(body_text) END AS digest, CASE WHEN doc_id % 6 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 6 = 0 THEN 'empty response body' ELSE '' END AS error, '.pdf' AS extension
  FROM pages WHERE status = 200 AND raw_path IS NOT NULL AND doc_id % 3 = 0 AND doc_id % 7 <> 0""")
def save_assets(pages):
    """Every third page is a PDF, every sixth an empty one; every seventh is said to be HTML."""
    p = pages.withColumn("final_url", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://www.example.edu/f/"), F.col("doc_id").cast("string"), F.lit(".pdf"))).otherwise(F.lit("https://www.example.edu/x.htm")))
    body = F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.col("body_text"))
    return records.assets(p, body, F.when(F.col("doc_id") % 7 == 0, "text/html; charset=utf-8").otherwise("application/pdf"))


@query("cleanup_flow", "articles", "sources", "article_media", "media", sql=f"""WITH hosted AS (SELECT a.*, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS h FROM articles a),
  kept AS (SELECT * FROM hosted x WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.organization_level = 'school' AND s.id LIKE '%2%' AND (x.h = s.host OR ends_with(x.h, '.' || s.host)))),
  owned AS (SELECT k.doc_id, (SELECT s.id FROM sources s WHERE s.id <> 'src5' AND (k.h = s.host OR ends_with(k.h, '.' || s.host)) ORDER BY length(s.host) DESC, s.id LIMIT 1) AS owner FROM kept k),
  mine AS (SELECT b.*, o.owner FROM article_media b JOIN owned o ON o.doc_id = b.doc_id AND o.owner IS NOT NULL),
  capped AS (SELECT doc_id, image_url FROM (SELECT m.*, s.max_images_per_page AS cap, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.created_at, m.image_url) AS n FROM mine m JOIN sources s ON s.id = m.owner) x WHERE cap IS NULL OR n <= cap)
  SELECT 'articles' AS what, (SELECT count(*) FROM articles) AS before, (SELECT count(*) FROM owned WHERE owner IS NOT NULL) AS after UNION ALL SELECT 'bridge', (SELECT count(*) FROM article_media), (SELECT count(*) FROM capped)
  UNION ALL SELECT 'media', (SELECT count(*) FROM media), (SELECT count(*) FROM media m WHERE EXISTS (SELECT 1 FROM capped c WHERE c.image_url = m.url))""")
def cleanup_flow(articles, sources, article_media, media):
    """What the whole cleanup would leave: blocked hosts, reassignment, image caps, orphans, in that order. Nothing is written."""
    return cleanup.dry_run(articles, article_media, media, sources.where("organization_level = 'school' AND id LIKE '%2%'"), sources.where("id <> 'src5'").select("id", F.array("host").alias("allowed_hosts"), F.array().cast("array<string>").alias("blocked_hosts"), F.col("max_images_per_page").alias("cap")))


@query("page_keyset", "pages", sql="SELECT url, status FROM pages WHERE url > 'https://www.src1.' AND status = 200 ORDER BY url LIMIT 500")
def page_keyset(pages):
    return pages.where("url > 'https://www.src1.' AND status = 200").select("url", "status").orderBy("url").limit(500)


@query("dashboard_extra", "pages", "frontier", sql="SELECT (SELECT count(*) FROM pages WHERE raw_path IS NOT NULL AND page_kind = 'course_resource') AS assets, (SELECT count(*) FROM frontier WHERE status = 'error') AS failures")
def dashboard_extra(pages, frontier):
    one = pages.agg(F.count_if(F.expr("raw_path IS NOT NULL AND page_kind = 'course_resource'")).alias("assets"))
    return one.join(frontier.agg(F.count_if(F.col("status") == "error").alias("failures")))  # frames of one row each


@query("audit_report", "articles", "pages", "media", "article_media", sql="""SELECT 'missing' AS section, 'title' AS key, count(*) AS value FROM articles WHERE coalesce(title, '') = '' UNION ALL SELECT 'missing', 'date', count(*) FROM articles WHERE coalesce(published_at, '') = ''
  UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*) FROM pages GROUP BY status UNION ALL SELECT 'media', status, count(*) FROM media GROUP BY status
  UNION ALL SELECT 'bridge', CASE WHEN m.url IS NULL THEN 'dangling' ELSE 'linked' END, count(*) FROM article_media b LEFT JOIN media m ON m.url = b.image_url GROUP BY 2 UNION ALL SELECT 'media', 'unreferenced', count(*) FROM media m WHERE NOT EXISTS (SELECT 1 FROM article_media b WHERE b.image_url = m.url)""")
def audit_report(articles, pages, media, article_media):
    """The sections of the audit as one table (section, key, value)."""
    row = lambda section, df, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "key", "value")
    one = lambda section, key, df: df.agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), F.lit(key).alias("key"), "value")
    bridge = article_media.join(media.select(F.col("url").alias("m")), F.col("image_url") == F.col("m"), "left")
    parts = [
        one("missing", "title", articles.where("coalesce(title, '') = ''")),
        one("missing", "date", articles.where("coalesce(published_at, '') = ''")),
        row("status", pages, F.col("status").cast("string")),
        row("media", media, F.col("status")),
        row("bridge", bridge, F.when(F.col("m").isNull(), "dangling").otherwise("linked")),
        one("media", "unreferenced", media.join(article_media.select(F.col("image_url").alias("url")), "url", "left_anti")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- skips and choices


@query("cutoff_skips", "frontier", sql=f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN substr(discovered_at, 1, 10) < '2024-01-10' AND (depth > 4 OR event_type_known) THEN 'before cutoff' ELSE '' END AS reason,
  CASE WHEN event_id % 4 <> 0 AND substr(discovered_at, 1, 10) < '2024-01-10' THEN 'before cutoff' ELSE '' END AS explicit FROM (SELECT *, status IN ('done', 'error') AS event_type_known FROM frontier) f""")
def cutoff_skips(frontier):
    """Every fourth link has no date; a URL is known once it was fetched."""
    published = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("discovered_at"))
    known, cutoff = F.col("status").isin("done", "error"), F.lit("2024-01-10T18:00:00")
    return frontier.select("event_id", records.late(published, cutoff, False, F.col("depth"), known).alias("reason"), records.late(published, cutoff, True, F.col("depth"), known).alias("explicit"))


@query("undated_skips", "frontier", sql="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' WHEN depth > 4 THEN 'undated deep link' WHEN event_id % 3 = 0 AND event_id % 9 <> 0 THEN 'document without date hint' ELSE '' END AS reason FROM frontier")
def undated_skips(frontier):
    n = F.col("event_id")
    return frontier.select("event_id", records.undated(F.when(n % 2 == 0, "2026-01-01").otherwise(""), F.col("depth"), n % 3 == 0, n % 9 == 0).alias("reason"))


@query("since_bounds", "articles", sql=f"SELECT doc_id, coalesce(CAST(TRY_CAST(nullif(published_at, '') AS TIMESTAMP) AS DATE) >= DATE '{CUTOFF}', true) AS after FROM articles")
def since_bounds(articles):
    """What a cut-off given by hand lets through: dates on or after it, and no dates."""
    return articles.select("doc_id", (records.late(F.col("published_at"), F.lit(f"{CUTOFF}T23:00:00"), True, F.lit(0), F.lit(False)) == "").alias("after"))


@query("global_quota", "frontier", sql="SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY priority DESC, event_id) AS r FROM frontier WHERE status = 'pending') f WHERE r <= 5 ORDER BY priority DESC, event_id LIMIT 40")
def global_quota(frontier):
    """At most 5 a source and 40 in all, the most urgent first."""
    return joins.first_rows(frontier.where("status = 'pending'"), ["source_id"], [F.col("priority").desc(), F.col("event_id")], 5).orderBy(F.col("priority").desc(), "event_id").limit(40).select("event_id")


@query("configured_sources", "sources", sql="SELECT id FROM sources WHERE organization_level = 'center' UNION SELECT id || '-x' FROM sources")
def configured_sources(sources):
    return sources.where("organization_level = 'center'").select("id").union(sources.select(F.concat("id", F.lit("-x")))).distinct()


@query("exit_codes", "outbox", sql="SELECT source_id, CAST(CASE WHEN count_if(status IN ('failed', 'pending')) > 0 THEN 2 ELSE 0 END AS INTEGER) AS code FROM outbox GROUP BY 1")
def exit_codes(o):
    return o.groupBy("source_id").agg(F.when(F.count_if(F.col("status").isin("failed", "pending")) > 0, 2).otherwise(0).alias("code"))


@query("retry_waits", "frontier", sql="SELECT event_id, least(power(2.0, attempts), 60.0) AS wait FROM frontier")
def retry_waits(frontier):
    return frontier.select("event_id", web.backoff(F.col("attempts")).alias("wait"))


# ---------------------------------------------------------------- functions


_H = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"


@query("url_matches", "raw_pages", sql=f"""SELECT page_id, {_H} = 'example.org' OR ends_with({_H}, '.example.org') AS ours, true AS origin, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/sitemap.xml' AS sitemap,
  regexp_replace(url, '[?#].*$', '') AS shown, sha256(url) AS digest FROM pages""")
def url_matches(pages):
    u = F.col("url")
    twin = F.concat(F.regexp_extract(u, "^([A-Za-z]+://[^/?#]+)", 1), F.lit("/other?x=1"))
    tagged = F.regexp_replace(u, "://", "://user:pw@")
    return pages.select("page_id", U.host_matches(u, F.array(F.lit("Example.org."))).alias("ours"), U.same_origin(u, twin).alias("origin"), U.sitemap_urls(u)[0].alias("sitemap"), U.safe_locator(tagged).alias("shown"), text.secret_free_url_digest(u).alias("digest"))


@query("article_urls", "frontier", sql="""SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE event_id % 4 = 1 END AS shaped, CASE event_id % 6 WHEN 0 THEN '2026-05-04' WHEN 3 THEN '2026-02-03' ELSE '' END AS day FROM frontier""")
def article_urls(frontier):
    tails = ("/2026/0504/c1a2/page.htm", "/notice/12.html", "/download/info/1.htm", "/detail/2026-02-03.htm", "/info/a?attachment_id=3", "/plain")
    u = F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, tails)), (F.col("event_id") % 6 + 1).cast("int")))
    return frontier.select("event_id", U.article_shaped(u).alias("shaped"), U.date_in_url(u).alias("day"))


@query("news_links", "raw_pages", sql="""SELECT page_id, CAST(1 + page_id % 3 AS INTEGER) AS links, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/info/' || CAST(page_id AS VARCHAR) || '/0.htm' AS first FROM pages""")
def news_links(pages):
    """Article-shaped targets of a page, at most ten, in order; here anchors are added to the page, some twice."""
    n = F.col("page_id")
    one = lambda i: F.concat(F.lit('<a href="/info/'), n.cast("string"), F.lit("/"), i.cast("string"), F.lit('.htm">x</a>'))
    more = F.array_join(F.transform(F.sequence(F.lit(0), (n % 3).cast("int")), lambda i: F.concat(one(i), one(i))), " ")
    found = U.news_links(F.concat(F.col("html"), more), F.col("url"))
    return pages.select("page_id", F.size(found).alias("links"), F.get(found, 0).alias("first"))


@query("text_bounds", "raw_documents", sql=r"""SELECT doc_id, nullif(trim(substr(trim(text), 1, 50)), '') AS bounded, CASE WHEN length(text) <= 60 THEN text WHEN length(regexp_replace(substr(text, 1, 60), '[ \t\n\r\f\v]+[^ \t\n\r\f\v]*$', '')) * 2 >= 60 THEN regexp_replace(substr(text, 1, 60), '[ \t\n\r\f\v]+[^ \t\n\r\f\v]*$', '') || '…' ELSE substr(text, 1, 60) || '…' END AS cut,
  substr(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), 1, 500) AS detail, replace(replace(substr(text, 1, 80), 'the', '[redacted]'), 'der', '[redacted]') AS redacted FROM documents""")
def text_bounds(docs):
    t = F.col("text")
    return docs.select("doc_id", text.bounded(t, 50).alias("bounded"), text.word_excerpt(t, 60).alias("cut"), text.error_detail(t).alias("detail"), text.redact(F.left(t, F.lit(80)), "the", "", "der").alias("redacted"))


@query("json_sanitize", "raw_events", sql="SELECT event_id, '{\"k\":\"a' || CAST(event_id AS VARCHAR) || '\",\"z\":[1,null,\"b\"]}' AS props FROM events")
def json_sanitize(events):
    dirty = F.concat(F.lit('{"z": [1, null, "\\u0001b"], "k\\ufeff": "a'), F.col("event_id").cast("string"), F.lit('\\u0007"}'))
    return events.select("event_id", text.sanitize_json(dirty).alias("props"))


@query("payload_kinds", "articles", sql="SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'xml' WHEN 2 THEN 'html' ELSE 'other' END AS kind FROM articles")
def payload_kinds(articles):
    n = F.col("doc_id") % 4
    body = F.when(n == 0, "  <!DOCTYPE html><p>").when(n == 1, "<?xml version='1.0'?><urlset>").otherwise(F.lit("plain"))
    return articles.select("doc_id", text.sniff(body, F.when(n == 2, "Text/HTML; charset=gbk").when(n == 3, "text/plain")).alias("kind"))


@query("decoded_bodies", "articles", sql="SELECT doc_id, '<meta charset=big5> plain ' || CAST(doc_id AS VARCHAR) AS decoded FROM articles")
def decoded_bodies(articles):
    return articles.select("doc_id", text.decode(F.concat(F.lit("<meta charset=big5> plain "), F.col("doc_id").cast("string")).cast("binary")).alias("decoded"))


@query("signature_values", "articles", sql="""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '蒋瑜香' WHEN 1 THEN '张三/李四' ELSE '' END AS name FROM articles""")
def signature_values(articles):
    raw = ("蒋瑜香/文", " 张三/李四 发布时间：2026-01-01", "http://a.b/c", "记者", "2026-01-02 10:00", "研究受国家基金资助", "x", "刘摄")
    return articles.select("doc_id", text.signature(F.element_at(F.array(*map(F.lit, raw)), (F.col("doc_id") % 8 + 1).cast("int"))).alias("name"))


@query("signature_roles", "articles", sql="SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '王五' WHEN 3 THEN '赵六' ELSE '' END AS author, CASE doc_id % 4 WHEN 0 THEN '李明' WHEN 2 THEN '黎静' ELSE '' END AS reporter, CASE doc_id % 4 WHEN 0 THEN '钱七' ELSE '' END AS editor, CASE doc_id % 4 WHEN 0 THEN '新华网' WHEN 1 THEN '物理学院' WHEN 2 THEN '本报记者 黎静' ELSE '' END AS publisher FROM articles")
def signature_roles(articles):
    ends = ("记者：王敏 记者：李明 来源：新华网 责任编辑：钱七", "作者：王五（物理学院）", "（本报记者 黎静）", "文/赵六 素材来源：网络")
    body = F.concat(F.col("body_text"), F.lit("\n"), F.element_at(F.array(*map(F.lit, ends)), (F.col("doc_id") % 4 + 1).cast("int")))
    return articles.select("doc_id", text.signatures(body).alias("s")).select("doc_id", "s.*")


@query("trailing_dates", "articles", sql=f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '2026-03-0' || CAST(1 + doc_id % 9 AS VARCHAR) ELSE '' END AS last, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '2027-01-01' END AS trusted FROM articles")
def trailing_dates(articles):
    n = F.col("doc_id")
    body = F.concat("body_text", F.when(n % 2 == 0, F.concat(F.lit("\n2026年3月"), (1 + n % 9).cast("string"), F.lit("日 "))).otherwise(F.lit(" end")))
    return articles.select("doc_id", dates.trailing(body).alias("last"), dates.trusted(F.lit("2027-01-01"), F.when(n % 3 == 0, "body").otherwise("meta"), F.lit(NOW).cast("timestamp")).alias("trusted"))


@query("fetch_outcomes", "pages", sql="SELECT url, CASE WHEN doc_id % 5 = 0 THEN 'robots_disallowed' WHEN status >= 400 THEN 'http_status' WHEN doc_id % 2 = 0 THEN 'body_size_limit' ELSE 'transport_error' END AS failure, CASE WHEN status < 300 THEN 'success' ELSE 'permanent' END AS delivery, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 WHEN status = 200 AND doc_id % 3 <> 0 THEN 2 ELSE 1 END AS INTEGER) AS media FROM pages")
def fetch_outcomes(pages):
    n = F.col("doc_id")
    media = classify.media_priority(n % 4 != 0, F.when(F.col("status") == 200, "ok").otherwise("error"), F.when(n % 3 != 0, F.lit(10)).otherwise(F.lit(9)), F.lit(10))
    return pages.select("url", classify.fetch_failure(F.col("status"), n % 5 == 0, F.when(n % 2 == 0, "body exceeds 9 bytes").otherwise("reset")).alias("failure"), classify.delivery(F.col("status")).alias("delivery"), media.alias("media"))


@query("followed_pages", "pages", sql="SELECT url, (depth = 0 OR value_score >= 16 OR page_kind IN ('news_listing', 'course_resource') OR doc_id % 10 = 9) AND doc_id % 13 <> 0 AS follow FROM pages")
def followed_pages(pages):
    n = F.col("doc_id")
    return pages.select("url", classify.should_follow(F.col("page_kind"), F.col("value_score"), F.lit(0), F.when(n % 10 == 9, 5).otherwise(4), F.col("depth"), n % 13 == 0).alias("follow"))


@query("generic_names", "articles", sql="SELECT doc_id, doc_id % 4 IN (0, 2) AS generic FROM articles")
def generic_names(articles):
    names = F.element_at(F.array(*map(F.lit, ("  News   Center ", "Physics", "首页", "news"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return articles.select("doc_id", classify.generic_name(names, ("news center", "首页")).alias("generic"))


@query("display_text", "raw_documents", sql="SELECT doc_id, replace(replace(replace(replace(replace(substr(text, 1, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS shown FROM documents")
def display_text(docs):
    return docs.select("doc_id", text.escaped(F.left("text", F.lit(200))).alias("shown"))


@query("shell_articles", "articles", sql="SELECT doc_id, doc_id % 3 = 0 AS shell FROM articles")
def shell_articles(articles):
    """Bodies whose last 1,000 characters hold a page frame's notice."""
    body = F.concat("body_text", F.when(F.col("doc_id") % 3 == 0, F.lit("\n版权所有 Copyright 2026")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" 版权所有 "), F.repeat(F.lit("x"), 1000))).otherwise(F.lit("")))
    return articles.select("doc_id", text.shell_end(body).alias("shell"))


@query("frontier_points", "frontier", sql="SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'moved' ELSE source_id END AS source_id, CASE WHEN event_id % 6 = 0 THEN 777 ELSE priority END AS priority FROM frontier")
def frontier_points(frontier):
    """Point updates by key: source and priority of some URLs."""
    new = frontier.where("event_id % 6 = 0").select("event_id", F.lit("moved").alias("source_id"), F.lit(777).alias("priority"))
    return joins.update_from(frontier, new, "event_id", ("source_id", "priority")).select("event_id", "source_id", "priority")
