"""Queries of the function library: URLs, dates, text, scores, page extraction, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, rules, text
from ..functions import url as U
from ..operators import extract
from ..sources.scratch import shared_folder
from ..streaming import incremental
from .model import NOW, load, with_tables

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None, cte: tuple[str, ...] = ()):
    def wrap(fn):
        _Q[name] = lambda spark, sf_dir: fn(*load(spark, sf_dir, *tables))
        if sql:
            _SQL[name] = with_tables(sql, *cte) if cte else sql
        return fn

    return wrap


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '[?]([^#]*)', 1)"


@query("url_parts", "raw_pages", sql=f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages")
def url_parts(pages):
    u = F.col("url")
    return pages.select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"))


@query("normalize_url_basic", "raw_pages", sql=f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE regexp_replace({_PATH}, '/+', '/', 'g') END
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src'))), '&'), ''), '') AS canonical FROM pages""")
def normalize_url_basic(pages):
    return pages.select("page_id", U.normalize_simple(F.col("url")).alias("canonical"))


# Holds for the test pages' URLs, which need no re-encoding; tests/ has others.
@query("normalize_url_exact", "raw_pages", sql=f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE regexp_replace({_PATH}, '/+', '/', 'g') END
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src'))), '&'), ''), '') AS canonical FROM pages""")
def normalize_url_exact(pages):
    return pages.select("page_id", U.normalize_url(F.col("url"), F.lit(None).cast("string")).alias("canonical"))


@query("suffix_explode", "raw_pages", sql=f"WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages) SELECT host, array_to_string(string_split(host, '.')[i:], '.') AS suffix FROM h, unnest(range(1, len(string_split(host, '.')) + 1)) AS r(i)")
def suffix_explode(pages):
    return pages.select(U.host(F.col("url")).alias("host")).distinct().select("host", F.explode(U.host_suffixes(F.col("host"))).alias("suffix"))


@query("url_flags", "frontier", cte=("frontier",), sql="""WITH u AS (SELECT url, event_id, CASE event_id % 9 WHEN 0 THEN url || '.pdf' WHEN 1 THEN url || '/search' WHEN 2 THEN url || '/download?fileid=3' WHEN 3 THEN url || '/_upload/article/files/a.html' WHEN 4 THEN url || '/login?x=1' WHEN 5 THEN url || '?sid=8' WHEN 6 THEN url || '/list?orderby=d' WHEN 7 THEN url || '/stats/' ELSE url END AS v FROM frontier)
  SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'search endpoint' WHEN 3 THEN 'uploaded HTML attachment' WHEN 4 THEN 'interactive login page' WHEN 5 THEN 'session-specific URL' WHEN 6 THEN 'sorted/paginated duplicate variant' WHEN 7 THEN 'personal/statistics endpoint' ELSE '' END AS reason,
    event_id % 9 IN (0, 3) AS asset, event_id % 9 IN (0, 2) AS document, 'http' || substr(v, 6) AS twin FROM u""")
def url_flags(frontier):
    tail = F.element_at(F.array(*map(F.lit, (".pdf", "/search", "/download?fileid=3", "/_upload/article/files/a.html", "/login?x=1", "?sid=8", "/list?orderby=d", "/stats/", ""))), (F.col("event_id") % 9 + 1).cast("int"))
    v = F.concat("url", tail)
    return frontier.select("event_id", U.low_value(v).alias("reason"), U.asset(v).alias("asset"), U.document_asset(v).alias("document"), F.element_at(U.variants(v), 2).alias("twin"))


@query("binary_payloads", "articles", cte=("articles",), sql="SELECT doc_id, doc_id % 3 = 0 AS binary_body FROM articles")
def binary_payloads(articles):
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  %PDF-1.7 "), "body_text")).otherwise(F.col("body_text"))
    return articles.select("doc_id", U.binary_payload(body.cast("binary")).alias("binary_body"))


@query("dates_in_text", "articles", cte=("articles",), sql="SELECT doc_id, coalesce(substr(nullif(published_at, ''), 1, 10), '') AS found FROM articles")
def dates_in_text(articles):
    y = F.substring("published_at", 1, 10)
    shown = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(y, "-", "/")).otherwise(F.concat(F.substring(y, 1, 4), F.lit("年"), F.substring(y, 6, 2), F.lit("月"), F.substring(y, 9, 2), F.lit("日")))
    return articles.select("doc_id", dates.parse_date_simple(F.coalesce(F.concat(F.lit("发布时间："), shown, F.lit(" x")), F.lit(""))).alias("found"))


@query("dates_exact", "articles", cte=("articles",), sql="SELECT doc_id, coalesce(published_at, '') AS found FROM articles")
def dates_exact(articles):
    return articles.select("doc_id", dates.parse_date(F.coalesce(dates.labelled(F.concat(F.lit("发布日期: "), F.col("published_at"))), F.lit(""))).alias("found"))


@query("recent_flags", "articles", cte=("articles",), sql=f"SELECT doc_id, coalesce(TRY_CAST(nullif(published_at, '') AS TIMESTAMP) >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY AND TRY_CAST(nullif(published_at, '') AS TIMESTAMP) <= TIMESTAMP '{NOW}' + INTERVAL 1 DAY, false) AS recent FROM articles")
def recent_flags(articles):
    return articles.select("doc_id", dates.within(F.col("published_at"), 365, F.lit(NOW).cast("timestamp")).alias("recent"))


@query("shanghai_time", "articles", cte=("articles",), sql="SELECT doc_id, strftime(TRY_CAST(published_at AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || '+08:00' AS published FROM articles WHERE coalesce(published_at, '') <> ''")
def shanghai_time(articles):
    return articles.where(F.coalesce("published_at", F.lit("")) != "").select("doc_id", dates.shanghai(F.col("published_at")).alias("published"))


@query("text_sanitize", "raw_documents", sql=r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS flat, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS short FROM documents")
def text_sanitize(docs):
    dirty = F.concat(F.lit("﻿\x01"), "text")
    return docs.select("doc_id", text.collapse(text.sanitize(dirty)).alias("flat"), text.excerpt(text.sanitize(dirty), 100).alias("short"))


@query("revision_event_id", "articles", cte=("articles",), sql="SELECT url, sha256(source_id || chr(10) || url || chr(10) || sha256(body_text)) AS event_id FROM articles")
def revision_event_id(articles):
    return articles.select("url", text.event_id(F.col("source_id"), F.col("url"), text.content_hash(F.col("body_text"))).alias("event_id"))


@query("json_canonical", "raw_events", sql="SELECT event_id, regexp_replace(props, '[ ]', '', 'g') AS props FROM events")
def json_canonical(events):
    return events.select("event_id", text.canonicalise_json(F.col("props")).alias("props"))


@query("attribution", "articles", cte=("articles",), sql="SELECT doc_id, 'writer ' || CAST(doc_id % 7 AS VARCHAR) AS author, 'office' AS publisher FROM articles")
def attribution(articles):
    body = F.concat("body_text", F.lit("\n（作者：writer "), (F.col("doc_id") % 7).cast("string"), F.lit(" 来源：office）"))
    return articles.select("doc_id", text.attribution(body).alias("a")).select("doc_id", "a.author", "a.publisher")


_SCORE = f"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, trim(regexp_replace(html, '<[^>]*>', '', 'g')) AS body FROM pages),
  s AS (SELECT *, regexp_matches(url || ' ' || url || ' ' || title, '(?i){rules.NEWS}') AS news, regexp_matches(url || ' ' || url || ' ' || title || ' ' || substr(body, 1, 2500), '(?i){rules.RESOURCE}') AS resource, regexp_matches(url || ' ' || url || ' ' || title, '(?i){rules.NAVIGATION}') AS nav, length(body) AS n FROM p),
  t AS (SELECT *, greatest(0, least(100, CASE WHEN news THEN 35 ELSE 0 END + CASE WHEN resource THEN 30 ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN n >= 200 THEN 10 WHEN n < 80 THEN -20 ELSE 0 END + CASE WHEN title <> '' THEN 5 ELSE 0 END + 5 - CASE WHEN nav THEN 20 ELSE 0 END - CASE WHEN page_id % 2 <> 0 AND NOT news AND NOT resource AND n < 160 THEN 10 ELSE 0 END)) AS v FROM s)
  SELECT page_id, CAST(v AS INTEGER) AS value_score, CASE WHEN v >= 70 THEN 'full_index' WHEN v >= 40 THEN 'metadata_and_assets' WHEN v >= 16 THEN 'audit_only' ELSE 'not_indexed' END AS value_tier,
    CASE WHEN news AND page_id % 2 = 0 THEN 'news_article' WHEN news THEN 'news_listing' WHEN resource THEN 'course_resource' WHEN page_id % 2 = 0 THEN 'article' WHEN nav THEN 'navigation' WHEN n < 80 THEN 'shell' ELSE 'page' END AS page_kind FROM t"""


@query("score_pages", "raw_pages", sql=_SCORE)
def score_pages(pages):
    """Scores by built-in functions only: the text between tags stands for the body."""
    body = F.trim(F.regexp_replace("html", "<[^>]*>", ""))
    s = classify.score_page(page_url=F.col("url"), now=F.lit(NOW).cast("timestamp"), title=F.regexp_extract("html", "<title>(.*?)</title>", 1), body=body, has_article=F.col("page_id") % 2 == 0)
    return pages.withColumn("s", s).select("page_id", "s.value_score", "s.value_tier", "s.page_kind")


@query("url_priority", "frontier", cte=("frontier",), sql=f"SELECT event_id, CAST(least(900, 100 + CASE WHEN regexp_matches(lower(url || ' ' || source_id), '{rules.NEWS}') THEN 400 ELSE 0 END + CASE WHEN regexp_matches(lower(url || ' ' || source_id), '{rules.RESOURCE}') THEN 180 ELSE 0 END - CASE WHEN regexp_matches(lower(url || ' ' || source_id), '{rules.NAVIGATION}') THEN 120 ELSE 0 END) AS INTEGER) AS priority FROM frontier")
def url_priority(frontier):
    return frontier.select("event_id", classify.url_priority(F.col("url"), F.col("source_id"), F.lit(""), F.lit(""), F.lit(NOW).cast("timestamp")).alias("priority"))


@query("page_title", "raw_pages", sql="SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS heading, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links FROM pages")
def page_title(pages):
    return pages.select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit('href="([^"]*)"')).cast("long").alias("links"))


# What the test pages' markup comes to: one article of a heading and paragraphs with bold text and line ends; tests/ has other pages.
_UNESCAPE = r"""regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[ \t\n\r\f]+', ' ', 'g')"""
_BODY = rf"""WITH x AS (SELECT page_id, url, html, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<h1>.*?</h1>', '') AS art, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1 FROM pages),
  b AS (SELECT *, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(art, '</?b>', '', 'g'), '</?p>|<br>'), lambda t: trim({_UNESCAPE})), lambda t: t <> ''), chr(10)) AS body, trim(list_transform([h1], lambda t: {_UNESCAPE})[1]) AS title,
    list_distinct(list_transform(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: starts_with(h, '/')), lambda h: regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || h)) AS targets FROM x)"""


@query("page_extract", "raw_pages", sql=f"SELECT url, '' AS canonical_url, title, length(body) > 180 AS is_article, '' AS published_at, CASE WHEN length(body) > 180 THEN sha256(body) ELSE '' END AS content_hash, CAST(len(targets) AS INTEGER) AS links FROM ({_BODY} SELECT * FROM b) y")
def page_extract(pages):
    fields = ("url", "canonical_url", "title", "is_article", "published_at", "content_hash")
    return extract.extract_pages(pages, fields=(*fields, "links")).select(*fields, F.size("links").alias("links"))


@query("page_markdown", "raw_pages", sql=f"SELECT url, CASE WHEN length(body) > 180 THEN array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(art, '<b>((?:[^<]|<br>)*?)(?:<br>| )*(</p>|$)', '**\\1**\\2', 'g'), '</?p>'), lambda t: regexp_replace(trim(regexp_replace(regexp_replace(list_transform([t], lambda t: {_UNESCAPE})[1], '<b> ?([^<]*?) ?</b>', '**\\1**', 'g'), '</?b>|( ?<br> ?)+$|^( ?<br> ?)+', '', 'g')), ' ?<br> ?', '  ' || chr(10), 'g')), lambda t: t <> ''), chr(10) || chr(10)) ELSE '' END AS body_markdown, CASE WHEN length(body) > 180 THEN body ELSE '' END AS body_text FROM ({_BODY} SELECT * FROM b) y")
def page_markdown(pages):
    return extract.extract_pages(pages, fields=("url", "body_markdown", "body_text"))


@query("link_graph", "raw_pages", sql=f"SELECT DISTINCT url AS source_url, unnest(targets) AS target_url FROM ({_BODY} SELECT * FROM b) y")
def link_graph(pages):
    return extract.extract_pages(pages, fields=("url", "links")).select(F.col("url").alias("source_url"), F.explode("links").alias("target_url")).distinct()


@query("retext", "raw_pages", sql=f"SELECT url, body AS body_text FROM ({_BODY} SELECT * FROM b) y WHERE length(body) > 180 AND length(url) % 3 = 0")
def retext(pages):
    """Articles whose stored text is out of date: here, every third one's."""
    a = extract.extract_pages(pages, fields=("url", "is_article", "body_html", "body_text")).where("is_article").select("url", "body_html", F.when(F.length("url") % 3 == 0, "old").otherwise(F.col("body_text")).alias("body_text"))
    return extract.retext(a)


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = shared_folder(spark, "stream")
    src = f"{base}/in"
    events.write.mode("overwrite").parquet(src)
    stream = incremental.read_events(spark, src, events)
    incremental.outbox_stream(stream, f"{base}/out", f"{base}/cp").start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.max("event_id").alias("last"))


_Q["incremental_stream"] = _incremental
_SQL["incremental_stream"] = "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, max(event_id) AS last FROM events GROUP BY 1"


def _discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first discovery over a stored edge list: event i links to 2i + 1 and 2i + 2."""
    n = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    s = lambda c: c.cast("string")
    edges = n.select(s(F.col("event_id")).alias("source_url"), F.explode(F.array(s(F.col("event_id") * 2 + 1), s(F.col("event_id") * 2 + 2))).alias("target_url")).join(n.select(s(F.col("event_id")).alias("target_url")), "target_url", "left_semi")
    return incremental.discover(edges, n.where("event_id = 0").select(s(F.col("event_id")).alias("url")), 5, shared_folder(spark, "links"))


_Q["link_discovery"] = _discover
_SQL["link_discovery"] = "WITH RECURSIVE r AS (SELECT event_id AS u, 0 AS depth FROM events WHERE event_id = 0 UNION SELECT e.event_id, r.depth + 1 FROM r JOIN events e ON e.event_id IN (2 * r.u + 1, 2 * r.u + 2) WHERE r.depth < 5) SELECT CAST(u AS VARCHAR) AS url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY u"
