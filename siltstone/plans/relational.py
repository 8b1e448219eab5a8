"""Queries over the archive's tables: predicates, paging, joins, deduplication, aggregates, windows, new states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, rules
from ..functions import url as U
from ..operators import dedup, joins, outbox, upsert
from .model import CUTOFF, NOW, TODAY, load, with_tables

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Registers fn(spark, *tables) under a name, with its SQL over the same tables."""

    def wrap(fn):
        _Q[name] = lambda spark, sf_dir: fn(*load(spark, sf_dir, *tables))
        if sql:
            _SQL[name] = with_tables(sql, *(t for t in tables if t in _MODEL)) if any(t in _MODEL for t in tables) else sql
        return fn

    return wrap


from .model import TABLES as _MODEL  # noqa: E402


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _kind_case(u: str = "lower(concat_ws(' ', a.url, coalesce(a.source_page_url, ''), coalesce(p.url, ''), coalesce(p.final_url, ''), coalesce(p.canonical_url, '')))") -> str:
    t, c = "coalesce(a.title, '')", "coalesce(a.category, '')"
    has = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
    rep = f"NOT {has(t, rules.REPORTAGE_WORDS)}"
    return f"""CASE WHEN a.publication_type IN ('news', 'notice', 'other') THEN a.publication_type
      WHEN contains({u}, '{rules.VIDEO_PATH}') OR lower(trim({t})) = 'faculty' OR lower(trim({c})) IN ('视频中心', '视频专访') THEN 'other'
      WHEN {has(u, rules.NOTICE_URL_PARTS)} OR {has(c, rules.NOTICE_CATEGORY_WORDS)} OR {has(t, rules.NOTICE_TITLE_WORDS)}
        OR ((contains({t}, '的通知') OR ends_with({t}, '通知') OR contains({t}, '通知：')) AND NOT contains({t}, '通知书')) OR contains({t}, '时刻表')
        OR ({rep} AND (contains({t}, '通告') OR contains({t}, '补充规定') OR (contains({t}, '招生') AND {has(t, rules.ADMISSION_WORDS)}) OR (contains({t}, '复试') AND {has(t, rules.RETEST_WORDS)}))) THEN 'notice'
      WHEN coalesce(p.page_kind, '') IN ('course_resource', 'document', 'asset', 'unknown') THEN 'other' ELSE 'news' END"""


_VISIBLE = f"""SELECT a.*, s.name AS source_name, {_kind_case()} AS kind, row_number() OVER (PARTITION BY a.source_id, coalesce(nullif(a.content_hash, ''), a.url) ORDER BY a.url) AS r
  FROM articles a JOIN sources s ON s.id = a.source_id LEFT JOIN pages p ON p.url = coalesce(nullif(a.source_page_url, ''), a.url)
  WHERE NOT s.discovery_only AND (p.url IS NULL OR (coalesce(p.page_kind, '') IN ('news_article', 'article') AND coalesce(p.duplicate_of, '') = ''))"""


def visible_news(sources: DataFrame, articles: DataFrame, pages: DataFrame, text: str = "", source_id: str = "", kind: str = "") -> DataFrame:
    """Publications that the list shows: visible sources and pages, filtered, one of each content, then by type."""
    p = pages.select(F.col("url").alias("p_url"), "final_url", "canonical_url", "page_kind", "duplicate_of")
    s = sources.where(~F.col("discovery_only")).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    a = articles.where(F.col("source_id") == source_id) if source_id else articles
    if text:
        a = a.where(F.col("title").ilike(f"%{text}%") | F.col("summary").ilike(f"%{text}%") | F.col("body_text").ilike(f"%{text}%"))
    rows = a.join(s, "source_id").withColumn("__page", F.coalesce(F.nullif("source_page_url", F.lit("")), "url")).join(p, F.col("__page") == F.col("p_url"), "left")
    rows = rows.where(F.col("p_url").isNull() | (F.col("page_kind").isin(*rules.PUBLIC_KINDS) & (F.coalesce("duplicate_of", F.lit("")) == "")))
    rows = rows.withColumn("publication_type", classify.publication_type(page_url=F.col("url"), source_id=F.col("source_id"), title=F.col("title"), category=F.col("category"), page_kind=F.col("page_kind"), other_urls=(F.col("source_page_url"), F.col("p_url"), F.col("final_url"), F.col("canonical_url")), stored=F.col("publication_type")))
    rows = dedup.visible_once(rows)
    return rows.where(F.col("publication_type") == kind) if kind in ("news", "notice") else rows


_COLS = ("url", "source_id", "source_name", "title", "author", "published_at", "category", "summary", "excerpt", "publication_type")


@query("news_page", "sources", "articles", "pages", sql=f"""SELECT url, source_id, source_name, title, author, published_at, category, summary, substr(body_text, 1, 240) AS excerpt, kind AS publication_type FROM ({_VISIBLE}) v WHERE r = 1
  ORDER BY published_at DESC NULLS LAST, url LIMIT 30 OFFSET 30""")
def news_page(sources, articles, pages, page: int = 2, size: int = 30):
    page, size = max(1, page), max(1, min(size, 100))
    rows = visible_news(sources, articles, pages).withColumn("excerpt", F.substring("body_text", 1, 240))
    return rows.select(*_COLS).orderBy(F.col("published_at").desc_nulls_last(), "url").offset((page - 1) * size).limit(size)


@query("news_count", "sources", "articles", "pages", sql=f"SELECT count(*) AS total FROM ({_VISIBLE}) v WHERE r = 1 AND kind = 'notice'")
def news_count(sources, articles, pages):
    return visible_news(sources, articles, pages, kind="notice").agg(F.count("*").alias("total"))


@query("search_articles", "sources", "articles", "pages", sql=f"SELECT url, kind AS publication_type FROM (SELECT * FROM ({_VISIBLE} AND (a.title ILIKE '%THAN%' OR a.summary ILIKE '%THAN%' OR a.body_text ILIKE '%THAN%')) v WHERE r = 1) w")
def search_articles(sources, articles, pages):
    return visible_news(sources, articles, pages, text="THAN").select("url", "publication_type")


@query("article_detail", "sources", "articles", "article_media", "media", sql="""SELECT a.url, s.name AS source_name, m.image_url, m.alt, d.mime_type, d.status FROM articles a JOIN sources s ON s.id = a.source_id JOIN article_media m ON m.doc_id = a.doc_id
  LEFT JOIN media d ON d.url = m.image_url WHERE NOT s.discovery_only""")
def article_detail(sources, articles, article_media, media):
    m = article_media.join(media.select(F.col("url").alias("image_url"), "mime_type", "status"), "image_url", "left")
    return articles.join(sources.where(~F.col("discovery_only")), articles["source_id"] == sources["id"]).join(m, "doc_id").select("url", F.col("name").alias("source_name"), "image_url", "alt", "mime_type", "status")


@query("summary_counts", "sources", "frontier", "pages", "articles", "media", "article_media", sql=f"""SELECT (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM frontier) AS frontier, (SELECT count(*) FROM frontier WHERE status = 'pending') AS pending, (SELECT count(*) FROM frontier WHERE status = 'filtered') AS filtered,
  (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages WHERE value_score >= 16) AS pages_indexable, (SELECT count(*) FROM pages WHERE page_kind = 'news_article') AS news_pages,
  (SELECT count(*) FROM pages WHERE page_kind = 'news_article' AND value_score >= 40 AND coalesce(duplicate_of, '') = '') AS news_indexable,
  (SELECT count(*) FROM pages WHERE page_kind = 'news_article' AND published_at >= '{CUTOFF}' AND published_at <= '{TODAY}' AND value_score >= 40 AND coalesce(duplicate_of, '') = '') AS recent_news,
  (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM articles WHERE published_at >= '{CUTOFF}' AND published_at <= '{TODAY}') AS recent_articles, (SELECT count(*) FROM media) AS media, (SELECT count(*) FROM media WHERE status = 'ok') AS media_ok,
  (SELECT count(*) FROM article_media) AS article_media, (SELECT max(fetched_at) FROM pages) AS last_fetched""")
def summary_counts(sources, frontier, pages, articles, media, article_media):
    n = lambda cond: F.count_if(F.expr(cond))
    once = "coalesce(duplicate_of, '') = ''"
    span = f"published_at >= '{CUTOFF}' AND published_at <= '{TODAY}'"
    one = [
        sources.agg(F.count("*").alias("sources")),
        frontier.agg(F.count("*").alias("frontier"), n("status = 'pending'").alias("pending"), n("status = 'filtered'").alias("filtered")),
        pages.agg(F.count("*").alias("pages"), n("value_score >= 16").alias("pages_indexable"), n("page_kind = 'news_article'").alias("news_pages"), n(f"page_kind = 'news_article' AND value_score >= 40 AND {once}").alias("news_indexable"), n(f"page_kind = 'news_article' AND {span} AND value_score >= 40 AND {once}").alias("recent_news"), F.max("fetched_at").alias("last_fetched")),
        articles.agg(F.count("*").alias("articles"), n(span).alias("recent_articles")),
        media.agg(F.count("*").alias("media"), n("status = 'ok'").alias("media_ok")),
        article_media.agg(F.count("*").alias("article_media")),
    ]
    out = one[0]
    for x in one[1:]:  # frames of one row each
        out = out.join(F.broadcast(x))
    return out


@query("tier_histogram", "pages", sql="SELECT value_tier AS tier, count(*) AS count FROM pages GROUP BY 1")
def tier_histogram(pages):
    return pages.groupBy(F.col("value_tier").alias("tier")).count().orderBy(F.col("count").desc(), "tier")


@query("kind_top", "pages", sql="SELECT page_kind AS kind, count(*) AS count FROM pages GROUP BY 1 ORDER BY count DESC, kind LIMIT 12")
def kind_top(pages):
    return pages.groupBy(F.col("page_kind").alias("kind")).count().orderBy(F.col("count").desc(), "kind").limit(12)


_RANK = f"""WITH ps AS (SELECT source_id, count(*) AS pages, count_if(page_kind = 'news_article' AND value_score >= 40 AND coalesce(duplicate_of, '') = '') AS news_pages, count_if(page_kind = 'news_article' AND published_at >= '{CUTOFF}' AND published_at <= '{TODAY}' AND value_score >= 40 AND coalesce(duplicate_of, '') = '') AS recent_news FROM pages GROUP BY 1),
 ast AS (SELECT source_id, count(*) AS articles, count_if(published_at >= '{CUTOFF}' AND published_at <= '{TODAY}') AS recent_articles FROM articles GROUP BY 1), fs AS (SELECT source_id, count(*) AS pending FROM frontier WHERE status = 'pending' GROUP BY 1)
 SELECT s.id, s.name, s.organization_level, coalesce(ps.pages, 0) AS pages, CAST(coalesce(news_pages, 0) AS BIGINT) AS news_pages, CAST(coalesce(recent_news, 0) AS BIGINT) AS recent_news, coalesce(articles, 0) AS articles, CAST(coalesce(recent_articles, 0) AS BIGINT) AS recent_articles, coalesce(pending, 0) AS pending
 FROM sources s LEFT JOIN ps ON ps.source_id = s.id LEFT JOIN ast ON ast.source_id = s.id LEFT JOIN fs ON fs.source_id = s.id"""


@query("source_ranking", "sources", "pages", "articles", "frontier", sql=_RANK + " ORDER BY news_pages DESC, recent_news DESC, pages DESC, name LIMIT 130")
def source_ranking(sources, pages, articles, frontier, limit: int = 130):
    """Facts are summed by source before they meet the dimension."""
    n = lambda cond: F.count_if(F.expr(cond))
    span = f"published_at >= '{CUTOFF}' AND published_at <= '{TODAY}'"
    good = "page_kind = 'news_article' AND value_score >= 40 AND coalesce(duplicate_of, '') = ''"
    ps = pages.groupBy("source_id").agg(F.count("*").alias("pages"), n(good).alias("news_pages"), n(f"{good} AND {span}").alias("recent_news"))
    ast = articles.groupBy("source_id").agg(F.count("*").alias("articles"), n(span).alias("recent_articles"))
    fs = frontier.where("status = 'pending'").groupBy("source_id").agg(F.count("*").alias("pending"))
    out = sources.select("id", "name", "organization_level")
    for f in (ps, ast, fs):
        out = out.join(f.withColumnRenamed("source_id", "id"), "id", "left")
    out = out.fillna(0, ["pages", "news_pages", "recent_news", "articles", "recent_articles", "pending"])
    return out.orderBy(F.col("news_pages").desc(), F.col("recent_news").desc(), F.col("pages").desc(), "name").limit(max(1, min(limit, 500)))


@query("source_report", "sources", "pages", "articles", "media", sql=f"""SELECT s.id, (SELECT count(*) FROM pages p WHERE p.source_id = s.id) AS pages, (SELECT count(*) FROM pages p WHERE p.source_id = s.id AND p.status = 200) AS pages_ok,
  (SELECT count(*) FROM articles a WHERE a.source_id = s.id) AS articles, (SELECT count(*) FROM articles a WHERE a.source_id = s.id AND (a.published_at IS NULL OR a.published_at = '')) AS undated,
  (SELECT count(*) FROM articles a WHERE a.source_id = s.id AND a.published_at >= '{CUTOFF}') AS recent, (SELECT max(published_at) FROM articles a WHERE a.source_id = s.id AND a.published_at <= '{TODAY}') AS newest,
  (SELECT count(*) FROM articles a WHERE a.source_id = s.id) > 0 AS has_publication, CASE WHEN starts_with(s.id, 'src1') THEN 'core' ELSE 'unit' END AS scope FROM sources s""")
def source_report(sources, pages, articles, media):
    """One pass over each fact table instead of ten correlated subqueries a row."""
    p = pages.groupBy("source_id").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == 200).alias("pages_ok"))
    a = articles.groupBy("source_id").agg(F.count("*").alias("articles"), F.count_if(F.coalesce("published_at", F.lit("")) == "").alias("undated"), F.count_if(F.col("published_at") >= CUTOFF).alias("recent"), F.max(F.when(F.col("published_at") <= TODAY, F.col("published_at"))).alias("newest"))
    out = sources.select("id").join(p.withColumnRenamed("source_id", "id"), "id", "left").join(a.withColumnRenamed("source_id", "id"), "id", "left").fillna(0, ["pages", "pages_ok", "articles", "undated", "recent"])
    return out.select("*", (F.col("articles") > 0).alias("has_publication"), F.when(F.col("id").startswith("src1"), "core").otherwise("unit").alias("scope"))


@query("missing_fields", "articles", sql="SELECT count_if(coalesce(trim(title), '') = '') AS no_title, count_if(coalesce(trim(author), '') = '') AS no_author, count_if(coalesce(published_at, '') = '') AS no_date, count_if(coalesce(trim(summary), '') = '') AS no_summary, count_if(coalesce(content_hash, '') = '') AS no_hash, count_if(length(body_text) < 80) AS short_body FROM articles")
def missing_fields(articles):
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return articles.agg(F.count_if(blank("title")).alias("no_title"), F.count_if(blank("author")).alias("no_author"), F.count_if(blank("published_at")).alias("no_date"), F.count_if(blank("summary")).alias("no_summary"), F.count_if(blank("content_hash")).alias("no_hash"), F.count_if(F.char_length("body_text") < 80).alias("short_body"))


@query("error_histogram", "media", sql="SELECT coalesce(nullif(error, ''), 'unknown') AS reason, count(*) AS count FROM media WHERE status = 'error' GROUP BY 1 ORDER BY count DESC, reason LIMIT 20")
def error_histogram(media):
    """Grouped by the expression: null and empty reasons are one row."""
    return media.where("status = 'error'").groupBy(F.coalesce(F.nullif("error", F.lit("")), F.lit("unknown")).alias("reason")).count().orderBy(F.col("count").desc(), "reason").limit(20)


@query("status_histogram", "frontier", sql="SELECT status, count(*) AS count FROM frontier GROUP BY 1")
def status_histogram(frontier):
    return frontier.groupBy("status").count()


@query("pending_queue", "frontier", sql="SELECT * FROM frontier WHERE status = 'pending' AND source_id = 'src3' ORDER BY priority DESC NULLS LAST, depth, discovered_at, url LIMIT 50")
def pending_queue(frontier):
    return upsert.claim(frontier, 50, ["src3"])


@query("point_get", "pages", sql="SELECT url, source_id, status, sha256 FROM pages WHERE url = 'https://www.src0.example.edu/info/1.htm' OR doc_id = 3")
def point_get(pages):
    return pages.where((F.col("url") == "https://www.src0.example.edu/info/1.htm") | (F.col("doc_id") == 3)).select("url", "source_id", "status", "sha256")


@query("exists_bulk", "pages", "articles", sql="SELECT p.url FROM pages p WHERE EXISTS (SELECT 1 FROM articles a WHERE a.url = p.url)")
def exists_bulk(pages, articles):
    return pages.join(articles.select("url"), "url", "left_semi").select("url")


@query("in_list", "articles", sql="SELECT url, content_hash FROM articles WHERE source_id IN ('src1', 'src4', 'src9')")
def in_list(articles):
    return articles.where(F.col("source_id").isin("src1", "src4", "src9")).select("url", "content_hash")


@query("date_windows", "articles", sql=f"""SELECT count_if(published_at >= '{CUTOFF}' AND published_at <= '{TODAY}') AS by_text, count_if(substr(published_at, 1, 10) >= '{CUTOFF}' AND substr(published_at, 1, 10) <= '{TODAY}') AS by_day, count_if(substr(published_at, 1, 10) > '{TODAY}') AS future FROM articles""")
def date_windows(articles):
    """Text comparison leaves out a timestamp of today; the day prefix takes it in."""
    d = F.substring("published_at", 1, 10)
    return articles.agg(F.count_if(F.col("published_at").between(CUTOFF, TODAY)).alias("by_text"), F.count_if(d.between(CUTOFF, TODAY)).alias("by_day"), F.count_if(d > TODAY).alias("future"))


@query("shell_suffix", "articles", sql="SELECT url FROM articles WHERE regexp_matches(coalesce(title, ''), '(ing|er)[.,]?$') OR contains(right(body_text, 1000), 'All rights reserved')")
def shell_suffix(articles):
    r"""\z is the end of the text alone, as $ is in the SQL; Java's $ also comes before a last line end."""
    return articles.where(F.coalesce("title", F.lit("")).rlike(r"(ing|er)[.,]?\z") | F.right("body_text", F.lit(1000)).contains("All rights reserved")).select("url")


@query("repair_needed", "articles", "pages", sql="SELECT p.url FROM pages p WHERE p.page_kind IN ('news_article', 'article') AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.url IN (p.url, p.final_url, p.canonical_url, p.duplicate_of))")
def repair_needed(articles, pages):
    known = joins.alias_semi(pages, articles, ("url", "final_url", "canonical_url", "duplicate_of")).select("url")
    return pages.join(known, "url", "left_anti").where(F.col("page_kind").isin(*rules.PUBLIC_KINDS)).select("url")


@query("keyset_page", "articles", sql="SELECT url, source_id FROM articles WHERE url > 'https://www.src1' ORDER BY url LIMIT 500")
def keyset_page(articles, after: str = "https://www.src1", size: int = 500):
    return articles.where(F.col("url") > after).orderBy("url").limit(size).select("url", "source_id")


@query("export_order", "articles", sql="SELECT url, published_at FROM articles ORDER BY published_at DESC NULLS LAST, url LIMIT 100")
def export_order(articles):
    return articles.select("url", "published_at").orderBy(F.col("published_at").desc_nulls_last(), "url").limit(100)


@query("top_two_per_source", "articles", sql="SELECT source_id, url, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(published_at, '') DESC, url) AS r FROM articles) x WHERE r <= 2")
def top_two_per_source(articles):
    return joins.first_rows(articles, ["source_id"], [F.coalesce("published_at", F.lit("")).desc(), F.col("url")], 2, "place").select("source_id", "url", "place")


@query("sample_per_source", "articles", sql="SELECT source_id, url FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(published_at, '') DESC, last_seen DESC, url) AS r FROM articles) x WHERE r = 1")
def sample_per_source(articles):
    return joins.first_rows(articles, ["source_id"], [F.coalesce("published_at", F.lit("")).desc(), F.col("last_seen").desc(), F.col("url")]).select("source_id", "url")


@query("page_sample_per_source", "pages", sql="SELECT source_id, url FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN raw_path IS NULL THEN 1 ELSE 0 END, fetched_at DESC, url) AS r FROM pages WHERE status = 200) x WHERE r = 1")
def page_sample_per_source(pages):
    return joins.first_rows(pages.where("status = 200"), ["source_id"], [F.col("raw_path").isNull().cast("int"), F.col("fetched_at").desc(), F.col("url")]).select("source_id", "url")


@query("host_routing", "raw_pages", sql="""WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages), s AS (SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS suffix FROM h UNION SELECT DISTINCT host FROM h WHERE length(host) % 3 = 0),
  src AS (SELECT suffix AS id, suffix FROM s WHERE NOT starts_with(suffix, 'm.')), b AS (SELECT host FROM h WHERE starts_with(host, 'www.')),
  m AS (SELECT p.page_id, src.id, length(suffix) AS n FROM pages p JOIN src ON regexp_extract(p.url, '^https?://([^/?#:]+)', 1) = suffix OR ends_with(regexp_extract(p.url, '^https?://([^/?#:]+)', 1), '.' || suffix)
    WHERE NOT (src.id = 'example.org' AND regexp_extract(p.url, '^https?://([^/?#:]+)', 1) IN (SELECT host FROM b)))
  SELECT p.page_id, (SELECT id FROM m WHERE m.page_id = p.page_id ORDER BY n DESC, id LIMIT 1) AS owner FROM pages p""")
def host_routing(pages):
    hosts = pages.select(U.host(F.col("url")).alias("host")).distinct()
    suffix = hosts.select(F.regexp_extract("host", r"([^.]+[.][^.]+)$", 1).alias("id")).union(hosts.where(F.length("host") % 3 == 0)).distinct().where(~F.col("id").startswith("m."))
    none = F.array().cast("array<string>")
    allowed = suffix.select("id", F.array("id").alias("allowed_hosts"), none.alias("blocked_hosts"))
    blocked = hosts.where(F.col("host").startswith("www.")).select(F.lit("example.org").alias("id"), none.alias("allowed_hosts"), F.array("host").alias("blocked_hosts"))
    sources = allowed.unionByName(blocked)  # a source may have several rows
    return joins.route_hosts(pages, sources).select("page_id", "owner")


@query("alias_semi", "pages", "articles", sql="SELECT p.url FROM pages p WHERE EXISTS (SELECT 1 FROM articles a WHERE a.url IN (p.url, p.final_url, p.canonical_url, p.duplicate_of))")
def alias_semi(pages, articles):
    return joins.alias_semi(pages, articles, ("url", "final_url", "canonical_url", "duplicate_of")).select("url")


@query("alias_lookup", "pages", "articles", sql="SELECT p.url, coalesce((SELECT nullif(a.title, '') FROM articles a WHERE a.url = p.url), (SELECT nullif(a.title, '') FROM articles a WHERE a.url = p.final_url), (SELECT nullif(a.title, '') FROM articles a WHERE a.url = p.canonical_url)) AS article_title FROM pages p")
def alias_lookup(pages, articles):
    """The first of url, final and canonical URL that has an article with a title."""
    return joins.alias_lookup(pages, articles, ("url", "final_url", "canonical_url"), "url", "title", "article_title").select("url", "article_title")


@query("orphan_media", "media", "article_media", sql="SELECT m.url FROM media m LEFT JOIN article_media b ON b.image_url = m.url WHERE b.image_url IS NULL")
def orphan_media(media, article_media):
    return media.join(article_media.select(F.col("image_url").alias("url")), "url", "left_anti").select("url")


@query("dangling_bridge", "media", "article_media", sql="SELECT b.doc_id, b.image_url FROM article_media b WHERE NOT EXISTS (SELECT 1 FROM media m WHERE m.url = b.image_url)")
def dangling_bridge(media, article_media):
    return joins.violations(article_media, media, "image_url", "url").select("doc_id", "image_url")


@query("orphan_breakdown", "media", "article_media", "articles", sql="SELECT CASE WHEN m.url IS NULL THEN 'dangling' WHEN a.doc_id IS NULL THEN 'stale' ELSE 'linked' END AS kind, count(*) AS count FROM article_media b LEFT JOIN media m ON m.url = b.image_url LEFT JOIN articles a ON a.doc_id = b.doc_id GROUP BY 1")
def orphan_breakdown(media, article_media, articles):
    j = article_media.join(media.select(F.col("url").alias("m_url")), F.col("image_url") == F.col("m_url"), "left").join(articles.select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return j.groupBy(F.when(F.col("m_url").isNull(), "dangling").when(F.col("has").isNull(), "stale").otherwise("linked").alias("kind")).count()


@query("fk_violations", "raw_lineitem", "raw_orders", sql="SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')")
def fk_violations(lineitem, orders):
    return joins.violations(lineitem, orders.where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("bridge_union", "articles", "media", "article_media", sql="SELECT DISTINCT a.doc_id, m.url FROM articles a JOIN media m ON m.last_conv = a.doc_id OR EXISTS (SELECT 1 FROM article_media b WHERE b.doc_id = a.doc_id AND b.image_url = m.url)")
def bridge_union(articles, media, article_media):
    return joins.bridged(articles, media, article_media.withColumnRenamed("image_url", "url"), "doc_id", "url", "last_conv")


@query("update_from_pages", "pages", "articles", sql="SELECT a.url, CASE WHEN p.url IS NULL THEN a.published_at ELSE p.published_at END AS published_at FROM articles a LEFT JOIN pages p ON p.url = a.url")
def update_from_pages(pages, articles):
    return joins.update_from(articles, pages, "url", ("published_at",)).select("url", "published_at")


@query("pages_in_selection", "pages", "frontier", sql="SELECT f.url FROM frontier f WHERE f.source_id IN (SELECT source_id FROM pages WHERE page_kind = 'news_listing' AND status = 404)")
def pages_in_selection(pages, frontier):
    return frontier.join(pages.where("page_kind = 'news_listing' AND status = 404").select("source_id"), "source_id", "left_semi").select("url")


@query("reconcile_labels", "raw_labels", "raw_documents", sql="""WITH l AS (SELECT doc_id, quality, toxic FROM labels), d AS (SELECT doc_id, CAST(n_chars % 2 AS INT) AS quality, 0 AS toxic FROM documents WHERE doc_id % 3 <> 0)
  SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'extra' ELSE 'differs' END AS state, CASE WHEN d.doc_id IS NULL OR l.doc_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN l.quality IS DISTINCT FROM d.quality THEN 'quality' END, CASE WHEN l.toxic IS DISTINCT FROM d.toxic THEN 'toxic' END) END AS differing
  FROM l FULL JOIN d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR l.quality IS DISTINCT FROM d.quality OR l.toxic IS DISTINCT FROM d.toxic""")
def reconcile_labels(labels, documents):
    want = documents.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return joins.reconcile(labels, want, "doc_id", ("quality", "toxic"))


@query("multiset_difference", "frontier", "outbox", sql="WITH a AS (SELECT source_id, count(*) AS n FROM frontier GROUP BY 1), b AS (SELECT source_id, count(*) AS n FROM outbox GROUP BY 1) SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.n, 0) AS left_count, coalesce(b.n, 0) AS right_count FROM a FULL JOIN b ON a.source_id = b.source_id WHERE a.n IS DISTINCT FROM b.n")
def multiset_difference(frontier, outbox_):
    return joins.same_multiset(frontier, outbox_, ["source_id"])


@query("known_url_variants", "articles", "pages", sql="SELECT DISTINCT u FROM (SELECT url AS u FROM articles UNION SELECT replace(url, 'https://', 'http://') FROM articles UNION SELECT canonical_url FROM pages WHERE canonical_url IS NOT NULL UNION SELECT replace(canonical_url, 'https://', 'http://') FROM pages WHERE canonical_url IS NOT NULL) x")
def known_url_variants(articles, pages):
    urls = articles.select("url").union(pages.select("canonical_url").where("canonical_url IS NOT NULL"))
    return urls.select(F.explode(U.variants(F.col("url"))).alias("u")).distinct()


@query("page_keepers", "pages", "articles", sql="SELECT url, first_value(url) OVER (PARTITION BY sha256 ORDER BY own, fetched_at, url) AS keeper, copies FROM (SELECT p.url, p.sha256, p.fetched_at, CASE WHEN EXISTS (SELECT 1 FROM articles a WHERE a.url = p.url) THEN 0 ELSE 1 END AS own, count(*) OVER (PARTITION BY p.sha256) AS copies FROM pages p) x WHERE copies > 1")
def page_keepers(pages, articles):
    return dedup.page_keepers(pages, articles)


@query("exact_duplicates", "pages", sql="""WITH big AS (SELECT * FROM pages WHERE octet_length(encode(body_text)) >= 2048), k AS (SELECT *, CASE WHEN page_kind IN ('news_article', 'article') THEN first_value(url) OVER (PARTITION BY sha256, page_kind IN ('news_article', 'article') ORDER BY fetched_at, url) ELSE first_value(url) OVER (PARTITION BY sha256 ORDER BY fetched_at, url) END AS keeper FROM big)
  SELECT url, keeper AS duplicate_of FROM k WHERE keeper <> url""")
def exact_duplicates(pages):
    return dedup.page_duplicates(pages)


@query("article_keepers", "articles", sql="SELECT url, keeper FROM (SELECT url, first_value(url) OVER (PARTITION BY source_id, sha256(body_text) ORDER BY NOT starts_with(url, 'https://'), url) AS keeper FROM articles WHERE length(body_text) >= 200) x WHERE keeper <> url")
def article_keepers(articles):
    return dedup.article_keepers(articles)


@query("visible_once", "articles", sql="SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY source_id, coalesce(nullif(content_hash, ''), url) ORDER BY url) AS r FROM articles) x WHERE r = 1")
def visible_once(articles):
    return dedup.visible_once(articles).select("url")


@query("copies_window", "pages", sql="SELECT url, count(*) OVER (PARTITION BY sha256) AS copies FROM pages")
def copies_window(pages):
    return pages.select("url", F.count("*").over(Window.partitionBy("sha256")).alias("copies"))


@query("coalesce_latest", "outbox", sql="""SELECT event_id, CASE WHEN open_ AND row_number() OVER (PARTITION BY entity_key, open_ ORDER BY created_at DESC, event_id DESC) > 1 THEN 'superseded' ELSE status END AS status FROM (SELECT *, status = 'pending' AND batch_id IS NULL AS open_ FROM outbox) x""")
def coalesce_latest(o):
    return dedup.coalesce_latest(o).select("event_id", "status")


@query("interleave_hosts", "raw_pages", sql="SELECT page_id, CAST(page_id % 3 AS BIGINT) AS priority, CAST(row_number() OVER (PARTITION BY page_id % 3, regexp_extract(url, '^https?://([^/?#:]+)', 1) ORDER BY url) - 1 AS INT) AS place FROM pages")
def interleave_hosts(pages):
    """Pages of one URL, whose order the SQL leaves open, go by id, so that every run gives the same places."""
    return dedup.interleave(pages.withColumn("priority", F.col("page_id") % 3), order=F.struct("url", "page_id")).select("page_id", "priority", "place")


@query("trim_excess", "article_media", sql="SELECT doc_id, image_url FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at, image_url) AS n FROM article_media) x WHERE n > 3")
def trim_excess(article_media):
    return upsert.trim_excess(article_media, "doc_id", 3, ["created_at", "image_url"]).select("doc_id", "image_url")


@query("over_cap", "article_media", sql="SELECT doc_id, count(image_url) AS images FROM article_media GROUP BY 1 HAVING count(image_url) > 3")
def over_cap(article_media):
    return article_media.groupBy("doc_id").agg(F.count("image_url").alias("images")).where("images > 3")


@query("media_per_article", "articles", "article_media", sql="SELECT a.url, a.title, length(a.body_text) AS chars, count(DISTINCT m.image_url) AS images FROM articles a LEFT JOIN article_media m ON m.doc_id = a.doc_id GROUP BY a.url, a.title, a.body_text")
def media_per_article(articles, article_media):
    n = article_media.groupBy("doc_id").agg(F.count_distinct("image_url").alias("images"))
    return articles.join(n, "doc_id", "left").select("url", "title", F.char_length("body_text").alias("chars"), F.coalesce("images", F.lit(0)).alias("images"))


@query("newest_per_source", "articles", sql=f"SELECT source_id, max(least(substr(published_at, 1, 10), '{TODAY}')) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY last_seen DESC, url) AS r FROM articles WHERE coalesce(published_at, '') <> '') x WHERE r <= 50 GROUP BY 1")
def newest_per_source(articles):
    seen = joins.first_rows(articles.where(F.coalesce("published_at", F.lit("")) != ""), ["source_id"], [F.col("last_seen").desc(), F.col("url")], 50)
    return seen.groupBy("source_id").agg(F.max(F.least(F.substring("published_at", 1, 10), F.lit(TODAY))).alias("newest"))


@query("late_filter", "articles", "frontier", sql="""WITH c AS (SELECT source_id, max(substr(published_at, 1, 10)) AS cut FROM articles WHERE coalesce(published_at, '') <> '' AND doc_id % 2 = 0 GROUP BY 1)
  SELECT a.url, CASE WHEN coalesce(substr(a.published_at, 1, 10), '') = '' OR c.cut IS NULL OR substr(a.published_at, 1, 10) >= c.cut THEN 'accept' WHEN a.doc_id % 6 > 4 OR a.doc_id % 2 = 0 THEN 'late' ELSE 'accept' END AS verdict FROM articles a LEFT JOIN c ON c.source_id = a.source_id""")
def late_filter(articles, frontier):
    """Late and known, or late and deep, is left out with a verdict; late, shallow and unseen passes."""
    day = F.substring("published_at", 1, 10)
    cut = articles.where((F.coalesce("published_at", F.lit("")) != "") & (F.col("doc_id") % 2 == 0)).groupBy("source_id").agg(F.max(day).alias("cut"))
    late = (F.coalesce(day, F.lit("")) != "") & F.col("cut").isNotNull() & (day < F.col("cut"))
    deep_or_known = (F.col("doc_id") % 6 > 4) | (F.col("doc_id") % 2 == 0)
    return articles.join(cut, "source_id", "left").select("url", F.when(late & deep_or_known, "late").otherwise("accept").alias("verdict"))


@query("source_quota", "frontier", sql="SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY source_id ORDER BY priority DESC NULLS LAST, url) AS n FROM frontier WHERE status = 'pending') x WHERE n <= 20")
def source_quota(frontier):
    return joins.first_rows(frontier.where("status = 'pending'"), ["source_id"], [F.col("priority").desc(), F.col("url")], 20).select("url")


@query("collapse_failures", "frontier", sql="SELECT source_id AS url, CAST(sum(attempts) AS BIGINT) AS attempts, max(event_id) AS id, max_by(last_error, event_id) FILTER (WHERE true) AS error FROM (SELECT source_id, attempts, event_id, coalesce(last_error, 'none') AS last_error FROM frontier) f GROUP BY 1")
def collapse_failures(frontier):
    f = frontier.select(F.col("source_id").alias("url"), "attempts", F.col("event_id").alias("id"), F.coalesce("last_error", F.lit("none")).alias("error"))
    return upsert.collapse_failures(f).select("url", "attempts", "id", "error")


@query("failure_report", "frontier", sql="SELECT source_id, total, CAST(greatest(total - 50, 0) AS BIGINT) AS omitted, coalesce(shown, 0) AS shown FROM (SELECT source_id, count(*) AS total, count_if(n <= 50) AS shown FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS n FROM frontier WHERE status = 'error') x GROUP BY 1) y")
def failure_report(frontier):
    w = Window.partitionBy("source_id").orderBy("event_id")
    return frontier.where("status = 'error'").withColumn("n", F.row_number().over(w)).groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(F.col("n") <= 50).alias("shown")).withColumn("omitted", F.greatest(F.col("total") - 50, F.lit(0)))


_UP = """WITH o AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, 'old' AS seen, 1 AS attempts, CASE WHEN c_custkey % 4 = 0 THEN 'error' ELSE 'ok' END AS status FROM customer WHERE c_custkey % 3 <> 0),
 n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE upper(c_name) END AS name, c_acctbal * 2 AS bal, 'new' AS seen, 1 AS attempts, CASE WHEN c_custkey % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM customer WHERE c_custkey % 2 = 0)
 SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN o.name WHEN o.k IS NULL THEN n.name ELSE coalesce(nullif(n.name, ''), o.name) END AS name, CASE WHEN n.k IS NULL THEN o.bal WHEN o.k IS NULL THEN n.bal ELSE least(o.bal, n.bal) END AS bal,
 coalesce(o.seen, n.seen) AS seen, CAST(coalesce(o.attempts, 0) + coalesce(n.attempts, 0) AS INT) AS attempts, CASE WHEN n.k IS NULL THEN o.status ELSE n.status END AS status FROM o FULL JOIN n ON o.k = n.k"""


def _slices(customer):
    old = customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.lit("old").alias("seen"), F.lit(1).alias("attempts"), F.when(F.col("c_custkey") % 4 == 0, "error").otherwise("ok").alias("status"))
    new = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.upper("c_name")).alias("name"), (F.col("c_acctbal") * 2).alias("bal"), F.lit("new").alias("seen"), F.lit(1).alias("attempts"), F.when(F.col("c_custkey") % 7 == 0, "error").otherwise("ok").alias("status"))
    return old, new


@query("upsert_merge", "raw_customer", sql=_UP)
def upsert_merge(customer):
    old, new = _slices(customer)
    return upsert.upsert(old, new, "k", {"name": upsert.fill, "bal": upsert.lowest, "seen": upsert.keep_old, "attempts": upsert.add})


@query("upsert_guarded", "raw_customer", sql=_UP.split(" SELECT coalesce(o.k")[0] + " SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL OR (o.status = 'ok' AND n.status = 'error') THEN o.bal ELSE n.bal END AS bal, CASE WHEN n.k IS NULL OR (o.status = 'ok' AND n.status = 'error') THEN o.status ELSE n.status END AS status FROM o FULL JOIN n ON o.k = n.k")
def upsert_guarded(customer):
    """An error never takes the place of a good row."""
    old, new = _slices(customer)
    return upsert.upsert(old, new, "k", guard=lambda o, n: ~((o["status"] == "ok") & (n["status"] == "error"))).select("k", "bal", "status")


@query("insert_ignore", "raw_customer", sql=_UP.split(" SELECT coalesce(o.k")[0] + " SELECT k, name, seen FROM o UNION ALL SELECT k, name, seen FROM n WHERE k NOT IN (SELECT k FROM o)")
def insert_ignore(customer):
    old, new = _slices(customer)
    return upsert.insert_ignore(old, new, ["k"]).select("k", "name", "seen")


@query("count_created", "raw_customer", sql="SELECT count(*) AS created FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def count_created(customer):
    old, new = _slices(customer)
    return upsert.count_new(old, new, "k")


_ENQ = """WITH n AS (SELECT url, max(priority + 5) AS priority FROM frontier WHERE event_id % 3 = 0 GROUP BY 1 UNION ALL SELECT concat('https://new.example.edu/', CAST(event_id AS VARCHAR)), 7 FROM frontier WHERE event_id % 50 = 0)
 SELECT coalesce(f.url, n.url) AS url, CASE WHEN f.url IS NULL THEN 'pending' WHEN n.url IS NOT NULL AND ((f.status = 'error' AND f.attempts < 5) {revive}) THEN 'pending' ELSE f.status END AS status, CAST(CASE WHEN f.url IS NULL THEN n.priority WHEN n.url IS NOT NULL AND ((f.status = 'error' AND f.attempts < 5) {revive} OR f.status = 'pending') THEN greatest(f.priority, n.priority) ELSE f.priority END AS INT) AS priority FROM frontier f FULL JOIN n ON f.url = n.url"""


def _found(frontier):
    a = frontier.where("event_id % 3 = 0").select("url", "source_id", "depth", (F.col("priority") + 5).alias("priority"), "discovered_at")
    b = frontier.where("event_id % 50 = 0").select(F.concat(F.lit("https://new.example.edu/"), F.col("event_id").cast("string")).alias("url"), "source_id", "depth", F.lit(7).alias("priority"), "discovered_at")
    return a.union(b)


@query("frontier_enqueue", "frontier", sql=_ENQ.replace("{revive}", ""))
def frontier_enqueue(frontier):
    return upsert.enqueue(frontier, _found(frontier)).select("url", "status", "priority")


@query("frontier_revive", "frontier", sql=_ENQ.replace("{revive}", "OR f.status = 'done' OR (f.status = 'filtered' AND coalesce(starts_with(f.last_error, 'incremental'), false))"))
def frontier_revive(frontier):
    return upsert.enqueue(frontier, _found(frontier), revive=True).select("url", "status", "priority")


@query("frontier_claim", "frontier", sql="WITH c AS (SELECT url FROM frontier WHERE status = 'pending' ORDER BY priority DESC NULLS LAST, depth, discovered_at, url LIMIT 100) SELECT f.url, CASE WHEN c.url IS NULL THEN f.status ELSE 'processing' END AS status, CAST(f.attempts + CASE WHEN c.url IS NULL THEN 0 ELSE 1 END AS INT) AS attempts FROM frontier f LEFT JOIN c ON c.url = f.url")
def frontier_claim(frontier):
    return upsert.transition(frontier, upsert.claim(frontier, 100), "processing").select("url", "status", "attempts")


@query("frontier_restart", "frontier", sql="SELECT url, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status FROM frontier")
def frontier_restart(frontier):
    return upsert.restart(frontier).select("url", "status")


@query("reset_listings", "frontier", sql="""WITH x AS (SELECT *, event_id % 4 = 0 AS l, event_id % 97 = 0 AS s FROM frontier), one AS (SELECT *, CASE WHEN l AND depth > 3 AND status = 'pending' THEN 'done' ELSE status END AS a FROM x), two AS (SELECT *, CASE WHEN l AND depth <= 3 AND a IN ('done', 'error', 'filtered') THEN 'pending' ELSE a END AS b FROM one)
  SELECT url, CASE WHEN s THEN 'pending' ELSE b END AS status FROM two""")
def reset_listings(frontier):
    listings = frontier.where("event_id % 4 = 0").select("url", F.lit("news_listing").alias("page_kind"))
    return upsert.reset_listings(frontier, listings, frontier.where("event_id % 97 = 0")).select("url", "status")


@query("filter_frontier", "frontier", sql="SELECT url, CASE WHEN status = 'pending' AND contains(url, '/list') THEN 'filtered' ELSE status END AS status, CASE WHEN status = 'pending' AND contains(url, '/list') THEN 'listing' ELSE last_error END AS last_error, CAST(CASE WHEN status = 'pending' AND NOT contains(url, '/list') THEN 1000 - depth ELSE priority END AS INT) AS priority FROM frontier")
def filter_frontier(frontier):
    return upsert.filter_frontier(frontier, F.when(F.col("url").contains("/list"), "listing").otherwise(""), 1000 - F.col("depth")).select("url", "status", "last_error", "priority")


@query("article_removal", "articles", "pages", sql="SELECT a.url FROM articles a WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = a.url AND p.status = 200 AND p.page_kind = 'course_resource')")
def article_removal(articles, pages):
    """Articles that stay when their page no longer yields one."""
    return articles.join(pages.where("status = 200 AND page_kind = 'course_resource'").select("url"), "url", "left_anti").select("url")


@query("reindex_removals", "articles", "pages", sql="SELECT a.url, sha256('{\"content_hash\":\"' || coalesce(a.content_hash, '') || '\",\"last_seen\":\"' || a.last_seen || '\",\"tombstone\":true,\"url\":\"' || a.url || '\"}') AS revision FROM articles a WHERE a.doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = a.url)")
def reindex_removals(articles, pages):
    """Candidates that reindexing didn't save again, each with its tombstone's revision."""
    from ..functions import text as T

    gone = articles.where("doc_id % 2 = 0").join(pages.select("url"), "url", "left_anti")
    return gone.select("url", T.tombstone_hash(F.col("url"), F.col("content_hash"), F.col("last_seen")).alias("revision"))


@query("jsonl_export", "articles", "article_media", sql="SELECT a.url, coalesce(string_agg(m.image_url || '|' || m.alt, ';' ORDER BY m.image_url, m.alt), '') AS images FROM articles a LEFT JOIN article_media m ON m.doc_id = a.doc_id GROUP BY a.url")
def jsonl_export(articles, article_media):
    m = article_media.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("image_url", "alt"))).alias("images"))
    return articles.join(m, "doc_id", "left").select("url", F.coalesce(F.array_join(F.transform("images", lambda x: F.concat_ws("|", x["image_url"], x["alt"])), ";"), F.lit("")).alias("images"))


@query("batch_settle", "outbox", sql="SELECT batch_id, CASE WHEN count_if(status = 'acked') = count(*) THEN 'acked' WHEN count_if(status = 'failed') = count(*) THEN 'failed' ELSE 'partial' END AS status, count(*) AS items FROM outbox WHERE batch_id IS NOT NULL GROUP BY 1")
def batch_settle(o):
    return outbox.settle(o.where("batch_id IS NOT NULL"))


@query("terminal_failures", "outbox", sql="SELECT count(*) AS failures FROM outbox WHERE status = 'failed' AND batch_id IS NULL AND last_error IN ('invalid_event', 'event_too_large')")
def terminal_failures(o):
    return o.where("status = 'failed' AND batch_id IS NULL").agg(F.count_if(F.col("last_error").isin("invalid_event", "event_too_large")).alias("failures"))


@query("source_conflicts", "outbox", sql="SELECT source_id, count(DISTINCT payload) AS versions FROM outbox WHERE batch_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT payload) > 1")
def source_conflicts(o):
    return o.where("batch_id IS NOT NULL").groupBy("source_id").agg(F.count_distinct("payload").alias("versions")).where("versions > 1")


@query("drop_discovery_events", "outbox", sql="SELECT event_id FROM outbox WHERE NOT (batch_id IS NULL AND source_id = 'src3')")
def drop_discovery_events(o):
    hidden = o.sparkSession.createDataFrame([("src3",)], "source_id string")
    gone = o.where("batch_id IS NULL").join(F.broadcast(hidden), "source_id", "left_semi").select("event_id")
    return o.join(gone, "event_id", "left_anti").select("event_id")


@query("batch_pack", "outbox", sql="""WITH RECURSIVE open_ AS (SELECT * FROM (SELECT event_id, source_id AS lane, created_at, bytes, row_number() OVER (PARTITION BY entity_key ORDER BY created_at DESC, event_id DESC) AS r FROM outbox WHERE status = 'pending' AND batch_id IS NULL) x WHERE r = 1),
  o AS (SELECT event_id, lane, bytes, row_number() OVER (PARTITION BY lane ORDER BY created_at DESC, event_id DESC) AS n FROM open_),
  f AS (SELECT event_id, lane, n, 0 AS batch, 1 AS items, bytes + 512 AS size FROM o WHERE n = 1 UNION ALL
    SELECT o.event_id, o.lane, o.n, CASE WHEN f.items = 10 OR f.size + o.bytes > 100000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.items = 10 OR f.size + o.bytes > 100000 THEN 1 ELSE f.items + 1 END, CASE WHEN f.items = 10 OR f.size + o.bytes > 100000 THEN o.bytes + 512 ELSE f.size + o.bytes END FROM f JOIN o ON o.lane = f.lane AND o.n = f.n + 1)
  SELECT event_id, lane, CAST(batch AS BIGINT) AS batch FROM f""")
def batch_pack(o):
    return outbox.plan_batches(o, items=10, most_bytes=100_000)


@query("object_plan", "pages", sql="SELECT kind, sha256, size, (row_number() OVER (ORDER BY kind, sha256) - 1) // 100 AS chunk FROM (SELECT page_kind AS kind, sha256, min(length(body_text)) AS size, count(DISTINCT length(body_text)) AS c FROM pages GROUP BY 1, 2) x WHERE c = 1")
def object_plan(pages):
    plan, _ = outbox.object_plan(pages.select(F.col("page_kind").alias("kind"), "sha256", F.char_length("body_text").alias("size")))
    return plan.select("kind", "sha256", "size", "chunk")


@query("payload_integrity", "outbox", sql="SELECT event_id FROM (SELECT event_id, payload, CASE WHEN event_id LIKE '%7' THEN 'x' ELSE sha256(payload) END AS d FROM outbox) x WHERE sha256(payload) <> d")
def payload_integrity(o):
    recorded = o.withColumn("payload_sha256", F.when(F.col("event_id").endswith("7"), "x").otherwise(F.sha2("payload", 256)))
    return outbox.broken_payloads(recorded).select("event_id")


@query("rescore", "pages", "articles", sql=None)
def rescore(pages, articles):
    """Scores anew from stored columns, without parsing: aliases find the article, digests the duplicate."""
    keeper = dedup.page_keepers(pages, articles).where("keeper <> url").select(F.col("url").alias("__u"), "keeper")
    rows = joins.alias_lookup(pages, articles, ("url", "final_url", "canonical_url"), "url", "source_id", "__has").join(keeper, F.col("url") == F.col("__u"), "left")
    s = classify.score_page(page_url=F.col("url"), now=F.lit(NOW).cast("timestamp"), final_url=F.col("final_url"), title=F.col("title"), body=F.col("body_text"), status=F.col("status"), has_article=F.col("__has").isNotNull(), published=F.col("published_at"), duplicate=F.col("keeper").isNotNull())
    return rows.withColumn("s", s).select("url", "s.page_kind", "s.value_score", "s.value_tier", F.array_join("s.score_reasons", "; ").alias("score_reasons"), F.col("keeper").alias("duplicate_of"))
