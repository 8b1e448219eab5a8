"""Queries of cleanup and audit: blocked hosts, reassignment, orphans, image jobs, consistency codes, batch bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, rules, text
from ..functions import url as U
from ..operators import cleanup, dedup, joins
from .model import TODAY, load, with_tables

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str):
    def wrap(fn):
        from .model import TABLES

        _Q[name] = lambda spark, sf_dir: fn(*load(spark, sf_dir, *tables))
        own = [t for t in tables if t in TABLES]
        _SQL[name] = with_tables(sql, *own) if own else sql
        return fn

    return wrap


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"


@query("blocked_host_delete", "articles", "sources", sql=f"SELECT url FROM articles WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.organization_level = 'school' AND s.id LIKE '%2%' AND ({_HOST} = s.host OR ends_with({_HOST}, '.' || s.host)))")
def blocked_host_delete(articles, sources):
    return cleanup.without_blocked(articles, sources.where("organization_level = 'school' AND id LIKE '%2%'")).select("url")


@query("host_reassignment", "articles", "sources", sql=f"""SELECT a.url, (SELECT s.id FROM sources s WHERE s.id NOT IN ('src5', 'src6') AND (lower(regexp_extract(a.url, '^[A-Za-z]+://([^/?#:]+)', 1)) = s.host OR ends_with(lower(regexp_extract(a.url, '^[A-Za-z]+://([^/?#:]+)', 1)), '.' || s.host)) ORDER BY length(s.host) DESC, s.id LIMIT 1) AS source_id FROM articles a
  WHERE a.source_id NOT IN ('src5', 'src6')""")
def host_reassignment(articles, sources):
    s = sources.where("id NOT IN ('src5', 'src6')").select("id", F.array("host").alias("allowed_hosts"), F.array().cast("array<string>").alias("blocked_hosts"))
    return cleanup.reassigned(articles.withColumn("source_id", F.lit("unknown")), s).select("url", "source_id")


@query("orphan_relink", "media", "article_media", sql="SELECT m.url, CAST(min(b.doc_id) AS BIGINT) AS article FROM media m JOIN article_media b ON b.image_url = m.url AND b.turn % 2 = 1 WHERE NOT EXISTS (SELECT 1 FROM article_media x WHERE x.image_url = m.url AND x.turn % 2 = 0) GROUP BY m.url")
def orphan_relink(media, article_media):
    """Bundles (here: odd turns) give orphans of the bridge (even turns) their articles back."""
    found, _ = cleanup.relinked_media(media, article_media.where("turn % 2 = 0"), article_media.where("turn % 2 = 1").select(F.col("image_url").alias("url"), F.col("doc_id").alias("article")))
    return found


@query("image_caps", "article_media", "articles", "sources", sql="SELECT b.doc_id, b.image_url FROM article_media b LEFT JOIN (SELECT m.doc_id, m.image_url, s.max_images_per_page AS cap, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.created_at, m.image_url) AS n FROM article_media m JOIN articles a ON a.doc_id = m.doc_id JOIN sources s ON s.id = a.source_id WHERE s.max_images_per_page IS NOT NULL) x ON x.doc_id = b.doc_id AND x.image_url = b.image_url WHERE x.n IS NULL OR x.n <= x.cap")
def image_caps(article_media, articles, sources):
    return cleanup.trimmed(article_media, articles, sources.select("id", F.col("max_images_per_page").alias("cap"))).select("doc_id", "image_url")


@query("image_jobs", "article_media", sql="""WITH r AS (SELECT image_url, doc_id AS article, 0 AS o FROM article_media WHERE turn % 2 = 0 UNION ALL SELECT image_url, doc_id + turn % 2, 1 FROM article_media), one AS (SELECT image_url, article, min(o) AS o FROM r GROUP BY 1, 2)
  SELECT image_url, string_agg(CAST(article AS VARCHAR), ',' ORDER BY o, article) AS articles FROM one GROUP BY 1""")
def image_jobs(article_media):
    bridge = article_media.where("turn % 2 = 0").select("image_url", F.col("doc_id").alias("article"))
    bundles = article_media.select("image_url", (F.col("doc_id") + F.col("turn") % 2).alias("article"))
    return cleanup.image_jobs(bridge, bundles).select("image_url", F.array_join(F.transform("articles", lambda x: x.cast("string")), ",").alias("articles"))


@query("media_bridge_export", "article_media", "articles", sql="SELECT a.url, b.image_url, b.alt FROM article_media b JOIN articles a ON a.doc_id = b.doc_id WHERE a.source_id IN ('src0', 'src2')")
def media_bridge_export(article_media, articles):
    return article_media.join(articles.where(F.col("source_id").isin("src0", "src2")), "doc_id").select("url", "image_url", "alt").orderBy("url", "image_url")


@query("article_listing", "articles", sql="SELECT url, content_hash FROM articles WHERE source_id = 'src3'")
def article_listing(articles):
    return articles.where("source_id = 'src3'").select("url", "content_hash").orderBy("url")


@query("assets_of_article", "articles", "pages", sql="SELECT a.url, p.url AS asset FROM articles a JOIN pages p ON p.final_url IN (a.url, nullif(a.source_page_url, '')) WHERE p.status = 200 AND p.raw_path IS NOT NULL")
def assets_of_article(articles, pages):
    """Assets (here: pages with a file) whose source is the article or its page."""
    keyed = articles.select("url", F.explode(joins.aliases("url", "source_page_url")).alias("k"))
    files = pages.where("status = 200 AND raw_path IS NOT NULL").select(F.col("final_url").alias("k"), F.col("url").alias("asset"))
    return keyed.join(files, "k").select("url", "asset")


@query("unavailable_urls", "pages", sql="SELECT DISTINCT u, access_mode FROM (SELECT url AS u, access_mode FROM pages WHERE access_mode IN ('auth_required', 'blocked') UNION SELECT replace(url, 'https://', 'http://'), access_mode FROM pages WHERE access_mode IN ('auth_required', 'blocked')) x")
def unavailable_urls(pages):
    return pages.where(F.col("access_mode").isin("auth_required", "blocked")).select(F.explode(U.variants(F.col("url"))).alias("u"), "access_mode").distinct()


@query("consistency_codes", "articles", "pages", sql="""SELECT a.url, concat_ws(',', CASE WHEN p.url IS NULL THEN 'page_missing' END, CASE WHEN NOT coalesce(p.title = a.title, false) THEN 'title' END, CASE WHEN NOT coalesce(a.content_hash = sha256(a.body_text), false) THEN 'hash' END, CASE WHEN NOT coalesce(a.published_at IS NOT DISTINCT FROM p.published_at, false) THEN 'date' END) AS codes FROM articles a LEFT JOIN pages p ON p.url = a.url""")
def consistency_codes(articles, pages):
    p = pages.select(F.col("url").alias("p_url"), F.col("title").alias("p_title"), F.col("published_at").alias("p_date"))
    j = articles.join(p, F.col("url") == F.col("p_url"), "left")
    codes = cleanup.mismatch_codes(page_missing=F.col("p_url").isNotNull(), title=F.col("p_title") == F.col("title"), hash=F.col("content_hash") == text.content_hash(F.col("body_text")), date=F.col("published_at").eqNullSafe(F.col("p_date")))
    return j.select("url", F.array_join(codes, ",").alias("codes"))


@query("issue_counters", "articles", sql="""WITH i AS (SELECT url, 'no_title' AS issue FROM articles WHERE coalesce(title, '') = '' UNION ALL SELECT url, 'no_date' FROM articles WHERE coalesce(published_at, '') = '' UNION ALL SELECT url, 'short' FROM articles WHERE length(body_text) < 200), r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY url) AS n FROM i)
  SELECT issue, count(*) AS count, string_agg(url, ',' ORDER BY url) FILTER (WHERE n <= 3) AS samples FROM r GROUP BY issue""")
def issue_counters(articles):
    codes = cleanup.mismatch_codes(no_title=F.col("title") != "", no_date=F.col("published_at") != "", short=F.char_length("body_text") >= 200)
    return cleanup.issues(articles.withColumn("codes", codes), "codes", "url", 3)


@query("parsed_against_stored", "article_media", sql="""WITH s AS (SELECT doc_id, list_distinct(list(image_url)) AS stored FROM article_media WHERE turn < 4 GROUP BY 1), p AS (SELECT doc_id, list_distinct(list(image_url)) AS parsed FROM article_media WHERE turn % 3 <> 1 GROUP BY 1)
  SELECT s.doc_id, array_to_string(list_sort(list_filter(parsed, lambda x: NOT list_contains(stored, x))), ',') AS missing, array_to_string(list_sort(list_filter(stored, lambda x: NOT list_contains(parsed, x))), ',') AS extra FROM s JOIN p ON p.doc_id = s.doc_id""")
def parsed_against_stored(article_media):
    s = article_media.where("turn < 4").groupBy("doc_id").agg(F.collect_set("image_url").alias("stored"))
    p = article_media.where("turn % 3 <> 1").groupBy("doc_id").agg(F.collect_set("image_url").alias("parsed"))
    return s.join(p, "doc_id").withColumn("d", cleanup.set_differences(F.col("stored"), F.col("parsed"))).select("doc_id", F.array_join("d.missing", ",").alias("missing"), F.array_join("d.extra", ",").alias("extra"))


@query("media_sets", "article_media", sql="SELECT doc_id, count(DISTINCT image_url) AS images, string_agg(DISTINCT alt, ',' ORDER BY alt) AS alts FROM article_media GROUP BY 1")
def media_sets(article_media):
    return article_media.groupBy("doc_id").agg(F.count_distinct("image_url").alias("images"), F.array_join(F.sort_array(F.collect_set("alt")), ",").alias("alts"))


@query("ordered_links", "raw_pages", sql="SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS targets, regexp_extract(html, 'href=\"([^\"]*)\"', 1) AS first_target FROM pages")
def ordered_links(pages):
    found = dedup.ordered_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", F.size(found).cast("long").alias("targets"), F.coalesce(F.get(found, 0), F.lit("")).alias("first_target"))


@query("article_link_counts", "raw_pages", sql=f"SELECT page_id, len(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: regexp_matches(x, '(?i){rules.NEWS}'))) AS article_links FROM pages")
def article_link_counts(pages):
    """Same-host links of article shape; relative targets are of the page's host."""
    targets = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    mine = F.filter(targets, lambda x: ((U.host(x) == "") | (U.host(x) == U.host(F.col("url")))) & x.rlike("(?i)" + rules.NEWS))
    return pages.select("page_id", F.size(mine).cast("long").alias("article_links"))


@query("identity_resolution", "outbox", sql="SELECT event_id, source_id, entity_key FROM outbox WHERE batch_id IS NOT NULL AND event_id LIKE '%0'")
def identity_resolution(o):
    keys = ["event_id", "source_id"]
    asked = o.where("event_id LIKE '%0'").select(*keys)
    found, _ = cleanup.resolve(asked, o.where("batch_id IS NOT NULL"), keys, "entity_key")
    return found


@query("unresolved_identities", "outbox", sql="SELECT event_id, source_id FROM outbox WHERE batch_id IS NULL AND event_id LIKE '%3'")
def unresolved_identities(o):
    keys = ["event_id", "source_id"]
    return cleanup.resolve(o.where("event_id LIKE '%3'").select(*keys), o.where("batch_id IS NOT NULL"), keys, "entity_key")[1]


@query("batch_cascade", "outbox", sql="WITH b AS (SELECT batch_id, CASE WHEN count_if(status = 'acked') = count(*) THEN 'acked' WHEN count_if(status = 'failed') = count(*) THEN 'failed' ELSE 'partial' END AS s FROM outbox WHERE batch_id IS NOT NULL GROUP BY 1) SELECT o.event_id, coalesce(b.s, o.status) AS status, CAST(1 + CASE WHEN b.s = 'failed' THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM outbox o LEFT JOIN b ON b.batch_id = o.batch_id")
def batch_cascade(o):
    from ..operators import outbox

    return cleanup.cascade(o.withColumn("attempts", F.lit(1)), outbox.settle(o.where("batch_id IS NOT NULL"))).select("event_id", "status", "attempts")


@query("body_recovery", "outbox", "articles", sql="SELECT o.event_id, a.url FROM outbox o JOIN articles a ON a.doc_id = CAST(substr(o.event_id, 2) AS BIGINT) WHERE o.batch_id IS NOT NULL AND a.content_hash = sha256(a.body_text)")
def body_recovery(o, articles):
    """Bodies of a batch's articles whose digest is the one recorded."""
    items = o.where("batch_id IS NOT NULL").withColumn("doc_id", F.substring("event_id", 2, 20).cast("long"))
    return items.join(articles, "doc_id").where(F.col("content_hash") == F.sha2("body_text", 256)).select("event_id", "url")


@query("date_precedence", "articles", "pages", sql=f"SELECT a.url, CASE WHEN coalesce(a.published_at, '') <> '' THEN a.published_at ELSE coalesce(p.published_at, '') END AS published, CASE WHEN coalesce(a.published_at, '') > '{TODAY}' THEN 'future' ELSE 'past' END AS era FROM articles a LEFT JOIN pages p ON p.url = a.url")
def date_precedence(articles, pages):
    j = articles.join(pages.select("url", F.col("published_at").alias("listed")), "url", "left")
    return j.select("url", dates.first_of(F.col("published_at"), F.col("listed")).alias("published"), F.when(F.coalesce("published_at", F.lit("")) > TODAY, "future").otherwise("past").alias("era"))
