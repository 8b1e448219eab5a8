"""Classifiers and scorers as one Column expression each: value of pages, queue priority, publication type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, rules, url


def _has(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike("(?i)" + pattern), F.lit(False))


def _any(col: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return F.coalesce(out, F.lit(False))


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def score_page(*, page_url: Column, now: Column, final_url: Column | None = None, title: Column | None = None, body: Column | None = None, html: Column | None = None, status: Column | None = None, content_type: Column | None = None, has_article: Column | None = None, published: Column | None = None, links: Column | None = None, documents: Column | None = None, duplicate: Column | None = None, robots: Column | None = None) -> Column:
    """struct(page_kind, access_mode, value_score, value_tier, score_reasons, published_at).

    The gates come first, in order; what passes them adds up points, each with
    its reason, between 0 and 100."""
    none, no, zero = F.lit(""), F.lit(False), F.lit(0)
    page_url, title, body, html = _text(page_url), _text(title if title is not None else none), _text(body if body is not None else none), _text(html if html is not None else none)
    target = F.coalesce(F.nullif(_text(final_url if final_url is not None else none), none), page_url)
    status = F.coalesce(status if status is not None else F.lit(200), zero)
    content_type = _text(content_type if content_type is not None else F.lit("text/html"))
    has_article, duplicate, robots = (F.coalesce(x if x is not None else no, no) for x in (has_article, duplicate, robots))
    links, documents = (F.coalesce(x if x is not None else zero, zero) for x in (links, documents))
    published = _text(published if published is not None else none)
    hay = F.lower(F.concat_ws(" ", page_url, target, title, F.left(body, F.lit(8000))))
    news = _has(F.concat_ws(" ", page_url, target, title), rules.NEWS)
    resource = _has(F.concat_ws(" ", page_url, target, title, F.left(body, F.lit(2500))), rules.RESOURCE)
    nav = _has(F.concat_ws(" ", page_url, target, title), rules.NAVIGATION)
    length = F.char_length(F.regexp_replace(body, r"(?U)^\s+|\s+$", ""))
    recent = dates.within(published, 365, now)
    signals = {"news": news, "resource": resource, "nav": nav, "length": length, "recent": recent}

    def judged(signal: Column) -> Column:
        news, resource, nav, length, recent = (signal[name] for name in signals)
        points = (
            (news, 35, F.lit("news/notice publication signal")),
            (resource, 30, F.lit("course/assignment/resource signal")),
            (has_article, 20, F.lit("article metadata or detail-page structure")),
            ((published != "") & recent, 20, F.lit("published within the last 365 days")),
            ((published != "") & ~recent, 5, F.lit("publication date captured")),
            (length >= 200, 10, F.lit("substantial text body")),
            (length < 80, -20, F.lit("empty or near-empty body")),
            (title != "", 5, F.lit("title captured")),
            (documents > 0, 10, F.concat(documents.cast("string"), F.lit(" document attachment link(s)"))),
            (F.lit(True), 5, F.lit("direct public response")),
            (nav, -20, F.lit("navigation/search/statistics boilerplate")),
            ((links > 0) & (length > 0) & (links > F.greatest(F.lit(40), F.floor(length / 12))), -10, F.lit("link-heavy listing with little unique text")),
            (~has_article & ~news & ~resource & (length < 160), -10, F.lit("generic shell without a publication/resource signal")),
        )
        total = F.lit(0)
        for cond, value, _ in points:
            total = total + F.when(cond, value).otherwise(0)
        score = F.greatest(zero, F.least(F.lit(100), total))
        tier = F.lit(rules.NOT_INDEXED)
        for least, name in reversed(rules.TIERS):
            tier = F.when(score >= least, name).otherwise(tier)
        reasons = F.array_compact(F.array(*(F.when(cond, reason) for cond, _, reason in points)))
        lower_type = F.lower(content_type)
        document = url.document_asset(target) | ((content_type != "") & ~lower_type.contains("html") & ~lower_type.contains("xml"))
        kind = F.when(document, "document").when(news & has_article, "news_article").when(news, "news_listing").when(resource, "course_resource").when(has_article, "article").when(nav, "navigation").when(length < 80, "shell").otherwise("page")

        def verdict(k, mode, s, t, why, date):
            c = lambda x: x if isinstance(x, Column) else F.lit(x)
            return F.struct(c(k).alias("page_kind"), c(mode).alias("access_mode"), c(s).cast("int").alias("value_score"), c(t).alias("value_tier"), why.alias("score_reasons"), c(date).alias("published_at"))

        gate = lambda k, mode, s, why, date: verdict(k, mode, s, rules.NOT_INDEXED, F.array(why), date)
        http = F.concat(F.lit("HTTP "), status.cast("string"))
        login = F.lower(html).contains("password") & (_has(hay, rules.AUTH) | F.lower(target).contains("/webapps/login"))
        return (
            F.when(robots, gate("robots_blocked", "blocked", 0, F.lit("robots.txt blocked"), published))
            .when(status.isin(401, 403), gate("auth_gate", "auth_required", 0, F.concat(http, F.lit(" requires access")), published))
            .when((status <= 0) | (status >= 400), gate("error", "unavailable", 0, http, published))
            .when(url.uploaded_html(target), gate("document", "public", 0, F.lit("uploaded HTML attachment"), ""))
            .when(login, gate("auth_gate", "login_required", 0, F.lit("login form without public body"), published))
            .when(duplicate, gate("duplicate", "public", 3, F.lit("same response body already stored under another URL"), published))
            .otherwise(verdict(kind, "public", score, tier, reasons, published))
        )

    # The signals are read many times and computed once, as the element of an array.
    return F.transform(F.array(F.struct(*(c.alias(name) for name, c in signals.items()))), judged)[0]


def url_priority(page_url: Column, source_id: Column, parent: Column, published: Column, now: Column) -> Column:
    """Place in the queue, larger first: publication pages above documents, recent ones above old ones."""
    page_url, parent = _text(page_url), _text(parent)
    date = F.coalesce(F.nullif(_text(published), F.lit("")), url.date_in_url(page_url))
    hay = F.lower(F.concat_ws(" ", page_url, _text(source_id)))
    news, resource = _has(hay, rules.NEWS), _has(hay, rules.RESOURCE)
    month, year = dates.within(date, 30, now), dates.within(date, 365, now)
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    low = F.lower(page_url)
    document = F.lit(260) + pts(resource, 100) + pts(news, 40) + F.when(month, 80).when(year, 40).otherwise(0)
    page = F.lit(100) + pts(news, 400) + F.when(resource, 180).when((parent != "") & _has(parent, rules.RESOURCE), 80).otherwise(0) + pts(low.contains("/sitemap") | low.rlike(r"\.(?:rss|atom)$"), 80) - pts(_has(hay, rules.NAVIGATION), 120) + F.when(month, 250).when(year, 120).otherwise(0)
    return F.when(url.document_asset(page_url), F.least(document, F.lit(500))).otherwise(F.least(page, F.lit(900))).cast("int")


def publication_type(*, page_url: Column, source_id: Column, title: Column, category: Column, page_kind: Column, other_urls: tuple[Column, ...] = (), stored: Column | None = None) -> Column:
    """'news', 'notice' or 'other'; a stored type wins. The only form of the rules, for SQL and DataFrames alike."""
    urls = F.lower(F.concat_ws(" ", _text(page_url), *map(_text, other_urls)))
    title, category, source = _text(title), _text(category), _text(source_id)
    named = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    reportage = _any(title, rules.REPORTAGE_WORDS)
    other = urls.contains(rules.VIDEO_PATH) | named(title).isin(*rules.OTHER_TITLES) | named(category).isin(*rules.OTHER_CATEGORIES) | ((source == rules.MATH_SOURCE) & named(category).isin(*rules.MATH_CATEGORIES))
    notice = (
        _any(urls, rules.NOTICE_URL_PARTS)
        | ((source == rules.CENTRAL_SOURCE) & (_any(urls, rules.NOTICE_SECTIONS) | urls.contains(rules.NOTICE_TREE)))
        | _any(category, rules.NOTICE_CATEGORY_WORDS)
        | _any(title, rules.NOTICE_TITLE_WORDS)
        | ((title.contains("的通知") | title.endswith("通知") | title.contains("通知：")) & ~title.contains("通知书"))
        | title.contains("时刻表")
        | (~reportage & (title.contains("通告") | (title.contains("招生") & _any(title, rules.ADMISSION_WORDS)) | (title.contains("复试") & _any(title, rules.RETEST_WORDS)) | title.contains("补充规定")))
    )
    computed = F.when(other, "other").when(notice, "notice").when(_text(page_kind).isin(*rules.OTHER_KINDS), "other").otherwise("news")
    return computed if stored is None else F.when(stored.isin("news", "notice", "other"), stored).otherwise(computed)


def organization_level(name: Column, levels: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first level one of whose words is in the name; 'unit' for none."""
    out = None
    for level, words in levels:
        out = F.when(_any(name, words), level) if out is None else out.when(_any(name, words), level)
    return out.otherwise("unit") if out is not None else F.lit("unit")


def fetch_failure(status: Column, robots: Column, error: Column) -> Column:
    """Kind of a failed fetch."""
    return F.when(F.coalesce(robots, F.lit(False)), "robots_disallowed").when(status >= 400, "http_status").when(_text(error).startswith("body exceeds "), "body_size_limit").otherwise("transport_error")


def delivery(status: Column) -> Column:
    """Outcome of a delivery: redirects and client errors are permanent, the rest is worth another try."""
    return F.when(status.between(200, 299), "success").when(status.between(300, 499), "permanent").otherwise("transient")


def media_priority(known: Column, status: Column, local_size: Column, size: Column) -> Column:
    """0: unseen, 1: to fetch again, 2: on disk as recorded (a size of 0 or null can't be checked and is trusted)."""
    intact = (status == "ok") & local_size.isNotNull() & ((F.coalesce(size, F.lit(0)) == 0) | (local_size == size))
    return F.when(~F.coalesce(known, F.lit(False)), 0).when(F.coalesce(intact, F.lit(False)), 2).otherwise(1)


def should_follow(kind: Column, score: Column, priority: Column, article_links: Column, depth: Column, suppressed: Column, least_score: int = 16) -> Column:
    """Whether a page's links are worth enqueueing: any of five signals, unless an incremental run suppresses them."""
    signal = (depth == 0) | (score >= least_score) | kind.isin("news_listing", "course_resource") | (priority >= 400) | (article_links >= 5)
    return F.coalesce(signal, F.lit(False)) & ~F.coalesce(suppressed, F.lit(False))


def generic_name(text: Column, names: tuple[str, ...]) -> Column:
    return F.lower(F.trim(F.regexp_replace(_text(text), r"(?U)\s+", " "))).isin(*[n.lower() for n in names])


def repair_needed(has_article: Column, page_kind: Column) -> Column:
    return ~has_article & (page_kind.isNull() | page_kind.isin(*rules.PUBLIC_KINDS))
