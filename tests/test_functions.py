from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import classify, dates, html, text
from siltstone.functions import url as U
from siltstone.operators import extract, joins, outbox, upsert
from siltstone.sources import archive, catalogue, web

NOW = "2026-06-30T12:00:00"


@pytest.mark.parametrize(
    "raw, base, want",
    [
        ("HTTP://Example.COM:80/a//b/../c/?b=2&a=1&utm_source=x#f", None, "http://example.com/a/c/?a=1&b=2"),
        ("../x?ref=1", "https://e.org/a/b/c", "https://e.org/a/x"),
        ("http://www.ustc.edu.cn/_t12/info/1.htm", None, "https://www.ustc.edu.cn/info/1.htm"),
        ("javascript:void(0)", "https://e.org/", ""),
        ("https://e.org:bad/", None, ""),
        ("/a${x}", "https://e.org/", ""),
        ("/a%27b", "https://e.org/", ""),
        ("", "https://e.org/", ""),
        ("https://e.org./", None, "https://e.org/"),
    ],
)
def test_canonical(raw, base, want):
    assert U.canonical(raw, base) == want


@settings(max_examples=60, deadline=None)
@given(st.from_regex(r"\Ahttps?://[a-z]{1,5}\.[a-z]{2,3}(:[0-9]{2,4})?(/[a-z0-9]{0,4}){0,3}(\?[a-z]=[0-9](&[a-z]=[0-9])?)?\Z"))
def test_canonical_is_stable(raw):
    once = U.canonical(raw)
    assert U.canonical(once) == once


def test_simple_form_agrees(spark):
    urls = ["https://E.org/a?b=1&a=2", "http://e.org:80", "https://e.org:8443//x//y?utm_a=1&gclid=2", "ftp://e.org/", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.normalize_simple(F.col("u")).alias("s"), U.normalize_url(F.col("u"), F.lit(None).cast("string")).alias("e")).collect()
    assert all((r["s"] or "") == r["e"] for r in rows)


def test_slashes_collapse(spark):
    assert spark.sql("SELECT regexp_replace('/a//b', '/{2,}', '/') AS x").first()["x"] == "/a/b"


@pytest.mark.parametrize(
    "value, want",
    [("2026年3月5日 08:30", "2026-03-05T08:30:00"), ("2026-13-40 then 20260305", "2026-03-05"), ("2026.9-2027.1", ""), ("x20260230", ""), ("1999-01-01", ""), ("", ""), ("12026-01-02", "")],
)
def test_parse_date(value, want):
    assert dates.parse(value) == want


def test_date_columns(spark):
    df = spark.createDataFrame([("2026-07-02", "path"), ("2026-07-02", "text"), ("2026-06-30", "text"), ("", "text"), (None, "text")], "d string, s string")
    now = F.lit(NOW).cast("timestamp")
    got = [tuple(r) for r in df.select(dates.within(F.col("d"), 30, now), dates.trusted(F.col("d"), F.col("s"), now)).collect()]
    assert got == [(False, "2026-07-02"), (False, ""), (True, "2026-06-30"), (False, ""), (False, None)]


@pytest.mark.parametrize(
    "path, want",
    [("page/2046/2026/0504/c1a2/page.htm", "2026-05-04"), ("2026/0504", "2026-05-04"), ("2026/0230/2025/0101/", "2025-01-01"), ("2046/2026/x", ""), ("2026/0230/2025-01-01.htm", ""), ("a/2026_02_03.htm", "2026-02-03"), ("a?2026-02-03", ""), (None, "")],
)
def test_date_in_url(spark, path, want):
    url = F.concat(F.lit("https://e.org/"), F.lit(path).cast("string"))
    assert spark.range(1).select(U.date_in_url(url).alias("d")).first()["d"] == want


def test_score_gates(spark):
    now = F.lit(NOW).cast("timestamp")
    s = lambda **k: classify.score_page(page_url=F.lit("https://e.org/news/1.htm"), now=now, **k)
    body = F.lit("x" * 500)
    r = spark.range(1).select(s(robots=F.lit(True)).alias("a"), s(status=F.lit(403)).alias("b"), s(status=F.lit(500)).alias("c"), s(duplicate=F.lit(True)).alias("d"), s(title=F.lit("t"), body=body, has_article=F.lit(True), published=F.lit("2026-06-01")).alias("e"), s(html=F.lit("<input type=password>"), title=F.lit("login")).alias("f")).first()
    assert [r[k]["page_kind"] for k in "abcdef"] == ["robots_blocked", "auth_gate", "error", "duplicate", "news_article", "auth_gate"]
    assert r["e"]["value_score"] == 35 + 20 + 20 + 10 + 5 + 5 and r["e"]["value_tier"] == "full_index"
    assert r["d"]["value_score"] == 3


@pytest.mark.parametrize(
    "title, category, want",
    [("关于放假的通知", "", "notice"), ("录取通知书发放", "", "news"), ("Faculty ", "", "other"), ("新闻：通告解读", "", "news"), ("通告", "", "notice"), ("招生简章", "", "notice"), ("班车时刻表", "", "notice"), ("x", "公示", "notice"), ("x", "视频中心", "other"), (None, None, "news")],
)
def test_publication_type(spark, title, category, want):
    c = classify.publication_type(page_url=F.lit("https://e.org/info/1"), source_id=F.lit("s"), title=F.lit(title), category=F.lit(category), page_kind=F.lit("news_article"))
    assert spark.range(1).select(c.alias("t")).first()["t"] == want


PAGE = """<html><head><title>Site</title><meta property="og:title" content="A fine day"><link rel="canonical" href="/c/1.htm">
<script type="application/ld+json">{"@graph":[{"author":[{"name":"A"},"B"],"datePublished":"2026-05-01T10:00:00"}]}</script></head>
<body><nav><a href="/">home</a></nav><div class="breadcrumb">首页 > 科研动态 > 正文</div><div id="vsb_content"><h1>A fine day</h1><p>First &amp; best. <b>Bold</b></p><table><tr><td>a</td><td>b</td></tr></table>
<figure><img data-src="/i.png" alt="pic"><figcaption>cap</figcaption></figure><ul><li>one</li><li>two</li></ul><p>""" + "long text " * 20 + """</p><script>x()</script></div>
<ul><li><a href="/info/2.htm">Second</a> 2026-01-02</li><li onclick="window.open('/info/3.htm')">Third</li></ul></body></html>"""


def test_extract():
    r = extract.extract("https://e.org/info/1.htm", PAGE)
    assert (r["title"], r["author"], r["published_at"], r["canonical_url"], r["category"]) == ("A fine day", "A, B", "2026-05-01T10:00:00", "https://e.org/c/1.htm", "科研动态")
    assert r["is_article"] and r["body_text"].startswith("First & best. Bold\na b\n") and "x()" not in r["body_text"]
    assert r["links"] == ["https://e.org/", "https://e.org/info/2.htm", "https://e.org/info/3.htm"] and r["link_dates"] == {"https://e.org/info/2.htm": "2026-01-02"}
    assert r["images"] == [{"url": "https://e.org/i.png", "alt": "pic", "title": "", "caption": "cap"}]
    for part in ("**Bold**", "| a | b |", "![pic](https://e.org/i.png)", "- one\n- two"):
        assert part in r["body_markdown"]


def test_extract_tolerates():
    for page in (None, "", "<", "<p>x", "<div" * 50, "</p></p>", "<script>"):
        assert extract.extract("https://e.org/", page)["is_article"] is False


LONG = "word " * 40


@pytest.mark.parametrize(
    "source, url, page, want",
    [
        ("vsb", "https://e.org/2026/0203/c1a2/page.htm", f'<h1 class="arti_title">T [2026-02-01]</h1><p class="arti_metas">发布时间：2026年2月3</p><div class="wp_articlecontent"><p>{LONG}</p></div><i>发布时间：2020-01-01</i>', ("T", "2026-02-03", "adapter")),
        ("vsb", "https://e.org/2026/0203/c1a2/page.htm", f'<div class="article-tit"><h1>T</h1></div><div class="wp_articlecontent"><p>{LONG}</p></div><i>发布时间：2026-1-2</i>', ("T", "2026-01-02", "adapter")),
        ("vsb", "https://e.org/other", f'<h1 class="arti_title">T</h1><div class="wp_articlecontent"><p>{LONG}</p></div>', ("T", "", "generic")),
        ("course", "https://e.org/portal/news/info/?id=3", f'<div class="infion-con"><span>T</span> 2026-3-4</div><div class="Content"><p>{LONG}</p></div>', ("T", "2026-03-04", "adapter")),
        ("jhtml", "https://e.org/a.jhtml", f'<p class="News-detail-title">T</p><div class="news-detail-notes">发布时间: 2026/5/6</div><div class="news-detail-news-con"><p>{LONG}</p></div>', ("T", "2026-05-06", "adapter")),
        ("jhtml", "https://e.org/a.jhtml", f'<p class="News-detail-title">T</p><div class="news-detail-notes">2026-05-06</div><div class="news-detail-news-con"><p>{LONG}</p></div>', ("T", "", "adapter")),
        ("wordpress", "https://e.org/p", f'<div class="detail-text"><h1>T</h1><h2><span>2026-07-08</span></h2><p>{LONG}</p></div>', ("T", "2026-07-08", "adapter")),
        ("wordpress", "https://e.org/p", f'<div class="detail-text"><h1>T</h1><p>{LONG}</p></div>', ("T", "", "generic")),
        ("yz", "https://e.org/p", f'<p class="zkd-title">T</p><div class="provenance">来源 2026-09-01</div><div class="txt-new"><p>{LONG}</p></div>', ("T", "2026-09-01", "adapter")),
    ],
)
def test_adapters(source, url, page, want):
    r = extract.extract(url, page, source)
    assert (r["title"], r["published_at"] if r["extraction_method"] == "adapter" else "", r["extraction_method"]) == want
    if want[2] == "adapter" and r["is_article"]:
        assert "T" not in r["body_text"].split() and r["body_text"].startswith("word")


def test_content_places():
    menu = "<ul class='content'>" + "<li><a href=x>many linked words in a menu of the page here</a></li>" * 8 + "</ul>"
    page = f"<body>{menu}<div class='nav'><div id='vsb_content'>{LONG * 5}</div></div><table><tr><td class='content'><p>{LONG}</p></td></tr></table><div id='divContent' style='display:none'><p>The real text of it.</p></div></body>"
    assert html.flat(html.content_root(html.parse(page)).text(" ")) == "The real text of it."
    assert html.content_root(html.parse("<body><p>only text</p></body>")).tag == "body"
    assert html.content_root(html.parse(f"<div class='cont'><div class='text'><img src=a></div></div><div class='text'>{LONG}</div>")).attrs["class"] == "text"


@pytest.mark.parametrize(
    "url, page, why",
    [
        ("https://e.org/x?attachment_id=3", f"<article><h1>T</h1><p>{LONG}</p></article>", "attachment"),
        ("https://e.org/news/list2.htm", f"<article><h1>T</h1><p>{LONG}</p></article>", "listing"),
        ("https://e.org/plain", f"<div class='content'><h1>T</h1><p>{LONG}</p></div>", "no sign of an article"),
        ("https://e.org/info/1.htm", "<div id='vsb_content'><h1>T</h1><p>发布时间: 2026-01-02 上一篇: </p></div>", "frame only"),
        ("https://e.org/info/1.htm", f"<body><h1>T</h1><div>{LONG}</div></body>", "no paragraph"),
        ("https://e.org/info/1.htm", "<div id='vsb_content'></div><h1>T</h1>", "empty"),
        ("https://e.org/info/1.htm", f"<div id='vsb_content'><p>{LONG}</p></div>", "untitled"),
    ],
)
def test_pages_that_are_no_articles(url, page, why):
    assert extract.extract(url, page)["is_article"] is False
    root = html.parse(page)
    node = html.content_root(root)
    clean = html.without_chrome(node)
    for h in clean.find("h1"):
        h.parent.kids = [k for k in h.parent.kids if k is not h]
    assert why in extract.vetoes(url, root, node, html.title(root), html.block_text(clean), False, False, False, False)


def test_dates_in_the_text():
    page = "<div id='vsb_content'><h1>T</h1><p>{}</p></div>"
    assert extract.extract("https://e.org/info/1.htm", page.format(LONG + " 2026年3月4日"))["published_at"] == "2026-03-04"
    assert extract.extract("https://e.org/info/1.htm", page.format("On 2026-03-04 " + LONG))["published_at"] == ""


def test_markdown_images():
    ok = extract.markdown_images_ok
    assert ok("![a](/p/1) `![b](/x)`\n```\n![c](/y)\n```", {"/p/1"})
    assert not ok("![a](/other)", {"/p/1"}) and not ok("![a][r]\n\n[r]: /other", {"/p/1"})


def test_display_is_safe():
    out = html.display(html.parse('<p onclick=x>a<script>b</script><a href="javascript:x">c</a><img src="l"><img src="m"></p>'), {"l": "/local/1"})
    assert out == '<p>a<a>c</a><img src="/local/1"></p>'


def test_json_and_text(spark):
    assert text.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert text.revision_hash({"a": 1, "observedAt": "x"}) == text.revision_hash({"a": 1, "observedAt": "y"})
    assert text.decode_body("中文内容".encode("gb18030")) == "中文内容" and text.decode_body(b"") == ""
    assert text.decode_body("繁體字".encode("big5"), "big5") and text.decode_body(b"<meta charset='big5'>" + "繁體字".encode("big5")).endswith("繁體字") and text.decode_body(b"\xff\xfe\xff") == "\ufffd\ufffd\ufffd"
    r = spark.createDataFrame([("﻿a\x01 b　 c",)], "s string").select(text.collapse(text.sanitize(F.col("s"))).alias("x")).first()
    assert r["x"] == "a b c"


def test_web_rules(spark):
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert [web.retry_after(x, now) for x in ("5", "900", "-1", "bad", None, "Thu, 01 Jan 2026 00:00:10 GMT")] == [5, 30, 0, 0, 0, 10]
    assert web.xml_links(b"<urlset><url><loc>https://e.org/a</loc></url><url><loc>/b</loc></url></urlset>", "https://e.org/") == ["https://e.org/a", "https://e.org/b"]
    assert web.xml_links(b"<rss><link>https://e.org/a</link><broken", "https://e.org/") == ["https://e.org/a"]
    urls = spark.createDataFrame([(f"https://{h}.org/x",) for h in "abcde"], "url string")
    robots = spark.createDataFrame([("https://a.org", 404, None), ("https://b.org", 403, None), ("https://c.org", 503, None), ("https://d.org", 200, "User-agent: *\nDisallow: /x")], "origin string, status int, body string")
    got = {r["url"][8]: (r["allowed"], r["reason"], r["cacheable"]) for r in web.robots_verdict(urls, robots).collect()}
    assert got == {"a": (True, "", True), "b": (False, "robots_denied", True), "c": (False, "robots_unavailable", False), "d": (False, "disallowed", True), "e": (False, "robots_unavailable", False)}
    fetched = web.fetch(urls, lambda u: {"status": 200, "body": u.encode()}, delay=0.0).collect()
    assert len(fetched) == 5 and all(r["status"] == 200 and r["error"] == "" for r in fetched)


def test_catalogue(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("sources:\n - {id: b, name: B, allowed_hosts: [B.Org], seed_urls: ['http://b.org/?utm_x=1']}\nsupplemental_sources:\n - {id: a, name: A, allowed_hosts: [a.org], max_images_per_page: 3, discovery_only: true}\n")
    src = catalogue.load_config(spark, str(tmp_path / "s.yaml"))
    rows = {r["id"]: r for r in src.collect()}
    assert rows["b"]["allowed_hosts"] == ["b.org"] and rows["b"]["seed_urls"] == ["http://b.org/"] and catalogue.image_caps(src).count() == 1
    assert catalogue.revision(src) == catalogue.revision(src.orderBy(F.col("id").desc()))
    page = spark.createDataFrame([('<a href="http://math.ustc.edu.cn/">数学学院</a><a href="http://x.com/">某中心</a><a href="/q">other</a>',)], "html string")
    found = {r["name"]: (r["level"], r["official"]) for r in catalogue.discover(page, "https://www.ustc.edu.cn/").collect()}
    assert found == {"数学学院": ("college", True), "某中心": ("center", False)}
    units = spark.createDataFrame([(0, "N", "http://h.org/", "H.org", "unit"), (1, "M", "http://h.org/2", "h.org", "unit"), (2, "x", "u", "", "unit")], "position int, name string, url string, host string, level string")
    (u,) = catalogue.unit_sources(units).collect()
    assert (u["id"], u["name"], u["aliases"]) == ("unit-h-org", "N", ["M"])


def test_routing_rules(spark):
    urls = spark.createDataFrame([("https://a.b.org/x",), ("https://b.org/",), ("https://c.com/",), ("bad",), (None,)], "url string")
    src = spark.createDataFrame([("z", ["b.org"], []), ("y", ["a.b.org"], []), ("x", ["a.b.org"], ["b.org"]), ("w", ["b.org."], [])], "id string, allowed_hosts array<string>, blocked_hosts array<string>")
    got = {r["url"]: r["owner"] for r in joins.route_hosts(urls, src).collect()}
    assert got == {"https://a.b.org/x": "y", "https://b.org/": "w", "https://c.com/": None, "bad": None, None: None}


def test_outbox(spark):
    box = spark.createDataFrame([("1", "p"), ("2", "q")], "event_id string, payload string")
    new = spark.createDataFrame([("2", "q"), ("2", "q"), ("3", "r"), ("1", "other")], "event_id string, payload string")
    out, bad = outbox.append(box, new)
    assert sorted(r["event_id"] for r in out.collect()) == ["1", "2", "3"] and [r["event_id"] for r in bad.collect()] == ["1"]
    assert sorted(r["event_id"] for r in outbox.append(out, new)[0].collect()) == ["1", "2", "3"]


def test_oversized_event(spark):
    rows = [("a", "k1", "2026-01-03", "pending", None, 10, "s"), ("b", "k2", "2026-01-02", "pending", None, 10**9, "s"), ("c", "k3", "2026-01-01", "pending", None, 10, "s")]
    box = spark.createDataFrame(rows, "event_id string, entity_key string, created_at string, status string, batch_id string, bytes long, source_id string")
    assert {r["event_id"]: r["batch"] for r in outbox.plan_batches(box).collect()} == {"a": 0, "b": -1, "c": 0}


def test_objects_and_bundles(spark, tmp_path):
    files = spark.createDataFrame([("https://e.org/a.PDF", "application/pdf", b"x"), ("https://e.org/b", "image/png", b"x"), ("https://e.org/c.averylongext", "text/plain", b"y")], "url string, content_type string, body binary")
    rows = archive.content_addressed(files).collect()
    assert len(rows) == 2 and {r["extension"] for r in rows} <= {".pdf", ".png", ".bin"}
    arts = spark.createDataFrame([("https://e.org/a", "t")], "url string, title string")
    imgs = spark.createDataFrame([("https://e.org/a", "i2", "x"), ("https://e.org/a", "i1", "y")], "url string, image_url string, alt string")
    archive.write_bundles(arts, imgs, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).count() == 1


def test_upsert_edge_cases(spark):
    schema = "k int, v string"
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, "a")], schema)
    assert upsert.upsert(empty, one, "k").collect() == one.collect() == upsert.upsert(one, empty, "k").collect()
    assert upsert.upsert(one, spark.createDataFrame([(1, "")], schema), "k", {"v": upsert.fill}).collect() == one.collect()
