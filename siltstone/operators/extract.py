"""Page extraction: one pass over the pages, one parse a page, a wide row out. Site adapters plug in by source or host."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import dates, html, rules, text
from ..functions.url import canonical

PAGE_SCHEMA = "url string, canonical_url string, title string, is_article boolean, author string, category string, summary string, published_at string, updated_at string, body_html string, body_text string, body_markdown string, extraction_method string, content_hash string, links array<string>, link_dates map<string,string>, images array<struct<url:string,alt:string,title:string,caption:string>>, raw_json string"

Adapter = Callable[[str, html.Node], dict | None]
_BY_SOURCE: dict[str, Adapter] = {}
_BY_HOST: dict[str, Adapter] = {}


def register(adapter: Adapter, sources: tuple[str, ...] = (), hosts: tuple[str, ...] = ()) -> None:
    """Makes an adapter responsible for sources (looked up first) and hosts. It returns fields to override, or None to decline."""
    _BY_SOURCE.update(dict.fromkeys(sources, adapter))
    _BY_HOST.update(dict.fromkeys(hosts, adapter))


@dataclass(frozen=True)
class Template:
    """A site template: where its pages keep title, date and body (each a choice of places), and which of its pages are articles."""

    name: str
    title: tuple[str, ...]
    date: tuple[str, ...]
    body: tuple[str, ...]
    url: str = ""
    labelled: bool = False  # a date counts only after its label
    anywhere: bool = False  # a labelled date counts wherever on the page it stands
    inside: bool = False  # title and date stand in the body and are no part of it

    def __call__(self, url: str, root: html.Node) -> dict | None:
        if self.url and not re.search(self.url, url, re.I):
            return None
        body = next((n for p in self.body for n in html.at(root, p)), None)
        scope = body if self.inside and body is not None else root
        head = next((n for n in html.at(scope, *self.title) if html.flat(n.text(" "))), None)
        if body is None or head is None:
            return None
        dated = [(n, self._day(html.flat(n.text(" ")))) for n in html.at(scope, *self.date)]
        when = next(((n, d) for n, d in dated if d), None)
        title = re.sub(r"\s*\[[0-9]{4}-[0-9]{2}-[0-9]{2}\]\s*$", "", html.flat(head.text(" "))).strip()
        day = when[1] if when else self._day(html.flat(root.text(" "))) if self.anywhere else ""
        if self.inside:
            if when is None:
                return None
            for n in (head, when[0]):
                n.parent.kids = [k for k in n.parent.kids if k is not n]
            if len(html.flat(body.text(" "))) < 10:
                return None
        return {"title": title, "published_at": day, "body": body} if title else None

    def _day(self, words: str) -> str:
        for pattern in (LABELLED_DAY, PLAIN_DAY)[: 1 if self.labelled else 2]:
            m = pattern.search(words)
            if m:
                return f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}"
        return ""


# Date forms, templates and the hosts that use them.
PLAIN_DAY = re.compile(r"(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})")
LABELLED_DAY = re.compile(r"发布时间[：:]\s*(20[0-9]{2})[-年/]([0-9]{1,2})[-月/]([0-9]{1,2})")
TEMPLATES = {
    "course": (Template("course", ("div.infion-con span",), ("div.infion-con",), ("div.Content",), url=r"//[^/]+/portal/news/info/*(?:[?#]|$)"), ("course",)),
    "jhtml": (Template("jhtml", ("p.News-detail-title",), ("div.news-detail-notes",), ("div.news-detail-news-con",), labelled=True), ("iat",)),
    "vsb": (Template("vsb", (".arti_title", ".article-tit h1"), (".arti_metas",), (".wp_articlecontent",), url=r"/20[0-9]{2}/[0-9]{4}/c[0-9]+a[0-9]+/", labelled=True, anywhere=True), ("mech", "iid", "www.nsrl", "physics")),
    "wordpress": (Template("wordpress", ("h1",), ("h2",), ("div.detail-text", "div.detail-content"), inside=True), ("lib",)),
    "yz": (Template("yz", ("p.zkd-title",), ("div.provenance",), ("div.txt-new",)), ("yz",)),
}
for _template, _hosts in TEMPLATES.values():
    register(_template, sources=(_template.name,), hosts=tuple(f"{h}.{rules.HOME_DOMAIN}" for h in _hosts))


def vetoes(url: str, root: html.Node, content: html.Node, title: str, body: str, pictures: bool, media: bool, marked: bool, dated: bool) -> list[str]:
    """Why a page yields no article; empty if it does. marked: its data says it is one; dated: it names its publication date."""
    parts = urlsplit(url)
    place = parts.path.lower()
    listing = bool(re.search(rules.LISTING_PATH, place))
    single = listing and bool((len(body) > 180 or pictures) and html.at(root, ".arti_title", ".wp_single", "#wp_column_article") and html.at(root, ".wp_articlecontent"))
    fallback = content.tag in ("body", "#document")
    detail = any(re.search(p, place) for p in rules.DETAIL_PATHS) or bool(re.search(rules.EVENT_PATH, url, re.I)) or single
    alone = len(root.find("article")) == 1 and len(body) > 180
    bare = re.sub(rules.FRAME_MARKS, "", re.sub(rules.FRAME_WORDS, "", body.replace(title, "", 1) if title else body))
    shown = pictures or media
    checks = {
        "attachment": "attachment_id=" in parts.query.lower() or rules.ATTACHMENT_PATH in place,
        "listing": listing and not single,
        "no sign of an article": not (marked or dated or detail or alone),
        "frame only": bool(body) and not bare and not shown,
        "no paragraph": fallback and not any(len(html.flat(p.text(" "))) >= 20 for p in content.find("p")),
        "section title": fallback and html.generic_title(title),
        "banner": not body and not media and title.casefold() in rules.BANNERS,
        "empty": not body and not shown,
        "untitled": not title.strip(),
    }
    return [why for why, so in checks.items() if so]


#: Fields that take work of their own.
COSTLY = frozenset(("body_html", "body_markdown", "images"))


def extract(url: str, page: str | None, source_id: str = "", fields_wanted: frozenset[str] = COSTLY) -> dict:
    """All fields of one page. Without an article the body fields are empty, and so are costly ones that aren't wanted."""
    root = html.parse(page)
    ld = html.jsonld(root)
    pick = lambda *keys: next((html.person(o[k]) if k == "author" else html.flat(str(o[k])) for k in keys for o in ld if o.get(k)), "")
    rel = next((n.attrs.get("href", "") for n in root.find("link") if "canonical" in n.attrs.get("rel", "").split()), "")
    canon = canonical(rel, url) or canonical(html.meta(root, "og:url"), url)
    links, hints = html.links(root, url)
    node = html.content_root(root)
    clean = html.without_chrome(node)
    method, title, error = "generic", html.title(root), ""
    adapter = _BY_SOURCE.get(source_id) or _BY_HOST.get((urlsplit(url).hostname or "").lower())
    fields: dict = {}
    if adapter:
        try:
            fields = adapter(url, root) or {}
        except Exception as e:  # an adapter's failure keeps the generic result
            error = f"{type(e).__name__}: {e}"
        if fields.get("body") is not None:
            clean, method = html.without_chrome(fields["body"]), "adapter"
        title = fields.get("title") or title
    repeated = next((n for n in clean.find("h1", "h2", "h3") if html.flat(n.text(" ")) == title), None)
    if repeated is not None and title:
        repeated.parent.kids = [k for k in repeated.parent.kids if k is not repeated]
    body = html.block_text(clean)
    around = html.flat(root.text(" "))
    labels = re.compile(f"(?:{dates.PUBLISH_LABELS})" + r"\s*[:：]?\s*([^\n|｜]{0,40})")
    label = labels.search(around)
    path_date = re.search(r"/(20\d{2})/(\d{2})(\d{2})(?:/|$)|(20\d{2})[-_](\d{2})[-_](\d{2})", urlsplit(url).path)
    published = fields.get("published_at") or dates.parse(pick("datePublished")) or dates.parse(html.meta(root, "article:published_time", "PubDate", "publishdate")) or (dates.parse(label[1]) if label else "") or (dates.parse("-".join(g for g in path_date.groups() if g)) if path_date else "")
    updated = dates.parse(pick("dateModified")) or dates.parse(html.meta(root, "article:modified_time"))
    pics = html.images(clean, url)
    marked = any(str(t).endswith("Article") for o in ld for t in (o.get("@type") if isinstance(o.get("@type"), list) else [o.get("@type")]))
    said = pick("datePublished") or html.meta(root, "article:published_time", "PubDate", "publishdate")
    article = not vetoes(url, root, fields.get("body") or node, title, body, bool(pics), html.holds_media(clean), marked, bool(said or label))
    if article and not published:
        # A date in the text counts where a label stands before it, or as its very last words.
        last = re.search(r"(20[0-9]{2})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日?\s*$", body)
        near = next((m for m in (labels.search(body[:3000]), labels.search(body[-1500:])) if m), None)
        published = (dates.parse(near[1]) if near else "") or (dates.parse("-".join(last.groups())) if last else "")
    raw = {"jsonld": ld} | ({"adapter_error": error} if error else {})
    return {
        "url": url, "canonical_url": canon, "title": title, "is_article": article, "author": pick("author") or html.meta(root, "author"), "category": pick("articleSection") or html.meta(root, "article:section") or html.crumbs(root),
        "summary": html.meta(root, "description", "og:description"), "published_at": published, "updated_at": updated, "body_html": html.serialise(clean) if article and "body_html" in fields_wanted else "", "body_text": body if article else "",
        "body_markdown": html.markdown(clean, url) if article and "body_markdown" in fields_wanted else "", "extraction_method": method, "content_hash": hashlib.sha256(body.encode("utf-8", "replace")).hexdigest() if article else "", "links": links, "link_dates": hints,
        "images": pics, "raw_json": text.canonical_json(raw),
    }


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", source_col: str | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """PAGE_SCHEMA, or those of its fields that are named, for every page, whatever its size; null ones yield no article.

    Reads only the columns it needs, and works out only what is asked for."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(PAGE_SCHEMA)
    schema = schema if fields is None else StructType([schema[f] for f in fields])
    shape, wanted = to_arrow_schema(schema), frozenset(schema.names)
    src = F.col(source_col) if source_col else F.lit("")
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"), src.alias("source"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [extract(u or "", h, s or "", wanted) for u, h, s in zip(*(c.to_pylist() for c in part.columns))]
                columns = ([list(x[f.name].items()) if f.name == "link_dates" else x[f.name] for x in found] for f in shape)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], names=schema.names)

    return rows.mapInArrow(run, schema)


def retext(articles: DataFrame) -> DataFrame:
    """(url, body_text) of articles whose text, taken anew from body_html, differs from the stored one."""
    from pyspark.sql import functions as F

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"url": pdf["url"], "old": pdf["body_text"], "body_text": [html.block_text(html.parse(x)) for x in pdf["body_html"]]})

    return articles.select("url", "body_text", "body_html").mapInPandas(run, "url string, old string, body_text string").where(~F.col("old").eqNullSafe(F.col("body_text"))).select("url", "body_text")


def rebuild_markdown(articles: DataFrame, strict: bool = False) -> DataFrame:
    """(url, body_markdown, changed) from body_html and the article's registered images (map of digest to place)."""

    def run(batches):
        for pdf in batches:
            new = [html.markdown(html.parse(h), u, dict(p or {}), strict) for u, h, p in zip(pdf["url"], pdf["body_html"], pdf["proxies"])]
            yield pd.DataFrame({"url": pdf["url"], "body_markdown": new, "changed": [a != b for a, b in zip(new, pdf["body_markdown"])]})

    return articles.select("url", "body_html", "body_markdown", "proxies").mapInPandas(run, "url string, body_markdown string, changed boolean")


def markdown_images_ok(markdown: str | None, registered: set[str]) -> bool:
    """Whether every image outside code goes to a registered place."""
    plain = re.sub(r"(?ms)^(```|~~~).*?^\1[^\n]*$", "", markdown or "")
    plain = re.sub(r"(`+)(?:.|\n)*?\1", "", plain)
    refs = dict(re.findall(r"(?m)^\s{0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s|$)", plain))
    used = re.findall(r"(?<!\\)!\[[^\]]*\]\(\s*<?([^)\s>]+)", plain)
    used += [refs.get(r or alt, "") for alt, r in re.findall(r"(?<!\\)!\[([^\]]*)\]\[([^\]]*)\]", plain)]
    return all(u in registered for u in used)
