"""Text, hashing and JSON functions."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Labels of persons in signatures.
LABELS = {"author": ("作者", "文/", "撰文", "撰稿"), "reporter": ("记者", "通讯员"), "editor": ("编辑", "责编", "责任编辑"), "publisher": ("来源", "供稿", "发布单位")}
#: How decodings are compared; earlier ones win ties.
ENCODINGS = ("utf-8", "gb18030", "big5")


def sanitize(col: Column) -> Column:
    """Without byte order marks and control characters other than tab and line ends."""
    return F.regexp_replace(col, r"[\p{Cc}\x{FEFF}&&[^\t\n\r]]", "")


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def bounded(col: Column, most: int) -> Column:
    """Sanitised, trimmed, cut and trimmed again; null if nothing is left."""
    return F.nullif(F.trim(F.left(F.trim(sanitize(col)), F.lit(most))), F.lit(""))


def excerpt(col: Column, most: int) -> Column:
    return F.when(F.char_length(col) > most, F.concat(F.left(col, F.lit(most)), F.lit("…"))).otherwise(col)


def word_excerpt(col: Column, most: int) -> Column:
    """Cut at the last space if at least half of the text stays."""
    cut = F.left(col, F.lit(most))
    at_word = F.regexp_replace(cut, r"\s+\S*\z", "")
    return F.when(F.char_length(col) <= most, col).when(F.char_length(at_word) * 2 >= most, F.concat(at_word, F.lit("…"))).otherwise(F.concat(cut, F.lit("…")))


def error_detail(col: Column) -> Column:
    return F.left(collapse(col), F.lit(500))


def redact(col: Column, *secrets: str) -> Column:
    for s in secrets:
        if s:
            col = F.replace(col, F.lit(s), F.lit("[redacted]"))
    return col


def content_hash(col: Column) -> Column:
    return F.sha2(F.coalesce(col, F.lit("")), 256)


def event_id(source: Column, url: Column, revision: Column) -> Column:
    return F.sha2(F.concat_ws("\n", source, url, revision), 256)


def label_value(col: Column, *labels: str) -> Column:
    """What follows one of the labels, up to the next label of any kind or the end of its line."""
    every = "|".join(x for names in LABELS.values() for x in names)
    return F.trim(F.regexp_extract(col, f"(?:{'|'.join(labels)})" + r"\s*[:：]\s*(.{1,120}?)(?=\s*(?:" + every + r")\s*[:：]|[\n)）|｜]|$)", 1))


def attribution(col: Column) -> Column:
    """author, reporter, editor and publisher named in the last 800 characters."""
    tail = F.right(col, F.lit(800))
    return F.struct(*(F.nullif(label_value(tail, *names), F.lit("")).alias(role) for role, names in LABELS.items()))


#: What cleans and rejects the value of a signature.
SIGNATURE_CUT = r"\s*(?:发布时间|发布日期|更新时间|修改时间|(?:点击|浏览|访问)(?:量|次数)?)\s*[:：].*$"
SIGNATURE_TAIL = r"(?:[/／][文图摄编]|摄影?)$"
NO_SIGNATURE = (r"(?i)^(?:https?://|www\.)", r"^(?:通讯员|编辑|记者|作者)$", r"^20[0-9]{2}[/.-][0-9]{1,2}[/.-][0-9]{1,2}(?:\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?$", r"受[^，。；;]{0,30}资助")
#: Where a name ends, and what stands before it for each role; of several matches the last one counts.
NAME = r"([^（）()\[\]\n，,。；;|｜、：\"'“”‘’「」『』《》\s0-9]+)"
NAME_ENDS = r"(?=来源|记者|编辑|作者|文/|图片|摄影|摄像|日期|时间|http|www|原文|链接|发布|责任编辑|剪辑|审核|校对|素材|文章|通讯员|[0-9]{4}|[0-9]{1,2}:[0-9]{2}|$|[（）()\[\]\n，,。；;|｜、：\"'“”‘’「」『』《》\s])"
ROLES = {
    "reporter": (r"记者\s*[:：]\s*", r"(?:本报|本网|本刊|本站|央视)?记者\s+"),
    "author": (r"作者\s*[:：]\s*", r"(?<!论)文\s*[:：/]\s*"),
    "editor": (r"(?:责任)?编辑\s*[:：]\s*",),
    "publisher": (r"(?<!素材|文章|资金)来源\s*[:：]\s*",),
}
UNIT_WORDS = "部|院|系|所|室|中心|实验室|办公室|委员会|工会|团委|党委|党组|报|社|网|台|刊|杂志|出版社|通讯社|媒体"


def signature(value: Column) -> Column:
    """A signature's value without labels that follow it and role marks at its end; '' for what can't be a name."""
    v = F.trim(F.regexp_replace(collapse(value), SIGNATURE_CUT, ""))
    fits = F.char_length(v).between(2, 120) & ~v.rlike(NO_SIGNATURE[0])
    w = F.trim(F.regexp_replace(v, SIGNATURE_TAIL, ""))
    wrong = F.char_length(w) < 2
    for pattern in NO_SIGNATURE[1:]:
        wrong = wrong | w.rlike(pattern)
    return F.when(fits & ~wrong, w).otherwise("")


def signatures(body: Column) -> Column:
    """author, reporter, editor and publisher of the signatures at the end of a text (its last 800 characters).

    Each role has labels in order of precedence; a unit named in brackets at the very end is the publisher if no label names one."""
    tail = F.right(F.coalesce(body, F.lit("")), F.lit(800))

    def last(label: str) -> Column:
        found = F.regexp_extract_all(tail, F.lit(label + NAME + NAME_ENDS), F.lit(1))
        return signature(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))

    out = {role: F.coalesce(*(F.nullif(last(x), F.lit("")) for x in labels), F.lit("")) for role, labels in ROLES.items()}
    unit = signature(F.regexp_extract(F.rtrim(tail), r"[（(]([^)）]{2,30})[）)]\s*$", 1))
    out["publisher"] = F.when(out["publisher"] != "", out["publisher"]).when(unit.rlike(UNIT_WORDS), unit).otherwise("")
    return F.struct(*(out[r].alias(r) for r in ("author", "reporter", "editor", "publisher")))


#: What the end of a body has in common with a page's frame.
SHELL_MARKS = ("版权所有", "Copyright", "All Rights Reserved", "技术支持")


def shell_end(body: Column) -> Column:
    """Whether the last 1,000 characters hold what belongs to the page's frame."""
    tail, out = F.right(F.coalesce(body, F.lit("")), F.lit(1000)), F.lit(False)
    for mark in SHELL_MARKS:
        out = out | tail.contains(mark)
    return out


def escaped(col: Column) -> Column:
    """Text for display in HTML."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(mark), F.lit(name))
    return col


def secret_free_url_digest(col: Column) -> Column:
    return F.sha2(col, 256)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, no escapes beyond JSON's own."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonicalise_json(text: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null for what isn't JSON. to_json drops nulls and keeps field order, so it can't stand in."""

    def one(x):
        try:
            return canonical_json(json.loads(x))
        except (TypeError, ValueError):
            return None

    return text.map(one)


def _clean(value: object) -> object:
    if isinstance(value, str):
        return "".join(c for c in value if c in "\t\n\r" or c != "﻿" and unicodedata.category(c) != "Cc")
    if isinstance(value, dict):
        return {_clean(str(k)): _clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_clean(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float)) else _clean(str(value))


@F.pandas_udf(StringType())
def sanitize_json(text: pd.Series) -> pd.Series:
    """JSON text with every string in it, keys too, sanitised."""

    def one(x):
        try:
            return canonical_json(_clean(json.loads(x)))
        except (TypeError, ValueError):
            return None

    return text.map(one)


def revision_hash(value: dict) -> str:
    """Digest of a normalised publication; when it was observed is no part of it."""
    return hashlib.sha256(canonical_json({k: v for k, v in value.items() if k != "observedAt"}).encode()).hexdigest()


def tombstone_hash(url: Column, content: Column, last_seen: Column) -> Column:
    """Digest of {content_hash, last_seen, tombstone, url} in canonical JSON, written without Python."""
    q = lambda c: F.to_json(F.array(F.coalesce(c, F.lit(""))))
    inner = lambda c: F.substr(q(c), F.lit(2), F.char_length(q(c)) - 2)
    return F.sha2(F.concat(F.lit('{"content_hash":'), inner(content), F.lit(',"last_seen":'), inner(last_seen), F.lit(',"tombstone":true,"url":'), inner(url), F.lit("}")), 256)


CHARSET = re.compile(rb"charset\s*=\s*['\"]?([\w-]+)", re.I)


def _reading(body: bytes, name: str) -> str | None:
    try:
        return body.decode(name)
    except (LookupError, UnicodeDecodeError):
        return None


def decode_body(body: bytes | None, header: str | None = None) -> str:
    """Text of a response, whose header may name a charset: of all strict readings the one of the most Chinese characters,
    then the least replacement marks, then the least signs of a wrong reading; the page's own charset and UTF-8 win ties."""
    if not body:
        return ""
    own = CHARSET.search(body[:8192])
    names = dict.fromkeys(filter(None, (own and own[1].decode("ascii", "ignore"), *ENCODINGS[:2], header, *ENCODINGS[2:])))
    readings = [t for t in (_reading(body, n) for n in names) if t is not None]
    worth = lambda t: (sum("一" <= c <= "鿿" for c in t), -t.count("\ufffd"), -sum(map(t.count, ("Ã", "Â", "\ufffd"))))
    return max(readings, key=worth) if readings else body.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode(body: pd.Series) -> pd.Series:
    return body.map(decode_body)


def sniff(body: Column, content_type: Column) -> Column:
    """'html', 'xml' or 'other' by type, first bytes and the first 200 characters."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    head = F.lower(F.trim(F.left(F.coalesce(body, F.lit("")), F.lit(200))))
    return F.when(kind.isin("text/html", "application/xhtml+xml") | head.contains("<html") | head.startswith("<!doctype html"), "html").when(kind.rlike("xml|rss|atom") | head.startswith("<?xml") | head.startswith("<rss") | head.startswith("<urlset"), "xml").otherwise("other")
