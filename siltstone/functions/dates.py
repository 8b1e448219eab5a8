"""Publication dates. Text in, ISO text out ('' for none); the clock is always a parameter."""

from __future__ import annotations

import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Separated dates come before compact ones; years are 20xx; a digit must not touch the match.
SEPARATED = r"(?<![0-9])(20[0-9]{2})[年./-]([0-9]{1,2})[月./-]([0-9]{1,2})日?(?:[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?(?![0-9])"
COMPACT = r"(?<![0-9])(20[0-9]{2})([0-9]{2})([0-9]{2})(?:[ T]([0-9]{2})([0-9]{2})([0-9]{2}))?(?![0-9])"
PUBLISH_LABELS = "发布时间|发布日期|发布于|发稿时间|(?<![一-鿿A-Za-z])日期"
ANY_LABELS = PUBLISH_LABELS + r"|更新时间|(?:来源|消息来源)\s*[:：]?\s*时间"
#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_PATTERNS = tuple(re.compile(p) for p in (SEPARATED, COMPACT))


def parse(text: str | None) -> str:
    """The first valid date or time that either pattern finds; a pattern's first match decides for it."""
    flat = " ".join((text or "").split())
    for pattern in _PATTERNS:
        m = pattern.search(flat)
        if not m:
            continue
        try:
            when = datetime(*(int(g or 0) for g in m.groups()))
        except ValueError:
            continue
        return when.isoformat(timespec="seconds") if any(m.groups()[3:]) else when.date().isoformat()
    return ""


@F.pandas_udf(StringType())
def parse_date(text: pd.Series) -> pd.Series:
    return text.map(parse)


def parse_date_simple(text: Column) -> Column:
    """Dates without times by JVM functions: separated, then compact. The text occurs once for each, as it may be costly to work out."""

    def of(pattern: str) -> Column:
        return F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, "$1-$2-$3").try_cast("date").cast("string")

    return F.coalesce(of(SEPARATED), of(COMPACT), F.lit(""))


def labelled(text: Column, labels: str = PUBLISH_LABELS) -> Column:
    """The 40 characters after a date label, for parse_date."""
    return F.regexp_extract(text, f"(?:{labels})" + r"\s*[:：]?\s*([^\n|｜]{0,40})", 1)


def trailing(text: Column) -> Column:
    """A full date that is the last content of a text. The text occurs once, without the two of F.right."""
    tail = F.substring(F.rtrim(text, F.lit(WHITE)), -300, 300)
    p = r"(20[0-9]{2})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日?\s*$"
    return F.coalesce(F.regexp_replace(F.regexp_extract(tail, p, 0), p, "$1-$2-$3").try_cast("date").cast("string"), F.lit(""))


def moment(value: Column) -> Column:
    """Timestamp of ISO text with or without time and offset; naive text is in the session's zone. Null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))


def within(value: Column, days: int, now: Column) -> Column:
    """Whether text is a moment of the last `days` days, or up to one day ahead."""
    t = moment(value)
    return F.coalesce((t >= now - F.expr(f"INTERVAL {days} DAYS")) & (t <= now + F.expr("INTERVAL 1 DAY")), F.lit(False))


def trusted(value: Column, source: Column, now: Column) -> Column:
    """A future date (beyond tomorrow) counts only if an explicit publication mark gave it."""
    late = moment(value) > now + F.expr("INTERVAL 1 DAY")
    return F.when(~F.coalesce(late, F.lit(False)) | source.isin("path", "jsonld", "meta", "labelled"), value).otherwise("")


def shanghai(value: Column) -> Column:
    """ISO text with offset +08:00 to the second; naive text is taken as local to Shanghai. The session's zone must be UTC."""
    has_offset = value.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    utc = F.when(has_offset, moment(value)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(value), "Asia/Shanghai"))
    return F.concat(F.date_format(F.from_utc_timestamp(utc, "Asia/Shanghai"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def first_of(*dates: Column) -> Column:
    """Precedence of date sources: the first that isn't empty."""
    return F.coalesce(*(F.nullif(d, F.lit("")) for d in dates), F.lit(""))


def pad(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
