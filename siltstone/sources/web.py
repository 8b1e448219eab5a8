"""What a crawl reads and sends: robots policies, sitemaps, retry rules, and the seams where a network would be.

Fetching itself is an interface: `Fetcher` is called in each task for a host's
URLs, with the host's delay kept by having a host in one task."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.text import decode_body
from ..functions.url import canonical

Fetcher = Callable[[str], dict]
FETCH_SCHEMA = "url string, status int, content_type string, body binary, error string"
#: Seconds that a Retry-After may ask for, bytes of a body, statuses worth a retry.
MOST_RETRY_AFTER, MOST_BODY, RETRY_STATUSES = 30.0, 30 << 20, (429, 500, 502, 503, 504)


def retry_after(value: str | None, now: datetime) -> float:
    """Seconds that a Retry-After header asks for (a number or a date), 0 to 30."""
    try:
        wait = float(value or 0)
    except ValueError:
        try:
            at = parsedate_to_datetime(value)
        except (TypeError, ValueError):
            return 0.0
        wait = ((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - now).total_seconds()
    return min(max(wait, 0.0), MOST_RETRY_AFTER)


def backoff(attempt: Column, most: float = 60.0) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(most))


def robots_verdict(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls with allowed and reason by their origin's stored robots.txt (origin, status, body).

    404: everything is allowed. Other 4xx: nothing is. 5xx, no answer or no
    record: not now, and `cacheable` is false so that a later run asks again."""
    origin = F.lower(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1))

    @F.pandas_udf("boolean")
    def may(url: pd.Series, body: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}

        def one(u, text):
            if text is None:
                return True
            if text not in known:
                known[text] = RobotFileParser()
                known[text].parse(text.splitlines())
            return known[text].can_fetch(agent, u)

        return pd.Series([one(u, t) for u, t in zip(url, body)])

    r = robots.select(F.lower("origin").alias("__o"), F.col("status").alias("__s"), F.col("body").alias("__b"))
    j = urls.withColumn("__origin", origin).join(r, F.col("__origin") == F.col("__o"), "left")
    status = F.coalesce("__s", F.lit(0))
    reason = F.when(status == 404, "").when(status.between(200, 299), F.when(may("url", "__b"), "").otherwise("disallowed")).when(status.between(400, 499), "robots_denied").otherwise("robots_unavailable")
    return j.withColumn("reason", reason).withColumns({"allowed": F.col("reason") == "", "cacheable": status.between(200, 499)}).drop("__origin", "__o", "__s", "__b")


def xml_links(body: bytes | None, base: str) -> list[str]:
    """Canonical loc and link texts of a sitemap or feed, in order; broken XML is read by pattern."""
    text = decode_body(body)
    try:
        found = [(n.text or "").strip() for n in ElementTree.fromstring(text).iter() if isinstance(n.tag, str) and n.tag.rpartition("}")[2].lower() in ("loc", "link")]
    except ElementTree.ParseError:
        found = [x.strip() for x in re.findall(r"(?is)<(?:loc|link)\b[^>]*>(.*?)</(?:loc|link)>", text)]
    return list(dict.fromkeys(u for u in (canonical(x, base) for x in found if x) if u))


def sitemap_urls(bodies: DataFrame) -> DataFrame:
    """(url, target) of every link in sitemap bodies (url, body)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"url": pdf["url"], "targets": [xml_links(b, u) for u, b in zip(pdf["url"], pdf["body"])]})

    return bodies.select("url", "body").mapInPandas(run, "url string, targets array<string>").select("url", F.explode("targets").alias("target"))


def fetch(urls: DataFrame, fetcher: Fetcher, delay: float = 1.0, retries: int = 2) -> DataFrame:
    """FETCH_SCHEMA for each URL. A host's URLs are in one task, which waits between them; several hosts share a task."""

    def run(batches):
        last: dict[str, float] = {}
        for pdf in batches:
            out = []
            for u in pdf["url"]:
                host = u.split("/")[2].lower() if "//" in u else ""
                got = {"status": 0, "error": "no attempt"}
                for attempt in range(retries + 1):
                    time.sleep(max(0.0, last.get(host, 0.0) + delay - time.monotonic()))
                    last[host] = time.monotonic()
                    try:
                        got = fetcher(u)
                    except Exception as e:
                        got = {"status": 0, "error": f"{type(e).__name__}: {e}"[:500]}
                    if got.get("status") and got["status"] not in RETRY_STATUSES:
                        break
                    time.sleep(retry_after(got.get("retry_after"), datetime.now(timezone.utc)) if attempt < retries else 0)
                body = got.get("body")
                if body is not None and len(body) > MOST_BODY:
                    body, got["error"] = None, f"body exceeds {MOST_BODY} bytes"
                out.append((u, int(got.get("status") or 0), got.get("content_type") or "", body, got.get("error") or ""))
            yield pd.DataFrame(out, columns=["url", "status", "content_type", "body", "error"])

    return urls.select("url", U.host(F.col("url")).alias("h")).repartition("h").mapInPandas(run, FETCH_SCHEMA)
