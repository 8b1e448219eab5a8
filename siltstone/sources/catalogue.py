"""Source catalogues: YAML lists, discovered units, per-source settings, revision digests."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, html, rules, text
from ..functions.url import canonical

SOURCE_SCHEMA = "id string, name string, organization_level string, allowed_hosts array<string>, blocked_hosts array<string>, seed_urls array<string>, aliases array<string>, discovery_only boolean, max_images_per_page int"
#: Levels by words of a unit's name, in order; what names a unit; hosts that are none.
LEVELS = (("department", ("系",)), ("college", ("学院", "学部")), ("center", ("中心",)), ("research", ("实验室", "研究所", "研究院")))
UNIT_WORDS = ("系", "学院", "学部", "中心", "实验室", "研究所", "研究院", "书院", "医院", "图书馆")
EXCLUDED_HOSTS = ("ustcnet.ustc.edu.cn", "ugs.ustc.edu.cn")


def load_config(spark: SparkSession, path: str, include_supplemental: bool = True) -> DataFrame:
    """The sources of a YAML file (a small dimension, read on the driver), hosts in lower case and seeds canonical."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    items = list(raw.get("sources") or []) + (list(raw.get("supplemental_sources") or []) if include_supplemental else [])
    low = lambda hosts: [str(h).lower() for h in hosts or []]
    rows = [(str(i["id"]), str(i.get("name", i["id"])), str(i.get("organization_level", "unit")), low(i.get("allowed_hosts")), low(i.get("blocked_hosts")), [u for u in map(canonical, i.get("seed_urls") or []) if u], list(map(str, i.get("aliases") or [])), bool(i.get("discovery_only", False)), i.get("max_images_per_page")) for i in items]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def discover(directory: DataFrame, page_url: str) -> DataFrame:
    """(name, url, host, level, official) of the anchors in directory pages (column html) whose text names a unit; each (name, url) once."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for page in pdf["html"]:
                for a in html.parse(page).find("a"):
                    name, url = html.flat(a.text(" ")), canonical(a.attrs.get("href", ""), page_url)
                    if url and name and any(w in name for w in UNIT_WORDS):
                        rows.append((name, url))
            yield pd.DataFrame(rows, columns=["name", "url"])

    from ..functions import url as U

    found = directory.select("html").mapInPandas(run, "name string, url string").distinct()
    host = U.host(F.col("url"))
    home = (host == rules.HOME_DOMAIN) | host.endswith("." + rules.HOME_DOMAIN)
    return found.select("name", "url", host.alias("host"), classify.organization_level(F.col("name"), LEVELS).alias("level"), (home & ~host.isin(*EXCLUDED_HOSTS)).alias("official"))


def unit_sources(units: DataFrame) -> DataFrame:
    """Sources of discovered units (position, name, url, host, level): the first of a host names it, later names are aliases."""
    u = units.where(F.coalesce("host", F.lit("")) != "").withColumn("host", F.lower("host"))
    g = u.groupBy("host").agg(F.min_by(F.struct("name", "url", "level"), "position").alias("f"), F.sort_array(F.collect_list(F.struct("position", "name"))).alias("all"))
    names = F.array_distinct(F.transform("all", lambda x: x["name"]))
    ident = F.concat(F.lit("unit-"), F.regexp_replace(F.regexp_replace("host", "[^a-z0-9]+", "-"), "^-|-$", ""))
    return g.select(ident.alias("id"), F.col("f.name").alias("name"), F.coalesce("f.level", F.lit("unit")).alias("organization_level"), F.array("host").alias("allowed_hosts"), F.array("f.url").alias("seed_urls"), F.array_except(names, F.array("f.name")).alias("aliases")).orderBy("id")


def image_caps(sources: DataFrame) -> DataFrame:
    return sources.where("max_images_per_page > 0").select("id", "max_images_per_page")


def revision(sources: DataFrame) -> str:
    """Digest of the catalogue: sources by id, hosts sorted. The catalogue is a driver-sized dimension."""
    rows = sorted(({"id": r["id"], "allowed_hosts": sorted(r["allowed_hosts"] or []), "blocked_hosts": sorted(r["blocked_hosts"] or []), "seed_urls": sorted(r["seed_urls"] or [])} for r in sources.collect()), key=lambda x: x["id"])
    return hashlib.sha256(text.canonical_json(rows).encode()).hexdigest()


def dumps(units: DataFrame, directory_url: str, generated_at: str) -> str:
    rows = [r.asDict() for r in units.collect()]
    return json.dumps({"directory_url": directory_url, "generated_at": generated_at, "units": [r for r in rows if r["official"]], "excluded": [r for r in rows if not r["official"]], "error": ""}, ensure_ascii=False, indent=2)
