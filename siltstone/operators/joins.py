"""Joins: host ownership, alias matches, reconciliation. Theta and OR conditions become equi-joins on exploded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U


def route_hosts(urls: DataFrame, sources: DataFrame, url_col: str = "url", key: str | None = None) -> DataFrame:
    """urls with owner: the source whose allowed host is the longest suffix of the URL's host.

    sources: id, allowed_hosts, blocked_hosts (arrays). A source with any
    blocked match is out; equal lengths go to the smaller id; no match is null.
    Suffixes of each distinct host are exploded, so the suffix condition is an
    equi-join and each host is matched once however many URLs it has."""
    host = U.host(F.col(url_col))
    urls = urls.withColumn("__host", host)
    suffixes = urls.select("__host").distinct().select("__host", F.explode(U.host_suffixes(F.col("__host"))).alias("__suffix"))
    flat = lambda c: sources.select(F.col("id").alias("__owner"), F.explode(c).alias("__h")).select("__owner", F.lower(F.rtrim("__h", F.lit("."))).alias("__suffix")).distinct()
    allowed, blocked = suffixes.join(flat("allowed_hosts"), "__suffix"), suffixes.join(flat("blocked_hosts"), "__suffix").select("__host", "__owner").distinct()
    owner = allowed.join(blocked, ["__host", "__owner"], "left_anti").groupBy("__host").agg(F.min(F.struct((-F.length("__suffix")).alias("n"), F.col("__owner").alias("o")))["o"].alias("owner"))
    return urls.join(owner, "__host", "left").drop("__host")


def aliases(*cols: str) -> Column:
    """Non-empty URL columns in order of precedence, without repeats."""
    return F.array_distinct(F.filter(F.array(*map(F.col, cols)), lambda x: x.isNotNull() & (x != "")))


def alias_semi(left: DataFrame, right: DataFrame, alias_cols: tuple[str, ...], key: str = "url") -> DataFrame:
    """Rows of left any of whose alias columns is a key of right."""
    keyed = left.select(*alias_cols).distinct().withColumn("__a", F.explode(aliases(*alias_cols)))
    hits = keyed.join(right.select(F.col(key).alias("__a")), "__a", "left_semi").select(*(F.col(c).alias(f"__{c}") for c in alias_cols)).distinct()
    return left.join(hits, _same_aliases(alias_cols), "left_semi")


def _same_aliases(cols: tuple[str, ...]) -> list[Column]:
    """All alias columns together name a row; any of them may be null."""
    return [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols]


def alias_lookup(left: DataFrame, right: DataFrame, alias_cols: tuple[str, ...], key: str, value: str, out: str) -> DataFrame:
    """left with the value of the first alias (in the order given) that right knows and whose value isn't empty."""
    rows = [F.col(c).alias(f"__{c}") for c in alias_cols]
    keyed = left.select(*alias_cols).distinct().select(*rows, F.posexplode(aliases(*alias_cols)).alias("__rank", "__a"))
    found = keyed.join(right.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).select(F.col(key).alias("__a"), F.col(value).alias("__v")), "__a")
    names = [f"__{c}" for c in alias_cols]
    best = found.groupBy(*names).agg(F.min(F.struct("__rank", "__v"))["__v"].alias(out))
    return left.join(best, _same_aliases(alias_cols), "left").drop(*names)


def violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose non-null key no parent has."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("__k")), F.col(child_key) == F.col("__k"), "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, state, differing) of keys that are missing on one side or differ in a field; nulls are equal."""
    a = left.select(F.col(key).alias("__lk"), F.lit(True).alias("__l"), *(F.col(f).alias(f"__l_{f}") for f in fields))
    b = right.select(F.col(key).alias("__rk"), F.lit(True).alias("__r"), *(F.col(f).alias(f"__r_{f}") for f in fields))
    both = a.join(b, F.col("__lk") == F.col("__rk"), "full")
    diff = F.array_compact(F.array(*(F.when(~F.col(f"__l_{f}").eqNullSafe(F.col(f"__r_{f}")), F.lit(f)) for f in fields)))
    state = F.when(F.col("__r").isNull(), "missing").when(F.col("__l").isNull(), "extra").when(F.size(diff) > 0, "differs")
    return both.withColumn("state", state).where("state IS NOT NULL").select(F.coalesce("__lk", "__rk").alias(key), "state", F.when(F.col("state") == "differs", F.array_join(diff, ",")).otherwise("").alias("differing"))


def same_multiset(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of cols whose counts differ between the two (none: they agree as multisets)."""
    a, b = left.groupBy(*cols).agg(F.count("*").alias("__a")), right.groupBy(*cols).agg(F.count("*").alias("__b"))
    cond = None
    for c in cols:
        own = a[c].eqNullSafe(b[c])
        cond = own if cond is None else cond & own
    return a.join(b, cond, "full").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*(F.coalesce(a[c], b[c]).alias(c) for c in cols), F.coalesce("__a", F.lit(0)).alias("left_count"), F.coalesce("__b", F.lit(0)).alias("right_count"))


def update_from(target: DataFrame, source: DataFrame, key: str, cols: tuple[str, ...]) -> DataFrame:
    """target with cols taken from source where the key matches (a match with null is a null)."""
    s = source.select(F.col(key).alias("__k"), F.lit(True).alias("__m"), *(F.col(c).alias(f"__{c}") for c in cols))
    joined = target.join(s, F.col(key) == F.col("__k"), "left")
    return joined.select(*(F.when(F.col("__m"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns))


def bridged(owners: DataFrame, items: DataFrame, bridge: DataFrame, owner_key: str, item_key: str, direct_col: str) -> DataFrame:
    """(owner, item) pairs by the item's own column or by the bridge table; each pair once."""
    direct = items.select(F.col(direct_col).alias(owner_key), item_key).where(F.col(owner_key).isNotNull())
    via = bridge.select(owner_key, item_key).join(items.select(item_key), item_key, "left_semi")
    return direct.unionByName(via).join(owners.select(owner_key), owner_key, "left_semi").dropDuplicates([owner_key, item_key])


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank_col: str | None = None) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank_col or "__rank", F.row_number().over(w)).where(F.col(rank_col or "__rank") <= n)
    return out if rank_col else out.drop("__rank")
