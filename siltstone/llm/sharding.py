"""Sharding by sampled splitters.

Size-weighted samples of the range key give quantile boundaries; records are
range-partitioned on them and overfull ranges are subdivided with further
samples. Exact running sums inside each range then cut the key order into
shards of equal bytes, so a sample decides only how the work is dealt, never
which shard a record belongs to.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SAMPLES_PER_RANGE = 32
RANGE_BYTES = 64 << 20
MOST_RANGES = 8192
#: Equal texts stay in one shard where they are at most this part of one.
GROUP_PART = 128


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Range number of (__k, __d): how many boundaries are at or below it, by halving steps."""
    if not bounds:
        return F.lit(0)
    longs = lambda values: F.expr(f"array({','.join(f'{v}L' if v > -(1 << 63) else 'bigint(-9223372036854775808)' for v in values)})")
    k, d = longs(b[0] for b in bounds), longs(b[1] for b in bounds)

    def step(have: Column, width: Column) -> Column:
        at = have + width
        bk, bd = F.get(k, at - 1), F.get(d, at - 1)
        return F.when((at <= len(bounds)) & ((bk < F.col("__k")) | ((bk == F.col("__k")) & (bd <= F.col("__d")))), at).otherwise(have)

    widths = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(widths, F.lit(0), step)


def _draw(narrow: DataFrame, total: int, m: int, seed: int) -> list[tuple[int, int, float]]:
    """About m keys drawn with probability in proportion to size (expected m, at most a few more), each with the bytes it stands for."""
    p = F.least(F.lit(1.0), F.col("__size") * F.lit(m / max(total, 1)))
    u = F.pmod(F.xxhash64(F.lit(seed), "__k", "__d"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = narrow.where(u < p).select("__k", "__d", F.greatest(F.col("__size").cast("double"), F.lit(total / m)).alias("w")).collect()
    return sorted((r[0], r[1], r[2]) for r in rows)


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    if not sample or parts < 2:
        return []
    cum = np.cumsum([s[2] for s in sample])
    at = np.searchsorted(cum, cum[-1] * np.arange(1, parts) / parts)
    return sorted({sample[i][:2] for i in at if i < len(sample)})


def shard(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", slot_col: str = "slot", overfull: float = 1.5, rounds: int = 4, ranges: int | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """df with `shard` (int, 0 to n_shards - 1) and `slot` (long, gapless from 0 in each shard).

    Records are ordered by (hash of the text, id), so equal texts are
    neighbours, and shard s takes those whose preceding bytes lie in the s-th
    part of all bytes: shards differ by one record at most. The size of a
    record is the UTF-8 bytes of its text plus 1. A null text counts as empty
    and a null id sorts first; repeated rows keep slots of their own. A group
    of equal texts on a boundary stays whole, in the shard in which it begins,
    if it has at most one in GROUP_PART of a shard's bytes; larger ones are
    split there, so that a group with a third of all rows overfills no shard.
    An empty table gives no rows.
    Columns of df named like the two outputs are replaced; others (or those in
    `keep`, so that texts need not travel) are kept.

    Driver memory: samples and range totals, at most MOST_RANGES *
    SAMPLES_PER_RANGE keys."""
    spark, tmp = df.sparkSession, Scratch(df.sparkSession, "shard")
    base = df.drop(shard_col, slot_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = base.withColumns({"__k": F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), "__d": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "__size": F.octet_length(text).cast("long") + 1})
    if keep is not None:
        keyed = keyed.select(*keep, "__k", "__d", "__size")
        base = base.select(*keep)
    narrow = tmp.table(keyed.select("__k", "__d", "__size"), "narrow")
    total, count = narrow.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    if not count:
        return base.withColumns({shard_col: F.lit(0), slot_col: F.lit(0).cast("long")})
    parts = ranges or int(min(MOST_RANGES, max(16 * n_shards, total // RANGE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    bounds = _quantiles(_draw(narrow, total, parts * SAMPLES_PER_RANGE, 1), parts)
    for turn in range(rounds + 1):
        sizes = {r["r"]: (r["b"], r["n"]) for r in narrow.groupBy(_range_of(bounds).alias("r")).agg(F.sum("__size").alias("b"), F.count("*").alias("n")).collect()}
        full = [r for r, (b, n) in sizes.items() if b > overfull * total / parts and n > 1]
        if not full or turn == rounds or len(bounds) >= MOST_RANGES:
            break
        inside = narrow.withColumn("r", _range_of(bounds)).where(F.col("r").isin(full))
        over = sum(sizes[r][0] for r in full)
        extra = 2 * sum(-(-sizes[r][0] * parts // total) for r in full)
        more = _quantiles(_draw(inside, over, extra * SAMPLES_PER_RANGE, 2 + turn), extra)
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    byte_base, row_base, b, n = [], [], 0, 0
    for r in range(len(bounds) + 1):
        byte_base.append(b)
        row_base.append(n)
        x = sizes.get(r, (0, 0))
        b, n = b + x[0], n + x[1]

    def placed(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("__r").orderBy("__k", "__d", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("__r") + 1).cast("long")
        rows = rows.withColumn("__r", _range_of(bounds)).withColumns({"__before": F.sum("__size").over(order) - F.col("__size"), "__row": F.count("*").over(order) - 1})
        return rows.withColumns({shard_col: F.least(F.lit(n_shards - 1), F.call_function("div", (F.col("__before") + at(byte_base)) * n_shards, F.lit(total)).cast("int")), "__row": F.col("__row") + at(row_base)})

    ends = {r[0]: (r[1], r[2]) for r in placed(narrow).groupBy(shard_col).agg(F.min(F.struct("__row", "__k")), F.max(F.struct("__row", "__k"))).collect()}
    first = {s: lo["__row"] for s, (lo, _) in ends.items()}
    # At most one group lies on each boundary.
    used = sorted(ends)
    torn = {ends[s][1]["__k"]: (s, t) for s, t in zip(used, used[1:]) if ends[s][1]["__k"] == ends[t][0]["__k"]}
    whole = {}
    if torn:
        for r in narrow.where(F.col("__k").isin(list(torn))).groupBy("__k").agg(F.sum("__size").alias("b"), F.count("*").alias("n")).collect():
            if r["b"] * n_shards * GROUP_PART <= total:
                whole[r["__k"]] = torn[r["__k"]][0]
    if whole:
        moved = placed(narrow).where(F.col("__k").isin(list(whole))).groupBy("__k", shard_col).agg(F.max("__row").alias("last")).collect()
        for r in moved:
            if r[shard_col] != whole[r["__k"]]:
                first[r[shard_col]] = max(first[r[shard_col]], r["last"] + 1)
    firsts = F.array(*(F.lit(first.get(s, 0)).cast("long") for s in range(n_shards)))
    out = placed(keyed)
    home = F.col(shard_col)
    for k, s in whole.items():
        home = F.when(F.col("__k") == k, F.lit(s)).otherwise(home)
    return out.withColumn(shard_col, home).withColumn(slot_col, F.col("__row") - F.element_at(firsts, F.col(shard_col) + 1)).drop("__k", "__d", "__size", "__r", "__before", "__row")
