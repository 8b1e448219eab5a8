"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its words gives each document floor(r) whole
copies; the remaining words are a sample of inclusion odds p/(1-p), where p is
the remaining share. Each document gets a random u and is ranked by
u/(1-u) / (p/(1-p)); the sample is the rank prefix whose words come nearest to
the remainder, so its size in words is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: One word is a run of these.
WORD = r"[^\x20\x09-\x0D]+"
#: Rank bins of a source. Only the bin that holds the cut is ever sorted.
BINS = 4096


def words_in(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(s, source_size, target): one row per source, the null source included.

    Weights repeat over the sources in code point order, null last. The total
    of `share` times all words is dealt by weight; a target stops at `most`
    times its source's words and the excess goes to the others by weight until
    none is above. The window without keys is over sources, a dimension table,
    after their words have been summed in parallel."""
    src = sized.groupBy(F.col(source_col).alias("s")).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("s").asc_nulls_last())
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights)) + 1))
    src = src.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    # Sources in the order in which they reach their cap as the level rises.
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("s").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumns({"left": F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "wleft": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    src = src.withColumn("level", F.col("left") / F.col("wleft"))
    src = src.withColumn("pos", F.row_number().over(rise))
    src = src.withColumn("free", F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct("pos", "level"))).over(every)["level"])
    return src.select("s", "source_size", F.least("cap", F.coalesce(F.col("free") * F.col("w"), F.col("cap"))).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", odds_col: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """df with size, source_size, target and taken (words, repeats counted: 0, 1 or 2 times size).

    u depends on the id and the seed alone, so reruns and any partitioning
    agree. odds_col, if given, multiplies a document's odds of inclusion. A
    null text has size 0 and is never taken; null sources form one source, the
    last; rows with equal ids have equal ranks and are taken or left together;
    an empty table gives no rows. Columns of df with the names of the outputs
    are replaced; `keep` names the columns to return (default: all)."""
    spark, tmp = df.sparkSession, Scratch(df.sparkSession, "mix")
    base = df.drop("size", "source_size", "target", "taken")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    names = base.columns if keep is None else list(keep)
    work = list(dict.fromkeys([*names, id_col, source_col, *([odds_col] if odds_col else [])]))
    docs = tmp.table(base.withColumns({"size": words_in(F.col(text_col)), "__u": u}).select(*work, "size", "__u"), "sized")
    src = tmp.table(source_targets(docs, source_col, weights, share, most), "sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    src = src.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))

    def ranked(rows: DataFrame) -> DataFrame:
        rows = rows.join(src, rows[source_col].eqNullSafe(src["s"]), "left")
        odds = F.col("p") / (1 - F.col("p"))
        if odds_col:
            odds = odds * F.greatest(F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0)), F.lit(1e-9))
        rows = rows.withColumn("__q", F.when(F.col("p") > 0, (F.col("__u") / (1 - F.col("__u"))) / odds))
        return rows.withColumn("__bin", F.floor(F.col("__q") / (1 + F.col("__q")) * BINS).cast("int"))

    narrow = ranked(docs.select(id_col, source_col, "size", "__u", *([odds_col] if odds_col else []))).where("p > 0 AND size > 0")
    bins = narrow.groupBy("s", "__bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    up = Window.partitionBy("s").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The bin in which the running words reach the remainder; all before it are in.
    cut_bin = bins.withColumn("upto", F.sum("words").over(up)).where("upto >= rest").groupBy(F.col("s").alias("cs")).agg(F.min(F.struct("__bin", (F.col("upto") - F.col("words")).alias("below"))).alias("c")).select("cs", F.col("c.__bin").alias("cbin"), "c.below")
    edge = narrow.join(cut_bin, narrow["s"].eqNullSafe(cut_bin["cs"]) & (F.col("__bin") == F.col("cbin")))
    run = Window.partitionBy("s").orderBy("__q", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = edge.withColumn("upto", F.sum("size").over(run) + F.col("below")).where("2 * upto - size <= 2 * rest").groupBy(F.col("s").alias("ls")).agg(F.max(F.struct(F.col("__q").alias("q"), F.col(id_col).alias("i"))).alias("last"))
    cuts = tmp.table(cut_bin.join(last, cut_bin["cs"].eqNullSafe(last["ls"]), "left").select("cs", "cbin", "last"), "cuts")
    out = ranked(docs)
    out = out.join(cuts, out["s"].eqNullSafe(cuts["cs"]), "left")
    by_id = F.col(id_col).isNull() | F.coalesce(F.col(id_col) <= F.col("last.i"), F.lit(False))
    inside = (F.col("__bin") < F.col("cbin")) | ((F.col("__bin") == F.col("cbin")) & F.coalesce((F.col("__q") < F.col("last.q")) | ((F.col("__q") == F.col("last.q")) & by_id), F.lit(False)))
    taken = F.col("size") * (F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.col("p") > 0, F.coalesce(inside, F.lit(True)).cast("long")).otherwise(0))
    return out.withColumn("taken", taken.cast("long")).select(*names, "size", "source_size", "target", "taken")


def copies(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes; documents without words, which no target counts, are left out."""
    n = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.where(F.col("taken") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), n))).drop("__copy", "size", "source_size", "target", "taken")
