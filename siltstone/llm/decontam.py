"""Benchmark decontamination with DataFrame functions only.

Benchmark texts become windows of n normalised words, broadcast as a hash table
from window hash to window text and items. A scan of the documents hashes every
window of words, probes the table and compares what it finds word for word, all
in one pass and without moving a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A word is a run of ASCII letters and digits and of anything beyond ASCII; this is what parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs of an item and a window that one broadcast holds (some 200 bytes each). More of them take more scans.
MOST_IN_SCAN = 400_000
#: What stands after a document's window hashes, so that every document leaves the scan with a row.
LAST = 0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _with_windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (words __w) with a column __x<length> for each length: the hashes of its windows of so many words.

    Hashes of 1, 2, 4, ... words are columns of their own, so that each is computed once."""

    def joined(a: str, b: str, gap: int) -> Column:
        return F.zip_with(a, F.slice(b, gap + 1, F.greatest(F.size(b) - gap, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    df = df.withColumn("__p1", F.transform("__w", lambda w: F.xxhash64(w)))
    size = 1
    while 2 * size <= max(lengths, default=1):
        df = df.withColumn(f"__p{2 * size}", joined(f"__p{size}", f"__p{size}", size))
        size *= 2
    for length in lengths:
        name, have = None, 0
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                if name is None:
                    df, have = df.withColumn("__x", F.col(f"__p{1 << bit}")), 1 << bit
                else:
                    df, have = df.withColumn("__x", joined("__x", f"__p{1 << bit}", have)), have + (1 << bit)
                name = "__x"
        df = df.withColumn(f"__x{length}", F.slice("__x", 1, F.greatest(F.size("__w") - length + 1, F.lit(0)))).drop("__x")
    return df


def _gram(at: Column, length: Column) -> Column:
    return F.array_join(F.slice("__w", at, length), " ")


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(h, len, gram, items): the distinct windows of all items; an item of fewer than n words, but not none, is one window."""
    b = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("__w")).where("size(__w) > 0")
    b = _with_windows(b, list(range(1, n + 1)))
    own = F.element_at(F.array(*(F.col(f"__x{k}") for k in range(1, n + 1))), F.least(F.size("__w"), F.lit(n)))
    b = b.select("item", "__w", F.least(F.size("__w"), F.lit(n)).alias("len"), F.posexplode_outer(own).alias("at", "h"))
    b = b.select("item", "len", "h", _gram(F.col("at") + 1, F.col("len")).alias("gram"))
    return b.groupBy("h", "len", "gram").agg(F.collect_set("item").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", keep: tuple[str, ...] = (), most_in_scan: int = MOST_IN_SCAN) -> tuple[DataFrame, DataFrame]:
    """(rows, hits). rows: id, __t (hash of the text), n_words and `keep` for every document;
    hits: id, __t, items (sorted ids of items with an occurring window, as strings), places (word numbers hit, from 1).

    A null text has no words. Documents of one id and text are one entry of
    hits. Benchmark items that are null or without words have no windows. An
    empty benchmark or table gives no hits. A benchmark of more than
    most_in_scan windows is broadcast in parts, each with a scan of its own."""
    tmp = Scratch(docs.sparkSession, "decontam")
    bench = tmp.table(benchmark_windows(benchmark, n, item_col, bench_text_col), "windows")
    sizes = bench.groupBy("len").agg(F.sum(F.size("items")).alias("c")).orderBy("len").collect()
    lengths, parts = [r["len"] for r in sizes], max(1, -(-sum(r["c"] for r in sizes) // most_in_scan))

    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__t"), words_of(F.col(text_col)).alias("__w"), *(F.col(c).alias(f"__keep{k}") for k, c in enumerate(keep)))
    kept = [f"__keep{k}" for k in range(len(keep))]
    rows = _with_windows(rows, lengths)
    every = F.concat(*(F.col(f"__x{k}") for k in lengths), F.array(F.lit(LAST).cast("long")))
    rows = rows.select("__id", "__t", *kept, "__w", F.size("__w").alias("__n"), every.alias("__every"))
    # Hashes of all lengths stand one after the other; `at` is a window's first word, from 1, if its hash is of length len.
    many = {k: F.greatest(F.col("__n") - k + 1, F.lit(0)) for k in lengths}
    before, offset = F.lit(0), F.lit(0)
    for k in lengths:
        offset = F.when(F.col("len") == k, before).otherwise(offset)
        before = before + many[k]
    at = F.col("__pos") - offset + 1
    end = F.lit(LAST).cast("long")
    found = None
    for part in range(parts):
        own = bench.where(F.pmod("h", F.lit(parts)) == part).select("h", "len", "gram", "items")
        if part == 0:
            # The end mark is a window of no words.
            mark = docs.sparkSession.range(1).select(end.alias("h"), F.lit(0).alias("len"), F.lit("").alias("gram"), F.array().cast("array<string>").alias("items"))
            own = own.unionByName(mark)
        # explode_outer: the plain one would make Spark evaluate the hashes once more in a filter.
        windows = rows.select("__id", "__t", *kept, "__w", "__n", F.posexplode_outer("__every").alias("__pos", "__h"))
        same = F.when(F.col("len") == 0, F.col("__pos") == before).otherwise(at.between(1, F.col("__n") - F.col("len") + 1) & (_gram(at, F.col("len")) == F.col("gram")))
        got = windows.join(F.broadcast(own), (F.col("__h") == F.col("h")) & same).select(F.col("__id").alias(id_col), "__t", *(F.col(a).alias(c) for a, c in zip(kept, keep)), F.col("__n").cast("long").alias("n_words"), at.alias("at"), "len", "items")
        found = got if found is None else found.unionByName(got)
    found = tmp.table(found, "scan")
    seen = found.where("len = 0").select(id_col, "__t", "n_words", *keep)
    hit = found.where("len > 0").select(id_col, "__t", "at", "len", "items").distinct()
    # Words that a window adds to those of the windows before it.
    upto = F.max(F.col("at") + F.col("len")).over(Window.partitionBy(id_col, "__t").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1))
    new = hit.withColumns({"lo": F.greatest("at", F.coalesce(upto, F.lit(1))), "hi": F.col("at") + F.col("len") - 1})
    places = F.flatten(F.collect_list(F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi"))))
    hits = new.groupBy(id_col, "__t").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sort_array(places).alias("places"))
    return seen, tmp.table(hits, "hits")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 8, least_items: int = 2, **names) -> DataFrame:
    """A row per document: id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= least_items)."""
    rows, hits = scan(docs, benchmark, n, **names)
    i = names.get("id_col", "doc_id")
    hits = hits.select(F.col(i).alias("__i"), F.col("__t").alias("__ht"), "items", F.size("places").cast("long").alias("hit"))
    out = rows.join(hits, rows[i].eqNullSafe(hits["__i"]) & (rows["__t"] == hits["__ht"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(i, "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(items) >= least_items).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 8, mode: str = "documents", least_items: int = 1, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """docs without contaminated documents (mode "documents"), or with the words hit cut from them (mode "spans").

    In mode "spans" a contaminated text keeps its remaining words as they
    stand, with everything between two kept words reduced to one space."""
    _, hits = scan(docs, benchmark, n, id_col, text_col, **names)
    hits = hits.where(F.size("items") >= least_items).select(F.col(id_col).alias("__i"), F.col("__t").alias("__ht"), "places")
    mark = docs.withColumn("__t", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    on = mark[id_col].eqNullSafe(hits["__i"]) & (mark["__t"] == hits["__ht"])
    if mode == "documents":
        return mark.join(hits, on, "left_anti").drop("__t")
    original = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    cut = F.array_join(F.filter(original, lambda w, i: ~F.array_contains(F.col("places"), i + 1)), " ")
    return mark.join(hits, on, "left").withColumn(text_col, F.when(F.col("places").isNotNull(), cut).otherwise(F.col(text_col))).select(*docs.columns)
