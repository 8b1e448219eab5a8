"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each text's set of word shingles gets a MinHash signature of K coordinates;
   documents of equal sets are one class from then on, so copies never expand.
2. Coordinate-value pairs are ordered by how many classes have them, rarest
   first, over the whole corpus. Two sets that agree in at least T of the K
   coordinates share a pair among the first K - T + 1 of either, so a class is
   posted under that prefix only; what many unrelated documents have in common
   (a licence line) stands last in the order and is hardly ever posted.
3. Posting lists of one class, and lists with the members of another list, are
   dropped. Each other list is merged once: its first member counts collisions
   with all, members already connected are skipped, and only what is not yet
   in the largest component goes on to count. Pairs of T collisions or more
   are confirmed on the full sets; a list yields links that span what it
   connects, at most one a member, and never its pairs.
4. A list too long for one task is merged in blocks that share its first
   members; if it is still in several pieces, its stragglers meet every block.

No link is lost to a cap: T lies five standard deviations below the agreement
expected at the threshold, and links are decided on the sets (48-bit shingle
hashes: a wrong intersection has a chance of about 1e-9 a pair).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Scratch, connected_components, freed

K = 40
#: Classes and shingles of a list that one task merges; a longer list is dealt in blocks.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1_000_000
#: First members of a long list that every block of it has.
LEADERS = 8

_A = (tk.mix(np.arange(1, K + 1, dtype="uint64") * np.uint64(0xA0761D6478BD642F)) | np.uint64(1))
_B = tk.mix(np.arange(1, K + 1, dtype="uint64") * np.uint64(0xE7037ED1A0B428DB))


def least_matches(similarity: float, k: int = K) -> int:
    """T: agreement that a pair at the threshold misses with a chance under one in 10^5."""
    return max(1, math.floor(k * similarity - 5 * math.sqrt(k * similarity * (1 - similarity))))


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of K minima (uint32) of non-empty sets given by their values and bounds."""
    out = np.empty((len(first) - 1, K), "uint32")
    for i in range(K):
        out[:, i] = np.minimum.reduceat(((values * _A[i] + _B[i]) >> np.uint64(32)).astype("uint32"), first[:-1])
    return out


def _sets(column: pa.Array, words: int):
    """(row, set) of each row of a column; sets are sorted 48-bit values, empty for texts without words."""
    for i, j, data, off in tk.pieces(column):
        starts, ends, first = tk.words(data, off)
        s, row = tk.shingles(tk.span_hashes(tk.FOLD[data], starts, ends), first, words)
        values, bounds = tk.distinct_by_row(s, row, j - i)
        yield i, j, values, bounds


def _sketch(words: int):
    """id, text -> id, n, cls (16 bytes that name the set), sig."""

    def run(batches):
        for b in batches:
            n, cls, sig = [], [], []
            for i, j, values, bounds in _sets(b.column(1), words):
                size = np.diff(bounds)
                has = np.flatnonzero(size)
                mins = iter(signatures(values, np.concatenate([bounds[:-1][has], bounds[-1:]])) if len(has) else ())
                for r in range(j - i):
                    n.append(int(size[r]))
                    if size[r]:
                        cls.append(hashlib.blake2b(values[bounds[r] : bounds[r + 1]].tobytes(), digest_size=16).digest())
                        sig.append(next(mins).tobytes())
                    else:
                        cls.append(None)
                        sig.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "cls", "sig"])

    return run


def _pairs(batches):
    """cls, sig -> key, cls: a row for each coordinate-value pair."""
    salt = tk.mix(np.arange(1, K + 1, dtype="uint64") * np.uint64(0x8EBC6AF09C88C6E3))
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "uint32").reshape(-1, K)
            key = tk.mix(sig.astype("uint64") ^ salt)
            at = np.repeat(np.arange(b.num_rows), K)
            yield pa.RecordBatch.from_arrays([pa.array(key.view("int64").ravel()), b.column(0).take(pa.array(at))], names=["key", "cls"])


class _Union:
    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> list[int]:
        """Connects x with others; returns one other of each component that this adds."""
        added = []
        for y in others:
            if self.of[y] != self.of[x]:
                added.append(int(y))
                self.of[self.of == self.of[y]] = self.of[x]
        return added


def merge_list(sigs: np.ndarray, sets: list[np.ndarray], t: int, percent: int, stragglers: np.ndarray | None = None, of: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what a list's links connect. stragglers: only pairs with one of these rows; of: components so far."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    row = np.repeat(np.arange(n), size)[order]
    cut = np.concatenate([[True], values[order][1:] != values[order][:-1]])
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(values)))
    group = np.empty(len(values), "int64")
    group[order] = np.cumsum(cut) - 1
    first = np.concatenate([[0], np.cumsum(size)])
    union = _Union(n)
    if of is not None:
        union.of = np.unique(of, return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def meet(x: int) -> None:
        able = np.flatnonzero(((sigs == sigs[x]).sum(1) >= t) & (union.of != union.of[x]))
        if not len(able):
            return
        g = group[first[x] : first[x + 1]]
        many = length[g]
        at = np.repeat(start[g] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(row[at], minlength=n)[able]
        linked = able[100 * common >= percent * (size[x] + size[able] - common)]
        links.extend((x, y) for y in union.join(x, linked))

    if stragglers is None:
        meet(0)
        largest = np.bincount(union.of).argmax()
        stragglers = np.flatnonzero(union.of != largest)
    for x in stragglers:
        meet(int(x))
    return links


def _merge(t: int, percent: int, with_comps: bool = False):
    """Rows (key, cls, sig, set[, comp, straggler]) sorted by key -> links (a, b)."""

    def solve(rows: pa.Table):
        key = rows.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        cls, packed = rows.column(1).to_pylist(), rows.column(3).to_pylist()
        sigs = np.frombuffer(b"".join(rows.column(2).to_pylist()), "uint32").reshape(-1, K)
        a, b = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            more = {}
            if with_comps:
                more = {"of": np.array(rows.column(4).slice(lo, hi - lo).to_pylist(), object).astype(bytes), "stragglers": np.flatnonzero(rows.column(5).slice(lo, hi - lo).to_numpy())}
            for x, y in merge_list(sigs[lo:hi], [tk.unpack48(p) for p in packed[lo:hi]], t, percent, **more):
                a.append(cls[lo + x])
                b.append(cls[lo + y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last list may go on
            if held and held[-1].column(0)[0].as_py() != key[0]:
                yield solve(pa.Table.from_batches(held))
                held = []
            if last:
                yield solve(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _full_sets(words: int):
    """text, cls -> cls, packed set."""

    def run(batches):
        for b in batches:
            out = []
            for i, j, values, bounds in _sets(b.column(0), words):
                out += [tk.pack48(values[bounds[r] : bounds[r + 1]]) for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["cls", "set"])

    return run


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of df: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Words are runs of bytes other than white space, A-Z lower-cased; the set is
    of runs of `words` words, or of the whole sequence where there are fewer.
    Sets a and b are linked where 100 |a & b| >= percent |a | b|. A null or
    wordless text has no set, n_shingles 0 and is its own component. Rows of
    one id are one document as far as ids go: each keeps its own n_shingles,
    and their components meet only if their sets do. A row with a null id has
    the component of its set, and is kept where no row with an id is in it. An
    empty table gives no rows. Other columns take no part."""
    spark, tmp = df.sparkSession, Scratch(df.sparkSession, "minhash")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    t = least_matches(percent / 100)
    prefix = K - t + 1
    sketch = tmp.table(docs.mapInArrow(_sketch(words), "id long, n long, cls binary, sig binary"), "sketch")
    classes = tmp.table(sketch.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    pairs = classes.select("cls", "sig").mapInArrow(_pairs, "key long, cls binary")
    # How many classes have a pair, where more than one has; a class's other pairs are rarer than all of these and link nothing.
    often = pairs.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    shared = pairs.join(often, "key").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("ks"))
    posts = shared.select("cls", F.explode(F.slice("ks", 1, F.greatest(F.size("ks") - F.lit(K - prefix), F.lit(0)))).alias("k")).select("cls", "k.key")
    posts = tmp.table(posts, "posts")
    freed(spark)
    # A list of the same members as another adds nothing: one of each membership stays.
    members = posts.join(classes.select("cls", "n"), "cls").groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "cls")).alias("y"), F.min("cls").alias("low")).where("m > 1")
    lists = members.groupBy("m", "x", "y", "low").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("long")
    lists = tmp.table(posts.join(lists.select("key", blocks.alias("blocks")), "key"), "lists")
    tmp.drop("posts")
    # The full sets of what is in a list, from the document that names the class; the digest tells apart texts that share an id.
    owners = lists.select("cls").distinct().join(classes.select("cls", F.col("id").alias("rep")), "cls")
    texts = docs.join(owners, F.col("id").eqNullSafe(F.col("rep"))).select("text", "cls")
    sets = texts.mapInArrow(_own_set(words), "cls binary, set binary").groupBy("cls").agg(F.first("set").alias("set"))
    sets = tmp.table(sets.join(classes.select("cls", "sig"), "cls"), "sets", "none")
    freed(spark)
    place = F.pmod(F.xxhash64(F.lit(3), "cls"), F.col("blocks"))
    rows = lists.withColumn("block", place)
    long = tmp.table(lists.where("blocks > 1").select("key", "cls", "blocks"), "long")
    has_long = bool(long.limit(1).count())
    if has_long:
        heads = long.groupBy("key", "blocks").agg(F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64(F.lit(5), "cls"), F.greatest(F.lit(1), F.col("blocks") * 256)) == 0, F.col("cls")))), 1, LEADERS).alias("heads"))
        heads = heads.select("key", "blocks", F.explode("heads").alias("cls"))
        rows = rows.unionByName(heads.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))).dropDuplicates(["key", "cls", "block"])
    work = rows.withColumn("task", F.when(F.col("blocks") > 1, F.xxhash64("key", "block")).otherwise(F.col("key"))).select("task", "cls").join(sets, "cls").select("task", "cls", "sig", "set")
    found = work.repartition("task").sortWithinPartitions("task", "cls").mapInArrow(_merge(t, percent), "a binary, b binary")
    comps = tmp.table(connected_components(tmp.table(found.distinct(), "links"), tmp, "cc1"), "comps1")
    freed(spark)
    if has_long:
        # Long lists once more: whoever is outside a list's largest component meets every block of it.
        owned = long.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        top = owned.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("top"), F.count("*").alias("comps")).where("comps > 1").select("key", "top")
        owned = tmp.table(owned.join(top, "key").withColumns({"block": place, "out": F.col("comp") != F.col("top")}), "stragglers")
        deal = F.ceil(F.count("*") / BLOCK_CLASSES)
        teams = owned.where("out").groupBy("key").agg(deal.cast("long").alias("teams"))
        out = owned.where("out").join(teams, "key").withColumn("team", F.pmod(F.xxhash64(F.lit(9), "cls"), F.col("teams"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        block = owned.join(teams, "key").withColumn("team", F.explode(F.sequence(F.lit(0).cast("long"), F.col("teams") - 1)))
        cols = ["key", "block", "team", "cls", "comp"]
        both = out.select(*cols, F.lit(1).alias("s")).unionByName(block.select(*cols, F.lit(0).alias("s"))).groupBy(*cols).agg(F.max("s").alias("s"))
        work = both.select(F.xxhash64("key", "block", "team").alias("task"), "cls", "comp", (F.col("s") == 1).alias("straggler")).join(sets, "cls").select("task", "cls", "sig", "set", "comp", "straggler")
        more = work.repartition("task").sortWithinPartitions("task", "cls").mapInArrow(_merge(t, percent, True), "a binary, b binary").distinct()
        every = comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more)
        comps = tmp.table(connected_components(tmp.table(every, "links2"), tmp, "cc2"), "comps2")
    named = classes.select("cls", "id").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = named.groupBy("comp").agg(F.min("id").alias("low"))
    label = tmp.table(named.join(lowest, "comp").select("cls", "low"), "labels")
    out = sketch.select("id", "n", "cls").join(label, "cls", "left")
    comp = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept"))


def _own_set(words: int):
    """text, cls -> cls, packed set, of rows whose text is what cls names."""

    def run(batches):
        for b in _full_sets(words)(batches):
            cls, sets = b.column(0).to_pylist(), b.column(1).to_pylist()
            same = [hashlib.blake2b(tk.unpack48(s).tobytes(), digest_size=16).digest() == c for c, s in zip(cls, sets)]
            yield b.filter(pa.array(same, pa.bool_()))

    return run


def one_of_each(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each near-duplicate group, the one of the smallest id; repeated rows of it are kept once."""
    marks = near_duplicates(df, words, percent, id_col, text_col)
    gone = marks.where(~F.col("kept")).select(F.col(id_col).cast("long").alias("__gone")).distinct()
    rest = df.join(gone, df[id_col].cast("long") == F.col("__gone"), "left_anti")
    return rest.dropDuplicates([id_col, text_col])
