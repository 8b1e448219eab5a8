"""Substring removal by suffix arrays: every byte covered by a long string that an earlier document has too.

No task sees the corpus. A window of `length` bytes picks the smallest hash
among its grams, so two equal windows pick the same gram at the same place:

1. Each document posts, for each gram that it picks, the segment of windows
   that pick it (under 2 * length bytes): gram hash, segment hash, place.
2. Grams of one document only are dropped. Where a later document has the same
   segment as an earlier one, all its windows go. What remains to compare are
   the first copies of different segments under one gram; a gram's only segment
   has nothing to compare with.
3. Those segments, hash-partitioned by gram and in order of their bytes, are
   read as a stream: equal ones are settled at once, so that an array holds
   each only once, however many documents have it. The different ones are
   concatenated in runs of whole grams and their suffixes sorted in two stages: only suffixes smaller than
   their successors are sorted directly, the others are induced from them by
   scanning the buckets of first bytes in order. Neighbours with a common
   prefix of `length` are equal windows; all but those of the first document go.
4. Each document takes the union of its windows out of its bytes.

A gram that a large part of all postings have (of a passage that a third of the
corpus quotes, or of one word over and over) is dealt by segment, after each task has settled its own copies, and
its first copies by window: equal segments and equal windows still meet. Which
grams those are a sample of documents tells; it decides how rows are dealt,
not what is removed.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Scratch, freed, small_batches

GRAM = 16
#: Bytes of segments at which a suffix array is built of the whole grams so far.
RUN_BYTES = 2 << 20
#: Rows that a task hands on at once.
ROWS = 10_000
#: Segments of one gram beyond which its windows are dealt singly.
MANY = 20_000
#: One document in SAMPLE is asked for grams that take one in COMMON of all postings, which are COMMON grams at most.
SAMPLE, COMMON = 64, 2000
#: Postings of a gram in the sample below which it isn't common.
LEAST = 50
#: Marks of a posting: of a common gram; settled, as an earlier document of its task has the same segment.
HOT, SETTLED = 1 << 61, 1 << 62
_U = np.uint64


# ---------------------------------------------------------------- suffix array


def _keys8(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number that orders like them, as a view; t ends in 8 bytes of padding or more."""
    return np.ndarray(len(t) - 7, ">u8", np.ascontiguousarray(t), strides=(1,))


def rises(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last is not."""
    change = np.flatnonzero(t[1:] != t[:-1])
    up = np.append(t[change] < t[change + 1], False)
    return np.repeat(up, np.diff(np.concatenate([[-1], change, [len(t) - 1]])))


def two_stage(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes (a mask) of t in order of their first `depth` bytes at least.

    t must end in at least depth + 16 bytes of which a rise is one. Sorts
    directly the rising suffixes that are wanted or that a wanted one needs,
    and induces the falling ones."""
    up = rises(t)
    if not wanted.any():
        return np.zeros(0, "int32")
    # A falling suffix is induced from its successor, so the chain up to the next rising one is needed.
    at = np.arange(len(t), dtype="int32")
    rose = np.maximum.accumulate(np.where(up, at, np.int32(-1)))
    need = np.maximum.accumulate(np.where(wanted, at, np.int32(-1)))
    need[1:] = need[1:] > rose[:-1]
    need[0] = wanted[0]
    need = need.astype(bool)
    del at, rose
    key = _keys8(t)
    b = np.flatnonzero(need & up).astype("int32")
    k = key[b].astype(_U)
    order = np.argsort(k, kind="stable")
    b, k = b[order], k[order]
    group = np.zeros(len(b), "int32")
    group[1:] = np.cumsum(k[1:] != k[:-1], dtype="int32")
    at = 8
    while at < depth:
        same = np.zeros(len(b), bool)
        eq = group[1:] == group[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        rows = np.flatnonzero(same)
        if not len(rows):
            break
        g, k = group[rows], key[b[rows] + at].astype(_U)
        order = np.lexsort((k, g))
        b[rows] = b[rows[order]]
        k = k[order]
        new = np.ones(len(b), bool)
        new[1:] = group[1:] != group[:-1]
        new[rows[1:]] |= (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        group = np.cumsum(new, dtype="int32")
        at += 8
    # Buckets by first byte: falling suffixes come before rising ones, and are appended in the order in which their successors are met.
    falling: list[list[np.ndarray]] = [[] for _ in range(256)]
    first = np.searchsorted(t[b], np.arange(257)) if len(b) else np.zeros(257, int)
    out = []

    def induce(s: np.ndarray) -> None:
        p = s - 1
        p = p[(p >= 0) & need[p] & ~up[p]]
        if not len(p):
            return
        c = t[p]
        o = np.argsort(c, kind="stable")
        p, c = p[o], c[o]
        cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        for lo, hi in zip(cuts, [*cuts[1:], len(c)]):
            falling[c[lo]].append(p[lo:hi])

    for c in range(256):
        done = 0
        while done < len(falling[c]):
            wave = np.concatenate(falling[c][done:]) if len(falling[c]) - done > 1 else falling[c][done]
            done = len(falling[c])
            out.append(wave)
            induce(wave)
        own = b[first[c] : first[c + 1]]
        if len(own):
            out.append(own)
            induce(own)
    sa = np.concatenate(out)
    return sa[wanted[sa]]


def common_prefix_reaches(t: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of sa but the first, whether it shares `length` bytes with the one before."""
    key = _keys8(t).view("<u8")
    eq = np.ones(max(len(sa) - 1, 0), bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        eq &= key[sa[1:] + at] == key[sa[:-1] + at]
    return eq


def earliest(segments: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment, the smallest owner of a segment that holds it; the first window of each segment and one more."""
    if not segments:
        return np.zeros(0, "int64"), np.zeros(1, "int64")
    # 0xFF is no byte of UTF-8, so no window of two segments' bytes equals one of a segment.
    t = np.frombuffer(b"\xff".join(segments) + b"\xff\x00\x01" + b"\x00" * (length + 32), "uint8")
    size = np.array([len(s) for s in segments])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    windows = size - length + 1
    base = np.concatenate([[0], np.cumsum(windows)])
    place = np.arange(base[-1], dtype="int32") + np.repeat((start - base[:-1]).astype("int32"), windows)
    wanted = np.zeros(len(t), bool)
    wanted[place] = True
    sa = two_stage(t, wanted, length)
    ids, rank = np.unique(owners, return_inverse=True)
    owner_at = np.zeros(len(t), "int32")
    owner_at[place] = np.repeat(rank.astype("int32"), windows)
    heads = np.flatnonzero(np.concatenate([[True], ~common_prefix_reaches(t, sa, length)]))
    low = np.minimum.reduceat(owner_at[sa], heads)
    owner_at[sa] = np.repeat(low, np.diff(np.append(heads, len(sa))))
    return ids[owner_at[place]], base


# ---------------------------------------------------------------- postings


def pick(data: np.ndarray, off: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, row, first window in bytes from the row's start, windows, segment hash) of each gram picked."""
    n, w = len(data), length - gram + 1
    many = np.maximum(np.diff(off) - length + 1, 0)
    if not many.any():
        z = np.zeros(0, "int64")
        return z.astype(_U), z, z, z, z.astype(_U)
    up, down = tk.powers(n)
    run = np.zeros(n + 1, _U)
    np.cumsum(tk.BYTE[data] * up[:n], out=run[1:])
    g = (run[gram:] - run[:-gram]) * down[: n - gram + 1]
    g = (g ^ (g >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    low, at, span = g, np.arange(len(g), dtype="int32"), 1

    def wider(low, at, by):
        right = low[by:] < low[:-by]  # the leftmost of equal grams wins
        return np.where(right, low[by:], low[:-by]), np.where(right, at[by:], at[:-by])

    while span * 2 <= w:
        low, at = wider(low, at, span)
        span *= 2
    if w > span:
        low, at = wider(low, at, w - span)
    first = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(many)), many)
    window = np.arange(first[-1]) + (off[:-1] - first[:-1])[row]
    a = at[window]
    cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
    s, r = window[cut], row[cut]
    count = np.diff(np.append(cut, len(window)))
    segment = tk.mix((run[s + count + length - 1] - run[s]) * down[s] + count.astype(_U))
    return tk.mix(g[a[cut]]), r, s - off[r], count, segment


def _mark(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """24 bits that tell apart different texts under one id."""
    return np.array([zlib.crc32(data[lo:hi]) & 0xFFFFFF for lo, hi in zip(off[:-1], off[1:])], "int64")


def _pack(start, count, mark):
    return (start << 30) | (count << 24) | mark


def _unpack(p: np.ndarray):
    return p >> 30, (p >> 24) & 63, p & 0xFFFFFF


def _common(docs: DataFrame, length: int) -> np.ndarray:
    """Hashes of grams that a large part of all postings have, by a sample of documents."""

    def run(batches):
        for b in batches:
            for _, _, data, off in tk.pieces(b.column(1)):
                h, n = np.unique(pick(data, off, length)[0].view("int64"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype("int64"))], names=["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long, n long")
    counts = sample.groupBy("h").agg(F.sum("n").alias("n"))
    every = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(LEAST, every // COMMON)).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], "int64").view(_U))


def _post(length: int, hot: np.ndarray):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in tk.pieces(b.column(1)):
                h, r, s, c, seg = pick(data, off, length)
                doc, place = ids[i:j][r].astype("int64"), _pack(s, c, _mark(data, off)[r])
                if len(hot):
                    at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h)
                    key = tk.mix(h[at] ^ (seg[at] * _U(0x9E3779B97F4A7C15)))
                    order = np.lexsort((doc[at], seg[at], key))
                    at, key = at[order], key[order]
                    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (seg[at][1:] != seg[at][:-1])])) if len(at) else at
                    settled = doc[at] > np.repeat(doc[at][head], np.diff(np.append(head, len(at))))
                    place[at] |= np.where(settled, HOT | SETTLED, HOT)
                    h[at] = np.where(settled, tk.mix(doc[at].astype(_U) ^ (place[at].astype(_U) << _U(7))), key)
                yield pa.RecordBatch.from_arrays([pa.array(h.view("int64")), pa.array(seg.view("int64")), pa.array(doc), pa.array(place)], names=["h", "seg", "doc", "place"])

    return run


NAMES = ["h", "doc", "place", "later", "hot"]


def _shared():
    """Rows sorted by (h, seg, doc) -> (h, doc, place, later, hot) of grams that two documents have; later: an earlier document has the same segment.

    What isn't later is asked for; the first copy of a gram's only segment is left out.

    Rows of a gram wait only while they are of one document. Those of common grams, marked in place, are known to be shared."""

    def run(batches):
        held = None  # rows of the last gram, so far of one document
        last = (None, None, None)  # gram known to be shared; its last segment and the first document of that
        for b in batches:
            if not b.num_rows:
                continue
            h, seg, doc, place = (c.to_numpy() for c in b.columns)
            if held is not None:
                h, seg, doc, place = (np.concatenate([x, y]) for x, y in zip(held, (h, seg, doc, place)))
                held = None
            settled = (place & SETTLED) != 0
            if settled.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[settled]), pa.array(doc[settled]), pa.array(place[settled] & ~(HOT | SETTLED)), pa.array(np.ones(settled.sum(), bool)), pa.array(np.ones(settled.sum(), bool))], names=NAMES)
                h, seg, doc, place = (x[~settled] for x in (h, seg, doc, place))
                if not len(h):
                    continue
            new = np.concatenate([[True], h[1:] != h[:-1]])
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(h)))
            lo, hi = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
            both = (lo != hi) | np.logical_or.reduceat((place & HOT) != 0, head)
            if last[0] is not None and h[0] == last[0]:
                both[0] = True
            if not both[-1]:
                at = head[-1]
                held = (h[at:], seg[at:], doc[at:], place[at:])
            keep = np.repeat(both, size)
            # A gram that begins and ends in these rows and has one segment only asks for no text.
            only = (seg[head] == seg[head + size - 1]) & ~np.logical_or.reduceat((place & HOT) != 0, head)
            only[-1] = False
            if last[0] is not None and h[0] == last[0]:
                only[0] = False
            sub = np.concatenate([[True], (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])])
            starts = np.flatnonzero(sub)
            rep = doc[starts].copy()
            if last[0] is not None and h[0] == last[0] and seg[0] == last[1]:
                rep[0] = last[2]
            rep_row = np.repeat(rep, np.diff(np.append(starts, len(h))))
            last = (h[-1], seg[-1], rep[-1]) if both[-1] else (None, None, None)
            later = doc > rep_row
            keep &= later | ~np.repeat(only, size)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(doc[keep]), pa.array(place[keep] & ~HOT), pa.array(later[keep]), pa.array((place[keep] & HOT) != 0)], names=NAMES)

    return run


def _rows(b: pa.RecordBatch):
    """(bytes of the text, numbers of each field of the list) of each row of (id, text, list of structs or numbers)."""
    text = b.column(1).cast(pa.large_string()).cast(pa.large_binary())
    size = b.column(2).value_lengths().fill_null(0).to_numpy()
    flat = b.column(2).flatten()
    fields = [c.to_numpy(zero_copy_only=False) for c in (flat.flatten() if pa.types.is_struct(flat.type) else [flat])]
    end = np.cumsum(size)
    for i, (lo, hi) in enumerate(zip((end - size).tolist(), end.tolist())):
        yield text[i].as_py() or b"", [c[lo:hi] for c in fields]


def _segments(length: int):
    """id, text, asks (h, place, hot) -> key, doc, place, bytes"""

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["key", "doc", "place", "piece"])

    def run(batches):
        out = ([], [], [], [])
        for b in batches:
            for doc, (raw, (gram, place, hot)) in zip(b.column(0).to_pylist(), _rows(b)):
                mark = zlib.crc32(raw) & 0xFFFFFF
                start, count, of = _unpack(place)
                for h, p, s, c, dealt in zip(*(x[of == mark].tolist() for x in (gram, place, start, count, hot))):
                    parts = [(h, p, raw[s : s + c + length - 1])]
                    if dealt:
                        parts = [(int.from_bytes(hashlib.blake2b(raw[s + k : s + k + length], digest_size=8).digest(), "little", signed=True), _pack(s + k, 1, mark), raw[s + k : s + k + length]) for k in range(c)]
                    for key, at, piece in parts:
                        for column, v in zip(out, (key, doc, at, piece)):
                            column.append(v)
                    if len(out[0]) >= ROWS:
                        yield batch(out)
                        out = ([], [], [], [])
        yield batch(out)

    return run


def _compare(length: int):
    """Rows (key, doc, place, piece) sorted by (key, piece, doc) -> (doc, place) of runs of windows that an earlier document has.

    Of equal pieces under a key, those of later documents go whole and at once. The first document's are compared
    with the key's other pieces, as one piece. A key of one piece has nothing more to compare."""

    def batch(doc, place):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place)], names=["doc", "place"])

    def solve(held):
        key, doc, place, fresh = (np.concatenate([h[k] for h in held]) for k in range(4))
        gram = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        use = np.bincount(gram, fresh)[gram] > 1
        pieces = pa.chunked_array([h[4] for h in held]).filter(pa.array(use[fresh])).to_pylist()
        doc, place, fresh = doc[use], place[use], fresh[use]
        low, base = earliest(pieces, doc[fresh], length)
        row = np.repeat(np.arange(len(pieces), dtype="int32"), np.diff(base))
        gone = low < doc[fresh][row]
        if not gone.any():
            return
        other = row[1:] != row[:-1]
        edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | other]))
        stop = np.flatnonzero(gone & np.concatenate([~gone[1:] | other, [True]]))
        # Every row of a piece has the piece's runs.
        of = np.cumsum(fresh) - 1
        runs = np.bincount(row[edge], minlength=len(pieces))
        n = runs[of]
        r = np.repeat(np.arange(len(of)), n)
        k = np.arange(len(r)) + np.repeat((np.cumsum(runs) - runs)[of] - (np.cumsum(n) - n), n)
        s, _, m = _unpack(place[r])
        yield batch(doc[r], _pack(s + edge[k] - base[row[edge[k]]], stop[k] - edge[k] + 1, m))

    def run(batches):
        held, size, last = [], 0, None  # rows that wait; bytes of their pieces; the last row's key, piece and the first document that has it
        for b in batches:
            if not b.num_rows:
                continue
            key, doc, place = (b.column(k).to_numpy() for k in range(3))
            piece = b.column(3)
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | ~pc.equal(piece[1:], piece[:-1]).to_numpy(zero_copy_only=False)
            fresh = head.copy()
            first = doc[head]
            if last is not None and last[0] == key[0] and last[1] == piece[0].as_py():
                fresh[0], first[0] = False, last[2]
            rep = np.repeat(first, np.diff(np.append(np.flatnonzero(head), len(key))))
            last = (key[-1], piece[-1].as_py(), rep[-1])
            gone = doc > rep
            if gone.any():
                yield batch(doc[gone], place[gone])
            stays = ~gone
            if not stays.any():
                continue
            held.append((key[stays], doc[stays], place[stays], fresh[stays], piece.filter(pa.array(fresh))))
            size += held[-1][4].nbytes
            if size < RUN_BYTES:
                continue
            # Enough for one array: of all grams but the last, which may go on.
            k, d, p, f, x = held.pop()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                n = int(f[:cut].sum())
                held.append((k[:cut], d[:cut], p[:cut], f[:cut], x[:n]))
                yield from solve(held)
                held = []
                k, d, p, f, x = k[cut:], d[cut:], p[cut:], f[cut:], x[n:]
            held.append((k, d, p, f, x))
            size = sum(h[4].nbytes for h in held)
        if held:
            yield from solve(held)

    return run


def _cut(length: int):
    """id, text, places -> id, bytes, bytes removed, runs removed, digest of the rest"""

    def run(batches):
        for b in batches:
            out = ([], [], [], [])
            for raw, (places,) in _rows(b):
                spans = removed_spans(raw, places, length)
                rest, at = hashlib.sha256(), 0
                for lo, hi in spans:
                    rest.update(raw[at:lo])
                    at = hi
                rest.update(raw[at:])
                for column, v in zip(out, (len(raw), sum(hi - lo for lo, hi in spans), len(spans), rest.hexdigest())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def removed_spans(raw: bytes, places, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the windows of these places that belong to this text."""
    if not len(places):
        return []
    mark = zlib.crc32(raw) & 0xFFFFFF
    s, c, m = _unpack(np.asarray(places, "int64"))
    s, e = s[m == mark], (s + c + length - 1)[m == mark]
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    if not len(s):
        return []
    head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[head].tolist(), e[np.append(head[1:] - 1, len(e) - 1)].tolist()))


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with_spans: (id, text, places), from which removed_spans gives the spans.

    Strings are judged on the input, in UTF-8 bytes, and never cross
    documents. Only a smaller id is earlier: rows of one id never take from
    each other, a null id takes no part in either way, and a null text is
    empty. Repeated rows are treated alike. An empty table gives no rows.
    length is 24 to 78 (a segment's windows are counted in 6 bits)."""
    if not GRAM + 8 <= length <= 78:
        raise ValueError("length must be 24 to 78")
    spark, tmp = df.sparkSession, Scratch(df.sparkSession, "suffix")

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = docs.where("id IS NOT NULL AND text IS NOT NULL")
    with small_batches(spark):
        hot = _common(known, length)
    posts = known.mapInArrow(_post(length, hot), "h long, seg long, doc long, place long")
    shared = posts.repartition("h").sortWithinPartitions("h", "seg", "doc").mapInArrow(_shared(), "h long, doc long, place long, later boolean, hot boolean")
    with small_batches(spark):
        shared = tmp.table(shared, "shared")
    freed(spark)
    asked = shared.where("NOT later")
    # Common grams that the sample didn't show: many first copies of different segments.
    many = tmp.table(asked.where("NOT hot").groupBy("h").count().where(F.col("count") > MANY).select("h", F.lit(True).alias("many")), "many")
    if many.limit(1).count():
        asked = asked.join(many, "h", "left").withColumn("hot", F.col("hot") | F.coalesce("many", F.lit(False)))
    asks = asked.groupBy("doc").agg(F.collect_list(F.struct("h", "place", "hot")).alias("asks"))
    pieces = known.join(asks, known["id"] == asks["doc"]).select("doc", "text", "asks").mapInArrow(_segments(length), "key long, doc long, place long, piece binary")
    with small_batches(spark):
        found = tmp.table(pieces.repartition("key").sortWithinPartitions("key", "piece", "doc").mapInArrow(_compare(length), "doc long, place long"), "found")
    freed(spark)
    places = shared.where("later").select("doc", "place").unionByName(found).groupBy("doc").agg(F.collect_list("place").alias("places"))
    joined = docs.join(places, docs["id"] == places["doc"], "left").select("id", "text", "places")
    if with_spans:
        return joined.withColumnRenamed("id", id_col)
    return joined.mapInArrow(_cut(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
