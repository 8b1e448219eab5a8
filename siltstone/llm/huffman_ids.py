"""Token ids in binary files: canonical, length-limited Huffman codes from global counts.

Texts become ids once and are counted; the counts of all files give one code
table with codes of at most MAX_BITS bits. A segment holds the ids of a run of
documents as one bit string, cut into blocks of BLOCK ids with the bit offset
of each block as a checkpoint, so blocks decode independently: the decoder
looks up MAX_BITS bits at a time in one table, for all blocks of a segment at
once.

Segments are rows of a Parquet table (any file system that Spark writes to,
task commit included), and the code lengths are a table beside them, so files
decode by themselves. A segment also says which run of the id order it is of
and how many ids of that run come before it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Scratch

#: Bits of a code at most; more only where there are more symbols than codes of so many bits.
MAX_BITS = 16
BLOCK = 128
#: Ids in a segment, unless one document has more.
SEGMENT_IDS = 1 << 19


# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `most` bits (package-merge), or of as many as its symbols need; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), "uint8")
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    most = max(most, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype("int64")
    n = len(order)
    # Each level merges the leaves with the pairs of the level before; which of its first 2n-2 items are leaves is all that lengths need.
    levels, packages = [], np.zeros(0, "int64")
    for _ in range(most):
        merged = np.concatenate([weight, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        items = merged[rank]
        items = items[: len(items) & ~1]
        packages = items[0::2] + items[1::2]
    length = np.zeros(n, "int64")
    take = 2 * n - 2
    for leaf in reversed(levels):
        leaf = leaf[:take]
        leaves = int(leaf.sum())
        length[:leaves] += 1
        take = 2 * (len(leaf) - leaves)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes (uint32) by length, then id."""
    codes = np.zeros(len(lengths), "uint32")
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    long = lengths[order].astype("int64")
    for bits in range(1, int(long[-1]) + 1 if len(long) else 0):
        own = order[long == bits]
        code <<= bits - last
        last = bits
        codes[own] = code + np.arange(len(own))
        code += len(own)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) by the next bits, as many as the longest code has and MAX_BITS at least."""
    most = max(MAX_BITS, int(lengths.max(initial=0)))
    codes = canonical(lengths).astype("int64")
    used = np.flatnonzero(lengths)
    ids, bits = np.zeros(1 << most, "uint32"), np.ones(1 << most, "uint8")
    lo = codes[used] << (most - lengths[used].astype("int64"))
    span = np.int64(1) << (most - lengths[used].astype("int64"))
    order = np.argsort(lo)
    at = np.repeat(used[order], span[order])
    ids[: len(at)], bits[: len(at)] = at, lengths[at]
    return ids, bits


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of each block of ids)."""
    if not len(ids):
        return b"", np.zeros(0, "int64")
    size = lengths[ids].astype("int64")
    if not size.all():
        raise ValueError("an id without a code")
    at = np.zeros(len(ids) + 1, "int64")
    np.cumsum(size, out=at[1:])
    # Codes lie in words of 32 bits; one of up to 32 bits touches two at most.
    word, shift = at[:-1] >> 5, 64 - (at[:-1] & 31) - size
    wide = codes[ids].astype("uint64") << shift.astype("uint64")
    out = np.zeros(int(at[-1] >> 5) + 2, "uint64")
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: int(at[-1] + 7) // 8], at[:-1:block].copy()


def decode_ids(data: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], block: int = BLOCK) -> np.ndarray:
    """The n ids; every block is read from its checkpoint, all blocks in step. Codes have 24 bits at most."""
    ids, bits = table
    most = len(ids).bit_length() - 1
    raw = np.frombuffer(data + b"\0" * 8, "uint8").astype("uint32")
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
    out = np.zeros((block, len(offsets)), "uint32")
    at = offsets.astype("int64").copy()
    left = n - block * (len(offsets) - 1) if len(offsets) else 0
    for i in range(block if len(offsets) > 1 else left):
        if i == left:
            at = at[:-1]
        key = (window[at >> 3] >> (32 - most - (at & 7)).astype("uint32")) & np.uint32((1 << most) - 1)
        out[i, : len(at)] = ids[key]
        at += bits[key]
    return out.T.ravel()[:n]


# ---------------------------------------------------------------- tokens


#: Units of text that a worker remembers (about 50 bytes each).
REMEMBERED = 2_000_000
#: 0: white space, 1: letters (ASCII, and the bytes of U+00C0 to U+00FF), 2: ASCII marks, 3: anything else.
UNIT_KIND = np.full(256, 3, "int8")
UNIT_KIND[[32, *range(9, 14)]] = 0
UNIT_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
UNIT_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and x != 39]] = 2
#: Bytes of text that are encoded together.
TOGETHER = 8 << 20


def _needs_whole(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with white space that tokenizers and byte classes may see differently, or with what may begin a special token."""
    a, b, c = data[:-2], data[1:-1], data[2:]
    odd = ((data >= 0x1C) & (data <= 0x1F))
    two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)) | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    lead = np.flatnonzero((a >= 0xE1) & (a <= 0xE3))
    x, y, z = a[lead], b[lead], c[lead]
    three = (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    at = np.concatenate([np.flatnonzero(odd), np.flatnonzero(two), lead[three]])
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, at, "right") - 1] = True
    return out


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, each distinct word once.

    For tokenizers whose pre-tokenizer drops white space no token spans two
    words, so a text's ids are its words' ids in a row. How a word of plain
    Latin letters splits is found by the tokenizer's own pattern and its model;
    any other word goes through the whole tokenizer, and so does any text with
    unusual white space. Words are found by a 64-bit hash and told apart by
    their bytes (over 16 of them: by a 128-bit digest); a text with a word whose hash
    another word has already goes through the whole tokenizer too."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        pre = spec.get("pre_tokenizer") or {}
        split = pre["pretokenizers"][0] if pre.get("type") == "Sequence" else {}
        self.by_word = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and "\\s" in split["pattern"].get("Regex", "") and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
        self.pattern = regex.compile(split["pattern"]["Regex"]) if self.by_word else None
        self.model = self.whole.model
        self.plain = regex.compile("[!-~À-ÖØ-öø-ÿ]*")
        self.folds = "Lowercase" in json.dumps(spec.get("normalizer") or {})
        width = max(self.whole.get_vocab().values()) if self.whole.get_vocab_size() else 0
        self.dtype = np.dtype("<u2" if width < 1 << 16 else "<u4")
        self._forget()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}

    @staticmethod
    def hash(key: np.ndarray) -> np.ndarray:
        return tk.key_hashes(key[:, 0], key[:, 1], key[:, 2])

    def library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        if not word.isascii() and not self.plain.fullmatch(word):
            return self.library(word)
        out: list[int] = []
        for piece in self.pattern.findall(word.lower() if self.folds else word):
            mapped = piece if piece.isascii() and piece.isprintable() else "".join(self.letters[b] for b in piece.encode())
            out += [t.id for t in self.model.tokenize(mapped)]
        return out

    def _forget(self) -> None:
        """What is known: hashes in order, the keys and length of each one's word, and where its ids begin in `flat`."""
        self.hashes, self.begins, self.sizes = np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "int64")
        self.keys = np.zeros((0, 3), "uint64")
        self.flat = np.zeros(0, self.dtype)

    def _learn(self, hashes: np.ndarray, keys: np.ndarray, lists: list[list[int]]) -> None:
        size = np.fromiter(map(len, lists), "int64", len(lists))
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter((x for k in lists for x in k), self.dtype, int(size.sum()))])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.begins, self.sizes = every[order], np.concatenate([self.begins, begin])[order], np.concatenate([self.sizes, size])[order]
        self.keys = np.concatenate([self.keys, keys])[order]

    def _units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans that encode on their own: runs of letters and runs of marks, or a whole word that has anything else in it."""
        kind = UNIT_KIND[data]
        # The two signs among the Latin letters of the second block are no letters.
        sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        kind[sign] = 3
        starts, ends, first = tk.words(data, off)
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(kind == 3), "right") - 1)
        mark = np.zeros(len(data) + 1, "int8")
        mark[starts[odd]] += 1
        mark[ends[odd]] -= 1
        kind[np.cumsum(mark[:-1]) > 0] = 3
        turn = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        turn = turn[~np.isin(turn, off, assume_unique=False)] if len(off) > 2 else turn
        starts, ends = np.sort(np.concatenate([starts, turn])), np.sort(np.concatenate([ends, turn]))
        return starts, ends, np.searchsorted(starts, off)

    def encode_column(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids of each row, ids) with end_id after each row."""
        for i, j, data, off in tk.pieces(column, TOGETHER):
            rows = j - i
            whole = _needs_whole(data, off) if self.by_word else np.ones(rows, bool)
            if whole.all():
                lists = [self.library(data[a:b].tobytes().decode()) for a, b in zip(off[:-1], off[1:])]
                counts = np.array([len(x) + 1 for x in lists], "int64")
                yield i, j, counts, np.concatenate([np.array([*x, end_id], self.dtype) for x in lists]) if rows else np.zeros(0, self.dtype)
                continue
            starts, ends, first = self._units(data, off)
            key = tk.span_keys(tk.FOLD[data] if self.folds else data, starts, ends)
            key = np.stack([*key, (ends - starts).astype("uint64")], axis=1)
            distinct, at, where = np.unique(self.hash(key), return_index=True, return_inverse=True)
            if len(self.hashes) > REMEMBERED:
                self._forget()
            place = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
            new = np.flatnonzero(self.hashes[place] != distinct) if len(self.hashes) else np.arange(len(distinct))
            raw = data.tobytes()
            if len(new):
                self._learn(distinct[new], key[at[new]], [self.word(raw[starts[k] : ends[k]].decode()) for k in at[new].tolist()])
                place = np.searchsorted(self.hashes, distinct)
            other = np.flatnonzero((key != self.keys[place][where]).any(1))
            whole[np.searchsorted(first, other, "right") - 1] = True
            size, begin = self.sizes[place], self.begins[place]
            flat = self.flat
            many = size[where]
            upto = np.cumsum(many)
            ids = flat[np.repeat(begin[where] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
            edge = np.concatenate([[0], upto])[first]
            counts = np.diff(edge) + 1
            out = np.full(len(ids) + rows, end_id, self.dtype)
            out[np.arange(len(ids)) + np.repeat(np.arange(rows), counts - 1)] = ids
            if whole.any():
                parts = np.split(out, np.cumsum(counts)[:-1])
                for r in np.flatnonzero(whole):
                    parts[r] = np.array([*self.library(raw[off[r] : off[r + 1]].decode()), end_id], self.dtype)
                counts, out = np.array([len(x) for x in parts], "int64"), np.concatenate(parts)
            yield i, j, counts, out

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for _, _, _, ids in self.encode_column(pa.array([text]), 0) for x in ids[:-1]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a worker process; its memory of words lives across tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- tables


def tokenize(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, crc, ids): ids as packed little-endian integers with end_id after each document, and their crc32."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for i, j, counts, ids in enc.encode_column(b.column(1), end_id):
                raw, edge = ids.tobytes(), np.concatenate([[0], np.cumsum(counts)]) * enc.dtype.itemsize
                parts = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(edge.astype("int64").tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
                crc = [zlib.crc32(raw[lo:hi]) for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counts), pa.array(crc, pa.int64()), parts], names=["id", "n", "crc", "ids"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, n long, crc long, ids binary")


def global_counts(tokens: DataFrame, width: int) -> np.ndarray:
    """Count of every id over all documents: each task adds up its own, tasks' tables are added by id."""
    dtype = f"<u{width}"

    def run(batches):
        total = np.zeros(0, "int64")
        for b in batches:
            found = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype))
            if len(found) > len(total):
                found[: len(total)] += total
                total = found
            else:
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "c"])

    rows = tokens.select("ids").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, "int64")
    counts[rows["id"].to_numpy("int64")] = rows["c"].to_numpy("int64")
    return counts


def write_segments(tokens: DataFrame, path: str, width: int = 2) -> None:
    """Writes (id, n, crc, ids) as segments in ascending id, and beside them a row with the code lengths. The vocabulary bounds what reaches the driver.

    Each task writes a run of the order by (id, crc), so rows of one id, or without one, don't meet in one task."""
    lengths = code_lengths(global_counts(tokens, width))
    codes = canonical(lengths)
    dtype = f"<u{width}"

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0

        def segment(docs, crcs, counts, parts):
            ids = np.frombuffer(b"".join(parts), dtype)
            data, offsets = encode_ids(ids, codes, lengths)
            gaps = np.diff(offsets, prepend=0).astype("<u2")  # a block has at most 128 codes of 24 bits
            row = [part, before, len(ids), docs, crcs[0], counts, gaps.tobytes(), data]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()))], names=["run", "before", "n", "docs", "crc", "counts", "gaps", "data"])

        rows, have = ([], [], [], []), 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                for column, v in zip(rows, row):
                    column.append(v)
                have += row[2]
                if have >= SEGMENT_IDS:
                    yield segment(*rows)
                    before, rows, have = before + have, ([], [], [], []), 0
        if rows[0]:
            yield segment(*rows)

    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("id").asc_nulls_first(), "crc")
    ordered = tokens.select("id", "crc", "n", "ids").repartitionByRange(n, *order).sortWithinPartitions(*order, "ids")
    ordered.mapInArrow(run, "run long, before long, n long, docs array<long>, crc long, counts array<long>, gaps binary, data binary").write.option("compression", "none").parquet(f"{path}/segments")
    row = [(bytearray(zlib.compress(lengths.astype("uint8").tobytes())),)]
    tokens.sparkSession.createDataFrame(row, "lengths binary").coalesce(1).write.parquet(f"{path}/codes")


def read_segments(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids): every document decoded from the files alone; start counts all ids before it,
    ids are little-endian unsigned 32-bit integers.

    The driver gets one row for each run of the order (a task of the writer)."""
    lengths = np.frombuffer(zlib.decompress(bytes(spark.read.parquet(f"{path}/codes").first()["lengths"])), "uint8")
    table = spark.read.parquet(f"{path}/segments")
    runs = table.groupBy("run").agg(F.min(F.struct(F.coalesce(F.element_at("docs", 1), F.lit(-(1 << 63))).alias("id"), F.element_at("docs", 1).isNotNull(), "crc")).alias("first"), F.sum("n").alias("n")).orderBy("first").collect()
    base, at = {}, 0
    for r in runs:
        base[r["run"]] = at
        at += r["n"]

    def run(batches):
        codes = decode_table(lengths)
        for b in batches:
            for which, before, docs, counts, gaps, data in zip(*(c.to_pylist() for c in b.columns)):
                counts = np.array(counts, "int64")
                ids = decode_ids(data, np.cumsum(np.frombuffer(gaps, "<u2"), dtype="int64"), int(counts.sum()), codes)
                ends = np.cumsum(counts)
                start = base[which] + before + ends - counts
                raw = [ids[e - c : e].astype("<u4").tobytes() for e, c in zip(ends, counts)]
                for i in range(0, len(raw), 512):
                    part = raw[i : i + 512]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 512], pa.int64()), pa.array(start[i : i + 512]), pa.array(counts[i : i + 512]), pa.array([zlib.crc32(x) for x in part], pa.int64()), pa.array(part, pa.binary())], names=["id", "start", "n_tokens", "ids_crc32", "ids"])

    return table.select("run", "before", "docs", "counts", "gaps", "data").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long, ids binary")


def encode(df: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Tokenizes df, writes its token files (at path, by default in the shared folder), reads them back and returns
    (id, start, n_tokens, ids_crc32) from what it read.

    A null text is empty: its document is the end id alone. Documents of equal
    ids (or null ones, which come first) stand in an order of their token ids' crc;
    an empty table writes no segments and gives no rows. Other columns take no part."""
    spark, tmp = df.sparkSession, Scratch(df.sparkSession, "ids")
    width = encoder(tokenizer).dtype.itemsize
    tokens = tmp.table(tokenize(df, tokenizer, end_id, id_col, text_col), "tokens")
    path = path or f"{tmp.base}/files"
    write_segments(tokens, path, width)
    tmp.drop("tokens")
    return read_segments(spark, path).select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
