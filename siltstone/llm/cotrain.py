"""Quality classification by co-training.

Two views of a document, each with a classifier of its own: its words and how
they repeat (content), and what a page index stores beside them (language,
source, length, shares of character classes). Starting from labelled
documents, each classifier labels all other documents that it is sure of for
the other one, over some rounds. Both are naive Bayes, so that a round is one
pass over all documents that counts features. Both are calibrated on labelled
documents, each scored as if it had not been counted, and a logistic
combination of the calibrated views scores every document. There is one such
pair for quality and one for toxicity.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkit as tk
from .common import Scratch

TARGETS = ("quality", "toxic")
#: Labelled documents whose scores calibrate the views, at most (an expected number; a hash of the id draws them).
MOST_SCORED = 20_000
WORD_IDS = 1 << 18
#: Quantiles at which numbers of the metadata view are cut; close at both ends, where junk lies.
CUTS = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998)
BINS = len(CUTS) + 1
#: Bytes of a word's beginning that are features as well.
STEMS = (4, 5, 6)
LANGS, SOURCES = 64, 1024
#: Numbers of the content view (words and their repetition), then those of the metadata view.
STYLE = ("word_length", "new_words", "new_shingles", "same_again")
NUMBERS = (*STYLE, "chars", "lines", "line_length", "upper", "digit", "punct", "symbols", "bar", "beyond_ascii")
META_IDS = len(NUMBERS) * BINS + LANGS + SOURCES

_CLASS = {name: np.zeros(256, "int64") for name in ("upper", "digit", "punct", "symbols", "bar", "beyond_ascii", "newline", "space")}
_CLASS["upper"][65:91] = 1
_CLASS["digit"][48:58] = 1
_CLASS["punct"][[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASS["symbols"][[35, 36, 37, 38, 42, 43, 61, 64, 94, 95, 96, 123, 125, 126, 60, 62]] = 1
_CLASS["bar"][124] = 1
_CLASS["beyond_ascii"][128:] = 1
_CLASS["newline"][10] = 1
_CLASS["space"][tk.SPACE] = 1


def views(texts: pa.Array, langs: list, sources: list):
    """(row range, word ids, first word id of each row, numbers, [language, source] ids) by pieces of a column."""
    # Letters and digits make words; everything else parts them.
    sep = np.ones(256, bool)
    sep[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    for i, j, data, off in tk.pieces(texts):
        n = j - i
        starts, ends, first = tk.words(data, off, sep)
        h = tk.span_hashes(tk.FOLD[data], starts, ends)
        row = np.repeat(np.arange(n), np.diff(first))
        stems = []
        for k in STEMS:
            long = ends - starts > k
            stems.append((tk.mix(tk.span_hashes(tk.FOLD[data], starts[long], starts[long] + k) + np.uint64(k)), row[long]))
        own, bounds = tk.distinct_by_row(np.concatenate([h, *(x for x, _ in stems)]), np.concatenate([row, *(r for _, r in stems)]), n)
        _, kinds = tk.distinct_by_row(h, row, n)
        again = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n)
        sh, sh_row = tk.shingles(h, first, 3)
        _, sh_bounds = tk.distinct_by_row(sh, sh_row, n)
        many = np.bincount(sh_row, minlength=n)
        size = np.maximum(np.diff(off), 1)
        count = np.maximum(np.diff(first), 1)
        total = {}
        for name, table in _CLASS.items():
            run = np.zeros(len(data) + 1, "int64")
            np.cumsum(table[data], out=run[1:])
            total[name] = run[off[1:]] - run[off[:-1]]
        letters = np.bincount(row, weights=ends - starts, minlength=n)
        numbers = np.stack([letters / count, np.diff(kinds) / count**0.8, np.diff(sh_bounds) / np.maximum(many, 1), again / count, np.log1p(size), np.log1p(total["newline"]), size / (1 + total["newline"]), *(total[x] / np.maximum(size - total["space"], 1) for x in ("upper", "digit", "punct", "symbols", "bar", "beyond_ascii"))], axis=1).astype("float32")
        named = np.stack([[zlib.crc32(str(x).encode()) % LANGS for x in langs[i:j]], [zlib.crc32(str(x).encode()) % SOURCES for x in sources[i:j]]], axis=1) if n else np.zeros((0, 2), "int64")
        yield i, j, (own & np.uint64(WORD_IDS - 1)).astype("int64"), bounds, numbers, named


@dataclass
class Sparse:
    """Rows of feature ids."""

    ids: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def sums(self, w: np.ndarray) -> np.ndarray:
        """A row's weights over the root of how many of its ids have one: words of one text aren't independent, and long texts have more of them."""
        return self.each(w[self.ids])

    def each(self, w: np.ndarray) -> np.ndarray:
        """The same, given the weight of each id in its place."""
        at = np.flatnonzero(w)
        row, n = np.searchsorted(self.first, at, "right") - 1, len(self.first) - 1
        return np.bincount(row, weights=w[at], minlength=n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))


def pack(ids: np.ndarray) -> bytes:
    """Rising ids as 16-bit gaps; a gap of k * 65535 + r is k times 65535, then r."""
    gaps = np.diff(ids, prepend=0)
    out = np.full(len(gaps) + int((gaps // 65535).sum()), 65535, "<u2")
    out[np.arange(len(gaps)) + np.cumsum(gaps // 65535)] = gaps % 65535
    return out.tobytes()


def unpack(rows: list[bytes]) -> Sparse:
    size = np.array([len(x) // 2 for x in rows], "int64")
    gaps = np.frombuffer(b"".join(rows), "<u2")
    total, ends = np.concatenate([[0], np.cumsum(gaps, dtype="int64")]), np.concatenate([[0], np.cumsum(size)])
    real = np.flatnonzero(gaps != 65535)
    ids = total[real + 1] - np.repeat(total[ends[:-1]], size)[real]
    return Sparse(ids, np.searchsorted(real, ends))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(seen, hit, n, positive, choose: bool = False) -> np.ndarray:
    """Naive Bayes weights of features from how many rows (of n, positive ones) have them: all that a fit needs are counts, which executors add up.

    With choose, a feature seen less than three times, or whose share of hits is within four deviations of chance, weighs 0."""
    p = np.clip(positive / np.maximum(n, 1e-9), 1e-3, 1 - 1e-3)
    w = np.log((hit + p) / p) - np.log((seen - hit + 1 - p) / (1 - p))
    keep = (seen >= 3) & (np.abs(hit - seen * p) >= 4 * np.sqrt(seen * p * (1 - p))) if choose else seen > 0
    return np.where(keep, w, 0.0).astype("float32")


def platt(z: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (of the columns of z, and a constant) of a logistic fit by Newton steps; what calibrates one view and combines two."""
    a = np.column_stack([z, np.ones(len(y))])
    # Smoothed targets keep a separable view from growing without bound.
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = _sigmoid(a @ w)
        g = a.T @ (p - t) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def combine(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of two calibrated views, none below 0: a view that says next to nothing must not count the wrong way round."""
    w = platt(z, y)
    for k in range(2):
        if w[k] < 0:
            one = platt(z[:, 1 - k : 2 - k], y)
            w = np.array([0.0, max(one[0], 0.0), one[1]] if k == 0 else [max(one[0], 0.0), 0.0, one[1]])
    return w


def _line(w: np.ndarray, *z: np.ndarray) -> np.ndarray:
    return np.column_stack(z) @ w[:-1] + w[-1]


@dataclass
class Model:
    """The fitted classifier: bin edges and, for each target, the weights of both views, their calibrations and combination."""

    edges: list[np.ndarray]
    heads: dict[str, tuple]

    def learned(self, name: str) -> bool:
        """Whether there were labels enough to learn from."""
        return bool(self.heads[name][2].any() or self.heads[name][3].any())

    def meta(self, numbers: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Feature ids of numbers and names, a row of them for each document; the first len(STYLE) are the content view's."""
        cols = [k * BINS + np.searchsorted(self.edges[k], numbers[:, k]) for k in range(numbers.shape[1])]
        return np.stack([*cols, len(NUMBERS) * BINS + named[:, 0], len(NUMBERS) * BINS + LANGS + named[:, 1]], axis=1)

    def logits(self, words: Sparse, meta: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated views."""
        wa, wb, ca, cb, _ = self.heads[name]
        w = wb[meta]
        return _line(ca, words.sums(wa), w[:, : len(STYLE)].sum(1)), _line(cb, w[:, len(STYLE) :].sum(1))

    def scores(self, words: Sparse, meta: np.ndarray) -> dict[str, np.ndarray]:
        return {name: _sigmoid(_line(h[4], *self.logits(words, meta, name))) for name, h in self.heads.items()}


def _featurise(batches):
    for b in batches:
        for i, j, ids, first, numbers, named in views(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
            words = [pack(np.sort(ids[first[r] : first[r + 1]])) for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words, pa.binary()), *map(pa.array, numbers.T), *(pa.array(c.astype("int32")) for c in named.T)], names=["id", "words", *NUMBERS, "lang_id", "source_id"])


def _read(b: pa.RecordBatch, model: Model):
    """(words, ids of the metadata view, quality, toxic) of a batch of the features table, by runs of rows."""
    for lo in range(0, b.num_rows, 2000):
        part = b.slice(lo, 2000)
        col = lambda c: part.column(c).to_numpy(zero_copy_only=False)
        label = {t: part.column(t).fill_null(-1).to_numpy(zero_copy_only=False).astype("int64") for t in TARGETS}
        yield unpack(part.column("words").to_pylist()), model.meta(np.column_stack([col(c) for c in NUMBERS]), np.column_stack([col("lang_id"), col("source_id")])), label


#: Feature ids of words, of numbers and names, and one that every document has.
WIDTH = WORD_IDS + META_IDS + 1
#: Counts travel in pieces of so many ids.
PIECE = 1 << 12


def _added(rows: DataFrame, count, kinds: int) -> np.ndarray:
    """Sums over all tasks of the counts (kinds x WIDTH) that count(batch, total) adds to a task's total."""

    def run(batches):
        total = np.zeros((kinds, WIDTH), "int64")
        for b in batches:
            count(b, total)
        for lo in range(0, WIDTH, PIECE):
            part = total[:, lo : lo + PIECE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["lo", "part"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for lo, part in zip(*(c.to_pylist() for c in b.columns)):
                part = np.frombuffer(zlib.decompress(part), "int64")
                sums[lo] = sums[lo] + part if lo in sums else part
        for lo, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["lo", "part"])

    schema = "lo long, part binary"
    out = np.zeros((kinds, WIDTH), "int64")
    for r in rows.mapInArrow(run, schema).repartition("lo").mapInArrow(add, schema).collect():
        out[:, r["lo"] : r["lo"] + PIECE] = np.frombuffer(zlib.decompress(r["part"]), "int64").reshape(kinds, -1)
    return out


def _count(total: np.ndarray, words: Sparse, meta: np.ndarray, y: np.ndarray, views: str = "ab") -> None:
    """Adds rows with y >= 0 to total[0], those with y == 1 to total[1]: features of the content view (a), the metadata view (b) or both."""
    size = np.diff(words.first)
    cols = meta[:, slice(0 if "a" in views else len(STYLE), None if "b" in views else len(STYLE))]
    for k, rows in enumerate((y >= 0, y == 1)):
        if "a" in views:
            total[k, :WORD_IDS] += np.bincount(words.ids[np.repeat(rows, size)], minlength=WORD_IDS)
        total[k, WORD_IDS:-1] += np.bincount(cols[rows].ravel(), minlength=META_IDS)
        total[k, -1] += int(rows.sum())


def balanced(extra: np.ndarray, base: np.ndarray, pool_weight: float) -> np.ndarray:
    """Counts of pseudo-labelled documents, weighted so that both labels have the share that they have among the labelled ones (base).

    A view that is sure of one label only teaches nothing; in all they weigh no more than the labelled documents."""
    hit, other = extra[1], extra[0] - extra[1]
    share = base[1, -1] / base[0, -1]
    whole = min(hit[-1] / share, other[-1] / (1 - share))
    if not whole:
        return np.zeros(extra.shape)
    weight = min(pool_weight, base[0, -1] / whole) * whole
    hit = hit * (weight * share / hit[-1])
    return np.stack([hit + other * (weight * (1 - share) / other[-1]), hit])


class Counts:
    """What a target's two views have seen: counts of the labelled documents and, weighted, of the pseudo-labelled ones."""

    def __init__(self, base: np.ndarray, extra: np.ndarray, pool_weight: float):
        own = [base + balanced(extra[2 * v : 2 * v + 2], base, pool_weight) for v in range(2)]
        self.n, self.positive = [x[0, -1] for x in own], [x[1, -1] for x in own]
        self.words, style = own[0][:, :WORD_IDS], slice(WORD_IDS, WORD_IDS + len(STYLE) * BINS)
        self.meta = own[1][:, WORD_IDS:-1].copy()
        self.meta[:, : len(STYLE) * BINS] = own[0][:, style]

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        a = fit(*self.words, self.n[0], self.positive[0], True)
        b = fit(*self.meta, self.n[1], self.positive[1])
        b[: len(STYLE) * BINS] = fit(*self.meta[:, : len(STYLE) * BINS], self.n[0], self.positive[0])
        return a, b

    def without_own(self, words: Sparse, meta: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(words, style, metadata) sums of labelled documents, each by the weights of all others."""
        own = y[words.row]
        a = words.each(fit(self.words[0, words.ids] - 1, self.words[1, words.ids] - own, self.n[0] - 1, self.positive[0] - own, True))
        v = np.where(np.arange(meta.shape[1]) < len(STYLE), 0, 1)
        n, positive = np.array(self.n)[v] - 1, np.array(self.positive)[v] - y[:, None]
        b = fit(self.meta[0, meta] - 1, self.meta[1, meta] - y[:, None], n, positive)
        return np.column_stack([a, b[:, : len(STYLE)].sum(1), b[:, len(STYLE) :].sum(1)])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", rounds: int = 3, sure: float = 0.995, pool_weight: float = 0.1) -> Model:
    """Fits on all labelled documents and, from the second round on, on all others that a view is sure of.

    Every round is a pass of the executors over the features of all documents; counts of feature ids come back (of fixed size), and the
    scores of labelled documents that calibrate: all of them, or a sample of about MOST_SCORED. Labels with a null id or value take no
    part; of several rows of one id the lowest quality and the highest toxicity count."""
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "cotrain")
    clean = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    drawn = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < F.lit(int(min(1.0, MOST_SCORED / max(clean.count(), 1)) * (1 << 30)))
    schema = ", ".join(["id long, words binary", *(f"{x} float" for x in NUMBERS), "lang_id int, source_id int"])
    features = docs.select(F.col(id_col).cast("long").alias("id"), "text", "lang", "source").mapInArrow(_featurise, schema)
    # Labels grow with the documents: the join is a shuffle at every size.
    rows = tmp.table(features.join(clean.hint("merge"), "id", "left"), "features")
    scored = tmp.table(rows.where(F.col("quality").isNotNull() & drawn), "scored")
    cuts = rows.agg(*(F.percentile_approx(c, list(CUTS), 10_000).alias(c) for c in NUMBERS)).first()
    model = Model([np.unique(cuts[c] or []) for c in NUMBERS], {})
    bare = Model(model.edges, {})

    def labelled(b, total):
        for words, meta, label in _read(b, bare):
            for k, t in enumerate(TARGETS):
                _count(total[2 * k : 2 * k + 2], words, meta, label[t])

    def known_scores(counts):
        """For each target (sums of words, of style, of metadata, labels) of labelled documents."""

        def run(batches):
            for b in batches:
                for words, meta, label in _read(b, bare):
                    for k, t in enumerate(TARGETS):
                        if t in counts:
                            z = counts[t].without_own(words, meta, label[t])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(meta), k)), *(pa.array(c, pa.float64()) for c in z.T), pa.array(label[t])], names=["k", "a", "s", "b", "y"])

        got = scored.mapInArrow(run, "k long, a double, s double, b double, y long").toPandas().sort_values(["k", "a", "s", "b", "y"])
        return {t: (got.loc[got.k == k, ["a", "s", "b"]].to_numpy(), got.loc[got.k == k, "y"].to_numpy()) for k, t in enumerate(TARGETS)}

    base = _added(rows.where("quality IS NOT NULL"), labelled, 4)
    extra = np.zeros((8, WIDTH), "int64")
    for turn in range(rounds + 1):
        counts = {}
        for k, t in enumerate(TARGETS):
            n, positive = int(base[2 * k, -1]), int(base[2 * k + 1, -1])
            if n < 10 or positive in (0, n):
                # Too little to learn from: the share of the label is all there is to say.
                p = (positive + 1) / (n + 2)
                model.heads[t] = (np.zeros(WORD_IDS, "float32"), np.zeros(META_IDS, "float32"), np.zeros(3), np.zeros(2), np.array([0.0, 0.0, float(np.log(p / (1 - p)))]))
                continue
            # Words are chosen anew each round, so that what the other view labels can bring new ones.
            counts[t] = Counts(base[2 * k : 2 * k + 2], extra[4 * k : 4 * k + 4], pool_weight)
        for t, (z, y) in known_scores(counts).items() if counts else ():
            if t in counts:
                ca, cb = platt(z[:, :2], y), platt(z[:, 2:], y)
                model.heads[t] = (*counts[t].weights(), ca, cb, combine(np.column_stack([_line(ca, z[:, 0], z[:, 1]), _line(cb, z[:, 2])]), y))
        if turn == rounds or not counts:
            break

        def exchanged(b, total, heads=dict(model.heads)):
            now = Model(bare.edges, heads)
            for words, meta, _ in _read(b, now):
                for k, t in enumerate(TARGETS):
                    # What one view is sure of becomes a label for the other.
                    for v, z in zip("ba", now.logits(words, meta, t)):
                        p = _sigmoid(z)
                        y = np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1))
                        at = 4 * k + 2 * "ab".index(v)
                        _count(total[at : at + 2], words, meta, y, v)

        extra = _added(rows.where("quality IS NULL"), exchanged, 8)
    tmp.drop("features", "scored")
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", least_quality: float = 0.5, most_toxic: float = 0.3, model: Model | None = None, **how) -> DataFrame:
    """docs with quality_score, toxic_score (probabilities) and kept (quality at least, toxicity below the bounds).

    Needs columns text, lang and source. Nulls there are values of their own; a
    null text is an empty one. Where usable labels are too few (under ten, or all
    alike) every document gets their mean (0.5 for none), and that score keeps
    and rejects nothing. Repeated rows get equal scores; an empty table gives no
    rows.
    Columns named like the outputs are replaced. The weights sent to the
    executors have a fixed size (about 2 MB)."""
    base = docs.drop("quality_score", "toxic_score", "kept")
    model = model or train(docs, labels, id_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = base.columns
    at = {c: names.index(c) for c in ("text", "lang", "source")}
    schema = StructType([*base.schema.fields]).add("quality_score", "double").add("toxic_score", "double")

    def run(batches):
        model = shared.value
        for b in batches:
            got = {"quality": [], "toxic": []}
            for _, _, ids, first, numbers, named in views(b.column(at["text"]), b.column(at["lang"]).to_pylist(), b.column(at["source"]).to_pylist()):
                for k, v in model.scores(Sparse(ids, first), model.meta(numbers, named)).items():
                    got[k].append(v)
            cols = [pa.array(np.concatenate(got[k]) if got[k] else [], pa.float64()) for k in ("quality", "toxic")]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*names, "quality_score", "toxic_score"])

    good = F.col("quality_score") >= least_quality if model.learned("quality") else F.lit(True)
    clean = F.col("toxic_score") < most_toxic if model.learned("toxic") else F.lit(True)
    return base.mapInArrow(run, schema).withColumn("kept", good & clean)
