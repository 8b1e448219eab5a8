"""Substring removal by hashing lines or paragraphs, and runs of the sentences in them.

A text is cut into sentences at line ends and after full stops. A unit is a
whole line (or paragraph), or the shortest run of whole sentences from one
sentence on that is long enough: a passage that stands in the middle of other
lines, or is wrapped in another way, has the same runs wherever it stands.
Units are normalised and digested; digests are grouped over all documents, the
earliest occurrence by (document id, place) stays and every later one is cut
out. Spans keep their offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_on_digest

#: What ends a sentence: marks before white space, full-width marks, or a line's end.
SEPARATOR = re.compile("[.!?][ \t-\r]+|[。！？][ \t-\r]*|\n[ \t-\r]*")
#: What in a separator ends a line or a paragraph.
ENDS = {"line": re.compile("\n"), "paragraph": re.compile("\n[ \t\x0b-\r]*\n")}
#: Characters other than white space that a unit has at least (some twenty words). Shorter lines agree by chance.
LEAST_CHARS = 100


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence with what separates it from the next, in code points; together they are the text."""
    out, at = [], 0
    for m in SEPARATOR.finditer(text or ""):
        out.append((at, m.end()))
        at = m.end()
    if text and at < len(text):
        out.append((at, len(text)))
    return out


def units(text: str | None, unit: str = "line", least_chars: int = LEAST_CHARS) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of each unit: lower-cased, runs of white space one space."""
    spans = sentences(text)
    words = [text[lo:hi].lower().split() for lo, hi in spans]
    size = [sum(map(len, w)) for w in words]
    norm = [" ".join(w) for w in words]
    pairs, stop, have = set(), 0, 0
    for k, (lo, hi) in enumerate(spans):
        while stop < len(spans) and have < least_chars:
            have += size[stop]
            stop += 1
        if have >= least_chars and size[k]:
            pairs.add((k, stop))
        have -= size[k]
    first, have = 0, 0
    for k, (lo, hi) in enumerate(spans):
        have += size[k]
        if k + 1 == len(spans) or ENDS[unit].search(text, lo, hi):
            if have >= least_chars:
                pairs.add((first, k + 1))
            first, have = k + 1, 0
    return [(spans[a][0], spans[b - 1][1], " ".join(x for x in norm[a:b] if x)) for a, b in sorted(pairs)]


def _digests(unit: str, least: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = ([], [], [], [], [])
                for i, t, text in zip(*(c.to_pylist() for c in part.columns)):
                    for lo, hi, norm in units(text, unit, least):
                        for column, v in zip(out, (i, t, lo, hi, hashlib.blake2b(norm.encode(), digest_size=16).digest())):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=["id", "t", "lo", "hi", "digest"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    return "".join(text[lo:hi] for lo, hi in zip(edges[::2], edges[1::2]))


def _apply(batches):
    for b in batches:
        n, gone, kept = [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            spans = merged([(s["lo"], s["hi"]) for s in spans or ()])
            n.append(len(sentences(text)))
            gone.append([{"start": lo, "end": hi} for lo, hi in spans])
            kept.append(text if not spans else cut(text, spans))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], names=["id", "n_sentences", "spans", "text"])


def dedup_units(df: DataFrame, unit: str = "line", least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, spans, text) of every document: spans are the maximal runs removed, as code point offsets of the original, text is what stays.

    Units are those of `units`: whole lines or paragraphs and runs of
    sentences, each of least_chars characters or more; what is shorter and in no
    longer repeat is left alone (least_chars=1 takes every line and sentence).
    Each goes by a 128-bit digest. Rank is (id, offset): a null id comes last,
    and rows of one id and text are one document, so none of them removes the
    other's units. A later repeat within a document goes as well. A null text
    has no units and stays null; an empty table gives no rows. Other columns
    take no part, whatever their names."""
    tmp = Scratch(df.sparkSession, "lines")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col).alias("text"))
    found = tmp.table(docs.mapInArrow(_digests(unit, least_chars), "id long, t long, lo long, hi long, digest binary"), "units")
    rank = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("i"), F.col("lo"), F.col("t"))
    # Map-side partial counts: a unit that a third of all documents share is a row per task here.
    first = found.groupBy("digest").agg(F.count("*").alias("c"), F.min(rank).alias("first")).where("c > 1")
    later = join_on_digest(found, tmp.table(first, "first"), "digest", "c").where(rank != F.col("first"))
    spans = later.select("id", "t", F.struct("lo", "hi").alias("s")).groupBy("id", "t").agg(F.collect_set("s").alias("spans"))
    s = spans.select(F.col("id").alias("__i"), F.col("t").alias("__t"), "spans")
    joined = docs.join(s, docs["id"].eqNullSafe(s["__i"]) & (docs["t"] == s["__t"]), "left").select("id", "text", "spans")
    out = joined.mapInArrow(_apply, "id long, n_sentences long, spans array<struct<start:long,end:long>>, text string")
    return out.select(F.col("id").alias(id_col), "n_sentences", "spans", F.col("text").alias(text_col))
