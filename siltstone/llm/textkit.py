"""Whole Arrow columns of text as byte arrays: words, shingles and their hashes without a loop over rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_RINV = _U(pow(int(_R), -1, 1 << 64))
_POWERS = [np.ones(1, _U), np.ones(1, _U)]
#: Bytes of text that are worked on at once; a longer text is one piece.
PIECE = 1 << 20

#: White space between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype="uint8")
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random-looking 64-bit value of each byte.
BYTE = mix(np.arange(1, 257, dtype=_U) * _R)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i up to n."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_R, _RINV)):
            a = np.full(max(n, 2 * PIECE) + 1, base, _U)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


def pieces(column: pa.Array | pa.ChunkedArray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `most` bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, "int64")[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, "uint8") if data is not None else np.zeros(0, "uint8")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, i + 60_000)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and one more) of the runs of bytes that don't separate words."""
    gap = sep[data]
    n = len(data)
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = off[(off > 0) & (off < n)]
    before[inner], after[inner - 1] = True, True
    starts = np.flatnonzero(~gap & before)
    return starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(starts, off)


#: Bytes of a span that its two keys hold as they are.
EXACT = 16
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each span: its bytes, where it has at most EXACT of them, else a 128-bit digest.

    With the span's length they tell spans apart: short ones for certain, long ones as blake2b does."""
    size = ends - starts
    padded = np.zeros(len(data) + EXACT, "uint8")
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + EXACT - 7, "<u8", padded, strides=(1,))
    a = eight[starts] & _KEEP[np.minimum(size, 8)]
    b = eight[np.minimum(starts + 8, len(data))] & _KEEP[np.clip(size - 8, 0, 8)]
    long = np.flatnonzero(size > EXACT)
    if len(long):
        raw = data.tobytes()
        digests = b"".join(hashlib.blake2b(raw[lo:hi], digest_size=16).digest() for lo, hi in zip(starts[long].tolist(), ends[long].tolist()))
        pair = np.frombuffer(digests, "<u8").reshape(-1, 2)
        a[long], b[long] = pair[:, 0], pair[:, 1]
    return a, b


def key_hashes(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a span's keys and length."""
    return mix(mix(a + _R) ^ (b * _U(0xD1342543DE82EF95) + size.astype(_U)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    return key_hashes(*span_keys(data, starts, ends), ends - starts)


_COEF = mix(np.arange(1, 65, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of the runs of k words of each row; a row of fewer words, but not none, has one of all its words."""
    n, rows = len(h), len(first) - 1
    count = np.diff(first)
    row = np.repeat(np.arange(rows), count)
    whole = np.flatnonzero((count > 0) & (count < k))
    if n >= k:
        s = h[: n - k + 1] * _COEF[0]
        for j in range(1, k):
            s = s + h[j : n - k + 1 + j] * _COEF[j]
        fits = np.arange(n - k + 1) + k <= first[1:][row[: n - k + 1]]
        out, out_row = mix(s[fits]), row[: n - k + 1][fits]
    else:
        out, out_row = np.zeros(0, _U), np.zeros(0, "int64")
    if len(whole):
        short = np.array([int((h[first[r] : first[r + 1]] * _COEF[: count[r]]).sum(dtype=_U)) for r in whole], _U)
        out, out_row = np.concatenate([out, mix(short + count[whole].astype(_U) * _COEF[63])]), np.concatenate([out_row, whole])
    return out, out_row


def distinct_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit values in order within rows, first of each row and one more): each row's set. At most 65536 rows."""
    key = np.sort((row.astype(_U) << _U(48)) | (values >> _U(16)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key, np.arange(rows + 1, dtype=_U) << _U(48)) if rows < 65536 else np.concatenate([np.searchsorted(key, np.arange(rows, dtype=_U) << _U(48)), [len(key)]])
    return key & _U((1 << 48) - 1), first


def pack48(a: np.ndarray) -> bytes:
    return a.astype("<u8").view("uint8").reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), "uint8")
    out[:, :6] = np.frombuffer(b, "uint8").reshape(-1, 6)
    return out.view("<u8").ravel()
