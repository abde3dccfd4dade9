"""Vectorised helpers over Arrow text columns (numpy inside Spark tasks).

A batch's texts are viewed as one UTF-8 byte buffer plus document offsets; the
functions below find words and lines, hash them, and gather ragged rows without
a Python loop over words. Everything is bounded by the slice size, never by the
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 4 << 20          # text handled at once in a task
_CHUNK = 1 << 20               # bytes hashed at once
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.RandomState(12345).randint(1, 1 << 62, 256).astype(U64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)    # \x20 and \x09-\x0D
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, bool)  # \x00-\x2F \x3A-\x60 \x7B-\x7F, after lower-casing A-Z
NOT_ALNUM[0:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (wrapping uint64 arithmetic)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n, _BASE, U64)
    q = np.full(n, _BASE_INV, U64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


_POW: list = [None, None]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW[0] is None or len(_POW[0]) < n:
        _POW[:] = _powers(max(n, _CHUNK + 1))
    return _POW[0], _POW[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]] for ascending spans; equal bytes
    give equal hashes wherever they stand."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _CHUNK, "right")))
        hi = int(ends[j - 1])
        pw, inv = _tables(hi - lo + 1)
        h = np.empty(hi - lo + 1, U64)
        h[0] = 0
        np.cumsum(_BYTE_CODE[data[lo:hi]] * pw[:hi - lo], out=h[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((h[e] - h[s]) * inv[s] + (e - s).astype(U64))
        i = j
    return out


def utf8_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) covering the column in order;
    null is an empty text. A slice ends before it would pass ``limit`` bytes,
    unless one text alone is longer."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def split_words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and per document its first word's index
    (length n + 1). Words never cross documents."""
    inside = ~sep[data]
    start = inside.copy()
    end = inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    n = len(data)
    b = offs[1:-1]
    b = b[(b > 0) & (b < n)]
    start[b] |= inside[b]
    end[b - 1] |= inside[b - 1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def split_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the newline) of \\n-split lines, and per
    document its first line's index. A text has one line more than newlines."""
    nl = np.flatnonzero(data == 10)
    n_docs = len(offs) - 1
    before = np.searchsorted(nl, offs)             # newlines before each offset
    lo = before + np.arange(n_docs + 1)            # line offsets
    doc_of_nl = np.searchsorted(offs, nl, "right") - 1
    # empty documents share an offset: a newline belongs to the last one starting there
    starts = np.empty(lo[-1], np.int64)
    ends = np.empty(lo[-1], np.int64)
    at = np.arange(len(nl)) + doc_of_nl            # line that each newline ends
    starts[lo[:-1]] = offs[:-1]
    ends[lo[1:] - 1] = offs[1:]
    ends[at] = nl
    starts[at + 1] = nl + 1
    return starts, ends, lo


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values (length len(h) - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U64(0xD1342543DE82EF95)
        out += h[j:j + n]
    return mix64(out)


def window_ok(doc_offs: np.ndarray, n_items: int, k: int) -> np.ndarray:
    """True where the window of k items starting at an item stays in its document."""
    n = max(0, n_items - k + 1)
    ok = np.ones(n, bool)
    cut = doc_offs[1:-1]
    for j in range(1, k):
        c = cut - j
        ok[c[(c >= 0) & (c < n)]] = False
    return ok


def owner(doc_offs: np.ndarray) -> np.ndarray:
    """Document index of each item."""
    return np.repeat(np.arange(len(doc_offs) - 1), np.diff(doc_offs))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True at each key that occurs at least twice."""
    out = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return out
    order = np.argsort(keys)
    s = keys[order]
    eq = s[1:] == s[:-1]
    m = np.zeros(len(keys), bool)
    m[1:] |= eq
    m[:-1] |= eq
    out[order] = m
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct key, and per key the number of its distinct one."""
    use, kinds = pd.factorize(keys)
    rep = np.empty(len(kinds), np.int64)
    rep[use[::-1]] = np.arange(len(keys) - 1, -1, -1)     # the first one is written last
    return rep, use


def cover(flags: np.ndarray, k: int, n_items: int) -> np.ndarray:
    """Items covered by a flagged window of k items (flags by window start)."""
    d = np.zeros(n_items + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(d, at, 1) if len(at) < 64 else None
    if len(at) >= 64:
        d[at] += 1
    np.subtract.at(d, np.minimum(at + k, n_items), 1)
    return np.cumsum(d[:-1]) > 0


def span_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values[offs[i]:offs[i+1]] as int64."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated rows [starts[i], starts[i] + lens[i])."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def gather_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc_offs: np.ndarray,
                joiner: bytes) -> list[str]:
    """Per document its spans joined by ``joiner`` (one byte)."""
    lens = ends - starts + 1
    idx = ragged(starts, lens)
    out = np.append(data, np.uint8(joiner[0]))[np.minimum(idx, len(data))] if len(idx) else np.zeros(0, np.uint8)
    e = np.cumsum(lens)
    if len(e):
        out[e - 1] = joiner[0]
    at = np.concatenate([[0], e])[doc_offs]
    raw = out.tobytes()
    return [raw[a:max(a, b - 1)].decode("utf-8") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
