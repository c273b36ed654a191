"""Word hashes of Arrow string columns, straight from the UTF-8 buffers, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LCG = 6364136223846793005
_SLICE = 1 << 20

_IS_SPACE = np.zeros(256, np.bool_)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_LCG))[_LOWER.astype(np.int64)]


with np.errstate(over="ignore"):
    _VALUE = _byte_table()
    _BASE = np.uint64((0x9E3779B97F4A7C15 & ~7) | 5)
    _INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        _POW[:] = [_powers(_BASE, max(n, _SLICE + 4096)), _powers(_INVERSE, max(n, _SLICE + 4096))]
    return _POW[0], _POW[1]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def word_spans(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; none crosses a document."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[raw]
    edge = np.zeros(n + 1, np.bool_)
    edge[off] = True
    before = np.empty(n, np.bool_)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, np.bool_)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, A-Z lower-cased. Spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
            part = raw[base : ends[j - 1]]
            power, inverse = _tables(len(part))
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_VALUE[part] * power[: len(part)], out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            i = j
    return out


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about so many bytes, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of consecutive documents, and where each document's words begin (one more entry than documents)."""
    starts, ends = word_spans(off, raw)
    return hash_spans(raw, starts, ends), np.searchsorted(starts, off).astype(np.int64)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k-word shingle; a text of fewer words is one shingle, one without words has none."""
    counts = np.diff(at)
    with np.errstate(over="ignore"):
        n = len(hashes)
        if n >= k:
            h = np.zeros(n - k + 1, np.uint64)
            for d in range(k):
                h = h * _BASE + hashes[d : n - k + 1 + d]
            h = mix(h)
        else:
            h = np.zeros(0, np.uint64)
        per = np.maximum(counts - k + 1, 0)
        doc = np.repeat(np.arange(len(counts)), per)
        first = np.cumsum(per) - per
        index = np.arange(int(per.sum())) - np.repeat(first, per) + np.repeat(at[:-1], per)
        h = h[index] if len(index) else np.zeros(0, np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        few = np.zeros(len(short), np.uint64)
        for d in range(k - 1):
            more = counts[short] > d
            few = np.where(more, few * _BASE + hashes[np.minimum(at[short] + d, max(n - 1, 0))], few) if n else few
        few = mix(few ^ (counts[short].astype(np.uint64) << np.uint64(57)))
    return np.concatenate([h, few]), np.concatenate([doc, short])
