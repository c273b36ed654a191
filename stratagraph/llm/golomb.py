"""Golomb coding (Rice's case: a power of two as divisor) of sorted 64-bit fingerprints."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBQI")


def encode(sorted_values: np.ndarray) -> bytes:
    """Ascending distinct uint64 values as coded gaps: quotients in unary, remainders in fixed width."""
    n = len(sorted_values)
    if n == 0:
        return b""
    gaps = np.diff(sorted_values, prepend=sorted_values[:1])
    mean = int(sorted_values[-1] - sorted_values[0]) // max(n - 1, 1)
    k = min(max(mean.bit_length() - 1, 0), 63)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    low = np.zeros((n, 0), np.uint8)
    if k:
        rest = (gaps & np.uint64((1 << k) - 1)).astype(">u8").view(np.uint8).reshape(n, 8)
        width = -(-k // 8)
        low = np.unpackbits(rest[:, 8 - width :], axis=1)[:, 8 * width - k :]
    return _HEAD.pack(int(sorted_values[0]), k, n, len(unary)) + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    first, k, n, n_unary = _HEAD.unpack_from(blob)
    at = _HEAD.size
    size = -(-n_unary // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n_unary))
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + size), count=n * k).reshape(n, k)
        width = -(-k // 8)
        full = np.zeros((n, 64), np.uint8)
        full[:, 64 - k :] = bits
        gaps |= np.packbits(full, axis=1).view(">u8").reshape(n).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.uint64(first) + np.cumsum(gaps)
