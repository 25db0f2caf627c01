"""Golomb-Rice coding of sorted unsigned 64-bit numbers, vectorised.

A number is stored as its distance from the one before it: the distance's high
part in unary (so many zeros, then a one), its low ``k`` bits as they are, with
``k`` chosen from the mean distance.
"""

from __future__ import annotations

import struct

import numpy as np


def encode(sorted_values: np.ndarray, base: int = 0) -> bytes:
    """``sorted_values``: ascending uint64, none below ``base``."""
    n = len(sorted_values)
    if not n:
        return struct.pack("<IBQ", 0, 0, base)
    gaps = np.diff(sorted_values, prepend=np.uint64(base))
    mean = int(sorted_values[-1] - np.uint64(base)) // n
    k = max(0, mean.bit_length() - 1)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<IBQ", n, k, base) + np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def decode(coded: bytes) -> np.ndarray:
    n, k, base = struct.unpack_from("<IBQ", coded)
    if not n:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(coded, np.uint8, offset=13))
    ends = np.flatnonzero(bits)[:n]
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    low = bits[ends[-1] + 1 : ends[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    gaps = (high << np.uint64(k)) + (low << shifts).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)
