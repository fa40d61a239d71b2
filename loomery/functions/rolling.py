"""Hashes of all windows of a byte string, in NumPy."""

from __future__ import annotations

import numpy as np

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def window_hashes(data: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes; equal runs hash equally wherever they stand."""
    x = np.frombuffer(data, dtype=np.uint8)
    m = len(x) - k + 1
    if m < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(x)), out=total[1:])
    h = (total[k:] - total[:-k]) * _powers(_INVERSE, m)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def minimizers(data: bytes, length: int, first_only: bool = False) -> np.ndarray:
    """For every run of ``length`` bytes its smallest window hash, each once; with first_only for the first run alone.

    Two strings that share a run of that length share a minimizer, which is what makes them meet.
    """
    k = length // 2 + 1
    h = window_hashes(data[:length] if first_only else data, k)
    w = length - k + 1
    if len(h) < w:
        return np.empty(0, np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1))
