"""Keyed permutations of row numbers.

``position`` sends 0 .. n-1 onto itself, a different way for every key, and one row
at a time: a permutation of a distributed table needs neither a shuffle nor a
table of places. A four-round Feistel network permutes the next power of four;
what leaves 0 .. n-1 is sent on until it is back (cycle walking).
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def position(row: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place of each row number under the permutation of 0 .. n-1 named ``key``."""
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    with np.errstate(over="ignore"):
        rounds = _scramble(np.uint64(key % 2**63) * np.uint64(5) + np.arange(1, 5, dtype=np.uint64) * _ODD)
        out = row.astype(np.uint64)
        out, todo = _walk(out, half, low, rounds), np.arange(len(row))
        while True:
            todo = todo[out[todo] >= n]
            if not len(todo):
                return out.astype(np.int64)
            out[todo] = _walk(out[todo], half, low, rounds)


def _walk(x, half, low, rounds):
    a, b = x >> half, x & low
    for r in rounds:
        a, b = b, a ^ (_scramble(b + r) & low)
    return a << half | b
