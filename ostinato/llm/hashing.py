"""Hashes of all runs of a sequence at once, in whole arrays."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, by doubling: the hash of 2n words is made of two hashes of n words."""
    have, n, done, at = h, 1, None, 0
    while True:
        if size & n:
            rest = have[at:]
            done = rest if done is None else mixed(done[: len(rest)] * BASE + rest + np.uint64(n))
            at += n
        if at == size:
            return done[: len(h) - size + 1]
        have = mixed(have[:-n] * BASE + have[n:] * ODD + np.uint64(n))
        n *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = 1
    while n < width:
        step = min(n, width - n)
        values = np.minimum(values[:-step], values[step:])
        n += step
    return values
