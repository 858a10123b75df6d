"""A wavelet tree over a permutation, in whole arrays: which of the points of a rectangle there are, for many rectangles at once."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Over ``values``, numbers from 0 below their count: level by level, bit by bit from the highest, zeros before ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.ones, self.zeros = [], []
        now = np.asarray(values, np.int64)
        for b in reversed(range(self.bits)):
            bit = (now >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of each place in [left, right) whose value lies in [low, high), for each rectangle."""
        box, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        l, r = np.asarray(left, np.int64), np.asarray(right, np.int64)
        for level, b in enumerate(reversed(range(self.bits))):
            ones, zeros = self.ones[level], self.zeros[level]
            at_l, at_r = ones[l], ones[r]
            box, value = np.r_[box, box], np.r_[value, value | (1 << b)]
            l, r = np.r_[l - at_l, zeros + at_l], np.r_[r - at_r, zeros + at_r]
            # Subtrees without places, or whose values are all outside, are left.
            keep = (l < r) & (value < high[box]) & (value + (1 << b) > low[box])
            box, value, l, r = box[keep], value[keep], l[keep], r[keep]
        return box, value
