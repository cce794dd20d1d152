"""Suffix order of many word sequences at once, with wavelet ranks over the positions."""

from __future__ import annotations

import numpy as np


def factor_ranks(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of ``words`` and, per level k, the rank of the 2^k words from each position on.

    ``ends`` holds the end of each position's sequence; the same word must be another number in another sequence. Equal
    ranks mean equal words of full length: a suffix cut by its sequence's end is equal to no other. A rank is the first slot of
    its group in the suffix order. The last level has no two equal ranks. Only slots that still share a rank are sorted again.
    Each level has one entry more, for the position behind the last.
    """
    n = len(words)
    order = np.argsort(words, kind="stable").astype(np.int32)
    slots = np.arange(n, dtype=np.int32)
    head = np.ones(n + 1, bool)
    head[1:n] = words[order[1:]] != words[order[:-1]]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head[:n], slots, 0))
    levels, span = [rank], 1
    while True:
        active = np.flatnonzero(~(head[:n] & head[1:]))
        if not len(active):
            return order, levels
        at = order[active].astype(np.int64)
        after = np.where(at + span < ends[at], rank[np.minimum(at + span, n)], -1)
        key = rank[at] * np.int64(n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[active] = at[by]
        first = np.ones(len(active), bool)
        first[1:] = key[1:] != key[:-1]
        head[active] = first
        rank = rank.copy()
        rank[order[active]] = np.maximum.accumulate(np.where(first, active, 0))
        levels.append(rank)
        span *= 2


class WaveletMatrix:
    """Counts and order statistics of any stretch of ``values``, which are below their number; all queries are arrays."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.levels = []
        for bit in reversed(range(n.bit_length())):
            one = (values >> bit) & 1 == 1
            before = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=before[1:])
            self.levels.append((bit, before, n - int(before[-1])))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of slots lo to hi are less than ``limit`` (at most the number of values)."""
        found = np.zeros(len(lo), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            up = (limit >> bit) & 1 == 1
            found += np.where(up, hi - lo - b + a, 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` smaller ones in slots lo to hi; with ``k = below(lo, hi, x)`` the successor of x there."""
        value = np.zeros(len(lo), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            low = hi - lo - b + a
            up = k >= low
            value += np.where(up, 1 << bit, 0)
            k = np.where(up, k - low, k)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return value
