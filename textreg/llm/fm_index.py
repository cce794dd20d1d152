"""FM-index over a shard of word ids: suffix order, wavelet ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Positions sorted by suffix, by prefix doubling. Zeros separate texts and count as different symbols."""
    n = len(ids)
    zero = ids == 0
    zeros = int(zero.sum())
    rank = ids.astype(np.int64) + zeros
    rank[zero] = np.arange(zeros)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + zeros + int(ids.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) if n else np.empty(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


class Wavelet:
    """Wavelet matrix: one bit vector per bit of the symbols, each answering rank queries in constant time."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        now = symbols
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (now >> bit) & 1
            zeros_before = np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32)
            self.levels.append((zeros_before, int(zeros_before[-1])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(at), at
        depth = len(self.levels)
        for k, (zeros, total) in enumerate(self.levels):
            one = ((symbol >> (depth - 1 - k)) & 1).astype(bool)
            lo0, hi0 = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            lo, hi = np.where(one, total + lo - lo0, lo0), np.where(one, total + hi - hi0, hi0)
        return hi - lo


class FMIndex:
    """Index of ``ids`` (positive words, zeros between texts)."""

    def __init__(self, ids: np.ndarray):
        order = suffix_order(ids)
        self.n, self.top = len(ids), int(ids.max(initial=0))
        self.last = ids[order - 1].astype(np.int64)  # the word before each suffix; the first text's is the last one
        self.ranks = Wavelet(self.last, self.top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=self.top + 1))])
        # Starts of texts are sampled as well, so a walk to a sample never leaves its text.
        sampled = (order % SAMPLE == 0) | (self.last == 0) | (order == 0)
        self.sampled, self.place = sampled, np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges ``[lo, hi)`` of the phrases: rows of words, left-aligned, of the given lengths."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= step) & (lo < hi))
            if not len(live):
                break
            word = phrases[live, lengths[live] - step]
            known = word <= self.top
            word = np.where(known, word, 0)
            base = self.first[word]
            new_lo, new_hi = base + self.ranks.rank(word, lo[live]), base + self.ranks.rank(word, hi[live])
            lo[live], hi[live] = np.where(known, new_lo, 0), np.where(known, new_hi, 0)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled position and add the steps."""
        out, rows, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            ready = open_[done]
            out[ready] = self.positions[self.place[rows[ready]]] + steps[ready]
            open_ = open_[~done]
            at = rows[open_]
            word = self.last[at]
            rows[open_] = self.first[word] + self.ranks.rank(word, at)
            steps[open_] += 1
        return out
