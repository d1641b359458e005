"""Suffix arrays and Burrows-Wheeler transforms of integer sequences, vectorised by prefix doubling."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of symbols >= 0 that ends in 0.

    Each 0 ends a piece and counts as a symbol of its own, smaller than all others and than later zeros;
    so a comparison never runs past the end of a piece.
    """
    n = len(symbols)
    if n <= 1:
        return np.arange(n)
    bits = max(int(symbols.max()).bit_length(), 1)
    h = max(1, 63 // bits)
    ends = np.flatnonzero(symbols == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the piece ends
    key = np.zeros(n, np.int64)
    padded = np.zeros(n + h, np.int64)
    padded[:n] = symbols
    for k in range(h):
        key = (key << bits) | np.where(left >= k, padded[k : k + n], 0)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]) | (left[order][1:] < h)
    while True:
        group = np.cumsum(fresh) - 1
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(fresh)[group]  # place of the group's first suffix
        again = ~fresh
        again[:-1] |= ~fresh[1:]
        at = np.flatnonzero(again)
        if not len(at):
            return order
        some = order[at]
        second = rank[np.minimum(some + h, n - 1)]
        kept = np.argsort(rank[some] * (n + 1) + second)
        some, second = some[kept], second[kept]
        order[at] = some
        firsts = rank[some]
        new = np.ones(len(at), bool)
        new[1:] = (firsts[1:] != firsts[:-1]) | (second[1:] != second[:-1])
        fresh[at] = new
        h *= 2


class WaveletMatrix:
    """rank(c, i): how often c stands in the first i symbols, for many c and i at once."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        seq = symbols.astype(np.int64)
        for bit in range(max(int(seq.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            ones = (seq >> bit) & 1
            before = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(seq) - int(before[-1])))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros(len(c), np.int64)
        i = i.astype(np.int64)
        for bit, before, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            start = np.where(one, zeros + before[start], start - before[start])
            i = np.where(one, zeros + before[i], i - before[i])
        return i - start


class FMIndex:
    """Backward search over a sequence of pieces, each ended by 0; positions by sampled suffixes."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        order = suffix_array(symbols)
        n = len(symbols)
        self.bwt = symbols[order - 1]  # the first suffix is preceded by the last symbol
        self.wavelet = WaveletMatrix(self.bwt)
        self.below = np.zeros(int(symbols.max(initial=0)) + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=len(self.below) - 1), out=self.below[1:])
        # suffix positions at every piece's start and at every sample-th place; a walk never crosses a 0
        kept = (order % sample == 0) | (self.bwt == 0)
        self.sampled = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=self.sampled[1:])
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase, a row of `phrases` of one width."""
        m, width = phrases.shape
        low, high = np.zeros(m, np.int64), np.full(m, len(self.bwt), np.int64)
        live = np.arange(m)
        for k in range(width - 1, -1, -1):
            c = phrases[live, k]
            c0 = np.minimum(c, len(self.below) - 2)
            a = self.below[c0] + self.wavelet.rank(c0, low[live])
            b = np.where(c == c0, self.below[c0] + self.wavelet.rank(c0, high[live]), a)
            low[live], high[live] = a, b
            live = live[a < b]
        found = np.zeros(m, bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of these suffixes, by steps back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        walking, rows, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(walking):
            here = self.sampled[rows + 1] > self.sampled[rows]
            out[walking[here]] = self.positions[self.sampled[rows[here]]] + steps
            walking, rows = walking[~here], rows[~here]
            c = self.bwt[rows]
            rows = self.below[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out
