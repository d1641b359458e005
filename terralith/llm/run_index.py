"""A run-length index over pieces of text: matching statistics from the transform's runs and samples at their ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .suffixes import suffix_array

NONE = np.iinfo(np.int64).max
STEP = 2


def symbols_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces plus 1, each piece ended by a 0, and where the pieces end. UTF-8 has no byte 255."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    stops = np.cumsum(sizes)
    symbols = np.zeros(int(sizes.sum()), np.uint8)
    filled = np.ones(len(symbols), bool)
    filled[stops - 1] = False
    symbols[filled] = np.frombuffer(b"".join(pieces), np.uint8) + np.uint8(1)
    return symbols, stops


def _eights(symbols: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on as one number, the first in the highest bits."""
    padded = np.append(symbols, np.zeros(8, np.uint8)).astype(np.uint64)
    out = np.zeros(len(symbols) + 1, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols of a from `at` and of b from `place` on are equal, at most `most`; both as `_eights`."""
    out, live, k = np.zeros(len(at), np.int64), np.flatnonzero(most > 0), 0
    while len(live):
        x = a[np.minimum(at[live] + k, len(a) - 1)] ^ b[np.minimum(place[live] + k, len(b) - 1)]
        same = x == 0
        apart = x.byteswap().view(np.uint8).reshape(-1, 8) != 0
        out[live] = k + np.where(same, 8, apart.argmax(axis=1))
        k += 8
        live = live[same]
        live = live[most[live] > k]
    return np.minimum(out, most)


class RunIndex:
    """Longest matches, up to `width` bytes told apart, of other texts within pieces that have an owner each.

    Kept, besides the symbols, are arrays with an entry per run of the Burrows-Wheeler transform: its first row, its
    byte, how far its rows go by one step back, the suffix positions sampled at its first and last row, and
    a threshold: of the rows between the run of the same byte before it and itself, the first one with the smallest
    common prefix. From a row before the threshold the run before has the longer match, from the others this one.
    `least` is the smallest owner of all suffixes that share `width` bytes, by runs of rows. Every 2 ** `STEP`-th row
    has its run noted, from where a row's own run is a few steps on.
    """

    def __init__(self, pieces: list[bytes], owners: np.ndarray, width: int):
        self.width = width
        symbols, stops = symbols_of(pieces)
        self.eights = _eights(symbols)
        order = suffix_array(symbols.astype(np.int64))
        n = len(order)
        bwt = symbols[order - 1]
        head = np.append(True, bwt[1:] != bwt[:-1])
        self.run_start = np.flatnonzero(head).astype(np.int32)
        self.run_byte = bwt[self.run_start]
        self.run_last = (np.append(self.run_start[1:], n) - 1).astype(np.int32)
        self.first_sample, self.last_sample = order[self.run_start], order[self.run_last]
        self.of_byte = by_byte = np.argsort(self.run_byte, kind="stable").astype(np.int32)
        lengths = (self.run_last - self.run_start + 1)[by_byte]
        self.shift = np.empty(len(by_byte), np.int32)
        self.shift[by_byte] = np.cumsum(lengths) - lengths
        self.shift -= self.run_start
        self.run_at = (np.cumsum(head, dtype=np.int32) - np.int32(1))[:: 1 << STEP].copy()
        self.key = self.run_byte[by_byte].astype(np.int64) * (len(by_byte) + 1) + by_byte
        piece = np.repeat(np.arange(len(pieces)), np.diff(stops, prepend=0))[order]
        left = stops[piece] - 1 - order  # symbols before the piece ends
        common = np.zeros(n, np.int64)
        common[1:] = _equal(self.eights, order[1:], self.eights, order[:-1], np.minimum(np.minimum(left[1:], left[:-1]), width))
        self.threshold = self._thresholds(common)
        group = np.cumsum(np.append(True, common[1:] < width)) - 1
        least = np.full(group[-1] + 1, NONE)
        np.minimum.at(least, group, owners[piece])
        rows = least[group]
        self.least_start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        self.least = rows[self.least_start]
        self.least_of_run = np.searchsorted(self.least_start, self.run_start, side="right") - 1
        self.least_last = np.append(self.least_start[1:], n) - 1

    def _thresholds(self, common: np.ndarray) -> np.ndarray:
        """For each place of `of_byte`: the row at which its run takes over from the run of the same byte before it."""
        n = len(common)
        packed = common * n + np.arange(n)
        out = np.zeros(len(self.of_byte), np.int64)
        edges = np.flatnonzero(np.append(True, np.diff(self.run_byte[self.of_byte]) != 0))
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(out)).tolist(), strict=True):
            if b - a > 1:
                runs = self.of_byte[a:b]
                between = np.stack([self.run_last[runs[:-1]] + 1, self.run_start[runs[1:]] + 1], axis=1).ravel()
                if between[-1] == n:
                    between = between[:-1]
                out[a + 1 : b] = np.minimum.reduceat(packed, between)[0::2] % n
        return out

    def stream(self, pieces: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Matching statistics of pieces, all read from the last byte back.

        Gives (bytes read, pieces, smallest owner) for the places whose match has `width` bytes or more.
        """
        text, stops = symbols_of(pieces)
        eights = _eights(text)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        by_size = np.argsort(-sizes, kind="stable")
        sizes, ends = sizes[by_size], stops[by_size] - 1
        live_at = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1 if len(sizes) else 1), side="right").tolist()
        row, run, length = (np.zeros(len(pieces), np.int32) for _ in range(3))
        for back in range(1, len(live_at)):
            n = live_at[back]
            at = ends[:n] - back
            c, r, k, m = text[at], row[:n], run[:n], length[:n]
            miss = np.flatnonzero(self.run_byte[k] != c)
            if len(miss):
                cj, j = c[miss], r[miss]
                place = np.searchsorted(self.key, cj.astype(np.int64) * (len(self.key) + 1) + k[miss])
                after, before = np.minimum(place, len(self.key) - 1), np.maximum(place - 1, 0)
                has_after = (place < len(self.key)) & (self.run_byte[self.of_byte[after]] == cj)
                has_before = (place > 0) & (self.run_byte[self.of_byte[before]] == cj)
                up = has_before & (~has_after | (j < self.threshold[after]))
                to = self.of_byte[np.where(up, before, after)]
                r[miss] = np.where(up, self.run_last[to], self.run_start[to])
                k[miss] = to
                sample = np.where(up, self.last_sample[to], self.first_sample[to])
                known = has_before | has_after
                most = np.where(known, np.minimum(m[miss], self.width), 0)
                m[miss] = np.where(known, _equal(eights, at[miss] + 1, self.eights, sample, most), -1)
            r += self.shift[k]  # one step back
            m += 1
            if len(miss) and len(lost := miss[m[miss] == 0]):
                r[lost] = 0
            k[:] = self.run_at[r >> STEP]
            ahead = np.flatnonzero(r > self.run_last[k])
            while len(ahead):
                k[ahead] += 1
                ahead = ahead[r[ahead] > self.run_last[k[ahead]]]
            long = np.flatnonzero(m >= self.width)
            if len(long):
                rows, which = r[long], self.least_of_run[k[long]]
                ahead = np.flatnonzero(rows > self.least_last[which])
                which[ahead] = np.searchsorted(self.least_start, rows[ahead], side="right") - 1
                yield back, by_size[long], self.least[which]
