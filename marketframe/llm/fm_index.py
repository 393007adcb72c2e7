"""An FM-index over a sequence of integers, small enough for one task's chunk of a corpus.

The transform is kept in a wavelet matrix of packed bits with a count per 64 bits, so a rank costs one
count, one word and one population count per level. All searches are done for many patterns at once.
With ``order`` suffixes are sorted by at least that many symbols, which is enough to count patterns no
longer than that; without it they are fully sorted, and places can be located too.
"""

from __future__ import annotations

import numpy as np


def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(bits)
    padded = np.zeros((n // 64 + 1) * 64, np.uint8)
    padded[:n] = bits
    words = np.packbits(padded, bitorder="little").view(np.uint64)
    before = np.zeros(len(words), np.int64)
    np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
    return words, before


class WaveletMatrix:
    """rank(symbol, i): how often the symbol stands in the first i places."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        seq = seq.astype(np.int64)
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1
            self.bits.append(_packed(bit.astype(np.uint8)))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        words, before = self.bits[k]
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & low).astype(np.int64)

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank(symbol, lo) and rank(symbol, hi)."""
        base = np.zeros(len(symbol), np.int64)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b, c = self._ones(k, lo), self._ones(k, hi), self._ones(k, base)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
            base = np.where(one, self.zeros[k] + c, base - c)
        return lo - base, hi - base

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places i."""
        out = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            words, _ = self.bits[k]
            one = ((words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(k, i)
            out = (out << 1) | one
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return out


def suffix_order(seq: np.ndarray, order: int | None = None) -> np.ndarray:
    """Places of suffixes sorted by their first ``order`` symbols or wholly, by doubling prefixes."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    h = 1
    while True:
        key = rank * (n + 2)
        key[: n - h] += rank[h:] if h < n else 0
        sa = np.argsort(key, kind="stable")
        sorted_key = key[sa]
        fresh = np.ones(n, np.int64)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        number = np.cumsum(fresh)
        rank[sa] = number
        h *= 2
        if number[-1] == n or h >= (order or n):
            return sa


class FMIndex:
    """Backward search over ``seq`` (symbols 1..sigma-1; 0 ends the sequence), with every ``every``-th place kept.

    With a ``weight`` for each place, an occurrence counts as often as the weight of its first place says.
    """

    def __init__(self, seq: np.ndarray, sigma: int, order: int | None = None, every: int = 8, weight: np.ndarray | None = None):
        text = np.concatenate([seq, [0]]).astype(np.int64)
        self.n = len(text)
        sa = suffix_order(text, order)
        self.matrix = WaveletMatrix(text[sa - 1], sigma)
        self.below = np.zeros(sigma + 1, np.int64)  # symbols smaller than this one
        np.cumsum(np.bincount(text, minlength=sigma), out=self.below[1:])
        self.mass = None if weight is None else np.concatenate([[0], np.cumsum(np.concatenate([weight, [0]])[sa])])
        if order:
            return
        kept = sa % every == 0
        self.kept, self.kept_before = _packed(kept.astype(np.uint8))
        self.kept_places = sa[kept]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``symbol`` + pattern from the intervals of the patterns."""
        a, b = self.matrix.ranks(symbol, lo, hi)
        return self.below[symbol] + a, self.below[symbol] + b

    def search(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns ``flat[first:first + size]``; those with under ``least`` occurrences come out empty."""
        m = len(first)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.flatnonzero(size > 0)
        left = size.astype(np.int64).copy()
        while len(live):
            left[live] -= 1
            a, b = self.step(flat[first[live] + left[live]], lo[live], hi[live])
            lo[live], hi[live] = a, b
            dead = (b - a if self.mass is None else self.mass[b] - self.mass[a]) < least
            hi[live[dead]] = lo[live[dead]]
            live = live[~dead & (left[live] > 0)]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffixes ``rows``: walk back to the next kept place."""
        out = np.zeros(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            word = self.kept[at >> 6]
            here = ((word >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            hit = at[here]
            low = (np.uint64(1) << (hit & 63).astype(np.uint64)) - np.uint64(1)
            index = self.kept_before[hit >> 6] + np.bitwise_count(self.kept[hit >> 6] & low).astype(np.int64)
            out[live[here]] = self.kept_places[index] + steps
            live, at = live[~here], at[~here]
            if len(live):
                symbol = self.matrix.access(at)
                a, _ = self.matrix.ranks(symbol, at, at)
                at = self.below[symbol] + a
                steps += 1
        return out
