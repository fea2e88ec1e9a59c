"""A compressed FM-index over a sequence of symbols: backward search for many patterns at once, in numpy.

The Burrows-Wheeler transform is held in a wavelet tree whose levels are bit vectors of 64 bits a word with a count for each
word, so a rank is two look-ups and a population count. Suffixes are sorted by prefix doubling, as far as the longest pattern needs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, upto: int) -> np.ndarray:
    """The order of the suffixes of text by their first ``upto`` symbols at least."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    length = 1
    while length < upto:
        behind = np.full(n, -1, np.int64)
        behind[: max(n - length, 0)] = rank[length:]
        key = rank * (n + int(text.max(initial=0)) + 2) + behind + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        length *= 2
        if n and rank[order[-1]] == n - 1:
            break
    return order


class WaveletTree:
    """Ranks of symbols below 2 ** levels; the nodes of one level stand side by side."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1])
            self.zeros.append(self.n - int(bits.sum()))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        self.start = self._walk(np.zeros(1 << self.levels, np.int64), np.arange(1 << self.levels)) if self.levels <= 22 else None

    def _walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][block] + np.bitwise_count(self.words[k][block] & mask)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = self._walk(np.zeros(len(symbol), np.int64), symbol) if self.start is None else self.start[symbol]
        return self._walk(at, symbol) - start


class FMIndex:
    """Search for patterns of at most ``longest`` positive symbols in a text that ends in 0; ``owner`` is a number for each place of the text."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, longest: int):
        order = suffix_array(text, longest + 1)
        self.tree = WaveletTree(text[order - 1])  # the symbol before the first is the last
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))))
        # smallest owner in runs of 2 ** k places of the suffix array
        self.least = [owner[order]]
        while 2 << len(self.least) - 1 <= len(text):
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one symbol more in front."""
        at = self.first[symbol]
        return at + self.tree.rank(symbol, lo), at + self.tree.rank(symbol, hi)

    def smallest_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), self.least[0].dtype)
        for j in np.unique(k):
            rows = np.flatnonzero(k == j)
            out[rows] = np.minimum(self.least[j][lo[rows]], self.least[j][hi[rows] - (1 << j)])
        return out

    def matching(self, text: np.ndarray, ends: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, lo, hi) for each end in text: the longest run of symbols before it, ``upto`` at most, that stands in two places of the index or more, and its interval."""
        length = np.zeros(len(ends), np.int64)
        los, his = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.tree.n, np.int64)
        for k in range(upto):
            lo, hi = self.extend(lo, hi, text[ends[alive] - 1 - k])
            go = hi - lo > 1
            alive, lo, hi = alive[go], lo[go], hi[go]
            if not len(alive):
                break
            length[alive], los[alive], his[alive] = k + 1, lo, hi
        return length, los, his
