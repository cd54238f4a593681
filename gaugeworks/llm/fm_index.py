"""FM-index of a shard: Burrows-Wheeler transform in a wavelet matrix, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


def order_to(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by the first ``depth`` symbols at least (prefix doubling); enough to search patterns of that length.

    Places and ranks take half a word where they fit, and one array of whole words is held beside them.
    """
    n = len(symbols)
    kind = np.int32 if n < 1 << 31 else np.int64
    rank = np.unique(symbols, return_inverse=True)[1].astype(kind)
    order, h = np.argsort(rank, kind="stable").astype(kind), 1
    while h < depth:
        key = rank.astype(np.int64)
        key *= n + 2
        key[: n - h] += rank[h:]
        key[: n - h] += 1
        order = np.argsort(key, kind="stable").astype(kind)
        key = key[order]
        rank[order[0]] = 0
        rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=kind)
        h *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol at any place; one packed bit vector with counts per 64 bits for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.bits = max(1, int(kinds - 1).bit_length())
        self.levels = []
        seq = symbols.astype(np.int32 if kinds < 1 << 31 else np.int64)
        for level in range(self.bits - 1, -1, -1):
            flags = (seq >> level & 1).astype(np.uint8)
            packed = np.packbits(np.r_[flags, np.zeros(-len(flags) % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
            ones = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
            self.levels.append((level, packed, np.r_[0, ones[:-1]], len(seq) - int(flags.sum())))
            seq = np.r_[seq[flags == 0], seq[flags == 1]]
        self.first = self._walk(np.arange(kinds), np.zeros(kinds, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, ones, zeros in self.levels:
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            one = ones[word] + np.bitwise_count(packed[word] & below)
            at = np.where(symbols >> level & 1, zeros + one, at - one)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbols, at) - self.first[symbols]


class FMIndex:
    """Index of symbols 1.., with 0 between segments; patterns up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, kinds: int, depth: int):
        self.order = order_to(symbols, depth)
        self.bwt = WaveletMatrix(symbols[self.order - 1], kinds)
        self.before = np.r_[0, np.cumsum(np.bincount(symbols, minlength=kinds))]

    def search(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns that begin at places of a symbol stream, each read backwards."""
        last = symbols[starts + length - 1]
        lo, hi = self.before[last], self.before[last + 1]
        for k in range(length - 2, -1, -1):
            c = symbols[starts + k]
            lo = self.before[c] + self.bwt.rank(c, lo)
            hi = self.before[c] + self.bwt.rank(c, hi)
        return lo, hi
