"""Numbers of byte-pair tokens without their ids.

A word's symbols form a linked list; a heap gives the lowest-rank adjacent pair (the leftmost of equal rank),
which is merged and its new neighbours are pushed.  Tokens are the initial symbols less the merges.  Counts of
pieces met before come from a bounded table of the worker.

Cases: null and empty texts have no tokens; texts and words of any length are counted whole in n log n; special
strings inside a text count once, as the library does by default.  The result is a column: other columns,
whatever their names, are untouched and an empty frame stays empty.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


class Counter:
    """Token counts of texts; remembers the counts of words and of pieces between white space."""

    def __init__(self, path: str):
        v = vocab.load(path)
        self.first = v.first.tolist()
        self.pairs = dict(zip(v.keys.tolist(), v.ranks.tolist(), strict=True))
        self.by_rank = v.by_rank.tolist()
        self.split = regex.compile(vocab.BYTE_PATTERN)
        self.pieces = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.special = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None
        self.memo: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word."""
        sym = [self.first[b] for b in word.encode()]
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        rank_of, merges = self.pairs.get, 0
        heap = []
        for i in range(n - 1):
            rank = rank_of(sym[i] << 32 | sym[i + 1])
            if rank is not None:
                heap.append((rank, i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two was merged meanwhile
            merges += 1
            sym[i], sym[j] = self.by_rank[rank], -1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                rank = rank_of(sym[i] << 32 | sym[k])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, sym[i], sym[k]))
            k = prev[i]
            if k >= 0:
                rank = rank_of(sym[k] << 32 | sym[i])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, sym[k], sym[i]))
        return n - merges

    def learn(self, pieces: set[str]) -> None:
        """Work out the counts of pieces not met before; the split runs once over all of them."""
        if len(self.memo) > vocab.MEMO:
            self.memo.clear()
        if len(self.words) > vocab.MEMO:
            self.words.clear()
        words = self.words
        solid = []
        for p in pieces:
            if p.isspace():
                self.memo[p] = self.word(p)
            else:
                solid.append(p)
        at = iter(solid)
        n = 0
        for t in self.split.findall("".join([p + "\n" for p in solid])):
            if t == "\n":  # no word of a piece is a line break
                self.memo[next(at)] = n
                n = 0
            else:
                c = words.get(t)
                if c is None:
                    c = words[t] = self.word(t)
                n += c

    def plain(self, text: str) -> int:
        pieces = self.pieces.findall(text)
        counts = list(map(self.memo.get, pieces))
        if None in counts:
            self.learn({p for p, n in zip(pieces, counts, strict=True) if n is None})
            counts = [self.memo[p] if n is None else n for p, n in zip(pieces, counts, strict=True)]
        return sum(counts)

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(text: Column, path: str) -> Column:
    """Number of tokens of each text (long)."""

    @F.pandas_udf("long")
    def n(s: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series([c.count(t) if isinstance(t, str) else 0 for t in s], dtype="int64")

    return n(text)
