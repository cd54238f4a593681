"""Encoding and decoding with byte-pair merges, many words at a time.

The symbols of all words a batch has not met before lie in one flat numpy array.  A round looks every
adjacent pair up by binary search over the sorted pair keys, finds the lowest rank in each word and merges all
places of that pair at once; words without a mergeable pair leave the array.  Ids and decoded texts equal
those of the tokenizers library without added special tokens, truncation or padding.

Cases: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole;
special strings inside a text become their single id; equal texts have equal ids.  Results are columns, so
other columns of the frame, whatever their names, are untouched and an empty frame stays empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: Symbols of new words merged in one go.
FLAT = 2_000_000


def merge_words(v: vocab.Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of words laid end to end; ``word`` numbers the word of each symbol, ascending.

    Returns the merged ids and the number of the word of each, in order of words.
    """
    far = np.iinfo(np.int32).max
    symbols, word = symbols.astype(np.uint64), word.astype(np.int64)

    def rank_at(i: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each of the given places."""
        key = (symbols[i] << np.uint64(32)) | symbols[i + 1]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        return np.where((v.keys[at] == key) & (word[i] == word[i + 1]), v.ranks[at], far)

    done_ids, done_words = [symbols[:0]], [word[:0]]
    rank = np.full(len(symbols), far, np.int32)
    if len(symbols) > 1:
        rank[:-1] = rank_at(np.arange(len(symbols) - 1))
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
        keep = lowest != far
        done_ids.append(symbols[~keep])
        done_words.append(word[~keep])
        place = np.flatnonzero((rank == lowest) & keep)
        if not len(place):
            break
        # In a run of overlapping places (aaaa) every other one merges, counted from the left.
        new_run = np.r_[True, (place[1:] != place[:-1] + 1) | (word[place[1:]] != word[place[:-1]])]
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))
        place = place[(np.arange(len(place)) - run_start) % 2 == 0]
        symbols[place] = v.by_rank[rank[place]]
        keep[place + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[place] = True
        symbols, word, rank, changed = symbols[keep], word[keep], rank[keep], changed[keep]
        changed[:-1] |= changed[1:]  # the pair before a merged place has a new right side
        if len(symbols):
            rank[-1], changed[-1] = far, False
            again = np.flatnonzero(changed)
            rank[again] = rank_at(again)
    ids, words = np.concatenate(done_ids), np.concatenate(done_words)
    order = np.argsort(words, kind="stable")
    return ids[order].astype(np.uint32), words[order]


class Encoder:
    """Ids of whole texts; remembers the ids of words and of pieces between white space.

    Each task has its own, so what it has learnt goes with it and does not stay in the worker while other stages run there.
    """

    def __init__(self, path: str):
        self.v = vocab.load(path)
        self.split = regex.compile(vocab.WORD_PATTERN + r"|\n")
        self.pieces = regex.compile(r"\S+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")") if self.v.special else None
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Work out the ids of normal pieces not met before: one split over all of them, then merges of their new words."""
        tokens = self.split.findall("".join([p + "\n" for p in pieces]))
        if len(self.words) > vocab.MEMO // 2:
            self.words.clear()
        new = set(tokens) - self.words.keys()
        new.discard("\n")
        group, size = [], 0
        for w in new:
            group.append(w)
            size += len(w)
            if size >= FLAT:
                self.merge(group)
                group, size = [], 0
        if group:
            self.merge(group)
        out, of_piece, words = [], [], self.words
        for t in tokens:
            if t == "\n":
                out.append(b"".join(of_piece))
                of_piece = []
            else:
                of_piece.append(words[t])
        self.memo.update(zip(pieces, out, strict=True))

    def merge(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(w) for w in raw], np.int64)
        ends = np.cumsum(sizes) - 1
        symbols = self.v.first[flat]
        symbols[ends] = self.v.last[flat[ends]]
        ids, of_word = merge_words(self.v, symbols, np.repeat(np.arange(len(words)), sizes))
        bounds = (4 * np.searchsorted(of_word, np.arange(len(words) + 1))).tolist()
        packed = ids.astype("<u4").tobytes()
        self.words.update(zip(words, [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], strict=True))

    def pieces_of(self, text: str) -> list[str]:
        """Normal form of a text without special strings, split at white space."""
        if not text.isascii():
            # Upper-case sigma has one lower-case form here, wherever it stands.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split() also splits at the four ASCII separators, which the pattern's \s does not hold to be space.
        return text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.pieces.findall(text)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        memo = self.memo
        for lo in range(0, len(texts), 256):
            batch = [t or "" for t in texts[lo : lo + 256]]
            mixed = {i: self.special.split(t) for i, t in enumerate(batch) if any(s in t for s in self.v.special)}
            split = [[] if i in mixed else self.pieces_of(t) for i, t in enumerate(batch)]
            found = [list(map(memo.get, ps)) for ps in split]
            unknown = {p for ps, ids in zip(split, found, strict=True) if None in ids for p, b in zip(ps, ids, strict=True) if b is None}
            if unknown:
                if len(memo) + len(unknown) > vocab.MEMO:
                    memo.clear()
                self.learn(list(unknown))
            out = [b"".join([memo[p] if b is None else b for p, b in zip(ps, ids, strict=True)] if None in ids else ids) for ps, ids in zip(split, found, strict=True)]
            for i, parts in mixed.items():
                marks = [self.v.special[name].to_bytes(4, "little") for name in parts[1::2]]
                out[i] = b"".join([x for pair in zip(self.encode(parts[::2]), [*marks, b""], strict=True) for x in pair])
            yield from out

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, as this vocabulary's library does that has no decoder of its own."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(text: Column, path: str) -> Column:
    """Ids of each text, packed as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(path)
        for s in batches:
            yield pd.Series(list(e.encode([t if isinstance(t, str) else None for t in s])), dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of packed ids."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(path)
        for s in batches:
            yield pd.Series([e.decode(bytes(b)) if b is not None else "" for b in s], dtype=object)

    return text(ids)


def round_trip(text: Column, path: str) -> Column:
    """Ids and the text they decode to, in one pass over the texts: struct(ids binary, decoded string)."""

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = Encoder(path)
        for s in batches:
            ids = list(e.encode([t if isinstance(t, str) else None for t in s]))
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([e.decode(b) for b in ids], dtype=object)})

    return both(text)
