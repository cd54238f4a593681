"""N-gram language model in an Elias-Fano trie.

The first level holds the words of the training texts (sorted 64-bit hashes) with their counts, the second the
words that follow each word: per shard the sorted contexts, monotone pointers to their children, and the children as
one monotone sequence in which each context's words start from the context's own base.  All three are Elias-Fano
sequences; a child carries its smoothed log10 probability in 16 bits.  A query finds the context, takes its base and
searches the successor of base + word.  Levels are files in the shared folder, mapped into memory by each task; no
table passes through the driver, and both levels grow with the corpus: nothing is pruned.

Smoothing: P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), where the last term leaves a share for all unknown words together, and
P(w | v) = (c(v w) + m P(w)) / (c(v) + m).  The first word follows a begin mark.

Counts are summed inside each task over up to a million tokens, then sent in blocks of sorted keys by shard; words are
sharded by hash, pairs by a hash of the pair, so a frequent word is spread over all shards.

Cases: null and empty texts are the end mark alone; unknown words and contexts have the probabilities above; rows with a
null id are scored but not learnt from; with nothing to learn from every token is unknown (probability 1); texts of any
length are taken whole; other columns stay as they are, columns named like results are replaced; an empty frame gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from . import elias_fano as ef
from . import words

END = np.uint64(0x5BF0364A1C0DE5ED)
ALPHA = 0.1
STEP = 2048.0
BLOCK_TOKENS = 1 << 20
BLOCKS = "shard int, keys binary, counts binary"


def token_groups(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, token hashes (each text's words and its end mark), tokens per text."""
    for lo, hashes, counts in words.grouped(texts, lower=True):
        ends = np.cumsum(counts) + np.arange(len(counts))
        out = np.empty(len(hashes) + len(counts), np.uint64)
        is_end = np.zeros(len(out), bool)
        is_end[ends] = True
        out[is_end], out[~is_end] = END, hashes
        yield lo, out, counts + 1


def _spread(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes one after another: zero planes shrink to nothing in the shuffle."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _gather(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class _Blocks:
    """Sums counts of keys until a million have come, then gives them out by shard."""

    def __init__(self, shards: int, shard_of):
        self.shards, self.shard_of = shards, shard_of
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        self.parts.append(keys)
        self.size += len(keys)
        if self.size >= BLOCK_TOKENS:
            yield self.flush()

    def flush(self) -> pd.DataFrame:
        keys = np.concatenate([*self.parts, np.empty(0, np.uint64)])
        self.parts, self.size = [], 0
        keys, counts = np.unique(keys, return_counts=True)
        shard = self.shard_of(keys)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(keys) else [0]
        rows = [(int(shard[a]), _spread(keys[a:b]), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame(rows, columns=["shard", "keys", "counts"])


def _merged(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = [_gather(b) for b in blocks["keys"]]
    counts = [np.frombuffer(b, np.uint32).astype(np.uint64) for b in blocks["counts"]]
    return _sum(np.concatenate(keys), np.concatenate(counts))


@dataclass(frozen=True)
class Model:
    """Where the levels lie and the totals of the training texts."""

    folder: str
    word_bits: int
    bases: tuple[int, ...]
    pair_shards: int
    docs: int
    tokens: int
    smooth: float

    @property
    def kinds(self) -> int:
        return self.bases[-1]

    def word_shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.word_bits)).astype(np.int64)

    def pair_shard(self, pairs: np.ndarray) -> np.ndarray:
        return (words.mix(pairs) % np.uint64(self.pair_shards)).astype(np.int64)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of different hashes, -1 if unknown; ids follow the order of hashes."""
        out, shard = np.full(len(hashes), -1, np.int64), self.word_shard(hashes)
        for s in np.unique(shard):
            if self.bases[s + 1] > self.bases[s]:
                mine = np.flatnonzero(shard == s)
                found = ef.EliasFano(ef.read(self.folder, f"words-{s}")).find(hashes[mine] & np.uint64((1 << (64 - self.word_bits)) - 1))
                out[mine] = np.where(found >= 0, found + self.bases[s], -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of word ids: 0 for unknown ones, the number of texts for the begin mark."""
        out = np.where(ids == self.kinds, float(self.docs), 0.0)
        shard = np.searchsorted(np.array(self.bases[1:]), ids, side="right")
        known = (ids >= 0) & (ids < self.kinds)
        for s in np.unique(shard[known]):
            mine = np.flatnonzero(known & (shard == s))
            out[mine] = ef.read(self.folder, f"words-{s}")["counts"][ids[mine] - self.bases[s]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ALPHA) / (self.tokens + ALPHA * (self.kinds + 1))

    def pair_logs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(word | context) of different pairs of ids."""
        c_word, c_context = self.counts(word), self.counts(context)
        out = np.log10(self.smooth * self.unigram(c_word)) - np.log10(c_context + self.smooth)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        pairs = (context[known].astype(np.uint64) << np.uint64(32)) | word[known].astype(np.uint64)
        shard = self.pair_shard(pairs)
        for s in np.unique(shard):
            mine = known[shard == s]
            level = ef.read(self.folder, f"pairs-{s}")
            if not len(level["logs"]):
                continue
            at = ef.EliasFano({k: level[f"context_{k}"] for k in ("lows", "upper", "zeros", "shape")}).find(context[mine].astype(np.uint64))
            mine, at = mine[at >= 0], at[at >= 0]
            child = ef.EliasFano({k: level[f"child_{k}"] for k in ("lows", "upper", "zeros", "shape")})
            found = child.find(at.astype(np.uint64) * np.uint64(self.kinds) + word[mine].astype(np.uint64))
            out[mine[found >= 0]] = level["logs"][found[found >= 0]] / -STEP
        return out

    def ids_of(self, tokens: np.ndarray) -> np.ndarray:
        kinds, at = np.unique(tokens, return_inverse=True)
        return self.word_ids(kinds)[at]

    def pairs_of(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and word ids of each token."""
        word = self.ids_of(tokens)
        context = np.r_[np.int64(self.kinds), word[:-1]]
        context[np.cumsum(sizes) - sizes] = self.kinds
        return context, word


def train(texts: DataFrame, text: str = "text", smooth: float = 200.0) -> Model:
    """Build the trie of all texts of a frame in the shared folder."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text).alias("text"))
    docs, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    word_bits = max(3, (size // (32 << 20)).bit_length())
    folder = f"{shared_folder(spark)}/ngram-lm-{uuid.uuid4().hex}"
    empty = Model(folder, word_bits, (0,) * ((1 << word_bits) + 1), 1, docs, 0, smooth)

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = _Blocks(1 << word_bits, empty.word_shard)
        for b in batches:
            for _, tokens, _ in token_groups(list(b["text"])):
                yield from blocks.add(tokens)
        yield blocks.flush()

    def build_words(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(b)
        width = 64 - word_bits
        arrays = ef.build(keys & np.uint64((1 << width) - 1), 1 << width)
        ef.write(folder, f"words-{key[0]}", arrays | {"counts": counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64)})
        return pd.DataFrame({"shard": [key[0]], "n": [len(keys)], "total": [int(counts.sum())]})

    made = texts.mapInPandas(count_words, BLOCKS).groupBy("shard").applyInPandas(build_words, "shard int, n bigint, total bigint").collect()
    sizes = np.zeros(1 << word_bits, np.int64)
    for shard, n, _ in made:
        sizes[shard] = n
    tokens = sum(r["total"] for r in made)
    model = Model(folder, word_bits, tuple(np.r_[0, np.cumsum(sizes)].tolist()), max(8, tokens >> 21), docs, tokens, smooth)

    def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = _Blocks(model.pair_shards, model.pair_shard)
        for b in batches:
            for _, tokens, n in token_groups(list(b["text"])):
                context, word = model.pairs_of(tokens, n)
                yield from blocks.add((context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))
        yield blocks.flush()

    def build_pairs(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = _merged(b)
        context, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        at = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pairs)]))
        logs = np.log10((counts + smooth * model.unigram(model.counts(word))) / (model.counts(context) + smooth))
        level = {"logs": np.minimum(np.round(logs * -STEP), 65535).astype(np.uint16)}
        level |= {f"context_{k}": a for k, a in ef.build(context[starts], model.kinds + 1).items()}
        level |= {f"pointer_{k}": a for k, a in ef.build(starts, len(pairs) + 1).items()}
        level |= {f"child_{k}": a for k, a in ef.build(at.astype(np.uint64) * np.uint64(model.kinds) + word.astype(np.uint64), len(starts) * model.kinds).items()}
        ef.write(folder, f"pairs-{key[0]}", level)
        return pd.DataFrame({"shard": [key[0]]})

    built = {r["shard"] for r in texts.mapInPandas(count_pairs, BLOCKS).groupBy("shard").applyInPandas(build_pairs, "shard int").collect()}
    for shard in set(range(model.pair_shards)) - built:
        ef.write(folder, f"pairs-{shard}", {"logs": np.empty(0, np.uint16)})
    return model


def score(text: Column, model: Model) -> Column:
    """struct(n_tokens, n_known, base_score, score) of each text."""

    @F.pandas_udf("n_tokens bigint, n_known bigint, base_score double, score double")
    def scored(s: pd.Series) -> pd.DataFrame:
        out = [np.empty((0, 4))]
        for _, tokens, sizes in token_groups([t if isinstance(t, str) else None for t in s]):
            starts = np.cumsum(sizes) - sizes
            if not model.tokens:
                out.append(np.stack([sizes, 0 * sizes, 0.0 * sizes, 0.0 * sizes], axis=1))
                continue
            context, word = model.pairs_of(tokens, sizes)
            kinds, at = np.unique(word, return_inverse=True)
            base = np.log10(model.unigram(model.counts(kinds)))[at]
            pairs, which = np.unique((context + 1).astype(np.uint64) << np.uint64(32) | (word + 1).astype(np.uint64), return_inverse=True)
            logs = model.pair_logs((pairs >> np.uint64(32)).astype(np.int64) - 1, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1)[which]
            sums = [np.add.reduceat(x, starts) for x in ((word >= 0).astype(np.int64), base, logs)]
            out.append(np.stack([sizes, *sums], axis=1))
        rows = np.concatenate(out)
        return pd.DataFrame({"n_tokens": rows[:, 0].astype(np.int64), "n_known": rows[:, 1].astype(np.int64), "base_score": rows[:, 2], "score": rows[:, 3]})

    return scored(text)
