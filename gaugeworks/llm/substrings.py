"""Removal of word passages that an earlier document holds, with an FM-index per shard.

A window of ``length`` words belongs to the shard of its anchor, the least hash of its word k-grams, so equal windows meet in
one shard and windows in a row that share their anchor travel as one segment of words.  First, blocks of sorted
anchors find those that two or more documents hold (copies inside a block count there, one of them goes on); only
segments of such anchors are read out: their places, and packed by shard their words with the smallest and largest document,
equal segments of a block once.  Each shard builds an FM-index over its different segments (words as symbols, wavelet matrix over the transform), streams the windows of its segments
through backward search, and takes the smallest document over each suffix range.  Segments of anchors
in more than ``HOT`` documents are split into single windows, dealt by their own words, so no anchor fills a shard.
Results go back to the documents as spans of words.  Words are compared as they are; hashes only deal out work.

Cases: null and empty texts have no words; a window counts once however often it stands in a document, repeats inside one
document or between rows of the same id remove nothing; rows with a null id neither lose words nor make others lose any;
texts and words of any length are taken whole; other columns stay, columns named ``spans`` are replaced; an empty frame
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import words
from .fm_index import FMIndex
from .jaccard import _ODD
from .ngram_lm import _gather, _spread
from .scratch import release

GRAM = 6
#: Documents from which on an anchor's segments are split into windows.
HOT = 20_000
BLOCK = 1 << 19
#: Bytes of different segments that a task holds before it packs them, and of texts hashed at a time.
HELD = 1 << 24
PIECE = 1 << 20
SHARD_SEGMENTS = 100_000
SEARCH = 1 << 17


def anchored(texts: list[str | None], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of each text: number of the text, anchor, first window and last window of each segment."""
    gram = min(GRAM, length)
    wide = length - gram + 1
    for lo, hashes, counts in words.grouped(texts, lower=False, size=PIECE):
        n = len(hashes) - length + 1
        if n <= 0:
            continue
        with np.errstate(over="ignore"):
            value = np.zeros(len(hashes) - gram + 1, np.uint64)
            for k in range(gram):
                value += hashes[k : k + len(value)] * _ODD[k]
            value = words.mix(value)
        place, span = np.arange(len(value)), 1
        while span < wide:  # least value of growing ranges, the leftmost of equal ones
            step = min(span, wide - span)
            right = value[step:] < value[:-step]
            place, value = np.where(right, place[step:], place[:-step]), np.where(right, value[step:], value[:-step])
            span += step
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)[:n]
        valid = np.arange(n) + length <= ends[owner]
        new = np.r_[True, (place[1:n] != place[: n - 1]) | (owner[1:] != owner[:-1])] & valid
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        number = np.cumsum(new) - 1
        last = starts + np.bincount(number[valid], minlength=len(starts)) - 1
        base = (ends - counts)[owner[starts]]
        cuts = np.flatnonzero(np.r_[True, owner[starts][1:] != owner[starts][:-1], True])
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield lo + int(owner[starts[a]]), value[starts[a:b]], (starts - base)[a:b], (last - base)[a:b]


def _texts(b: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in b["text"]]


def shared_anchors(docs: DataFrame, length: int, shards: int) -> DataFrame:
    """Anchors of each document that another document holds too, one row each."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ids, held = [], [], 0

        def block() -> pd.DataFrame:
            k, d = np.concatenate([*keys, np.empty(0, np.uint64)]), np.concatenate([*ids, np.empty(0, np.int64)])
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])][: len(k)]
            k, d = k[new], d[new]
            first = np.r_[True, k[1:] != k[:-1]][: len(k)]
            several = ~first
            several[:-1] |= ~first[1:]
            out = [(int(doc % shards), None, None, int(doc), part) for doc, part in _by_doc(d[several], k[several])]
            k, d = k[first], d[first]
            shard = (k % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            k, d, shard = k[order], d[order], shard[order]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(k) else [0]
            out += [(int(shard[a]), _spread(k[a:b]), d[a:b].tobytes(), None, None) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pd.DataFrame(out, columns=["shard", "keys", "ids", "doc", "anchors"]).astype({"doc": "Int64"})

        for batch in batches:
            names = batch["doc"].to_numpy()
            for i, anchor, _, _ in anchored(_texts(batch), length):
                anchor = np.unique(anchor)
                keys.append(anchor)
                ids.append(np.full(len(anchor), names[i], np.int64))
                held += len(anchor)
                if held >= BLOCK:
                    yield block()
                    keys, ids, held = [], [], 0
        yield block()

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        done, rows = b[b["anchors"].notna()], b[b["keys"].notna()]
        lists = [np.frombuffer(x, np.uint64) for x in done["anchors"]]
        held, anchors = [np.repeat(done["doc"].to_numpy(np.int64), [len(x) for x in lists])], lists
        if len(rows):
            k = np.concatenate([_gather(x) for x in rows["keys"]])
            d = np.concatenate([np.frombuffer(x, np.int64) for x in rows["ids"]])
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[starts, len(k)])
            shared = np.repeat(d[starts] != d[np.r_[starts[1:], len(k)] - 1], sizes)
            held.append(d[shared])
            anchors = [*lists, k[shared]]
        return pd.DataFrame({"doc": np.concatenate(held), "anchor": np.concatenate([*anchors, np.empty(0, np.uint64)]).astype(np.int64)})

    found = docs.mapInPandas(blocks, "shard int, keys binary, ids binary, doc bigint, anchors binary")
    return found.groupBy("shard").applyInPandas(meet, "doc bigint, anchor bigint")


def _by_doc(docs: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(docs, kind="stable")
    docs, anchors = docs[order], anchors[order]
    cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True]) if len(docs) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(docs[a]), anchors[a:b].tobytes()


def segments(docs: DataFrame, lists: DataFrame, hot, length: int, shards: int) -> DataFrame:
    """Segments of the wanted anchors of each document, in two kinds of rows.

    Places: doc, t (hash of the text), at (first word of each segment), ka and kb (hash of its words).  Words, a row for each
    shard and block of segments: shard, keys (the same hashes), words (packed, ``raw`` bytes; the words of a segment are joined
    by one space), low and high (smallest and largest document of the block); equal segments of a block are held once.
    """
    columns = ["doc", "t", "at", "ka", "kb", "shard", "keys", "words", "raw", "low", "high"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"doc": "Int64", "t": "Int64", "shard": "Int64", "raw": "Int64"})

    def packed(held: dict[bytes, list]) -> list[tuple]:
        kinds = list(held)
        deal, low, high = (np.array([v[k] for v in held.values()], kind) for k, kind in ((1, np.uint64), (2, np.int64), (3, np.int64)))
        shard = (deal % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((deal, shard))  # segments of an anchor side by side pack well
        cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1], True])
        out = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            mine = order[lo:hi]
            chosen = [kinds[k] for k in mine.tolist()]
            raw = b"\n".join(chosen)
            keys = b"".join(held[w][0] for w in chosen)
            out.append((None, None, None, None, None, int(shard[mine[0]]), keys, pa.compress(raw, codec="zstd", asbytes=True), len(raw), low[mine].tobytes(), high[mine].tobytes()))
        return out

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, often = {}, 0, hot.value
        for batch in batches:
            texts, out = _texts(batch), []
            names, marks, lists = batch["doc"].tolist(), batch["t"].tolist(), batch["wanted"].tolist()
            for i, anchor, first, last in anchored(texts, length):
                wanted = np.asarray(lists[i], np.int64).astype(np.uint64)
                mine = np.flatnonzero(np.isin(anchor, wanted))
                if not len(mine):
                    continue
                parts, doc = words.utf8(texts[i]).split(), names[i]
                ranges = []
                for value, busy, a, z in zip(anchor[mine].tolist(), np.isin(anchor[mine], often).tolist(), first[mine].tolist(), last[mine].tolist(), strict=True):
                    ranges += [(None, k, k) for k in range(a, z + 1)] if busy else [(value, a, z)]
                keys = []
                for value, a, z in ranges:
                    w = b" ".join(parts[a : z + length])
                    known = held.get(w)
                    if known is None:
                        key = hashlib.blake2b(w, digest_size=16).digest()
                        known = held[w] = [key, int.from_bytes(key[:8], "little") if value is None else value, doc, doc]
                        size += len(w)
                    else:
                        known[2], known[3] = min(known[2], doc), max(known[3], doc)
                    keys.append(known[0])
                both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                out.append((doc, marks[i], np.array([r[1] for r in ranges], np.int32), both[:, 0], both[:, 1], None, None, None, None, None, None))
                if size >= HELD:
                    out += packed(held)
                    held, size = {}, 0
                if len(out) >= 500:
                    yield frame(out)
                    out = []
            yield frame(out)
        if held:
            yield frame(packed(held))

    kinds = "doc bigint, t bigint, at array<int>, ka array<bigint>, kb array<bigint>, shard bigint, keys binary, words binary, raw bigint, low binary, high binary"
    return docs.join(lists, "doc").mapInPandas(read, kinds)


def _unpacked(rows: pd.DataFrame) -> pd.DataFrame:
    """Different segments of packed rows: words, ka, kb, low, high."""
    parts = [pa.decompress(w, decompressed_size=int(n), codec="zstd", asbytes=True).split(b"\n") for w, n in zip(rows["words"], rows["raw"], strict=True)]
    parts = [w for p in parts for w in p]
    low, high = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("low", "high"))
    keys = np.frombuffer(b"".join(rows["keys"]), np.int64).reshape(-1, 2)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    return pd.DataFrame(
        {
            "words": [parts[k] for k in order[starts].tolist()],
            "ka": keys[starts, 0],
            "kb": keys[starts, 1],
            "low": np.minimum.reduceat(low[order], starts),
            "high": np.maximum.reduceat(high[order], starts),
        }
    )


def first_docs(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Smallest document of each window of each segment, by an FM-index over the segments (columns words, ka, kb, low)."""
    segments = rows["words"].tolist()
    sizes = np.array([w.count(b" ") + 1 for w in segments])
    # Words are numbered as they are split (any order of symbols serves), so only different ones are held.
    kinds: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    ids = np.fromiter(map(kinds.__getitem__, chain.from_iterable(w.split(b" ") for w in segments)), np.int32, int(sizes.sum()))
    n_kinds = len(kinds) + 1
    del kinds
    starts = np.cumsum(sizes + 1) - sizes  # one separator before each segment
    stream = np.zeros(len(ids) + len(segments) + 1, np.int32)
    inside = np.ones(len(stream), bool)
    inside[starts - 1] = inside[-1] = False
    stream[inside] = ids
    del ids
    index = FMIndex(stream, n_kinds, length)
    number = np.cumsum(~inside, dtype=np.int32) - 1
    low = np.append(rows["low"].to_numpy(np.int64), np.iinfo(np.int64).max)
    by_suffix = np.append(low[number[index.order]], np.iinfo(np.int64).max)  # ranges may end at the last suffix
    del number
    n_windows = sizes - length + 1
    windows = np.repeat(starts - np.r_[0, np.cumsum(n_windows)[:-1]], n_windows) + np.arange(int(n_windows.sum()))
    least = np.empty(len(windows), np.int64)
    for a in range(0, len(windows), SEARCH):
        lo, hi = index.search(stream, windows[a : a + SEARCH], length)
        ranges, at = np.unique(lo << 32 | hi, return_inverse=True)
        edges = np.stack([ranges >> 32, ranges & 0xFFFFFFFF], axis=1).ravel()
        least[a : a + SEARCH] = np.minimum.reduceat(by_suffix, edges)[::2][at]
    ends = np.cumsum(n_windows)
    return pd.DataFrame({"ka": rows["ka"].to_numpy(), "kb": rows["kb"].to_numpy(), "firsts": [least[e - n : e] for e, n in zip(ends, n_windows, strict=True)]})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 13) -> DataFrame:
    """Spans of words that windows of smaller documents cover: _ss_doc, _ss_t (hash of the text), spans (array of from, to)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("t")).where("doc IS NOT NULL AND text IS NOT NULL")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    anchors = shared_anchors(docs.select("doc", "text"), length, max(8, total // (16 << 20)))
    lists = cut(anchors.groupBy("doc").agg(F.collect_list("anchor").alias("wanted")))
    release(spark)
    # An anchor is hot in more than HOT documents, so what is sent to the tasks is a small part of the table.
    often = lists.select(F.explode(F.array_distinct("wanted")).alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = spark.sparkContext.broadcast(often.select("anchor").toPandas()["anchor"].to_numpy(np.int64).astype(np.uint64))
    n_segments = lists.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    found = cut(segments(docs, lists, hot, length, max(8, n_segments // SHARD_SEGMENTS)))
    release(spark)

    def search(b: pd.DataFrame) -> pd.DataFrame:
        rows = _unpacked(b)
        out = first_docs(rows, length)
        # A window whose segment one document alone holds, which is also its first, removes nothing.
        useful = [bool((f < h).any()) for f, h in zip(out["firsts"], rows["high"], strict=True)]
        return out[useful]

    packed = found.where("shard IS NOT NULL").select("shard", "keys", "words", "raw", "low", "high")
    firsts = cut(packed.groupBy("shard").applyInPandas(search, "ka bigint, kb bigint, firsts array<bigint>"))
    release(spark)

    places = found.where("doc IS NOT NULL").select("doc", "t", F.explode(F.arrays_zip("at", "ka", "kb")).alias("s")).select("doc", "t", "s.*")
    gone = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc"), F.col("at") + i)), lambda x: x.isNotNull())
    joined = places.join(firsts, ["ka", "kb"]).select("doc", "t", gone.alias("gone")).where(F.size("gone") > 0)
    starts = cut(joined.groupBy("doc", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("starts")))
    release(spark)

    @F.pandas_udf("array<struct<from:int,to:int>>")
    def spans(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            x = np.asarray(x)
            new = np.flatnonzero(np.r_[True, np.diff(x) > length])
            ends = np.r_[x[new[1:] - 1], x[-1]] + length
            out.append([{"from": int(a), "to": int(z)} for a, z in zip(x[new], ends, strict=True)])
        return pd.Series(out, dtype=object)

    return starts.select(F.col("doc").alias("_ss_doc"), F.col("t").alias("_ss_t"), spans("starts").alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their spans (null where nothing goes)."""
    left = docs.drop("spans").withColumn("_ss_u", F.xxhash64(text))
    return left.join(spans, (F.col(id_col) == F.col("_ss_doc")) & (F.col("_ss_u") == F.col("_ss_t")), "left").drop("_ss_doc", "_ss_t", "_ss_u")


def kept(text: Column, spans: Column) -> Column:
    """struct(n_words, n_removed, kept): the words outside the spans, joined by one space."""

    @F.pandas_udf("n_words bigint, n_removed bigint, kept string")
    def left_over(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(texts, ranges, strict=True):
            w = words.utf8(t if isinstance(t, str) else None).split()
            n, at, out = len(w), 0, []
            for x in r if r is not None else ():
                out += w[at : x["from"]]
                at = x["to"]
            out += w[at:]
            rows.append((n, n - len(out), b" ".join(out).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"]).astype({"n_words": "int64", "n_removed": "int64"})

    return left_over(text, spans)
