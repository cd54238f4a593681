"""Exact inner-product search over integer vectors, score at a time.

Vectors are dealt into blocks of bounded size.  A block is an impact-ordered index: per dimension the vectors
sorted by value.  For a query a posting's impact is what it adds over the least value of its dimension; impacts are
quantised into levels and the segments of all dimensions are processed by falling level.  Before a level ends, each
vector's score lies between what it has gathered and that plus the level's bound for each dimension still to come.
Processing stops only when these bounds prove that few vectors can be among the best, or when nothing is left; the
possible members are then rescored exactly.  The best of each block meet in one window per query that is limited
before it is shuffled.

Queries meet every block in chunks of bounded size, so neither side is broadcast or held whole by a task.

Cases: components and scores saturate at the limits of 64-bit integers; vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; shorter
vectors count as ending in zeros; equal scores go to the smaller id; a repeated id is another candidate, a query's own id
is none; fewer candidates than ``k`` give fewer rows; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .negatives import matrix, products, quantised

BLOCK = 8192
CHUNK = 4096
LEVELS = 8
#: Above every sum of impacts: a vector's seen postings are counted in these units, beside its impacts, in one exact sum.
_SEEN = 1 << 44
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null unless all components are finite."""
    return quantised(vector, scale)


class Block:
    """Impact-ordered index of one block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.int64)
        by_value = np.argsort(self.rows, axis=0, kind="stable")
        self.postings = np.ascontiguousarray(by_value.T).astype(np.intp)
        self.values = np.ascontiguousarray(np.take_along_axis(self.rows, by_value, axis=0).T)
        #: What a posting has over the least value of its dimension, and what it lacks to the greatest.
        self.over = (self.values - self.values[:, :1]).astype(np.float64)
        self.under = (self.values[:, -1:] - self.values).astype(np.float64)
        self.spread = float(np.abs(self.rows.astype(np.float64)).max(initial=0)) * 2

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the ``k`` best; a proven superset."""
        n = len(self.ids)
        # Products too large for exact sums of impacts are all scored.
        if n <= 4 * k or not len(q) or self.spread * float(np.abs(q).sum(dtype=np.float64)) >= _SEEN or len(q) * _SEEN >= 2**53:
            return np.arange(n)
        low, high = self.values[:, 0], self.values[:, -1]
        width = np.abs(q) * (high - low)
        used = np.flatnonzero(width)
        if not len(used):
            return np.arange(n)
        step = -(-int(width.max()) // LEVELS)
        bounds = np.arange(LEVELS + 1) * step
        cuts = []  # per dimension the ends of its segments, in the order of its impacts
        for d in used:
            part = -(-bounds // abs(q[d]))
            if q[d] > 0:
                cuts.append(n - np.searchsorted(self.values[d], low[d] + part, side="left"))
            else:
                cuts.append(np.searchsorted(self.values[d], high[d] - part, side="right"))
        ends = np.array(cuts)
        ends[:, LEVELS] = 0  # the greatest impacts belong to the top level, also where they equal its bound
        both, weight = np.zeros(n), np.abs(q[used]).astype(np.float64).tolist()
        few = max(8 * k, n // 64)
        for level in range(LEVELS - 1, -1, -1):
            size = int((ends[:, level] - ends[:, level + 1]).sum())
            ids, impacts, at = np.empty(size, np.intp), np.empty(size), 0
            for d, a, b, w in zip(used.tolist(), ends[:, level + 1].tolist(), ends[:, level].tolist(), weight, strict=True):
                if a == b:
                    continue
                part = slice(n - b, n - a) if q[d] > 0 else slice(a, b)
                ids[at : at + b - a] = self.postings[d, part]
                np.multiply((self.over if q[d] > 0 else self.under)[d, part], w, out=impacts[at : at + b - a])
                at += b - a
            impacts += float(_SEEN)
            both += np.bincount(ids, impacts, n)
            seen = np.floor(both / _SEEN)
            gathered = both - seen * _SEEN
            least = np.partition(gathered, n - k)[n - k]
            possible = np.flatnonzero(gathered + (len(used) - seen) * bounds[level] >= least)
            if len(possible) <= few:
                break
        return possible

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.candidates(q, k + int(np.count_nonzero(self.ids == query_id)))
        at = at[self.ids[at] != query_id]
        scores = products(self.rows[at], q)
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][order], scores[order]


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "vector") -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries``: query_id, rank (from 1), vec_id, score."""
    stored = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").distinct()
    n_blocks = max(1, -(-stored.count() // BLOCK))
    n_chunks = max(1, -(-asked.count() // CHUNK))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = stored.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int")).withColumn("chunk", every(n_chunks))
    right = asked.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_chunks)).cast("int")).withColumn("block", every(n_blocks))

    def meet(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(block) and len(chunk):
            dims = max(block["v"].map(len).max(), chunk["v"].map(len).max())
            index = Block(block["id"].to_numpy(), matrix(list(block["v"]), dims))
            for query_id, q in zip(chunk["id"], matrix(list(chunk["v"]), dims), strict=True):
                ids, scores = index.best(query_id, q, k)
                out["query_id"].extend([query_id] * len(ids))
                out["vec_id"].extend(ids)
                out["score"].extend(scores)
        return pd.DataFrame(out, dtype="int64")

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(meet, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
