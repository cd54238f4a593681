"""Hard negatives from integer vectors: one-bit codes after a rotation, with a proven interval around every estimate.

Each vector is turned by a fixed orthogonal map and kept as the signs of its coordinates (the code), the length of its
projection on the code's direction (the alignment) and the length of what is left (the residual).  An anchor's product
with a code is counted from bit planes of the turned anchor, within a known rounding error.  Product with the vector =
alignment times product with the code, plus the product of two remainders, which by Cauchy-Schwarz is at most the
product of their lengths.  So every row has an interval that surely holds its exact score, and only rows whose interval
reaches the window that is asked for are scored, in whole numbers.

Vectors lie in blocks of bounded size, indexed once and kept as a table; anchors meet every block in parts of bounded
size.  The best rows of each block meet in one window per anchor that is limited before it is shuffled.  First pass:
each anchor's positives.  Second pass: for each positive the negatives within its window of scores.

Cases: rows without id, label or vector, or with a null or non-finite component, take no part; shorter vectors count as
ending in zeros; ``floor(scale * x)`` and scores saturate at the limits of 64-bit integers; rows equal in id, label and vector
count once; rows that share an id only are rows of their own, but never positives or negatives of an anchor of that id;
equal scores go to the smaller id; anchors without positives, and positives without negatives, give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

BLOCK = 8192
PART = 8192
#: Bit planes a turned anchor is rounded to; they set the work, the rounding error is part of the interval.
PLANES = 8
#: Relative allowance for floating-point rounding of the interval's ends, far above what the few hundred steps can add.
SLACK = 1e-9
_LONG = 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null unless all components are finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale)))


def matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def rotated(rows: np.ndarray) -> np.ndarray:
    """Rows under a fixed orthogonal map: twice random signs and a Hadamard transform, on a power of two of 64 or more."""
    dims = max(64, 1 << (rows.shape[1] - 1).bit_length() if rows.shape[1] else 0)
    x = np.zeros((len(rows), dims))
    x[:, : rows.shape[1]] = rows
    signs = np.random.default_rng(12).integers(0, 2, (2, dims)) * 2.0 - 1
    for s in signs:
        x *= s
        h = 1
        while h < dims:
            pairs = x.reshape(len(x), -1, 2, h)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), dims)
            h *= 2
        x /= np.sqrt(dims)
    return x


class Codes:
    """One-bit codes of some vectors, and the interval of each one's product with an anchor."""

    def __init__(self, bits: np.ndarray, align: np.ndarray, norm: np.ndarray):
        self.bits, self.align, self.norm = bits, align, norm
        self.residual = np.sqrt(np.maximum(norm**2 * (1 + SLACK) - align**2, 0))
        self.ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    @classmethod
    def of(cls, rows: np.ndarray) -> Codes:
        x = rotated(rows)
        bits = np.packbits(x > 0, axis=1, bitorder="little").view(np.uint64)
        return cls(bits, np.abs(x).sum(axis=1) / np.sqrt(x.shape[1]), np.sqrt((x * x).sum(axis=1)))

    def interval(self, turned: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the products with a turned anchor, for a slice of the vectors."""
        root = np.sqrt(len(turned))
        low, high = turned.min(), turned.max()
        step = (high - low) / (2**PLANES - 1) or 1.0
        units = np.rint((turned - low) / step).astype(np.int64)
        wrong = np.abs(turned - (low + step * units)).sum() / root
        bits, counted = self.bits[at], np.zeros(len(self.align[at]), np.int64)
        for k in range(PLANES):
            plane = np.packbits((units >> k & 1).astype(bool), bitorder="little").view(np.uint64)
            counted += np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64) << k
        on_code = (2 * (low * self.ones[at] + step * counted) - turned.sum()) / root
        length = np.sqrt(turned @ turned)
        beside = np.sqrt(np.maximum(length**2 - np.maximum(np.abs(on_code) - wrong, 0) ** 2, 0))
        room = self.align[at] * wrong + self.residual[at] * beside + SLACK * length * self.norm[at]
        middle = self.align[at] * on_code
        return middle - room, middle + room


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products in whole numbers, saturated at 64 bits."""
    if not len(rows):
        return np.zeros(0, np.int64)
    # With every partial sum below the mantissa's range, floating point computes whole numbers exactly.
    bound = float(np.abs(rows.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).sum())
    if bound < 2**24:
        return (rows.astype(np.float32) @ q.astype(np.float32)).astype(np.int64)
    if bound < 2**53:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return rows.astype(np.int64) @ q
    exact = rows.astype(object) @ q.astype(object)
    return np.array([min(max(int(s), -_LONG), _LONG) for s in exact], np.int64)  # the least can be negated


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class Block:
    """Vectors of one block, sorted by label and id."""

    def __init__(self, ids: np.ndarray, labels: list[str], rows: np.ndarray, codes: Codes):
        self.ids, self.rows, self.codes = ids, rows, codes
        names = np.array(labels, object)
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        ends = np.r_[starts[1:], len(names)]
        self.span = {names[a]: slice(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}

    def _scored(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return products(self.rows[at], q)

    def positives(self, own: int, label: str, q: np.ndarray, turned: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows of the label, without the anchor's own id."""
        at = self.span.get(label)
        if at is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower, upper = self.codes.interval(turned, at)
        other = self.ids[at] != own
        found = at.start + np.flatnonzero(other & (upper >= _kth(lower[other], k)))
        scores = self._scored(found, q)
        order = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][order], scores[order]

    def negatives(self, own: int, label: str, q: np.ndarray, turned: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores the best ``k`` rows of other labels inside it."""
        lower, upper = self.codes.interval(turned, slice(None))
        other = self.ids != own
        if label in self.span:
            other[self.span[label]] = False
        masks = []
        for low, high in windows:
            sure = lower[other & (lower >= low) & (upper <= high)]
            masks.append(other & (upper >= max(low, _kth(sure, k))) & (lower <= high) & (low <= high))
        found = np.flatnonzero(np.logical_or.reduce(masks))
        scores = self._scored(found, q)
        order = np.lexsort((self.ids[found], -scores))
        found, scores = found[order], scores[order]
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))[:k]
            out.append((self.ids[found[inside]], scores[inside]))
        return out


def indexed(rows: DataFrame, n_blocks: int) -> DataFrame:
    """One row per block: ids, labels, values, codes, alignments and lengths."""

    def build(b: pd.DataFrame) -> pd.DataFrame:
        keys = list(zip(b["label"], b["id"].tolist(), (np.asarray(v, np.int64).tobytes() for v in b["v"]), strict=True))
        order = sorted({k: i for i, k in enumerate(keys)}.values(), key=lambda i: keys[i])
        dims = max(len(v) for v in b["v"])
        values = matrix([b["v"].iloc[i] for i in order], dims)
        codes = Codes.of(values)
        for kind in (np.int16, np.int32, np.int64):
            if np.iinfo(kind).min <= values.min(initial=0) and values.max(initial=0) <= np.iinfo(kind).max:
                break
        return pd.DataFrame(
            {
                "block": [b["block"].iloc[0]],
                "ids": [b["id"].to_numpy(np.int64)[order].tobytes()],
                "labels": [[b["label"].iloc[i] for i in order]],
                "width": [np.dtype(kind).itemsize],
                "dims": [dims],
                "v": [values.astype(kind).tobytes()],
                "bits": [codes.bits.tobytes()],
                "align": [codes.align.tobytes()],
                "norm": [codes.norm.tobytes()],
            }
        )

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_blocks)).cast("int"))
    schema = "block int, ids binary, labels array<string>, width int, dims int, v binary, bits binary, align binary, norm binary"
    return cut(dealt.groupBy("block").applyInPandas(build, schema))


def _opened(row) -> Block:
    ids = np.frombuffer(row["ids"], np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[row["width"]]
    values = np.frombuffer(row["v"], kind).reshape(len(ids), row["dims"])
    codes = Codes(np.frombuffer(row["bits"], np.uint64).reshape(len(ids), -1), np.frombuffer(row["align"]), np.frombuffer(row["norm"]))
    return Block(ids, list(row["labels"]), values, codes)


def _meet(index: DataFrame, anchors: DataFrame, n_blocks: int, n_parts: int, answer, columns: str) -> DataFrame:
    """Every part of the anchors meets every block once; ``answer(block, anchor row, q, turned)`` yields result rows."""

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    names = ["row", "anchor_id", *(c.split()[0] for c in columns.split(", "))]

    def meet(blocks: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(blocks) and len(part):
            block = _opened(blocks.iloc[0])
            dims = max(block.rows.shape[1], max(len(v) for v in part["v"]))
            wide = np.zeros((len(block.rows), dims), block.rows.dtype)
            wide[:, : block.rows.shape[1]] = block.rows
            block.rows = wide
            asked = matrix(list(part["v"]), dims)
            # Anchors are turned by the map the block's codes were made with; components beyond it meet zeros there.
            turned = rotated(asked[:, : blocks["dims"].iloc[0]])
            for i, anchor in enumerate(part.to_dict("records")):
                out.extend((anchor["row"], anchor["id"], *x) for x in answer(block, anchor, asked[i], turned[i]))
        return pd.DataFrame(out, columns=names)

    left = index.withColumn("part", every(n_parts))
    right = anchors.withColumn("part", F.pmod("row", F.lit(n_parts)).cast("int")).withColumn("block", every(n_blocks))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, f"row bigint, anchor_id bigint, {columns}")


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    id_col: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
) -> DataFrame:
    """Negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors.  A negative has another label and a score of ``low_percent`` to ``high_percent``
    of the positive's.
    """
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<bigint>").alias("v"), anchor.alias("asked"))
    given = cut(given.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"))
    anchors = given.where("asked").select("id", "label", "v").distinct().withColumn("row", F.xxhash64("id", "label", "v"))
    anchors = cut(anchors)
    n_blocks = max(1, -(-given.count() // BLOCK))
    n_parts = max(1, -(-anchors.count() // PART))
    index = indexed(given.drop("asked"), n_blocks)

    def best(block: Block, a, q, turned):
        ids, scores = block.positives(a["id"], a["label"], q, turned, positives)
        yield from zip(ids.tolist(), scores.tolist(), strict=True)

    found = _meet(index, anchors, n_blocks, n_parts, best, "positive_id bigint, positive_score bigint")
    order = Window.partitionBy("row", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    wanted = found.groupBy("row", "anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found"))
    wanted = cut(anchors.join(wanted, (anchors["row"] == wanted["row"]) & (anchors["id"] == wanted["anchor_id"])).select(anchors["row"], "id", "label", "v", "found"))

    def near(block: Block, a, q, turned):
        marks = [(int(p["place"]), int(p["positive_id"]), int(p["positive_score"])) for p in a["found"]]
        windows = [(-(-low_percent * s // 100), high_percent * s // 100) for _, _, s in marks]
        for mark, (ids, scores) in zip(marks, block.negatives(a["id"], a["label"], q, turned, windows, negatives), strict=True):
            for x, s in zip(ids.tolist(), scores.tolist(), strict=True):
                yield *mark, x, s

    hard = _meet(index, wanted, n_blocks, n_parts, near, "place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("row", "anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
