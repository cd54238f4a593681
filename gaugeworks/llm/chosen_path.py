"""Near-duplicate groups by chosen paths: a similarity join on shingle sets that branches on minwise tokens.

Sets that are equal form one class.  In each of ``TREES`` independent trees a class walks from the root: a node's number
fixes one or two hash functions (``100 / percent`` on average), and a set goes on to the child that the least token under
each of them names.  Two sets with a Jaccard index of j agree in a step with probability j, so near ones stay together and
others part; ``miss`` gives the share of pairs that never meet again, and TREES is chosen so that it is negligible.

Nodes of up to ``LIMIT`` classes are compared exhaustively by odd sketches (bits that count tokens by remainder, modulo
two): differing bits never exceed the sets' difference, so the sift drops no link.  What passes is proposed as a spanning
forest, most alike first, and confirmed on whole sets; where a proposal fails, finer sketches join what may link into
groups, which are compared on whole sets within tasks.  Larger nodes are first held against a few pivots.  What links to one shares its label, and
only pairs with different labels still matter: a node of one label is done, one with few rows outside its main label meets
that label in blocks, any other branches on.  So groups of copies cost their size, and no task meets a whole large node.

Cases: texts without words, null or empty, have an empty set and link with nothing; a text with fewer words than a
shingle is one shingle; rows with a null id have a null component, are kept and link nobody; repeated rows are copies
with the same id, rows that share only the id are judged one by one; other columns are dropped; an empty frame gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import words
from .graph import components
from .jaccard import _of, set_hash, shingle_sets
from .scratch import release

TREES = 10
#: Steps taken before nodes are counted, and by nodes that are still too large.
FIRST_STEPS = 2
MORE_STEPS = 3
LIMIT = 2048
PIVOTS = 8
#: Bits for each token of the sketches that the second look uses.
FINE = 6.0
#: Rows of a main label that one task holds against the rows outside it.
ROWS = 4096
#: Sets of a group that one task holds against as many others, at most, and tokens of these sets.
PART_ROWS = 4096
PART_TOKENS = 1 << 20
#: Sets that are held against others at a time, and tokens of these others.
_STRIP = 64
_TOKENS = 1 << 16
#: Numbers in one array of a step, and bytes of token sets in one output batch.
_CELLS = 1 << 18
_BATCH = 1 << 22
#: Characters whose words are hashed at a time; one longer text is taken whole.
_PIECE = 1 << 19
_STEP = words._series(64, 31) | np.uint64(1)


def miss(similarity: float, steps: int, percent: int, trees: int = TREES) -> float:
    """Chance that two sets share no node after so many steps in any tree."""
    whole, rest = divmod(100 / percent, 1)
    lost = 0.0
    for _ in range(steps):
        apart = 1 - similarity + similarity * lost
        lost = apart**whole * (1 - rest + rest * apart)
    return lost**trees


def roots(trees: int = TREES) -> np.ndarray:
    return words._series(trees, 32)


def sets_of(texts: pd.Series, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and shingle set of each text, a piece of the batch at a time."""
    rows = [t if isinstance(t, str) else None for t in texts]
    lo = 0
    while lo < len(rows):
        hi, held = lo, 0
        while hi < len(rows) and (hi == lo or held + len(rows[hi] or "") <= _PIECE):
            held += len(rows[hi] or "")
            hi += 1
        for i, s in shingle_sets(rows[lo:hi], size):
            yield lo + i, s
        lo = hi


def descend(nodes: np.ndarray, tokens: np.ndarray, steps: int, percent: int) -> np.ndarray:
    """Nodes of a set so many steps below the given ones."""
    whole, rest = divmod(100 / percent, 1)
    for _ in range(steps):
        with np.errstate(over="ignore"):
            more = (words.mix(nodes + _STEP[0]) >> np.uint64(40)).astype(np.int64) < rest * (1 << 24)
            keys = np.concatenate([words.mix(nodes + _STEP[i + 1]) for i in range(int(whole))] + [words.mix(nodes[more] + _STEP[int(whole) + 1])])
            at_once = max(1, _CELLS // len(tokens))
            least = [words.mix(tokens[None, :] ^ keys[i : i + at_once, None]).min(axis=1) for i in range(0, len(keys), at_once)]
            nodes = words.mix(np.concatenate(least) + keys)
    return np.unique(nodes)


def odd_sketch(tokens: np.ndarray, per_token: float = 0.75) -> np.ndarray:
    """Parities of the tokens by remainder; ``per_token`` bits for each on the next power of two, 64 at least."""
    bits = max(64, 1 << (int(per_token * len(tokens)) - 1).bit_length() if len(tokens) > 1 else 0)
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


class Sketches:
    """Sketches of several widths; a wide one folds to half its width without losing the bound."""

    def __init__(self, raw: list[np.ndarray], n: np.ndarray):
        self.n = n
        self.width = np.array([len(r) for r in raw], np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        parts = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            parts[w] = (at, np.concatenate([raw[i] for i in at]).astype(np.int64).view(np.uint64).reshape(len(at), w))
        for w, (at, bits) in parts.items():
            place = np.full(len(raw), -1)
            place[at] = np.arange(len(at))
            if 2 * w in parts:
                wide_at, wide = parts[2 * w]
                place[wide_at] = len(at) + np.arange(len(wide_at))
                bits = np.concatenate([bits, wide[:, :w] ^ wide[:, w:]])
            self.rows[w] = (place, bits)

    def passing(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs whose sizes and sketches do not rule a link out, and the share of their tokens that surely differs."""
        few, many = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        keep = 100 * few >= percent * many
        i, j = i[keep], j[keep]
        out_i, out_j, out_d = [], [], []
        least = np.minimum(self.width[i], self.width[j])
        most = np.maximum(self.width[i], self.width[j])
        for w in np.unique(least).tolist():
            place, bits = self.rows[w]
            of = np.flatnonzero((least == w) & (most <= 2 * w))
            for a in range(0, len(of), max(1, _CELLS // w)):
                p, q = i[of[a : a + max(1, _CELLS // w)]], j[of[a : a + max(1, _CELLS // w)]]
                differ = np.bitwise_count(bits[place[p]] ^ bits[place[q]]).sum(axis=1, dtype=np.int64)
                both = self.n[p] + self.n[q]
                ok = (100 + percent) * differ <= (100 - percent) * both
                out_i.append(p[ok])
                out_j.append(q[ok])
                out_d.append(differ[ok] / both[ok])
            far = np.flatnonzero((least == w) & (most > 2 * w))  # sizes this near cannot be so far apart in width; kept to lose nothing
            out_i.append(i[far])
            out_j.append(j[far])
            out_d.append(np.ones(len(far)))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *out_i]), np.concatenate([none, *out_j]), np.concatenate([np.zeros(0), *out_d])


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index pairs inside runs, in arrays of bounded size, and whether the runs met so far are complete."""
    for m in np.unique(sizes[sizes > 1]).tolist():
        first = starts[sizes == m]
        if m * m <= _CELLS:
            i, j = np.triu_indices(m, 1)
            at_once = max(1, _CELLS // len(i))
            for a in range(0, len(first), at_once):
                base = first[a : a + at_once, None]
                yield (base + i).ravel(), (base + j).ravel(), True
            continue
        strip = max(1, _CELLS // m)
        for base in first.tolist():
            for a in range(0, m, strip):
                i, j = np.nonzero(np.arange(a, min(a + strip, m))[:, None] < np.arange(m)[None, :])
                yield base + a + i, base + j, a + strip >= m


def forest(i: np.ndarray, j: np.ndarray, differ: np.ndarray, node: np.ndarray, sid: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which pairs form a spanning forest of each node over its labels, most alike first.

    Each round every component takes its first pair to another one; pairs have one order, so no round closes a ring.
    """
    order = np.lexsort((np.maximum(sid[i], sid[j]), np.minimum(sid[i], sid[j]), differ, node[i]))
    ends = np.unique(np.concatenate([i, j]))
    _, part = np.unique(np.stack([node[ends], label[ends]]), axis=1, return_inverse=True)
    p, q = part.ravel()[np.searchsorted(ends, i[order])], part.ravel()[np.searchsorted(ends, j[order])]
    kept, at = [], np.arange(len(order))
    while True:
        open_ = p != q
        p, q, at = p[open_], q[open_], at[open_]
        if not len(at):
            return order[np.sort(np.concatenate([*kept, np.zeros(0, np.int64)]))]
        best, other = (np.full(int(max(p.max(), q.max())) + 1, len(at)) for _ in range(2))
        # Pairs are in order, so writing them from the last to the first leaves each component its first.
        best[p[::-1]] = np.arange(len(at))[::-1]
        other[q[::-1]] = np.arange(len(at))[::-1]
        best = np.minimum(best, other)
        own = np.flatnonzero(best < len(at))
        chosen = np.unique(best[own])
        kept.append(at[chosen])
        up = np.arange(len(best))
        mine = best[own]
        up[own] = np.where(p[mine] == own, q[mine], p[mine])
        twins = own[(up[up[own]] == own) & (own < up[own])]
        up[twins] = twins
        while (up[up] != up).any():
            up = up[up]
        p, q = up[p], up[q]


def _nodes_compared(rows: DataFrame, percent: int) -> DataFrame:
    """Among rows (node, sid, n, sketch, label) of small nodes: pairs (node, x, y) that form a forest of all passing pairs of
    different labels, and with y null each further row x that passes with some row of another label."""

    def judged(b: pd.DataFrame) -> pd.DataFrame:
        node, sid, label = (b[c].to_numpy(np.int64) for c in ("node", "sid", "label"))
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[starts, len(node)])
        known = Sketches(b["sketch"].tolist(), b["n"].to_numpy(np.int64))
        found, held, passed = [], [], np.zeros(len(b), bool)
        for i, j, complete in _pairs_within(starts, sizes):
            differ = label[i] != label[j]
            i, j, d = known.passing(i[differ], j[differ], percent)
            passed[i] = passed[j] = True
            held.append((i, j, d))
            # The forest of a forest and more pairs is the forest of all pairs, so a strip leaves no more than a forest.
            i, j, d = (np.concatenate([h[k] for h in held]) for k in range(3))
            kept = forest(i, j, d, node, sid, label)
            held = [(i[kept], j[kept], d[kept])]
            if complete:
                found += held
                held = []
        i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(2))
        passed[i] = passed[j] = False
        more = np.flatnonzero(passed)
        x, y = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
        return pd.DataFrame({"node": np.r_[node[i], node[more]], "x": np.r_[x, sid[more]], "y": pd.Series([*y.tolist(), *[None] * len(more)], dtype="Int64")})

    # The window brings a node's rows together, one node after the other, and leaves out lone ones.
    node = Window.partitionBy("node")
    met = rows.withColumns({"low": F.min("label").over(node), "high": F.max("label").over(node)}).where("low <> high").drop("low", "high")
    return met.mapInPandas(lambda batches: map(judged, _whole_nodes(batches)), "node bigint, x bigint, y bigint")


def _whole_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows with each node's in one frame."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        node = batch["node"].to_numpy()
        earlier = np.flatnonzero(node != node[-1]) if len(node) else np.zeros(0, np.int64)
        last = int(earlier[-1]) + 1 if len(earlier) else 0  # the last node may go on in the next batch
        held = batch.iloc[last:].reset_index(drop=True)
        if last:
            yield batch.iloc[:last].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def linked_rows(sets: list[np.ndarray], part: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set to the others, counted on whole sets, and the first set it is joined to by links.

    If there are two parts, only sets of different parts are compared.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    starts = np.r_[0, np.cumsum(n)]
    kinds, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    links, root, place = np.zeros(m, np.int64), np.arange(m), np.full(len(kinds), -1)
    across = bool((part != part[0]).any())
    for a in range(0, m, _STRIP):
        b = min(a + _STRIP, m)
        mine = token[starts[a] : starts[b]]
        used = np.unique(mine)
        place[used] = np.arange(len(used))
        holds = np.zeros((len(used), b - a), np.uint8)
        holds[place[mine], owner[starts[a] : starts[b]] - a] = 1
        for lo, hi in _runs(starts, a, m):
            at = place[token[starts[lo] : starts[hi]]]
            hit = at >= 0
            at, whose = at[hit], owner[starts[lo] : starts[hi]][hit]
            if not len(at):
                continue
            first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            both = np.add.reduceat(holds[at], first, axis=0, dtype=np.int64)
            whose = whose[first]
            true = (100 * both >= percent * (n[whose][:, None] + n[a:b] - both)) & (whose[:, None] > np.arange(a, b))
            if across:
                true &= part[whose][:, None] != part[a:b]
            j, i = np.nonzero(true)
            i, j = i + a, whose[j]
            links += np.bincount(np.concatenate([i, j]), minlength=m)
            while True:
                p, q = root[i], root[j]
                if (p == q).all():
                    break
                np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                while (root[root] != root).any():
                    root = root[root]
        place[used] = -1
    return links, root


def _runs(starts: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Sets of a bounded number of tokens, one at least."""
    while first < last:
        upto = min(last, max(first + 1, int(np.searchsorted(starts, starts[first] + _TOKENS))))
        yield first, upto
        first = upto


def linked_within(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links inside groups (sid, grp), judged on whole sets (sid, n, held): x, y (a set that x is joined to, or x), n (links of x).

    A group of many sets is compared in parts, every two parts in one task, so x comes once per part; no pairs are written.
    """
    rows = groups.join(sets, "sid")
    size = rows.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).where("m > 1")
    parts = F.greatest(F.ceil(F.col("m") / PART_ROWS), F.ceil(F.col("tokens") / PART_TOKENS)).cast("int")
    rows = rows.join(size.select("grp", parts.alias("parts")), "grp")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "grp", "own", "sid", "held")

    def judged(b: pd.DataFrame) -> pd.DataFrame:
        node, sid, own = (b[c].to_numpy(np.int64) for c in ("node", "sid", "own"))
        cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
        out = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            _, at = np.unique(sid[lo:hi], return_index=True)  # a set read twice is one
            at += lo
            if len(at) > 1:
                links, root = linked_rows([b["held"].iat[k] for k in at.tolist()], own[at], percent)
                some = links > 0
                out.append((sid[at][some], sid[at][root[some]], links[some]))
        x, y, n = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in range(3))
        return pd.DataFrame({"x": x, "y": y, "n": n})

    met = rows.withColumn("m", F.count("*").over(Window.partitionBy("node"))).where("m > 1").select("node", "own", "sid", "held")
    return met.mapInPandas(lambda batches: map(judged, _whole_nodes(batches)), "x bigint, y bigint, n bigint")


def described(docs: DataFrame, size: int, percent: int, trees: int) -> DataFrame:
    """One row per document: doc, n, a and b (hash of its set), sketch, nodes."""
    start = roots(trees)

    columns = ["doc", "n", "a", "b", "sketch", "nodes"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"doc": "Int64", "n": "int64", "a": "int64", "b": "int64"})

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows = batch["doc"].tolist(), []
            for i, s in sets_of(batch["text"], size):
                if len(s):
                    rows.append((ids[i], len(s), *set_hash(s), odd_sketch(s), descend(start, s, FIRST_STEPS, percent).astype(np.int64)))
                else:
                    rows.append((ids[i], 0, 0, 0, None, None))
                if len(rows) == 1000:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return cut(docs.mapInPandas(describe, "doc bigint, n bigint, a bigint, b bigint, sketch array<bigint>, nodes array<bigint>"))


def _arrays(wanted: DataFrame, docs: DataFrame, classes: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Classes ``wanted`` (sid) read again from their texts: sid, n, held (an array made of the set)."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            sid, a, b = batch["sid"].tolist(), batch["a"].tolist(), batch["b"].tolist()
            out, held = [], 0
            for i, s in sets_of(batch["text"], size):
                if sid[i] not in seen and len(s) and set_hash(s) == (a[i], b[i]):
                    seen.add(sid[i])
                    out.append((sid[i], len(s), of(s)))
                    held += out[-1][2].nbytes
                if held >= _BATCH:
                    yield pd.DataFrame(out, columns=["sid", "n", "held"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["sid", "n", "held"])

    asked = wanted.join(classes.select("sid", "doc", "a", "b"), "sid")
    return _of(docs, asked).mapInPandas(hashed, "sid bigint, n bigint, held array<bigint>")


def _read_sets(ends: DataFrame, known: DataFrame | None, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """Whole sets (sid, n, held) of the classes (sid), and those that are known."""
    if known is not None:
        ends = ends.join(known.select("sid"), "sid", "left_anti")
    sets = cut(_arrays(ends, docs, classes, size, lambda s: s.view(np.int64)))
    return sets if known is None else known.unionByName(sets)


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs with ``linked``: their whole sets compared; and the sets that are known now."""
    pairs = cut(pairs)
    sets = _read_sets(pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct(), known, docs, classes, size)
    left, right = sets.drop("n").withColumnsRenamed({"sid": "x", "held": "sx"}), sets.drop("n").withColumnsRenamed({"sid": "y", "held": "sy"})
    both = F.size(F.array_intersect("sx", "sy"))
    linked = 100 * both >= percent * (F.size("sx") + F.size("sy") - both)
    judged = cut(pairs.join(left, "x").join(right, "y").select("x", "y", linked.alias("linked")).distinct())
    release(docs.sparkSession)
    return judged, sets


def _first_pivot(rows: DataFrame, big: DataFrame, percent: int) -> DataFrame:
    """Each row of a large node with the first of the node's pivots that may link it: node, sid, pivot (or null)."""
    whole = F.struct("sid", "n", "sketch")
    picks = [F.min_by(whole, F.xxhash64("sid", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = rows.join(big, "node", "left_semi").groupBy("node").agg(*picks)
    pivots = cut(pivots.select("node", F.array(*[f"p{i}" for i in range(PIVOTS)]).alias("pivots")))

    def passes(p: Column) -> Column:
        # Sketches of another width are left out here, where a missed pivot costs work but no link.
        differ = F.aggregate(F.zip_with("sketch", p["sketch"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
        sizes = 100 * F.least("n", p["n"]) >= percent * F.greatest("n", p["n"])
        return (F.size("sketch") == F.size(p["sketch"])) & sizes & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + p["n"]))

    # A pivot passes itself and so stops at itself or at an earlier pivot.
    return rows.join(pivots, "node").select("node", "sid", F.get(F.filter("pivots", passes), F.lit(0))["sid"].alias("pivot"))


def _branched(rows: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Children of rows (node, sid, label): node, sid, n, sketch, label."""
    per_set = rows.groupBy("sid").agg(F.collect_list(F.struct("node", "label")).alias("at"))
    wanted = per_set.join(classes.select("sid", "doc", "a", "b"), "sid")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            sid, a, b, at = (batch[c].tolist() for c in ("sid", "a", "b", "at"))
            out = []
            for i, s in sets_of(batch["text"], size):
                if sid[i] in seen or not len(s) or set_hash(s) != (a[i], b[i]):
                    continue
                seen.add(sid[i])
                sketch = odd_sketch(s)
                for x in at[i]:
                    below = descend(np.array([x["node"]], np.int64).view(np.uint64), s, MORE_STEPS, percent)
                    out.extend((int(v), sid[i], len(s), sketch, x["label"]) for v in below.astype(np.int64))
            yield pd.DataFrame(out, columns=["node", "sid", "n", "sketch", "label"])

    return _of(docs, wanted).mapInPandas(walk, "node bigint, sid bigint, n bigint, sketch array<bigint>, label bigint")


def _blocks(rows: DataFrame, mains: DataFrame) -> DataFrame:
    """Rows of nodes with few rows outside the main label: the main label's rows in blocks, the others in every block."""
    both = rows.join(mains.select("node", "main", "m"), "node")
    n_blocks = F.ceil(F.col("m") / ROWS).cast("int")
    inside = F.array(F.pmod(F.xxhash64("sid"), n_blocks).cast("int"))
    block = F.explode(F.when(F.col("label") == F.col("main"), inside).otherwise(F.sequence(F.lit(0), n_blocks - 1)))
    return both.withColumn("block", block).select(F.xxhash64("node", "block").alias("node"), "sid", "n", "sketch", "label")


def _tiles(rows: DataFrame, mains: DataFrame) -> DataFrame:
    """Rows of large nodes with many labels in parts of half a small node's rows, every two parts as one node."""
    both = rows.join(mains.select("node", "m"), "node")
    n_parts = F.ceil(2 * F.col("m") / LIMIT).cast("int")
    own = F.pmod(F.xxhash64("sid"), n_parts).cast("int")
    both = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    return both.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "sid", "n", "sketch", "label")


def small_nodes(rows: DataFrame, mains: DataFrame) -> DataFrame:
    """Rows (node, sid, n, sketch, label) dealt so that each pair of labels of a node still meets and no node is large.

    ``mains`` has each node's main label, its rows m and those outside the main label, others.  Large nodes are fewer than one
    in LIMIT rows, so their names go to the tasks and the rows stay where they are.
    """
    large = mains.where(F.col("m") > LIMIT)
    small = rows.join(F.broadcast(large.select("node")), "node", "left_anti")
    few, many = F.broadcast(large.where(F.col("others") <= LIMIT)), F.broadcast(large.where(F.col("others") > LIMIT))
    return small.unionByName(_blocks(rows, few)).unionByName(_tiles(rows, many))


def settled(rest: DataFrame, confirmed: list[DataFrame], real: DataFrame, classes: DataFrame, size: int, percent: int, sets: DataFrame | None = None, count: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Links (x, y) that join all classes which links among the rows (node, sid, n, sketch, label) of small nodes join.

    ``confirmed`` are pairs (x, y, linked) judged before; their links are among the result.  ``sets`` (sid, n, held) are known.
    With ``count`` the second frame has the number of all links (sid, n) of each class that has some.
    """
    spark = rest.sparkSession
    proposed = cut(_nodes_compared(rest, percent))
    release(spark)
    pairs = proposed.where("y IS NOT NULL").select("x", "y").distinct()
    for p in confirmed:
        pairs = pairs.join(p.select("x", "y"), ["x", "y"], "left_anti")
    judged, sets = _confirmed(pairs, real, classes, size, percent, sets)
    for c in confirmed:
        judged = judged.unionByName(c.select("x", "y", "linked"))
    judged = cut(judged.distinct())

    # Where a proposal failed, another pair of the node may link.  Of its rows that passed, sketches with far more bits than
    # tokens leave few that do not link; what these join is compared on whole sets.
    failed = proposed.join(judged.where("NOT linked"), ["x", "y"], "left_semi").select("node").distinct()
    open_rows = proposed.join(failed, "node", "left_semi").select("node", F.explode(F.array("x", "y")).alias("sid"))
    open_rows = cut(open_rows.where("sid IS NOT NULL").distinct())
    links = judged.where("linked").select("x", "y")
    likely, counted = None, None
    if not open_rows.isEmpty():
        labels = components(links, "x", "y").select(F.col("node").alias("sid"), F.col("component").alias("label"))
        labelled = cut(open_rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
        several = labelled.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        labelled = cut(labelled.join(several, "node", "left_semi"))
        fine = cut(_arrays(labelled.select("sid").distinct(), real, classes, size, lambda s: odd_sketch(s, FINE)).withColumnRenamed("held", "sketch"))
        likely = _nodes_compared(labelled.join(fine, "sid").select("node", "sid", "n", "sketch", "label"), percent)
        likely = cut(likely.where("y IS NOT NULL").select("x", "y").distinct())
        release(spark)
    if likely is not None or count:
        near = links if likely is None else links.unionByName(likely)
        groups = components(near, "x", "y").select(F.col("node").alias("sid"), F.col("component").alias("grp"))
        groups = groups.unionByName(groups.select(F.col("grp").alias("sid"), "grp").distinct())  # the least node names the others
        if not count:
            touched = groups.join(likely.select(F.col("x").alias("sid")).distinct(), "sid", "left_semi").select("grp").distinct()
            groups = groups.join(touched, "grp", "left_semi")
        groups = cut(groups)
        sets = _read_sets(groups.select("sid"), sets, real, classes, size)
        found = cut(linked_within(groups, sets, percent))
        release(spark)
        links = links.unionByName(found.where("x <> y").select("x", "y"))
        counted = found.groupBy(F.col("x").alias("sid")).agg(F.sum("n").alias("n"))
    return links, counted


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80, trees: int = TREES) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept (it is that id)."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    per_doc = described(docs, size, percent, trees)
    real = docs.where(F.col("doc").isNotNull())
    classes = per_doc.where("n > 0 AND doc IS NOT NULL").groupBy("a", "b")
    classes = classes.agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
    classes = cut(classes.withColumn("sid", F.monotonically_increasing_id()))

    rows = classes.select(F.explode("nodes").alias("node"), "sid", "n", "sketch", F.col("sid").alias("label"))
    small, confirmed = [], []
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
        large = cut(sizes.where(F.col("m") > LIMIT))
        small.append(rows.join(large.select("node"), "node", "left_anti"))
        big = large.where("low <> high").select("node")
        if big.isEmpty():
            break
        members = cut(rows.join(big, "node", "left_semi"))
        led = cut(_first_pivot(members, big, percent))
        stars = led.where("pivot <> sid").select(F.least("sid", "pivot").alias("x"), F.greatest("sid", "pivot").alias("y")).distinct()
        judged, _ = _confirmed(stars, real, classes, size, percent)
        confirmed.append(judged)
        true = judged.where("linked").select("x", "y")
        ours = led.withColumns({"x": F.least("sid", "pivot"), "y": F.greatest("sid", "pivot")}).join(true, ["x", "y"]).select("node", "sid", "pivot")
        # A pivot leads itself; what it leads takes its label.
        lead = members.select("node", F.col("sid").alias("pivot"), F.col("label").alias("lead"))
        led_labels = ours.join(lead, ["node", "pivot"]).select("node", "sid", "lead")
        members = members.join(led_labels, ["node", "sid"], "left").withColumn("label", F.least("label", F.coalesce("lead", "label"))).drop("lead")
        members = cut(members)
        counts = members.groupBy("node", "label").agg(F.count("*").alias("c"))
        mains = counts.groupBy("node").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("m"), (F.sum("c") - F.max("c")).alias("others"))
        mains = cut(mains.where("others > 0"))
        few = mains.where(F.col("others") <= LIMIT)
        small.append(_blocks(members, few))
        rows = members.join(mains.where(F.col("others") > LIMIT).select("node"), "node", "left_semi")
        rows = cut(_branched(rows.select("node", "sid", "label"), real, classes, size, percent))
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)
    links, _ = settled(rest, confirmed, real, classes, size, percent)

    found = components(links, "x", "y").select(F.col("node").alias("sid"), "component")
    grouped = classes.select("sid", "a", "b", "doc").join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = grouped.groupBy("component").agg(F.min("doc").alias("least"))
    grouped = grouped.join(least, "component").select("a", "b", "least")
    out = per_doc.select("doc", "n", "a", "b").join(grouped, ["a", "b"], "left")
    own = F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")))
    out = out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
