"""Near-duplicate groups by Jaccard index of word shingles.

Texts with equal shingle sets form one class.  Shingles are ordered frequent last; a set is filed under its prefix: rare
shingles one by one, frequent ones in pairs.  If ``t`` shingles of a set may be missing in a partner, its prefix is
extended until ``t`` losses cannot break everything it is filed under: a rare shingle counts one, a group of m frequent
shingles m - 1.  So two sets that link share an entry.  Frequent shingles fall into groups by hash; the number of groups
follows the size class of the smaller set of a pair, and a set is filed for each class its partners may have.  Sets of
fewer than ``PAIRS_FROM`` shingles file single shingles only.  What counts as frequent changes the work, never the result.

Entries meet in blocks of sorted hashes by shard; inside a block the sets of one entry follow its first set, which
alone goes on to the shard, so a frequent entry costs a shard one row per block.  Entries of two or more sets are kept,
without a set that all others are held against.  Each set is first held against its hubs: a pair is dropped when its sizes or its counts of shingles by hash remainder rule a
link out, first by few remainders, then by about as many as the set has shingles; for what is left the whole sets of 64-bit
shingle hashes are compared.  The sets of an entry that are still in different components are compared within one task, once for all
entries of the same sets, by odd sketches, an entry of many sets in parts; what passes is proposed as a spanning forest, most alike first, so an entry
gives fewer pairs than it has sets, and is confirmed on whole sets.  What links, or by finer sketches may link where a
proposal failed, forms groups; inside a group all sets are compared on whole within tasks, which counts every link.
Only texts of such sets are dealt out again; a bitmap of fixed size keeps most others from being shuffled.

Cases: texts without words, null or empty, have an empty set, link with nothing and are their own component; a text with
fewer words than a shingle is one shingle; a repeated row is a copy with the same id; rows with a null id have a null
component and link nobody; other columns are dropped, an empty frame gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import words
from .graph import components
from .ngram_lm import _gather, _spread
from .scratch import release

PAIRS_FROM = 16
#: A shingle is frequent from so many sets on, as far as the list goes; its length bounds what is sent to the tasks.
FREQUENT_FROM = 24
FREQUENT_MOST = 1 << 19
GROUP_TOKENS = 1 << 20
#: Entries that a task sorts at a time are GROUP_TOKENS by so much.
BLOCK_PART = 4
#: Remainders that shingles are counted by; two sets share at most the sum of the smaller counts.
REMAINDERS = 256
#: Bits of the map of wanted ids, and of one of its rows; a fuller map lets more texts pass, the join after it none.
MAP_BITS = 1 << 25
ROW_BITS = 1 << 15
_ODD = words._series(64, 21) | np.uint64(1)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and sorted distinct shingle hashes of each text."""
    for lo, hashes, counts in words.grouped(texts, lower=True):
        ends = np.cumsum(counts)
        full = max(0, len(hashes) - size + 1)
        with np.errstate(over="ignore"):
            rolled = np.zeros(full, np.uint64)
            for k in range(size):
                rolled += hashes[k : k + full] * _ODD[k]
            rolled = words.mix(rolled)
            for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                if n >= size:
                    yield lo + i, np.unique(rolled[end - n : end - size + 1])
                elif n:
                    short = (hashes[end - n : end] * _ODD[size : size + n]).sum(dtype=np.uint64) + np.uint64(n)
                    yield lo + i, words.mix(np.array([short]))
                else:
                    yield lo + i, np.empty(0, np.uint64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def losses(n: int, percent: int) -> int:
    """Shingles of a set of n that a linked partner may lack."""
    return n - -(-n * percent // 100)


def _size_class(n: int) -> int:
    return n.bit_length() - 1


def entries(s: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set is filed under: single shingles, and pairs of frequent shingles (hashed with their size class)."""
    n = len(s)
    need = losses(n, percent) + 1
    at = np.minimum(np.searchsorted(frequent, s), max(len(frequent) - 1, 0))
    often = frequent[at] == s if len(frequent) else np.zeros(n, bool)
    rare, common = s[~often], s[often]
    if len(rare) >= need:
        return rare[:need], np.empty(0, np.uint64)
    need -= len(rare)
    singles, pairs = [rare], []
    for c in {_size_class(n), _size_class(max(1, -(-n * percent // 100)))}:
        if 1 << c < PAIRS_FROM:
            singles.append(common[:need])
            continue
        group = (words.mix(common) % np.uint64(1 << (c - 2))).astype(np.int64)
        order = np.argsort(group, kind="stable")
        first = np.zeros(len(common), bool)
        first[order] = np.r_[True, group[order][1:] != group[order][:-1]]
        kept = np.cumsum(~first)  # losses it takes to break all pairs of the prefix, less one
        upto = int(np.searchsorted(kept, need)) + 1
        if upto > len(common):
            raise AssertionError("a set of this size always has enough pairs")
        for g in np.unique(group[:upto]):
            members = common[:upto][group[:upto] == g]
            i, j = np.triu_indices(len(members), 1)
            with np.errstate(over="ignore"):
                pairs.append(words.mix(members[i] * _ODD[40] + members[j] * _ODD[41] + np.uint64(c)))
    return np.unique(np.concatenate(singles)), np.concatenate([*pairs, np.empty(0, np.uint64)])


def sketch(s: np.ndarray) -> bytes:
    """Counts of shingles by remainder, at most 255 each."""
    return np.minimum(np.bincount((s % np.uint64(REMAINDERS)).astype(np.int64), minlength=REMAINDERS), 255).astype(np.uint8).tobytes()


def fine_sketch(s: np.ndarray) -> bytes | None:
    """Counts of shingles by so many remainders (a power of two) as the set has shingles, in half bytes; 15 is 15 or more."""
    if len(s) < REMAINDERS // 4:
        return None
    buckets = 1 << len(s).bit_length()
    counts = np.minimum(np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 15).astype(np.uint8)
    return (counts[0::2] | counts[1::2] << 4).tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """The most shingles two sets can share by their fine sketches; the finer one is folded to the other's remainders."""
    counts = []
    for raw in (x, y):
        halves = np.frombuffer(raw, np.uint8)
        c = np.empty(2 * len(halves), np.int64)
        c[0::2], c[1::2] = halves & 15, halves >> 4
        c[c == 15] = 1 << 40
        counts.append(c)
    fewest = min(map(len, counts))
    p, q = (c.reshape(-1, fewest).sum(axis=0) for c in counts)
    return int(np.minimum(p, q).sum())


def described(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """One row per document (doc, n, a, b: size and hash of its set; its sketches) and shingles that some task met in several sets."""

    from .chosen_path import odd_sketch, sets_of  # that module builds on this one

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        held = 0

        def often() -> pd.DataFrame:
            kinds, n = np.unique(np.concatenate([*seen.values(), np.empty(0, np.uint64)]), return_counts=True)
            kinds, n = kinds[n > 1], n[n > 1]
            return pd.DataFrame({"doc": pd.Series([None] * len(kinds), dtype="Int64"), "n": n, "a": kinds.astype(np.int64), "b": np.zeros(len(kinds), np.int64), "shingle": True, "sketch": None, "fine": None, "odd": None})

        for batch in batches:
            rows = []
            ids = batch["doc"].tolist()
            for i, s in sets_of(batch["text"], size):
                a, b = set_hash(s) if len(s) else (0, 0)
                rows.append((ids[i], len(s), a, b, False, sketch(s) if len(s) else None, fine_sketch(s), odd_sketch(s) if len(s) else None))
                if a not in seen:
                    seen[a] = s
                    held += len(s)
                if held >= GROUP_TOKENS:
                    yield often()
                    seen.clear()
                    held = 0
            out = pd.DataFrame(rows, columns=["doc", "n", "a", "b", "shingle", "sketch", "fine", "odd"])
            yield out.astype({"doc": "Int64", "n": "int64", "a": "int64", "b": "int64", "shingle": "bool"})
        yield often()

    both = cut(docs.mapInPandas(describe, "doc bigint, n bigint, a bigint, b bigint, shingle boolean, sketch binary, fine binary, odd array<bigint>"))
    return both.where("NOT shingle").drop("shingle"), both.where("shingle").select("a", "n")


def filed(docs: DataFrame, frequent, size: int, percent: int, shards: int) -> DataFrame:
    """Entries of two or more different sets: entry, set, hub (another set of the entry, or itself for its first set).

    A set that is the hub of all others of its entry has no row of its own there, as each pair it forms is a row already.
    """
    from .chosen_path import sets_of

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, sets, held, seen = [], [], 0, set()

        def block() -> pd.DataFrame:
            k, s = np.concatenate([*keys, np.empty(0, np.uint64)]), np.concatenate([*sets, np.empty(0, np.int64)])
            order = np.lexsort((s, k))
            k, s = k[order], s[order]
            first = np.r_[True, k[1:] != k[:-1]][: len(k)]
            leader = s[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))] if len(k) else s
            rows = [(int(shard), _spread(k[m]), s[m].tobytes(), leader[m].tobytes(), None) for shard, m in _dealt(~first, s.astype(np.uint64), shards)]
            leads = np.zeros(len(k), np.uint8)
            leads[:-1] = ~first[1:]
            rows += [(int(shard), _spread(k[m]), s[m].tobytes(), None, leads[m].tobytes()) for shard, m in _dealt(first, k, shards)]
            return pd.DataFrame(rows, columns=["shard", "keys", "sets", "hubs", "leads"])

        for batch in batches:
            for _, s in sets_of(batch["text"], size):
                if len(s):
                    a = set_hash(s)[0]
                    if a in seen:
                        continue
                    seen.add(a)
                    k = np.concatenate(entries(s, frequent.value, percent))
                    keys.append(k)
                    sets.append(np.full(len(k), a, np.int64))
                    held += len(k)
                    if held >= GROUP_TOKENS // BLOCK_PART:
                        yield block()
                        keys, sets, held, seen = [], [], 0, set()
        yield block()

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        follow, lead = b[b["hubs"].notna()], b[b["leads"].notna()]
        out = []
        for x, y, z in zip(follow["keys"], follow["sets"], follow["hubs"], strict=True):
            out.append((_gather(x), np.frombuffer(y, np.int64), np.frombuffer(z, np.int64)))
        if len(lead):
            k = np.concatenate([_gather(x) for x in lead["keys"]])
            s = np.concatenate([np.frombuffer(x, np.int64) for x in lead["sets"]])
            leads = np.concatenate([np.frombuffer(x, np.uint8) for x in lead["leads"]])
            order = np.lexsort((s, k))
            k, s, leads = k[order], s[order], leads[order]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[starts, len(k)])
            hub = np.repeat(s[starts], sizes)
            other = np.repeat(np.add.reduceat((leads > 0) & (s != hub), starts, dtype=np.int64) > 0, sizes)  # has another hub too
            on = other | (s != hub)
            out.append((k[on], s[on], hub[on]))
        k, s, h = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pd.DataFrame({"entry": k.astype(np.int64), "set": s, "hub": h})

    return docs.mapInPandas(blocks, "shard int, keys binary, sets binary, hubs binary, leads binary").groupBy("shard").applyInPandas(meet, "entry bigint, set bigint, hub bigint")


def _dealt(mask: np.ndarray, by: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Chosen rows, in order, by remainder."""
    rows = np.flatnonzero(mask)
    shard = (by[rows] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    rows, shard = rows[order], shard[order]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(rows) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(shard[a]), rows[a:b]


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of sets whose sizes and sketches do not rule a link out."""

    @F.pandas_udf("boolean")
    def enough(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), REMAINDERS).astype(np.int64) for s in (x, y))
        both = np.where((p == 255) & (q == 255), 1 << 40, np.where(p == 255, q, np.where(q == 255, p, np.minimum(p, q)))).sum(axis=1)
        both = np.minimum(both, np.minimum(nx.to_numpy(), ny.to_numpy()))
        return pd.Series(100 * both >= percent * (nx.to_numpy() + ny.to_numpy() - both))

    left = classes.select(F.col("a").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("kx"))
    right = classes.select(F.col("a").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("ky"))
    found = pairs.join(left, "x").join(right, "y").where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    found = cut(found.where(enough("kx", "ky", "nx", "ny")).select("x", "y", (F.col("nx") + F.col("ny")).alias("n")))
    release(pairs.sparkSession)

    @F.pandas_udf("boolean")
    def finely(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for p, q, both in zip(x, y, n.tolist(), strict=True):
            shared = None if p is None or q is None else most_shared(p, q)
            out.append(shared is None or 100 * shared >= percent * (both - shared))
        return pd.Series(out, dtype=bool)

    fine = classes.select("a", "fine").where("fine IS NOT NULL")
    left, right = fine.withColumnsRenamed({"a": "x", "fine": "fx"}), fine.withColumnsRenamed({"a": "y", "fine": "fy"})
    kept = cut(found.join(left, "x", "left").join(right, "y", "left").where(finely("fx", "fy", "n")).select("x", "y"))
    release(pairs.sparkSession)
    return kept


def _of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose id is wanted.  A bitmap of the ids' hashes, of at most MAP_BITS bits, sifts them before the shuffle."""
    place = F.pmod(F.xxhash64("doc"), F.lit(MAP_BITS))
    row, at = F.floor(place / ROW_BITS).alias("_row"), place % ROW_BITS
    maps = wanted.select(row, at.alias("_at")).groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_map"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    sifted = docs.withColumns({"_row": row, "_at": at}).join(F.broadcast(maps), "_row")
    sifted = sifted.where(F.getbit(byte, F.expr("cast(_at % 8 as int)")) == 1)
    return sifted.select("doc", "text").join(wanted, "doc")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that link: whole sets compared; and these sets (sid, n, held)."""
    from .chosen_path import sets_of

    needed = pairs.select(F.col("x").alias("a")).unionAll(pairs.select(F.col("y").alias("a"))).distinct()
    needed = needed.join(classes, "a").select("a", F.col("rep").alias("doc"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = batch["a"].tolist()
            out = [(wanted[i], len(s), s.view(np.int64)) for i, s in sets_of(batch["text"], size) if len(s) and set_hash(s)[0] == wanted[i]]
            yield pd.DataFrame(out, columns=["sid", "n", "held"])

    @F.pandas_udf("boolean")
    def links(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    sets = cut(_of(docs, needed).mapInPandas(hashed, "sid bigint, n bigint, held array<bigint>"))
    release(docs.sparkSession)
    left, right = (sets.select(F.col("sid").alias(k), F.col("held").alias(f"s{k}")) for k in "xy")
    found = cut(pairs.join(left, "x").join(right, "y").where(links("sx", "sy")).select("x", "y").distinct())
    release(docs.sparkSession)
    return found, sets


def open_entries(entry: DataFrame, named: DataFrame) -> DataFrame:
    """Entries of several labels: node, main (the label of most rows), m (rows), others (rows outside main).  ``named`` are the rows of
    ``entry`` (entry, set) with their label.

    Entries that hold the same sets give the same proposals, so one of them goes on: near copies meet in dozens of entries.
    Equal are entries of as many rows with equal sums of two 64-bit hashes of the sets, each summed in halves.
    """
    parts = named.groupBy("entry", "label").agg(F.count("*").alias("c"))
    main = parts.groupBy("entry").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("most"), F.count("*").alias("labels"))
    main = cut(main.where("labels > 1").select("entry", "main", "m", (F.col("m") - F.col("most")).alias("others")))
    release(entry.sparkSession)
    hashes = [F.xxhash64("set", F.lit(seed)) for seed in (1, 2)]
    halves = [half for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1)))]
    sums = [f"h{i}" for i in range(len(halves))]
    held = entry.join(main.select("entry"), "entry", "left_semi").groupBy("entry").agg(*[F.sum(h).alias(k) for k, h in zip(sums, halves, strict=True)])
    one = F.min(F.struct(F.col("entry").alias("node"), "main", "others")).alias("one")
    return main.join(held, "entry").groupBy("m", *sums).agg(one).select("one.node", "one.main", "m", "one.others")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links) and n_links (all links of its class to others)."""
    from .chosen_path import settled, small_nodes

    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    rows, often = described(docs, size)
    top = often.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "a").limit(FREQUENT_MOST)
    frequent = spark.sparkContext.broadcast(np.sort(top.select("a").toPandas()["a"].to_numpy(np.int64).astype(np.uint64)))

    real = docs.where(F.col("doc").isNotNull())
    shingles = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entry = cut(filed(real, frequent, size, percent, max(8, shingles // (4 * GROUP_TOKENS))))
    release(spark)
    classes = cut(rows.where("n > 0 AND doc IS NOT NULL").groupBy("a").agg(F.min("doc").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.first("fine").alias("fine"), F.min("b").alias("b"), F.first("odd").alias("odd")))
    release(spark)

    # First each set against its hubs.
    hubs = entry.where("set <> hub").select(F.least("set", "hub").alias("x"), F.greatest("set", "hub").alias("y")).distinct()
    links, sets = _links(_possible(hubs, classes, percent), real, classes, size, percent)
    labels = components(links, "x", "y")

    # Then what still lies in different components of one entry.
    named = entry.select("entry", "set").join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("component", "set")).drop("component")
    main = cut(open_entries(entry.select("entry", "set"), named))
    open_rows = named.join(main.select(F.col("node").alias("entry")), "entry", "left_semi").select(F.col("entry").alias("node"), F.col("set").alias("sid"), "label")
    open_rows = cut(open_rows.join(classes.select(F.col("a").alias("sid"), "n", F.col("odd").alias("sketch")), "sid").select("node", "sid", "n", "sketch", "label"))
    release(spark)
    judged = cut(hubs.join(links.withColumn("linked", F.lit(True)), ["x", "y"], "left").select("x", "y", F.coalesce("linked", F.lit(False)).alias("linked")))
    named = classes.select(F.col("a").alias("sid"), F.col("rep").alias("doc"), "a", "b")
    links, counted = settled(small_nodes(open_rows, main), [judged], real, named, size, percent, sets, count=True)

    reps = classes.select("a", "rep")
    edges = links.join(reps.withColumnsRenamed({"a": "x", "rep": "rx"}), "x").join(reps.withColumnsRenamed({"a": "y", "rep": "ry"}), "y")
    found = components(edges, "rx", "ry")
    degrees = counted.select(F.col("sid").alias("a"), F.col("n").alias("n_links"))
    classes = classes.join(found, classes["rep"] == found["node"], "left").select("a", F.coalesce("component", "rep").alias("component"))
    classes = classes.join(degrees, "a", "left")
    own = F.when(F.col("n") > 0, F.col("component"))
    return rows.join(classes, "a", "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce(own, F.col("doc"))).alias("component_id"),
        F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
