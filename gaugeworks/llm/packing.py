"""Best-fit packing of token pieces into sequences of a fixed capacity.

Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, which plans by linear grouping:
large lengths, sorted downwards, form groups of equal cardinality and count as the largest length of their group;
configurations of these few sizes are built around the largest size left, filling the rest by an exact subset
sum, each as often as the sizes last; then the actual lengths take the places of the rounded ones, and small
lengths go best-fit into what is left.  Pieces of one length are alike, so a plan is a list of slots (length,
ranks from-to, sequence, offset) whose number depends on the capacity and the groups, not on the documents.
Pieces learn their rank within their length from counts per (length, salt), so a length that a third of all
pieces share is spread over many tasks, and look their slot up by binary search.

Cases: null and empty texts are one piece that holds the end id alone; longer texts are cut, never dropped; equal
pieces and repeated rows each get a place of their own; an empty frame gives an empty result.  Columns named like
results (``sequence_id``, ``offset``) are replaced; working columns bear names that start with ``_pk_``.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .bpe import Encoder

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
PIECES_IDS = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>"


def pieces(text: Column, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> Column:
    """Token pieces of a text: its ids and the end id, cut into pieces of at most ``capacity``; with the ids if asked for."""
    end = int(end_id).to_bytes(4, "little")

    @F.pandas_udf(PIECES_IDS if with_ids else PIECES)
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path)
        for s in batches:
            out = []
            for ids in encoder.encode([t if isinstance(t, str) else None for t in s]):
                raw = ids + end
                rows = []
                for i in range(0, len(raw), 4 * capacity):
                    part = raw[i : i + 4 * capacity]
                    row = {"piece": len(rows), "start": i // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                    rows.append(row | {"ids": part} if with_ids else row)
                out.append(rows)
            yield pd.Series(out, dtype=object)

    return cut_up(text)


def group_lengths(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Split lengths, largest first, into groups of equal cardinality: lists of (length, count)."""
    total = sum(counts.values())
    out: list[list[tuple[int, int]]] = []
    room = 0
    share = max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if room == 0:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def fill(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """Multiset of sizes (index: times) with the largest sum within the room; larger sizes first among equal sums."""
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for g, size in enumerate(sizes):
        if counts[g] == 0 or size > room:
            continue
        before, most = reach, min(counts[g], room // size)
        step = 1
        while most:  # binary split of the multiplicity
            take = min(step, most)
            reach |= (reach << (size * take)) & mask
            most, step = most - take, step * 2
        stages.append((g, before))
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    out: dict[int, int] = {}
    for g, before in reversed(stages):
        n = 0
        while not before >> left & 1:
            left -= sizes[g]
            n += 1
        if n:
            out[g] = n
    return out


class Plan:
    """Slots: pieces of ``length`` with ranks ``rank``.. lie at ``offset`` of sequences ``sequence``.., ``count`` of them."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.ranks: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs of sequences
        self.rooms: list[int] = []

    def leave(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.open:
                bisect.insort(self.rooms, room)
            self.open[room].append((first, count))

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.slots.append((length, self.ranks[length], count, first, offset))
        self.ranks[length] += count

    def run(self, config: list[int], times: int, stock: list[list[tuple[int, int]]]) -> None:
        """Open ``times`` sequences for a configuration of groups and put actual lengths of the groups there."""
        first = self.sequences
        self.sequences += times
        taken, ends = [], set()
        for g in config:  # the next ``times`` pieces of the group, as (length, count)
            parts, need = [], times
            while need:
                length, n = stock[g].pop(0)
                use = min(n, need)
                parts.append((length, use))
                if n > use:
                    stock[g].insert(0, (length, n - use))
                need -= use
            taken.append(parts)
            ends.update(np.cumsum([n for _, n in parts]).tolist())
        heads = [list(p) for p in taken]
        at = 0
        for end in sorted(ends):
            n, offset = end - at, 0
            for parts in heads:
                length, have = parts[0]
                self.put(length, n, first + at, offset)
                offset += length
                if have == n:
                    parts.pop(0)
                else:
                    parts[0] = (length, have - n)
            self.leave(self.capacity - offset, first + at, n)
            at = end

    def best_fit(self, length: int, n: int) -> None:
        while n:
            i = bisect.bisect_left(self.rooms, length)
            if i == len(self.rooms):
                count = -(-n // (self.capacity // length))
                self.leave(self.capacity, self.sequences, count)
                self.sequences += count
                continue
            room = self.rooms[i]
            first, count = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.rooms.pop(i)
            fits = room // length
            whole = min(count, n // fits)
            for j in range(fits if whole else 0):
                self.put(length, whole, first, self.capacity - room + j * length)
            self.leave(room - fits * length, first, whole)
            n -= whole * fits
            if whole < count:
                rest = n if n < fits else 0
                for j in range(rest):
                    self.put(length, 1, first + whole, self.capacity - room + j * length)
                n -= rest
                used = whole + (rest > 0)
                self.leave(room - rest * length, first + whole, used - whole)
                self.leave(room, first + used, count - used)

    def table(self) -> dict[str, np.ndarray]:
        """Slots sorted by (length, rank), keyed by both in one integer."""
        rows = np.array(self.slots, np.int64).reshape(-1, 5)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        return {"length": rows[:, 0], "rank": rows[:, 1], "sequence": rows[:, 3], "offset": rows[:, 4]}


def plan(counts: dict[int, int], capacity: int, groups: int = 1500, small: int | None = None) -> Plan:
    """Plan a histogram of lengths; lengths up to ``small`` (a sixteenth of the capacity) are packed last, best-fit."""
    small = capacity // 16 if small is None else small
    out = Plan(capacity)
    stock = group_lengths({k: n for k, n in counts.items() if k > small}, groups)
    sizes = [part[0][0] for part in stock]
    left = [sum(n for _, n in part) for part in stock]
    g = 0
    while g < len(sizes):
        if left[g] == 0:
            g += 1
            continue
        left[g] -= 1
        config = {g: 1}
        for other, n in fill(sizes, left, capacity - sizes[g]).items():
            config[other] = config.get(other, 0) + n
        left[g] += 1
        times = min(left[k] // n for k, n in config.items())
        for k, n in config.items():
            left[k] -= n * times
        out.run([k for k, n in sorted(config.items()) for _ in range(n)], times, stock)
    for length in sorted((k for k in counts if k <= small), reverse=True):
        out.best_fit(length, counts[length])
    return out


def pack(df: DataFrame, capacity: int = 4096, length: str = "length", order: tuple[str, ...] = (), groups: int = 1500) -> DataFrame:
    """Give each row of a frame of lengths (1 to ``capacity``) a ``sequence_id`` and its ``offset`` there.

    The frame is written once to the shared folder.  ``order`` names columns that tell rows apart.
    """
    spark = df.sparkSession
    df = cut(df.drop("sequence_id", "offset"))
    by_length = df.groupBy(length).agg(F.count("*").alias("_pk_n")).collect()  # at most ``capacity`` rows
    counts = {r[0]: r[1] for r in by_length if r[0] is not None}
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    slots = plan(counts, capacity, groups).table()
    shared = spark.sparkContext.broadcast(slots)

    # A fixed number of rows per (length, salt): more rows mean more salts, not longer windows.
    salts = max(16, sum(counts.values()) // 100_000)
    keys = [*order, length]
    salted = df.withColumn("_pk_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    before = Window.partitionBy(length).orderBy("_pk_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(length, "_pk_salt")
        .agg(F.count("*").alias("_pk_n"))
        .select(length, "_pk_salt", F.coalesce(F.sum("_pk_n").over(before), F.lit(0)).alias("_pk_from"))
    )
    ranked = salted.withColumn("_pk_rank", F.row_number().over(Window.partitionBy(length, "_pk_salt").orderBy(*keys)) - 1)
    ranked = ranked.join(starts, [length, "_pk_salt"]).withColumn("_pk_rank", F.col("_pk_rank") + F.col("_pk_from"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        t = shared.value
        at = np.empty(len(lengths), np.int64)
        lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
        for v in np.unique(lengths):
            lo, hi = np.searchsorted(t["length"], [v, v + 1])
            mine = lengths == v
            at[mine] = lo + np.searchsorted(t["rank"][lo:hi], ranks[mine], side="right") - 1
        shift = ranks - t["rank"][at]
        return pd.DataFrame({"sequence_id": t["sequence"][at] + shift, "offset": t["offset"][at]})

    placed = ranked.withColumn("_pk_at", place(F.col(length), F.col("_pk_rank")))
    return placed.select(*df.columns, "_pk_at.sequence_id", "_pk_at.offset")
