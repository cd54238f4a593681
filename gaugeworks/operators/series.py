"""Ordered work over keyed time series that may hold one very busy key.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  A ``Series`` lays the rows of busy keys out by
(key, chunk) instead.  Chunks are stretches of a key's order (time, then tie) of about equal depth, so rows of one
time can lie in several chunks and a dense stretch has more chunks than a sparse one; a quiet key is one chunk.  What a
chunk needs from its neighbours is small (an edge row, a running total, a few border rows) and is computed by a
partial aggregate over chunks, then joined back on (key, chunk), the layout the window already needs.

``Series.plan`` counts the rows of each key once.  Unless a key holds more than ``gaugeworks.series.rowsPerChunk``, the
plain window stays; else the rows are written once, and the busy keys' rows are dealt by range of (key, time, tie), which
gives them their chunk numbers.  Rows without a key or a time belong to no series; operators that judge row by row give them
back with a null result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .lineage import cut

CHUNK = "_chunk"
OWN = "_own"
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
DEFAULT_ROWS_PER_CHUNK = 1_000_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
ROWS_PER_CHUNK_CONF = "gaugeworks.series.rowsPerChunk"


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp, zone-less timestamp or date."""
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def seconds_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / F.lit(1e6)


def rows_per_chunk(spark) -> int:
    return int(spark.conf.get(ROWS_PER_CHUNK_CONF, str(DEFAULT_ROWS_PER_CHUNK)))


def fits_one_task(df: DataFrame) -> bool:
    """Whether all rows together are no more than one chunk may hold; counts without reading the values."""
    return df.count() <= rows_per_chunk(df.sparkSession)


def null_safe_join(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the keys of ``df`` stay."""
    renamed = side.withColumnsRenamed({k: f"_side_{k}" for k in keys})
    on = [df[k].eqNullSafe(renamed[f"_side_{k}"]) for k in keys]
    return df.join(renamed, on, how).drop(*[f"_side_{k}" for k in keys])


def is_small(side: DataFrame) -> bool:
    """Whether a written table may be broadcast: bounded in rows and in bytes of its values."""
    widths = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in side.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    per_row = F.lit(16 * len(side.columns)) + sum(widths, F.lit(0))
    rows, size = side.agg(F.count("*"), F.coalesce(F.sum(per_row), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def spread_by_key(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join rows with a table of one row per key.

    The table is written first, so its true size decides: up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` it is
    broadcast and the rows stay where they are, beyond that it is a shuffled join whose busy keys are split at run time.
    """
    side = cut(per_key)
    side = F.broadcast(side) if is_small(side) else side
    return null_safe_join(df, side, keys, how) if null_safe else df.join(side, keys, how)


@dataclass(frozen=True)
class Series:
    frame: DataFrame
    keys: tuple[str, ...]
    ts: str
    tie: tuple[str, ...]
    chunked: bool = False
    #: Rows without a key or a time, and whether ``rows`` gives them back.
    rest: DataFrame | None = None
    whole: bool = False

    @classmethod
    def of(cls, df: DataFrame, keys, ts: str, tie=()) -> Series:
        """A series with plain windows per key."""
        keys, tie = tuple(keys), tuple(tie)
        placed = F.col(ts).isNotNull()
        for k in keys:
            placed = placed & F.col(k).isNotNull()
        return cls(df.where(placed), keys, ts, tie, rest=df.where(~placed))

    @classmethod
    def plan(cls, df: DataFrame, keys, ts: str, tie=()) -> Series:
        """Plain windows unless a key holds more rows than one task should."""
        return cls.of(df, keys, ts, tie).split(rows_per_chunk(df.sparkSession))

    def split(self, limit: int) -> Series:
        """Lay out keys of more than ``limit`` rows in chunks of at most so many.

        The busy keys' rows are dealt by range and sorted in their partitions, where every 2^k neighbours make a chunk.
        """
        counts = self.frame.groupBy(*self.keys).agg(F.count("*").alias("_n"))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= limit:
            return self
        base = cut(self.frame)
        busy = cut(base.groupBy(*self.keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*self.keys, F.lit(True).alias("_busy")))
        marked = base.join(F.broadcast(busy) if is_small(busy) else busy, list(self.keys), "left")
        line = [*self.keys, *self.order]
        dealt = marked.where("_busy").repartitionByRange(*line).sortWithinPartitions(*line)
        # The id counts a partition's rows in their order, the partition's number above.
        dealt = dealt.withColumn(CHUNK, F.shiftright(F.monotonically_increasing_id(), limit.bit_length() - 1))
        quiet = marked.where(F.col("_busy").isNull()).withColumn(CHUNK, F.lit(0).cast("long"))
        frame = cut(dealt.unionByName(quiet).select(*base.columns, CHUNK))
        return replace(self, frame=frame, chunked=True)

    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else list(self.keys)

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tie]

    def order_key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def _chunks(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def with_frame(self, df: DataFrame) -> Series:
        """Same layout over a frame derived row by row from this one."""
        return replace(self, frame=df)

    def rows(self) -> DataFrame:
        out = self.frame.drop(CHUNK)
        return out.unionByName(self.rest, allowMissingColumns=True) if self.whole else out

    def judged(self) -> Series:
        """The rows without a key or a time come back too, without a result."""
        return replace(self, whole=True)

    def mirrored(self, ts: str) -> Series:
        """The same layout in falling order of time; ``ts`` is a column that mirrors the time."""
        frame = self.frame.withColumn(CHUNK, -F.col(CHUNK)) if self.chunked else self.frame
        return replace(self, frame=frame, ts=ts)

    def attach(self, per_key: DataFrame) -> Series:
        """Left join a table with one row per key.

        Chunked, a table too long to broadcast goes to the key's chunks first, so no key meets in one task.
        """
        keys = list(self.keys)
        if not self.chunked:
            return self.with_frame(self.frame.join(per_key, keys, "left"))
        side = cut(per_key)
        if is_small(side):
            return self.with_frame(self.frame.join(F.broadcast(side), keys, "left"))
        side = self.frame.select(*self.parts).distinct().join(side, keys)
        return self.with_frame(self.frame.join(side, self.parts, "left"))

    def scan(
        self,
        prev: dict[str, Column] | None = None,
        next: dict[str, Column] | None = None,
        sums: dict[str, Column] | None = None,
        lasts: dict[str, Column] | None = None,
    ) -> Series:
        """One ordered pass: values of the previous and next row of the key, running totals, and the latest
        non-null value so far (totals and latest include the row itself).

        Chunked, one aggregate per (key, chunk) feeds all of them and is joined back once.
        """
        prev, next, sums, lasts = prev or {}, next or {}, sums or {}, lasts or {}
        df, w = self.frame, self.window()
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pack = lambda cols: F.struct(*[c.alias(k) for k, c in cols.items()])
        local = {}
        if prev:
            local["_prev"] = F.lag(pack(prev)).over(w)
        if next:
            local["_next"] = F.lead(pack(next)).over(w)
        local |= {n: F.sum(c).over(upto) for n, c in sums.items()}
        local |= {n: F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
        if self.chunked:
            df = df.join(self._carry(prev, next, sums, lasts, pack), self.parts, "left")
            for n, c in local.items():
                carried = F.col("_c_" + n)
                if n in sums:
                    # The chunk's total takes the type that a plain running total has, whatever the number of chunks.
                    kind = self.frame.select(F.sum(sums[n])).schema[0].dataType
                    local[n] = F.when(c.isNull(), carried).otherwise(c + F.coalesce(carried, F.lit(0))).cast(kind)
                else:
                    local[n] = F.coalesce(c, carried)
        made = [*prev, *next, *sums, *lasts]
        keep = [c for c in self.frame.columns if c not in made]
        out = df.select(*keep, *[c.alias("_s_" + n) for n, c in local.items()])
        sides = [F.col("_s__prev")[k].alias(k) for k in prev] + [F.col("_s__next")[k].alias(k) for k in next]
        return self.with_frame(out.select(*keep, *sides, *[F.col("_s_" + n).alias(n) for n in [*sums, *lasts]]))

    def _carry(self, prev, next, sums, lasts, pack) -> DataFrame:
        """What each (key, chunk) takes over from the chunks around it."""
        at, order = self.order_key(), self._chunks()
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        totals, carried = {}, {}
        if prev:
            totals["_prev"] = F.max_by(pack(prev), at)
            carried["_prev"] = F.lag("_t__prev").over(order)
        if next:
            totals["_next"] = F.min_by(pack(next), at)
            carried["_next"] = F.lead("_t__next").over(order)
        for n, c in sums.items():
            totals[n] = F.sum(c)
            carried[n] = F.sum("_t_" + n).over(before)
        for n, c in lasts.items():
            totals[n] = F.max_by(c, F.when(c.isNotNull(), at))
            carried[n] = F.last("_t_" + n, ignorenulls=True).over(before)
        per_chunk = self.frame.groupBy(*self.parts).agg(*[c.alias("_t_" + n) for n, c in totals.items()])
        return per_chunk.select(*self.parts, *[c.alias("_c_" + n) for n, c in carried.items()])

    def neighbours(self, prev: dict[str, Column] | None = None, next: dict[str, Column] | None = None) -> Series:
        return self.scan(prev=prev, next=next)

    def running(self, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> Series:
        return self.scan(sums=sums, lasts=lasts)

    def settle(self) -> Series:
        """Write a chunked frame that several passes will read to the checkpoint folder."""
        return self if not self.chunked else self.with_frame(cut(self.frame))

    def row_halo(self, before: int, after: int) -> Series:
        """Copy up to ``before``/``after`` bordering rows into each chunk; originals have ``_own`` true.

        Afterwards any row frame within the halo is exact under ``window()``.
        """
        own = self.frame.withColumn(OWN, F.lit(True))
        if not self.chunked:
            return self.with_frame(own)
        w, desc = self.window(), Window.partitionBy(*self.parts).orderBy(*[F.desc(c) for c in self.order])
        body = [c for c in self.frame.columns if c not in self.parts]
        packed = F.struct(*[F.col(c).alias(c) for c in [*self.order, *[c for c in body if c not in self.order]]])
        ranked = self.frame.select(*self.parts, packed.alias("_row"), F.row_number().over(w).alias("_up"), F.row_number().over(desc).alias("_down"))
        edges = (
            ranked.where((F.col("_down") <= before) | (F.col("_up") <= after))
            .groupBy(*self.parts)
            .agg(
                F.array_sort(F.collect_list(F.when(F.col("_down") <= before, F.col("_row")))).alias("_tail"),
                F.array_sort(F.collect_list(F.when(F.col("_up") <= after, F.col("_row")))).alias("_head"),
            )
        )
        back = self._chunks().rowsBetween(-max(before, 1), -1)
        ahead = self._chunks().rowsBetween(1, max(after, 1))
        near = edges.select(
            *self.parts,
            F.flatten(F.collect_list("_tail").over(back)).alias("_tails"),
            F.flatten(F.collect_list("_head").over(ahead)).alias("_heads"),
        ).select(
            *self.parts,
            F.concat(
                F.slice("_tails", F.greatest(F.size("_tails") - before + 1, F.lit(1)), before) if before else F.slice("_tails", 1, 0),
                F.slice("_heads", 1, after),
            ).alias("_rows"),
        )
        copies = near.select(*self.parts, F.explode("_rows").alias("_row")).select(
            *self.parts, *[F.col("_row")[c].alias(c) for c in body], F.lit(False).alias(OWN)
        )
        return self.with_frame(own.unionByName(copies))

    def owned(self) -> Series:
        return self.with_frame(self.frame.where(OWN).drop(OWN))
