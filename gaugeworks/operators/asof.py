"""Joins along time: as-of, nearest, effective-dated, interval and range tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import Series, from_micros, micros

_SIDE = "_side"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    tie: str,
    right_tie: str | None = None,
    defaults: dict | None = None,
    tolerance_us: int | None = None,
    match_ts: str | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it, per key.

    Both sides go into one union and one running "latest right row", so there is a single shuffle and no
    pair is ever formed.  Equal right times: the greatest ``right_tie`` wins.  A matched null stays null;
    ``defaults`` fill only rows without a match.  ``tolerance_us`` is inclusive.  Every left row comes back: one
    without a key or time matches nothing.
    """
    right_tie = right_tie or tie
    hit = F.struct(F.col(right_ts).alias("_at"), *[F.col(v).alias(v) for v in values])
    left_type, right_type = left.schema[tie].dataType, right.schema[right_tie].dataType
    shape = left.select(
        *keys,
        F.col(left_ts).alias("_ts"),
        F.lit(1).alias(_SIDE),
        F.lit(None).cast(right_type).alias("_rank"),
        F.col(tie).alias("_tie"),
        F.struct(*left.columns).alias("_left"),
    )
    other = right.select(
        *keys,
        F.col(right_ts).alias("_ts"),
        F.lit(0).alias(_SIDE),
        F.col(right_tie).alias("_rank"),
        F.lit(None).cast(left_type).alias("_tie"),
        hit.alias("_hit"),
    )
    both = shape.unionByName(other, allowMissingColumns=True)
    if not keys:
        both = both.withColumn("_all", F.lit(0))
    line = Series.plan(both, keys or ["_all"], "_ts", (_SIDE, "_rank", "_tie"))
    found = line.running(lasts={"_hit": F.col("_hit")}).frame.where(F.col(_SIDE) == 1)
    ok = F.col("_hit").isNotNull()
    if tolerance_us is not None:
        ok = ok & (micros(F.col("_ts")) - micros(F.col("_hit._at")) <= tolerance_us)
    defaults = defaults or {}
    cols = [F.when(ok, F.col("_hit")[v]).otherwise(F.lit(defaults.get(v))).alias(v) for v in values]
    if match_ts:
        cols.append(F.when(ok, F.col("_hit._at")).alias(match_ts))
    lacking = F.col(left_ts).isNull()
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    missed = [F.lit(defaults.get(v)).cast(right.schema[v].dataType).alias(v) for v in values]
    if match_ts:
        missed.append(F.lit(None).cast(right.schema[right_ts].dataType).alias(match_ts))
    return found.select("_left.*", *cols).unionAll(left.where(lacking).select(*left.columns, *missed))


def nearest_join(targets: DataFrame, df: DataFrame, target_ts: str, ts: str, tie: str, values: list[str], tolerance_us: int, keys: list[str] | None = None) -> DataFrame:
    """Nearest row within the tolerance of each target, earliest on equal distance; nulls if none.

    Linear work: rows and distinct target times go into one union, one running pass finds the latest row at or before a
    target, a second one the earliest at or after it, and the nearer of the two wins.  No pair is formed.  Of rows with one
    time the least ``tie`` counts.
    """
    keys = keys or []
    row = F.struct(F.col(ts).alias("match_ts"), *values)
    rows = df.groupBy(*keys, ts).agg(F.min_by(row, F.col(tie)).alias("_row")).withColumnRenamed(ts, "_ts").withColumn(_SIDE, F.lit(0))
    ids = targets.select(*keys, F.col(target_ts).alias("_ts")).distinct().withColumn(_SIDE, F.lit(1))
    both = rows.unionByName(ids, allowMissingColumns=True).withColumn("_back", -micros(F.col("_ts")))
    if not keys:
        both = both.withColumn("_all", F.lit(0))
    names = keys or ["_all"]
    line = Series.plan(both, names, "_ts", (_SIDE,)).running(lasts={"_before": F.col("_row")})
    # The same pass over mirrored time gives the row after.
    turned = line.with_frame(line.frame.withColumn("_at", from_micros(F.col("_back")))).mirrored("_at").running(lasts={"_after": F.col("_row")})
    near = lambda c: F.abs(micros(F.col(c)["match_ts"]) - micros(F.col("_ts")))
    fits = lambda c: near(c) <= tolerance_us
    best = F.when(fits("_before") & ~F.coalesce(fits("_after") & (near("_after") < near("_before")), F.lit(False)), F.col("_before")).when(fits("_after"), F.col("_after"))
    found = turned.frame.where(F.col(_SIDE) == 1).select(*keys, F.col("_ts").alias(target_ts), best.alias("_row"))
    return targets.join(found, [*keys, target_ts], "left").select(*targets.columns, F.col("_row.match_ts").alias("match_ts"), *[F.col("_row")[v].alias(v) for v in values])


def spread_days(df: DataFrame, start: Column, end: Column, day: str) -> DataFrame:
    """One row per calendar day of each inclusive date range."""
    return df.withColumn(day, F.explode(F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day")))))


def effective_join(fact: DataFrame, dim: DataFrame, fact_date: str, dim_date: str, value: str) -> DataFrame:
    """Dimension value in force on the fact's date; before the first date the earliest value, null for a null date.

    The dimension is unrolled to one row per day, which turns the range condition into an equi-join that
    may be broadcast by size or shuffled.  Dates outside the dimension are moved to its nearest end.
    """
    first, last = dim.agg(F.min(dim_date)).scalar(), dim.agg(F.max(dim_date)).scalar()
    per_day = dim.groupBy(F.col(dim_date).alias("_from")).agg(F.max(value).alias(value))
    steps = Series.of(per_day.withColumn("_all", F.lit(0)), ["_all"], "_from").neighbours(next={"_to": F.col("_from")}).frame
    days = spread_days(steps, F.col("_from"), F.coalesce(F.date_sub("_to", 1), F.col("_from")), "_day").select("_day", value)
    day = F.when(F.col(fact_date).isNotNull(), F.greatest(first, F.least(last, F.col(fact_date))))
    return fact.withColumn("_day", day).join(days, "_day", "left").drop("_day")


def check_positive(df: DataFrame, value: str) -> DataFrame:
    """Fail the job when a divisor such as a headcount is not above zero."""
    return df.withColumn(value, F.when(F.col(value) > 0, F.col(value)).otherwise(F.raise_error(F.lit(f"{value} must be > 0"))))


def window_join(df: DataFrame, windows: DataFrame, day: str, shoulder_days: int = 0) -> DataFrame:
    """Daily rows inside named date windows (``part`` = inside) and in the shoulders before and after.

    ``windows`` has label, start_d, end_d; all ends are inclusive.
    """
    edges = F.array(
        F.struct(F.lit("inside").alias("part"), F.col("start_d").alias("a"), F.col("end_d").alias("b")),
        *(
            [
                F.struct(F.lit("before").alias("part"), F.date_sub("start_d", shoulder_days).alias("a"), F.date_sub("start_d", 1).alias("b")),
                F.struct(F.lit("after").alias("part"), F.date_add("end_d", 1).alias("a"), F.date_add("end_d", shoulder_days).alias("b")),
            ]
            if shoulder_days
            else []
        ),
    )
    spans = windows.select("label", F.explode(edges).alias("_e")).select("label", "_e.*")
    days = spread_days(spans, F.col("a"), F.col("b"), day).select("label", "part", day)
    return df.join(days, day)


def ranges_by_key(ranges: DataFrame, keys: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """Configured ranges as one short array per entity."""
    return ranges.groupBy(*keys).agg(F.collect_list(F.struct(F.col(low).alias("low"), F.col(high).alias("high"))).alias("_ranges"))


def in_ranges(df: DataFrame, ranges: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Flag values inside any configured range of their entity, both ends included."""
    test = F.exists("_ranges", lambda r: F.col(value).between(r["low"], r["high"]))
    return df.join(ranges_by_key(ranges, keys), keys, "left").withColumn(name, F.coalesce(test, F.lit(False))).drop("_ranges")


def timeline(*parts: DataFrame) -> DataFrame:
    """Distinct (key, time) points of several signals; partial distinct runs before the shuffle."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()

