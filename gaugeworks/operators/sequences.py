"""Gap segments, state intervals, runs, rolling values and sensor error masks over a ``Series``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import ranges_by_key
from .quantiles import exact_median
from .series import MINUTE, SECOND, Series, from_micros, micros



def _reading_gaps(s: Series, extra_prev: dict | None = None, extra_next: dict | None = None) -> Series:
    at = micros(F.col(s.ts))
    s = s.neighbours({"_prev_us": at, **(extra_prev or {})}, {"_next_us": at, **(extra_next or {})})
    return s.with_frame(s.frame.withColumn("_us", micros(F.col(s.ts))))


def typical_gap(gaps: Series) -> DataFrame:
    """Exact median gap (microseconds) between consecutive rows of each key; absent for single rows."""
    return exact_median(gaps.frame, list(gaps.keys), F.col("_us") - F.col("_prev_us"), "_typical", small=not gaps.chunked)


def with_gaps(s: Series, floor_us: int = 30 * MINUTE, factor: float = 3.0, prev: dict | None = None, next: dict | None = None) -> Series:
    """Add ``_prev_us``, ``_next_us``, ``_us``, ``_typical`` and the break threshold ``_limit`` of the key.

    The neighbour times serve the median and all later steps, so a chunked series writes them once.
    """
    gaps = _reading_gaps(s, prev, next).settle()
    gaps = gaps.attach(typical_gap(gaps))
    limit = F.greatest(F.lit(float(floor_us)), F.col("_typical") * factor)
    return gaps.with_frame(gaps.frame.withColumn("_limit", limit))


def breaks_before() -> Column:
    return F.col("_prev_us").isNull() | (F.col("_us") - F.col("_prev_us") > F.col("_limit"))


def breaks_after() -> Column:
    return F.col("_next_us").isNull() | (F.col("_next_us") - F.col("_us") > F.col("_limit"))


def segments(s: Series, name: str = "segment", floor_us: int = 30 * MINUTE, factor: float = 3.0) -> Series:
    """Number the stretches of a key between gaps longer than max(floor, factor * median gap), from 1."""
    g = with_gaps(s, floor_us, factor)
    g = g.with_frame(g.frame.withColumn("_new", breaks_before().cast("long")))
    return g.running(sums={name: F.col("_new")})


def meter_delta(s: Series, cumulative: str, name: str) -> DataFrame:
    """Interval reading from a cumulative one, stamped at the interval end; a null ends both its intervals."""
    lag = s.neighbours({"_before": F.col(cumulative)}).frame
    return lag.withColumn(name, F.col(cumulative) - F.col("_before")).where(F.col(name).isNotNull()).drop("_before", "_chunk")


def daily_delta(df: DataFrame, keys: list[str], ts: str, tie: str, cumulative: str, name: str) -> DataFrame:
    """Second daily reading minus the first: consecutive first readings of calendar days."""
    day = F.col(ts).cast("date")
    daily = df.groupBy(*keys, day.alias("d")).agg(F.min_by(cumulative, F.struct(ts, tie)).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("d")  # one row per day is left
    return daily.select(*keys, "d", (F.lead("_first").over(w) - F.col("_first")).alias(name))


def rolling_rows(df: DataFrame, keys: list[str], order: str, value: str, name: str, rows: int = 7) -> DataFrame:
    """Mean of the last ``rows`` rows of a per-day table (shorter at the start)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.avg(value).over(w))


def sliding_sum(s: Series, step: Column, name: str, frame_us: int, closed: bool) -> Series:
    """Sum of ``step`` over rows of (t - frame, t], or of [t - frame, t] if ``closed``, at each row's time t.

    The sum is a difference of two running totals: the one at t and the one at the frame's start.  Rows are added up per
    time first; each time then asks for the total at its frame's start by a row of its own in the same running pass, so no
    row is copied into another's frame however many rows a frame holds.
    """
    keys = list(s.keys)
    moments = s.frame.groupBy(*keys, micros(F.col(s.ts)).alias("_t")).agg(F.sum(step).alias("_d"))
    asked = F.col("_t") - (frame_us + 1 if closed else frame_us)
    probes = moments.select(*keys, asked.alias("_at"), F.lit(1).alias("_ask"), F.col("_t"), F.lit(None).cast(moments.schema["_d"].dataType).alias("_d"))
    both = moments.select(*keys, F.col("_t").alias("_at"), F.lit(0).alias("_ask"), "_t", "_d").unionByName(probes)
    line = Series.plan(both, keys, "_at", ("_ask",)).running(sums={"_sum": F.coalesce(F.col("_d"), F.lit(0))})
    at = lambda ask: F.max(F.when(F.col("_ask") == ask, F.col("_sum")))
    sums = line.frame.groupBy(*keys, "_t").agg((at(0) - F.coalesce(at(1), F.lit(0))).alias(name))
    marked = s.frame.withColumn("_t", micros(F.col(s.ts)))
    return s.with_frame(marked.join(sums, [*keys, "_t"], "left").drop("_t"))


def rolling_change(s: Series, value: Column, name: str, frame_us: int = 5 * MINUTE) -> Series:
    """Sum of row-to-row changes over (t - frame, t]; the first row of a key counts as no change."""
    lag = s.neighbours({"_before": value}).settle()
    out = sliding_sum(lag, F.coalesce(value - F.col("_before"), F.lit(0.0)), name, frame_us, closed=False)
    return out.with_frame(out.frame.drop("_before"))


def burst_counts(s: Series, hit: Column, name: str, frame_us: int = 600 * SECOND) -> Series:
    """Hits within [t - frame, t], both ends included."""
    return sliding_sum(s, F.coalesce(hit, F.lit(False)).cast("long"), name, frame_us, closed=True)


def light_errors(s: Series, value: str, name: str, min_run: int = 10, high: float = 500.0) -> Series:
    """Zeros in runs shorter than ``min_run`` rows, and any value above ``high``."""
    halo = s.row_halo(min_run - 1, min_run - 1)
    w = halo.window()
    back = Window.partitionBy(*halo.parts).orderBy(*[F.desc(c) for c in s.order])
    zero = F.coalesce(F.col(value) == 0, F.lit(False))

    df = halo.frame.withColumn("_zero", zero)
    for label, order in (("_left", w), ("_right", back)):
        df = df.withColumn("_pos", F.row_number().over(order))
        last_other = F.max(F.when(~F.col("_zero"), F.col("_pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn(label, F.col("_pos") - F.coalesce(last_other, F.lit(0)))
    short = F.col("_zero") & (F.col("_left") + F.col("_right") - 1 < min_run)
    error = short | F.coalesce(F.col(value) > high, F.lit(False))
    out = halo.with_frame(df.withColumn(name, error)).owned().judged()
    return out.with_frame(out.frame.drop("_zero", "_left", "_right", "_pos"))


def distance_errors(s: Series, value: str, name: str, ranges: DataFrame | None = None, echo: int = 4, descending: bool = False) -> Series:
    """Negative values with the ``echo`` rows after them, and values in an excluded range of the entity.

    ``descending`` marks the rows before a negative one instead, as on newest-first input.
    """
    halo = s.row_halo(0 if descending else echo, echo if descending else 0)
    frame = halo.window().rowsBetween(0, echo) if descending else halo.window().rowsBetween(-echo, 0)
    echoed = F.max(F.coalesce(F.col(value) < 0, F.lit(False))).over(frame)
    out = halo.with_frame(halo.frame.withColumn(name, echoed)).owned().judged()
    if ranges is None:
        return out
    excluded = F.exists("_ranges", lambda r: F.col(value).between(r["low"], r["high"]))
    out = out.attach(ranges_by_key(ranges, list(s.keys)))
    return out.with_frame(out.frame.withColumn(name, F.col(name) | F.coalesce(excluded, F.lit(False))).drop("_ranges"))


def flag_intervals(s: Series, flag: str, end: str = "next", floor_us: int = 30 * MINUTE, factor: float = 3.0, lone_gap_us: int = 5 * MINUTE) -> DataFrame:
    """Intervals of consecutive true rows, cut at gaps: key columns, start_ts, end_ts, samples.

    ``end="next"`` closes an interval at the following row of the segment when there is one, ``"pad"``
    always at the last true row plus the median gap.
    """
    on = F.coalesce(F.col(flag), F.lit(False))
    g = with_gaps(s, floor_us, factor, {"_prev_on": on}, {"_next_on": on})
    pad = F.coalesce(F.col("_typical"), F.lit(float(lone_gap_us)))
    limit = F.greatest(F.lit(float(floor_us)), pad * factor) if end == "pad" else F.col("_limit")
    df = g.frame.withColumn("_limit", limit)
    begins = on & (breaks_before() | ~F.col("_prev_on"))
    own_end = F.col("_us") + pad.cast("long")
    close = own_end if end == "pad" else F.when(breaks_after(), own_end).otherwise(F.col("_next_us"))
    df = df.withColumn("_begin", begins.cast("long")).withColumn("_close", close).withColumn("_on", on)
    spans = g.with_frame(df).running(sums={"_island": F.col("_begin")}).frame.where("_on")
    return (
        spans.groupBy(*s.keys, "_island")
        .agg(F.min(s.ts).alias("start_ts"), from_micros(F.max_by("_close", F.struct(*s.order))).alias("end_ts"), F.count("*").alias("samples"))
        .drop("_island")
    )


def mask_events(s: Series, active: Column, limit_us: Column | int, value: str | None = None, name: str = "event_id") -> tuple[Series, DataFrame]:
    """Events among active rows only: (active rows numbered by event, one summary row per event).

    ``limit_us`` is the longest gap inside an event; a column must be constant within a key.
    """
    act = s.with_frame(s.frame.where(active)).neighbours({"_prev_us": micros(F.col(s.ts))})
    limit = F.lit(limit_us) if isinstance(limit_us, int) else limit_us
    new = F.col("_prev_us").isNull() | (micros(F.col(s.ts)) - F.col("_prev_us") > limit)
    rows = act.with_frame(act.frame.withColumn("_new", new.cast("long"))).running(sums={name: F.col("_new")})
    rows = rows.with_frame(rows.frame.drop("_prev_us", "_new"))
    keys = [*s.keys, name]
    aggs = [F.min(s.ts).alias("event_start"), F.max(s.ts).alias("event_end"), F.count("*").alias("samples")]
    if value:
        aggs.append(F.max(value).alias("max_value"))
    summary = rows.frame.groupBy(*keys).agg(*aggs)
    minutes = (micros(F.col("event_end")) - micros(F.col("event_start"))) / F.lit(60e6)
    summary = summary.withColumn("duration_minutes", minutes)
    if value:
        mid = exact_median(rows.frame, keys, F.col(value), "median_value", small=not s.chunked)
        summary = summary.join(mid, keys, "left")
    return rows, summary


def size_filter(summary: DataFrame, min_samples: int, strict: bool) -> DataFrame:
    return summary.where(F.col("samples") > min_samples if strict else F.col("samples") >= min_samples)


def substantial(rows: Series, summary: DataFrame, min_samples: int, strict: bool, name: str = "event_id") -> DataFrame:
    """Active rows that belong to events of the wanted size."""
    kept = size_filter(summary, min_samples, strict).select(*rows.keys, name)
    return rows.frame.join(kept, [*rows.keys, name], "left_semi")


def presence_hours(s: Series, flag: str, floor_us: int = 30 * MINUTE, factor: float = 3.0) -> DataFrame:
    """Hours per key and day during which the flag was 1; days with readings but no presence give 0.

    A reading holds until the next one of its segment; the stretch is cut at midnight.
    """
    g = with_gaps(s, floor_us, factor)
    a, b = from_micros(F.col("_us")), from_micros(F.col("_next_us"))
    first, last = a.cast("date"), from_micros(F.col("_next_us") - 1).cast("date")
    holds = (F.col(flag) == 1) & ~breaks_after() & (F.col("_next_us") > F.col("_us"))
    pieces = F.transform(
        F.sequence(first, last, F.expr("interval 1 day")),
        lambda d: F.struct(
            d.alias("day"),
            (
                F.least(micros(b), micros(F.date_add(d, 1).cast("timestamp_ntz"))) - F.greatest(micros(a), micros(d.cast("timestamp_ntz")))
            ).alias("us"),
            F.lit(0).alias("read"),
        ),
    )
    seen = F.array(F.struct(first.alias("day"), F.lit(0).cast("long").alias("us"), F.lit(1).alias("read")))
    per_row = g.frame.select(*s.keys, F.explode(F.when(holds, F.concat(seen, pieces)).otherwise(seen)).alias("_p"))
    return (
        per_row.groupBy(*s.keys, F.col("_p.day").alias("day"))
        .agg((F.sum("_p.us") / F.lit(3600e6)).alias("hours_present"), F.max("_p.read").alias("_read"))
        .where(F.col("_read") == 1)
        .drop("_read")
    )


def runs(s: Series, active: Column, value: str, floor_us: int = 180 * SECOND, factor: float = 3.0, lone_gap_us: int = 60 * SECOND) -> DataFrame:
    """Runs of active rows with totals; a run lasts from its first to its last row plus one median gap."""
    act = s.with_frame(s.frame.where(active))
    seg = segments(act, "run", floor_us, factor).frame
    out = seg.groupBy(*s.keys, "run").agg(
        F.min(s.ts).alias("start_ts"),
        F.max(s.ts).alias("end_ts"),
        F.sum(value).alias("total"),
        F.count("*").alias("samples"),
        F.max("_typical").alias("_typical"),
    )
    length = micros(F.col("end_ts")) - micros(F.col("start_ts")) + F.coalesce(F.col("_typical"), F.lit(float(lone_gap_us)))
    return out.withColumn("duration_minutes", length / F.lit(60e6)).drop("_typical")


def _fit_weights(width: int) -> list[list[float]]:
    """Row i: weights of a quadratic fit over ``width`` points evaluated at point i."""
    import numpy as np

    design = np.vander(np.arange(width, dtype=float) - width // 2, 3)
    return (design @ np.linalg.pinv(design)).tolist()


def savgol(s: Series, value: str, name: str) -> Series:
    """Quadratic smoothing over 9 rows (7 for series of 7 or 8 rows, none below 7), ends fitted.

    Every row sees at most eight rows on each side, so border copies of eight rows make chunks exact.
    """
    halo = s.row_halo(8, 8)
    w = halo.window()
    whole = Window.partitionBy(*halo.parts)

    def smooth(width: int) -> Column:
        half, pos, n = width // 2, F.col("_pos"), F.col("_len")
        centre = F.greatest(F.lit(half + 1), F.least(pos, n - half))
        window_start = centre - half
        around_start = F.greatest(pos - 8, F.lit(1))
        points = F.slice(F.col("_around"), (window_start - around_start + 1).cast("int"), width)
        table = F.array(*[F.array(*[F.lit(v) for v in row]) for row in _fit_weights(width)])
        weights = F.element_at(table, (pos - window_start + 1).cast("int"))
        return F.aggregate(F.zip_with(points, weights, lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)

    df = (
        halo.frame.withColumn("_pos", F.row_number().over(w))
        .withColumn("_len", F.count("*").over(whole))
        .withColumn("_around", F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-8, 8)))
    )
    smoothed = F.when(F.col("_len") < 7, F.col(value)).when(F.col("_len") < 9, smooth(7)).otherwise(smooth(9))
    out = halo.with_frame(df.withColumn(name, smoothed)).owned().judged()
    return out.with_frame(out.frame.drop("_pos", "_len", "_around"))


def extrema(s: Series, value: str, threshold: Column | str, name: str = "kind") -> Series:
    """Local maxima and minima whose size reaches the threshold; first and last rows never count."""
    n = s.neighbours({"_before": F.col(value)}, {"_after": F.col(value)})
    v, p, q = F.col(value), F.col("_before"), F.col("_after")
    limit = F.col(threshold) if isinstance(threshold, str) else threshold
    kind = F.when((v >= p) & (v > q), "max").when((v <= p) & (v < q), "min")
    df = n.frame.withColumn(name, kind).where(F.col(name).isNotNull() & (F.abs(v) >= limit) & (limit > 0))
    return replace(n, frame=df.drop("_before", "_after"), whole=False)


def run_lengths(s: Series, rules: dict[str, tuple[Column, str | None]]) -> Series:
    """Rows so far in the current unbroken run of member rows (0 outside), one column per rule.

    A rule is (membership, column): with a column the run also needs an unchanged value of it.  All rules
    share two passes: one numbers the rows and looks back a row, one carries each run's first row number.
    """
    one = F.lit(1).cast("long")
    member = {n: F.coalesce(m, F.lit(False)) for n, (m, _) in rules.items()}
    prev = {"_p_" + n: m for n, m in member.items()}
    prev |= {"_v_" + n: F.col(same) for n, (_, same) in rules.items() if same}
    base = s.scan(prev=prev, sums={"_rn": one}).settle()
    starts = {}
    for n, (_, same) in rules.items():
        fresh = ~F.coalesce(F.col("_p_" + n), F.lit(False))
        if same:
            fresh = fresh | ~F.coalesce(F.col("_v_" + n) == F.col(same), F.lit(False))
        starts["_s_" + n] = F.when(member[n] & fresh, F.col("_rn"))
    out = base.running(lasts=starts)
    zero = F.lit(0).cast("long")
    lengths = {n: F.when(member[n], F.col("_rn") - F.col("_s_" + n) + 1).otherwise(zero) for n in rules}
    return out.with_frame(out.frame.withColumns(lengths).drop("_rn", *prev, *starts))


def alerts(s: Series, distance: str, light: str, zero_distance: int = 10, zero_light: int = 5, same_light: int = 5, missing_light: int = 3) -> DataFrame:
    """Rows at which a sensor-health counter has reached its limit, one row per rule."""
    limits = {"zero_distance": zero_distance, "zero_light": zero_light, "identical_light": same_light, "missing_light": missing_light}
    d, x = F.col(distance), F.col(light)
    rules = {"zero_distance": (d == 0, None), "zero_light": (x == 0, None), "identical_light": (x.isNotNull(), light), "missing_light": (x.isNull(), None)}
    counted = run_lengths(s, rules).rows()
    hits = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("run"), F.lit(n).alias("_min")) for r, n in limits.items()])
    rows = counted.select(*s.keys, *s.order, F.explode(F.filter(hits, lambda h: h["run"] >= h["_min"])).alias("_h"))
    return rows.select(*s.keys, *s.order, "_h.rule", "_h.run")
