"""Dashboard statistics over keyed readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hour_between, period, power_kw, prev_working_day
from .asof import window_join
from .lineage import cut
from .quantiles import exact_median, exact_quantiles
from .sequences import mask_events, substantial, with_gaps
from .series import SECOND, Series, fits_one_task, micros, null_safe_join, spread_by_key


def weekly_dense(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Totals per Monday week; empty weeks between a key's first and last week are zero."""
    week = period(F.col(ts), "week").alias("week")
    sums = df.groupBy(*keys, week).agg(F.sum(value).alias("total"))
    grid = sums.groupBy(*keys).agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days"))).alias("week"))
    return grid.join(sums, [*keys, "week"], "left").fillna(0.0, subset=["total"])


def monthly(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    return df.groupBy(*keys, period(F.col(day), "month").alias("month")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))


def stats_with_fallback(df: DataFrame, keys: list[str], ts: str, value: str, valid: Column, year_start: Column, since: Column | None = None) -> DataFrame:
    """Max, total and error count in the look-back window, total and first day since ``year_start``.

    Valid rows decide when a key has any, all rows otherwise.
    """
    recent = F.lit(True) if since is None else F.col(ts) >= since
    ok, this_year = F.coalesce(valid, F.lit(False)), F.col(ts) >= year_start

    def pick(agg, column: Column, scope: Column) -> Column:
        good = F.count_if(scope & ok) > 0
        return F.when(good, agg(F.when(scope & ok, column))).otherwise(agg(F.when(scope, column)))

    v = F.col(value)
    return df.groupBy(*keys).agg(
        pick(F.max, v, recent).alias("max_value"),
        pick(F.sum, v, recent).alias("total"),
        F.count_if(recent & ~ok).alias("errors"),
        pick(F.sum, v, this_year).alias("year_total"),
        pick(F.min, F.col(ts), this_year).cast("date").alias("year_first_day"),
    )


def latest(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, valid: Column) -> DataFrame:
    """Latest valid value of a key, else its latest value of all."""
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col(ts).alias("t")), F.struct(F.coalesce(valid, F.lit(False)).cast("int"), ts, tie))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias("latest_value"), F.col("_b.t").alias("latest_ts"))


def latest_rows(df: DataFrame, keys: list[str], ts: str, tie: str, n: int = 10) -> DataFrame:
    """The ``n`` newest rows of each key; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def summary_argmax(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    first_max = F.min_by(day, F.struct(-F.col(value), F.col(day)))
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("max_value"), first_max.alias("max_day"), F.count("*").alias("days"))


def day_change(df: DataFrame, keys: list[str], day: str, value: str, as_of: Column) -> DataFrame:
    """Value of the last working day before ``as_of`` and its change from the working day before."""
    d1 = prev_working_day(as_of)
    d0 = prev_working_day(d1)

    def on(d: Column) -> Column:
        return F.max(F.when(F.col(day) == d, F.col(value)))

    return df.groupBy(*keys).agg(F.coalesce(on(d1), F.lit(0.0)).alias("previous_day"), F.coalesce(on(d1) - on(d0), F.lit(0.0)).alias("change"))


def trend_pct(df: DataFrame, keys: list[str], day: str, value: str, as_of: Column, days: int = 365) -> DataFrame:
    """Percent change of a least-squares line from the first to the last day of the look-back."""
    last_year = df.where(F.col(day) >= F.date_sub(as_of, days))
    x, y = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double"), F.coalesce(F.col(value), F.lit(0.0))
    fit = last_year.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_m"), F.regr_intercept(y, x).alias("_c"), F.min(x).alias("_a"), F.max(x).alias("_b"), F.count("*").alias("days")
    )
    start = F.col("_c") + F.col("_m") * F.col("_a")
    pct = F.col("_m") * (F.col("_b") - F.col("_a")) / start * 100
    use = (F.col("days") >= 2) & F.col("_m").isNotNull() & (start > 0)
    return fit.select(*keys, "days", F.when(use, pct).otherwise(0.0).alias("trend_pct"))


def idle_power(df: DataFrame, keys: list[str], ts: str, kwh: str) -> DataFrame:
    night = F.when(hour_between(F.col(ts), 1, 5), power_kw(F.col(kwh)))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(night), F.lit(0.0)).alias("idle_kw"))


def energy_split(df: DataFrame, keys: list[str], ts: str, kwh: str, hours: float = 168.0) -> DataFrame:
    """Idle and active energy of the period in percent of the total; idle may exceed 100."""
    night = F.when(hour_between(F.col(ts), 1, 5), power_kw(F.col(kwh)))
    both = df.groupBy(*keys).agg(F.coalesce(F.avg(night), F.lit(0.0)).alias("idle_kw"), F.sum(kwh).alias("total_kwh"))
    idle, total = F.col("idle_kw") * hours, F.col("total_kwh")
    active = F.greatest(total - idle, F.lit(0.0))
    return both.where(total > 0).select(
        *keys, "idle_kw", "total_kwh", idle.alias("idle_kwh"), active.alias("active_kwh"), (idle / total * 100).alias("idle_pct"), (active / total * 100).alias("active_pct")
    )


def shutdown_savings(df: DataFrame, windows: DataFrame, day: str, value: str, keys: list[str] | None = None, shoulder_days: int = 21) -> DataFrame:
    """Energy saved in each named window against the mean of the days around it."""
    keys = keys or []
    joined = window_join(df, windows, day, shoulder_days)
    inside, v = F.col("part") == "inside", F.col(value)
    agg = joined.groupBy(*keys, "label").agg(
        F.count_if(inside).alias("days_with_data"),
        F.count_if(~inside).alias("baseline_days"),
        F.avg(F.when(~inside, v)).alias("_base"),
        F.sum(F.when(inside, v)).alias("_actual"),
    )
    expected = F.when((F.col("days_with_data") > 0) & (F.col("baseline_days") > 0), F.col("_base") * F.col("days_with_data"))
    saved = expected - F.col("_actual")
    return agg.select(
        *keys,
        "label",
        "days_with_data",
        "baseline_days",
        F.round(F.when(expected.isNotNull(), F.col("_base")), 1).alias("baseline_per_day"),
        F.round(expected, 1).alias("expected"),
        F.round("_actual", 1).alias("actual"),
        F.round(saved, 1).alias("saved"),
        F.round(F.when(expected > 0, saved / expected * 100), 1).alias("saved_pct"),
    )


def comparison_windows(before_anchor: str, after_anchor: str, days: int = 90) -> list[tuple]:
    """(label, first day, last day) of the period ending before one date and the one starting after another."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(before_anchor), date.fromisoformat(after_anchor)
    return [("before", a - timedelta(days=days), a - timedelta(days=1)), ("after", b + timedelta(days=1), b + timedelta(days=days))]


def compare_periods(df: DataFrame, keys: list[str], day: str, value: str, before_anchor: str, after_anchor: str, days: int = 90, small: bool | None = None) -> DataFrame:
    """Daily statistics of the periods before and after a change, with differences, one row per key."""
    (_, a0, a1), (_, b0, b1) = comparison_windows(before_anchor, after_anchor, days)
    d = F.col(day)
    label = F.when(d.between(F.lit(a0), F.lit(a1)), "before").when(d.between(F.lit(b0), F.lit(b1)), "after")
    tagged = df.withColumn("_p", label).where(F.col("_p").isNotNull())
    ids = [*keys, "_p"]
    stats = tagged.groupBy(*ids).agg(F.count("*").alias("days"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    stats = null_safe_join(stats, exact_median(tagged, ids, F.col(value), "median", small), ids, "left")
    names = ["days", "total", "mean", "median", "min", "max"]
    side = lambda p, n: F.max(F.when(F.col("_p") == p, F.col(n))).alias(f"{p}_{n}")
    wide = stats.groupBy(*keys).agg(*[side(p, n) for p in ("before", "after") for n in names])
    for n in ("total", "mean"):
        diff = F.col(f"after_{n}") - F.col(f"before_{n}")
        wide = wide.withColumn(f"{n}_diff", diff).withColumn(f"{n}_pct", F.when(F.col(f"before_{n}") != 0, diff / F.col(f"before_{n}") * 100))
    return wide


def share_hours(df: DataFrame, keys: list[str], value: str, threshold: float, active_threshold: float = 8.0) -> DataFrame:
    """Share of samples above a threshold as hours per day, mean above it, and idle/active percent."""
    v = F.col(value)
    active = F.avg((v >= active_threshold).cast("double")) * 100
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        (F.avg((v > threshold).cast("double")) * 24).alias("hours_per_day"),
        F.avg(F.when(v > threshold, v)).alias("mean_above"),
        active.alias("active_pct"),
        (F.lit(100.0) - active).alias("idle_pct"),
        F.count("*").alias("samples"),
    )


def weighted_pct(s: Series, is_open: str, is_light: str, open_size: int = 10, night_size: int = 100, night: tuple[int, int] = (19, 7)) -> DataFrame:
    """Time-weighted percent of open sash and light, all hours and at night, counting large events only.

    A sample weighs the gap to the next one (the median gap for the last), at most max(30 min, 3 medians).
    """
    keys = list(s.keys)
    night_col = hour_between(F.col(s.ts), *night)
    base = with_gaps(s, 1800 * SECOND, 3.0)
    lone = F.lit(60.0 * SECOND)
    typical = F.coalesce(F.col("_typical"), lone)
    cap = F.greatest(F.lit(1800.0 * SECOND), typical * 3)
    gap = F.coalesce((F.col("_next_us") - F.col("_us")).cast("double"), typical)
    df = base.frame.select(*s.frame.columns, F.greatest(F.lit(0.0), F.least(gap, cap)).alias("_w"), night_col.alias("_night"), cap.alias("_cap"))
    rows = s.with_frame(cut(df))  # four uses follow
    df = rows.frame

    def events(mask: Column, size: int, strict: bool, name: str) -> DataFrame:
        act, summary = mask_events(rows, mask, F.col("_cap"))
        return substantial(act, summary, size, strict).select(*keys, "_w").groupBy(*keys).agg(F.sum("_w").alias(name))

    is_open, is_light = F.col(is_open), F.col(is_light)
    totals = df.groupBy(*keys).agg(F.sum("_w").alias("_all"), F.sum(F.when(F.col("_night"), F.col("_w"))).alias("_nights"), F.sum(F.when(is_light & F.col("_night"), F.col("_w"))).alias("_light_night"))
    parts = [
        events(is_open, open_size, True, "_open"),
        events(is_open & F.col("_night"), night_size, False, "_open_night"),
        events(is_light, open_size, True, "_light"),
    ]
    for p in parts:
        totals = totals.join(p, keys, "left")
    pct = lambda part, whole: F.when(F.col(whole) > 0, F.coalesce(F.col(part), F.lit(0.0)) / F.col(whole) * 100)
    return totals.select(
        *keys,
        F.round(pct("_open", "_all"), 2).alias("pct_open"),
        F.round(pct("_open_night", "_nights"), 2).alias("pct_open_night"),
        F.round(pct("_light", "_all"), 2).alias("pct_light"),
        F.round(pct("_light_night", "_nights"), 2).alias("pct_light_night"),
        F.round(F.col("_nights") / F.lit(3600e6), 2).alias("night_hours"),
    )


def entities_all_days(df: DataFrame, keys: list[str], ts: str, days: list) -> DataFrame:
    """Entities with rows on every wanted day, with row counts."""
    day = F.col(ts).cast("date")
    per_day = df.where(day.isin([F.lit(d).cast("date") for d in days])).groupBy(*keys, day.alias("_d")).agg(F.count("*").alias("_n"))
    return per_day.groupBy(*keys).agg(F.count("*").alias("days"), F.sum("_n").alias("rows")).where(F.col("days") == len(days))


def busiest(df: DataFrame, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), *keys).limit(1)


def pick_entity(df: DataFrame, keys: list[str], ts: str, days: list) -> DataFrame:
    """First entity with rows on every wanted day, else the first entity."""
    full = entities_all_days(df, keys, ts, days).select(*keys, F.lit(0).alias("_o"))
    every = df.select(*keys).distinct().withColumn("_o", F.lit(1))
    return full.unionByName(every).orderBy("_o", *keys).limit(1).drop("_o")


def burst_median(df: DataFrame, keys: list[str], value: str, small: bool | None = None) -> DataFrame:
    """Median of a burst's non-zero samples; 0 when all are zero, null when there are none."""
    v = F.col(value)
    seen = df.groupBy(*keys).agg(F.count(v).alias("_n"))
    mid = exact_median(df.where(v != 0), keys, v, "_m", small)
    out = F.when(F.col("_n") > 0, F.coalesce(F.col("_m"), F.lit(0.0)))
    return null_safe_join(seen, mid, keys, "left").select(*keys, out.alias("burst_value"))


def noise_threshold(df: DataFrame, keys: list[str], value: str, factor: float = 2.0, small: bool | None = None) -> DataFrame:
    """Robust noise level: 1.4826 * MAD, the sample deviation when that is zero; threshold = factor * level."""
    v = F.col(value)
    small = fits_one_task(df) if small is None else small
    centre = exact_median(df, keys, v, "_mid", small)
    spread = null_safe_join(df, centre, keys) if small else spread_by_key(df, centre, keys, "inner", null_safe=True)
    mad = exact_median(spread, keys, F.abs(v - F.col("_mid")), "mad", small)
    dev = df.groupBy(*keys).agg(F.stddev_samp(v).alias("_sd"))
    sigma = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).otherwise(F.col("_sd"))
    return null_safe_join(dev, mad, keys, "left").select(*keys, sigma.alias("sigma"), F.when(sigma > 0, sigma * factor).otherwise(0.0).alias("threshold"))


def band_summary(events: DataFrame, band: str, minutes: str, litres: str, small: bool | None = None) -> DataFrame:
    """Events, litres, median length and percent of litres per band; events outside all bands are left out."""
    inside = events.where(F.col(band).isNotNull())
    sums = inside.groupBy(band).agg(F.count("*").alias("events"), F.sum(litres).alias("litres"))
    mid = exact_median(inside, [band], F.col(minutes), "median_minutes", small)
    total = inside.agg(F.sum(litres)).scalar()
    return sums.join(mid, band).withColumn("pct_litres", F.when(total > 0, F.col("litres") / total * 100).otherwise(0.0))


def length_histogram(events: DataFrame, minutes: str) -> DataFrame:
    return events.groupBy(F.floor(minutes).alias("minute")).agg(F.count("*").alias("events"))


def length_percentiles(events: DataFrame, keys: list[str], minutes: str, small: bool | None = None) -> DataFrame:
    return exact_quantiles(events, keys, F.col(minutes), {"p95": 0.95, "p99": 0.99}, small)


def week_band(events: DataFrame, ts: str, band: str, litres: str, labels: list[str]) -> DataFrame:
    """Litres per week (ending Sunday) and band, as columns; empty cells are zero."""
    kept = events.where(F.col(band).isNotNull()).withColumn("week_end", period(F.col(ts), "week_end"))
    return kept.groupBy("week_end").pivot(band, labels).agg(F.sum(litres)).fillna(0.0, subset=labels)


def drop_empty_columns(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Leave out value columns without any positive total (reads one row of sums)."""
    sums = wide.agg(*[F.sum(c).alias(c) for c in columns]).first()
    return wide.drop(*[c for c in columns if not (sums[c] or 0) > 0])


def baseline_shift(df: DataFrame, group: str, ts: str, value: str, shifted: str, reference: str, name: str, opening_us: int = 300 * SECOND) -> DataFrame:
    """Move one group's values so that its opening mean meets the reference group's."""
    at, pair = F.col(ts), df.where(F.col(group).isin(shifted, reference))
    of = lambda g, c: F.when(F.col(group) == g, c)
    start = pair.agg(F.struct(F.min(of(shifted, at)).alias("s"), F.min(of(reference, at)).alias("r"))).scalar()
    opened = micros(F.when(F.col(group) == shifted, start["s"]).otherwise(start["r"]))
    mean = lambda g: F.avg(of(g, F.col(value)))
    offset = pair.where(micros(at) < opened + opening_us).agg(mean(shifted) - mean(reference)).scalar()
    return df.withColumn(name, F.when(F.col(group) == shifted, F.col(value) - offset).otherwise(F.col(value)))


def window_scale(df: DataFrame, group: str, ts: str, value: str, scaled: str, scaled_window: tuple, reference: str, reference_window: tuple, name: str) -> DataFrame:
    """Scale one group by the ratio of window means; fails when a window is empty or its mean is zero."""

    def mean(g: str, w: tuple) -> Column:
        return F.avg(F.when((F.col(group) == g) & F.col(ts).between(F.lit(w[0]).cast("timestamp_ntz"), F.lit(w[1]).cast("timestamp_ntz")), F.col(value)))

    ratio = df.agg(mean(reference, reference_window).alias("r"), mean(scaled, scaled_window).alias("s")).select(
        F.when(F.col("r").isNull() | F.col("s").isNull(), F.raise_error(F.lit("no samples in a reference window")).cast("double"))
        .when(F.col("s") == 0, F.raise_error(F.lit("reference window average is zero")).cast("double"))
        .otherwise(F.col("r") / F.col("s"))
    ).scalar()
    return df.withColumn(name, F.when(F.col(group) == scaled, F.col(value) * ratio).otherwise(F.col(value)))


def padded_limits(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Axis limits: min and max with 5 % of the span, or of the value when the span is zero."""
    m = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    span = F.col("_b") - F.col("_a")
    pad = F.when(span > 0, span * 0.05).otherwise(F.greatest(F.abs("_b") * 0.05, F.lit(1.0)))
    low, high = F.coalesce(F.col("_a") - pad, F.lit(0.0)), F.coalesce(F.col("_b") + pad, F.lit(1.0))
    return m.select(*keys, low.alias("low"), high.alias("high"))


def error_counts(df: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(f)).alias(f) for f in flags], F.count("*").alias("rows"))


def interval_volume(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int = 5) -> DataFrame:
    """Sum per tumbling interval, only intervals above zero."""
    start = F.floor(micros(F.col(ts)) / (seconds * SECOND)) * (seconds * SECOND)
    sums = df.groupBy(*keys, start.alias("_s")).agg(F.sum(value).alias("volume")).where(F.col("volume") > 0)
    return sums.select(*keys, F.timestamp_micros("_s").cast("timestamp_ntz").alias("interval_start"), "volume")


def daily_table(df: DataFrame, day: str, value: str, months: DataFrame | None = None) -> DataFrame:
    """Daily rows with date text, year and month name, optionally only the wanted (year, month) pairs."""
    d = F.col(day)
    out = df.withColumn("date_text", F.date_format(d, "yyyy-MM-dd")).withColumn("year", F.year(d)).withColumn("month", F.date_format(d, "MMM")).withColumn(value, F.round(value, 2))
    return out if months is None else out.join(months, ["year", "month"], "left_semi")
