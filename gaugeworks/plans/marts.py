"""Dashboard tables: stat cards, chart series and latest rows of each dashboard, as frames to write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import kwh_context, water_error
from ..operators import sequences, stats, stock, usage, waste
from ..operators.series import Series


def hood_marts(readings: DataFrame, hoods: DataFrame, ranges: DataFrame, keys: list[str], ts: str, tie: str) -> dict[str, DataFrame]:
    """Sash, light and presence of hoods from readings with distance and light."""
    s = Series.plan(readings, keys, ts, (tie,))
    flagged = sequences.light_errors(sequences.distance_errors(s, "distance", "distance_error", ranges), "light", "light_error").settle()
    clean = flagged.rows()
    good_distance, good_light = clean.where(~F.col("distance_error")), clean.where(~F.col("light_error"))
    sash = usage.calibrate(good_distance, hoods, keys, "distance")
    lights = usage.presence(good_light, hoods, keys, "light", "room_lux")
    ours = good_distance.join(hoods.select(*keys), keys, "left_semi"), good_light.join(hoods.select(*keys), keys, "left_semi")
    state = usage.usage_state(*ours, keys, ts, tie, "distance", "light", hoods)
    hours = sequences.presence_hours(Series.plan(lights, keys, ts, (tie,)), "presence")
    latest_distance = stats.latest(clean, keys, ts, tie, "distance", ~F.col("distance_error")).withColumnsRenamed({"latest_value": "latest_distance", "latest_ts": "distance_ts"})
    latest_light = stats.latest(clean, keys, ts, tie, "light", ~F.col("light_error")).withColumnsRenamed({"latest_value": "latest_light", "latest_ts": "light_ts"})
    cards = latest_distance.join(latest_light, keys).join(stats.error_counts(clean, keys, ["distance_error", "light_error"]), keys)
    cards = cards.join(stats.share_hours(sash, keys, "sash_pct", 5.0), keys, "left").join(usage.bad_use_hours(state.rows(), keys), keys, "left")
    return {
        "hood_cards": cards,
        "hood_sash": sash.select(*keys, ts, "sash_pct"),
        "hood_state": state.rows(),
        "hood_bad_intervals": sequences.flag_intervals(state, "bad_use"),
        "hood_presence_hours": hours,
        "hood_latest": stats.latest_rows(readings, keys, ts, tie),
    }


def water_marts(readings: DataFrame, keys: list[str], ts: str, tie: str, value: str, year_start, since) -> dict[str, DataFrame]:
    valid = ~water_error(F.col(value))
    return {
        "water_cards": stats.stats_with_fallback(readings, keys, ts, value, valid, year_start, since),
        "water_weekly": stats.weekly_dense(readings.where(valid), keys, ts, value),
        "water_latest": stats.latest_rows(readings, keys, ts, tie),
    }


def energy_marts(daily: DataFrame, minutes: DataFrame, keys: list[str], day: str, total: str, ts: str, kwh: str, as_of) -> dict[str, DataFrame]:
    cards = stats.summary_argmax(daily, keys, day, total)
    cards = cards.join(stats.day_change(daily, keys, day, total, as_of), keys).join(stats.trend_pct(daily, keys, day, total, as_of).drop("days"), keys, "left")
    return {
        "energy_cards": cards.withColumn("equivalents", kwh_context(F.col("mean"))),
        "energy_split": stats.energy_split(minutes, keys, ts, kwh),
        "energy_monthly": stats.monthly(daily, keys, day, total),
        "energy_rolling": sequences.rolling_rows(daily, keys, day, total, "mean7"),
    }


def stock_marts(containers: DataFrame, listed: DataFrame, classes: DataFrame) -> dict[str, DataFrame]:
    light = stock.traffic_light(containers, listed, classes)
    return {
        "stock_traffic_light": light,
        "stock_traffic_wide": stock.traffic_wide(light),
        "stock_red": stock.red_inventory(containers, listed, classes),
        "stock_skipped": stock.skipped_total(containers, listed),
    }


def waste_marts(rows: DataFrame, flags: list[str]) -> dict[str, DataFrame]:
    long = waste.allocate(rows, flags=flags)
    return {
        "waste_daily": long,
        "waste_quarter": waste.period_total(long, "quarter"),
        "waste_year": waste.period_total(long, "year"),
        "waste_quarter_share": waste.pivot_share(long, flags, "quarter"),
        "waste_year_share": waste.pivot_share(long, flags, "year"),
        "waste_top": waste.top_category(long),
    }


def write_marts(marts: dict[str, DataFrame], folder: str) -> None:
    for name, df in marts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
