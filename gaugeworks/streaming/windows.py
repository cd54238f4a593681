"""Windowed and session aggregates over streams (the same functions serve batch frames).

Rows later than the watermark are dropped; a window leaves the state when the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str, delay: str, name: str = "event_time") -> DataFrame:
    """Zoned event time with a watermark; zone-less columns cannot carry one."""
    return df.withColumn(name, F.col(ts).cast("timestamp")).withWatermark(name, delay)


def tumbling(df: DataFrame, keys: list[str], ts: str, value: str, width: str, delay: str, positive_only: bool = False) -> DataFrame:
    """Sum and count per key and tumbling window."""
    sums = event_time(df, ts, delay).groupBy(*keys, F.window("event_time", width)).agg(F.sum(value).alias("total"), F.count("*").alias("samples"))
    out = sums.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("start_ts"), F.col("window.end").cast("timestamp_ntz").alias("end_ts"), "total", "samples")
    return out.where(F.col("total") > 0) if positive_only else out


def session_runs(df: DataFrame, keys: list[str], ts: str, value: str, gap_us: int, delay: str) -> DataFrame:
    """Runs with gaps of at most ``gap_us`` microseconds.

    Session windows split at gaps equal to their length, hence one microsecond more.
    """
    window = F.session_window("event_time", f"{gap_us + 1} microseconds")
    runs = event_time(df, ts, delay).groupBy(*keys, window).agg(F.min("event_time").alias("_a"), F.max("event_time").alias("_b"), F.sum(value).alias("total"), F.count("*").alias("samples"))
    return runs.select(*keys, F.col("_a").cast("timestamp_ntz").alias("start_ts"), F.col("_b").cast("timestamp_ntz").alias("end_ts"), "total", "samples")
