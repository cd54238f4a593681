"""Table scans, time-bounded scans and look-back windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Scan with projection; column choice reaches the reader.  ``schema`` saves an inference pass."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select(*columns) if columns else df


def newest_first(df: DataFrame, ts: str) -> DataFrame:
    return df.orderBy(F.desc(ts))


def scan_window(df: DataFrame, ts: str, start=None, end=None, keys: dict | None = None, day: str | None = None) -> DataFrame:
    """Rows of [start, end) and of the given entities, as plain predicates the scan can push down.

    ``day`` names a partition column that holds the date of ``ts``; the range on the time then also bounds the days, so other
    days' partitions are not listed or read.
    """
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    if start is not None:
        df = df.where(F.col(ts) >= at(start))
        if day:
            df = df.where(F.col(day) >= at(start).cast("date"))
    if end is not None:
        df = df.where(F.col(ts) < at(end))
        if day:
            df = df.where(F.col(day) <= (at(end) - F.expr("interval 1 microsecond")).cast("date"))
    for k, v in (keys or {}).items():
        df = df.where(F.col(k).isin(v) if isinstance(v, (list, tuple)) else F.col(k) == v)
    return df


def last_days(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    return df.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def lookback(df: DataFrame, ts: str, as_of: Column, max_span_days: int = 120, window_days: int = 7, month_start: bool = False) -> DataFrame:
    """All rows when they span at most ``max_span_days``, else only the last ``window_days``.

    ``month_start`` moves the start back to the first day of its month.
    """
    span = df.agg((F.max(ts) - F.min(ts) <= F.make_dt_interval(F.lit(max_span_days))).alias("short")).scalar()
    start = as_of - F.make_dt_interval(F.lit(window_days))
    if month_start:
        start = F.trunc(start.cast("date"), "month").cast("timestamp_ntz")
    return df.where(span | (F.col(ts) >= start))


def day_slices(df: DataFrame, ts: str, name: str = "day") -> DataFrame:
    return df.withColumn(name, F.col(ts).cast("date"))
