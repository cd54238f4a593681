"""Appending, idempotent, snapshot and export sinks over file tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut

DAY = "day"
#: Days of a batch that are named one by one in the partition filter; a batch of more days reads the span between its ends.
NAMED_DAYS = 400


def append(df: DataFrame, path: str, partition_by: list[str] | None = None, enabled: bool = True, fmt: str = "parquet") -> bool:
    """Append to a table folder, created on first use; ``enabled=False`` leaves it untouched."""
    if not enabled:
        return False
    writer = df.write.mode("append").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return True


def unseen(df: DataFrame, stored: DataFrame, keys: list[str], tie: list[str] | None = None) -> DataFrame:
    """Rows whose keys are not stored yet, one per key (the least by ``tie``)."""
    body = [c for c in df.columns if c not in keys]
    order = F.struct(*(tie or body)) if (tie or body) else F.lit(0)
    row = F.struct(*body) if body else F.struct(F.lit(0).alias("_"))
    once = df.groupBy(*keys).agg(F.min_by(row, order).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in body])
    return once.join(stored.select(*keys), keys, "left_anti").select(*df.columns)


def open_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or nothing where there is no such folder; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def on_days(stored: DataFrame, days: list[date], day: str = DAY) -> DataFrame:
    """Rows of the given days; a filter on the partition column, so other days' files are not listed or read."""
    if len(days) <= NAMED_DAYS:
        return stored.where(F.col(day).isin(days))
    return stored.where(F.col(day).between(F.lit(days[0]), F.lit(days[-1])))


def days_of(df: DataFrame, day: str = DAY) -> list[date]:
    """The frame's days in order: all of them up to ``NAMED_DAYS``, else some that include the first and the last."""
    distinct = df.select(day).where(F.col(day).isNotNull()).distinct()
    named = [r[0] for r in distinct.limit(NAMED_DAYS + 1).collect()]
    if len(named) > NAMED_DAYS:
        named += list(df.agg(F.min(day), F.max(day)).first())
    return sorted(set(named))


def _check_keys(stored: DataFrame, df: DataFrame, keys: list[str]) -> None:
    kinds, ours = dict(stored.dtypes), dict(df.dtypes)
    for k in keys:
        if kinds.get(k) != ours[k]:
            raise ValueError(f"stored table has {k} as {kinds.get(k)}, the batch as {ours[k]}")


def append_new(df: DataFrame, path: str, keys: list[str], ts: str, tie: list[str] | None = None) -> dict[str, int]:
    """Append only rows with unseen keys; gives the inserted and skipped row counts.

    The table lies in one partition per day of ``ts``, which must be one of the keys: a key can only be stored under its own
    day, so no more than the batch's days are read, whatever the table's size.  The inserted rows are counted while they
    are written.  A table that is there but cannot be read, or whose keys have other types, is an error, never "no table".
    Rows without a time are skipped.
    """
    if ts not in keys or DAY in df.columns:
        raise ValueError(f"the time must be one of the keys, and {DAY} is the table's own column")
    spark = df.sparkSession
    batch = cut(df.withColumn(DAY, F.col(ts).cast("date")))
    rows = batch.count()
    days = days_of(batch)
    stored = open_table(spark, path)
    if stored is not None:
        _check_keys(stored, batch, [*keys, DAY])
    dated = batch.where(F.col(DAY).isNotNull())
    known = dated.limit(0) if stored is None else on_days(stored, days)
    fresh = unseen(dated, known, [*keys, DAY], tie)
    written = Observation()
    append(fresh.observe(written, F.count(F.lit(1)).alias("inserted")), path, [DAY])
    inserted = written.get["inserted"]
    return {"inserted": inserted, "skipped": rows - inserted}


def write_snapshot(df: DataFrame, path: str, category: Column | str, taken: datetime, enabled: bool = True) -> bool:
    """Add a run's rows to a snapshot table, stamped with the time of the run.

    The table lies in partitions of (category, run date); a run replaces the partitions it has rows for and no others, so
    writing it once more leaves one copy and earlier runs stay.  ``enabled=False`` leaves the table untouched.
    """
    if not enabled:
        return False
    name = F.col(category) if isinstance(category, str) else category
    stamped = df.withColumns({"category": name, "snapshot_ts": F.lit(taken).cast("timestamp_ntz"), "run_date": F.lit(taken.date())})
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category", "run_date").parquet(path)
    return True


def between_days(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from the first day through the last day; fails when the range is reversed."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if b < a:
        raise ValueError("end date before start date")
    at = lambda d: F.lit(d.isoformat()).cast("timestamp_ntz")
    return df.where((F.col(ts) >= at(a)) & (F.col(ts) < at(b + timedelta(days=1))))


def export_between(tables: dict[str, DataFrame], start: str, end: str, out: str, ts: str = "Timestamp") -> list[str]:
    """One time-ordered CSV folder per table with a time column; other tables are left out."""
    done = []
    for name, df in tables.items():
        if ts not in df.columns:
            continue
        rows = between_days(df, ts, start, end)
        rows.repartitionByRange(F.col(ts)).sortWithinPartitions(ts).write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
        done.append(name)
    return done


def export_day(tables: dict[str, DataFrame], day: str, out: str, ts: str = "Timestamp") -> list[str]:
    return export_between(tables, day, day, out, ts)


def tables_with(spark: SparkSession, column: str, database: str | None = None) -> dict[str, DataFrame]:
    """Tables and views of a database (the current one, with the session's views) that have the column, by name."""
    found = {}
    for t in spark.catalog.listTables(database):
        full = t.name if t.isTemporary else ".".join(f"`{p}`" for p in [*(t.namespace or []), t.name])
        df = spark.table(full)
        if column in df.columns:
            found[t.name] = df
    return found


def export_database(spark: SparkSession, start: str, end: str, out: str, ts: str = "Timestamp", database: str | None = None) -> list[str]:
    """Export every table of a database that has the time column; the names of those exported."""
    return export_between(tables_with(spark, ts, database), start, end, out, ts)


def write_clean(df: DataFrame, path: str, fmt: str, run_date: date) -> None:
    """Cleaned rows with the run date: JSON keeps lists as arrays, CSV holds them as JSON text."""
    out = df.withColumn("date", F.lit(run_date))
    if fmt == "csv":
        lists = [c for c, kind in out.dtypes if kind.startswith("array")]
        out = out.withColumns({c: F.to_json(c) for c in lists})
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        out.write.mode("overwrite").json(path)
