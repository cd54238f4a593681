"""Idempotent appends by day, snapshots, catalog export and partition pruning."""

import datetime as dt
import pathlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gaugeworks.sinks import tables as sinks
from gaugeworks.sources import scans
from gaugeworks.streaming import ingest

T0 = dt.datetime(2026, 1, 1)


def minutes(spark, first, n, site="s", step=60):
    rows = [(site, T0 + dt.timedelta(minutes=step * i), float(i)) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, kwh double")


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(x for x in plan.split("\n") if "PartitionFilters" in x).split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_append_new_in_any_order_and_again(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.append_new(minutes(spark, 0, 48), path, ["site", "ts"], "ts") == {"inserted": 48, "skipped": 0}
    assert sinks.append_new(minutes(spark, 24, 48), path, ["site", "ts"], "ts") == {"inserted": 24, "skipped": 24}
    assert sinks.append_new(minutes(spark, 24, 48), path, ["site", "ts"], "ts") == {"inserted": 0, "skipped": 48}
    twice = minutes(spark, 100, 2).unionByName(minutes(spark, 100, 2).withColumn("kwh", F.lit(-1.0)))
    assert sinks.append_new(twice, path, ["site", "ts"], "ts", ["kwh"]) == {"inserted": 2, "skipped": 2}
    stored = spark.read.parquet(path)
    assert stored.count() == 74 and stored.where("day <> cast(ts as date)").count() == 0
    assert [r.kwh for r in stored.where("kwh < 0").collect()] == [-1.0, -1.0]
    none = minutes(spark, 0, 1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    assert sinks.append_new(none, path, ["site", "ts"], "ts") == {"inserted": 0, "skipped": 1}


def test_only_the_days_at_hand_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_new(minutes(spark, 0, 24 * 30), path, ["site", "ts"], "ts")
    stored = sinks.open_table(spark, path)
    few = sinks.on_days(stored, [dt.date(2026, 1, 5), dt.date(2026, 1, 9)])
    assert "2026-01-05" in partition_filters(few) or "day" in partition_filters(few)
    assert {pathlib.Path(f).parent.name for f in few.inputFiles()} <= {p.name for p in (tmp_path / "t").iterdir()}
    assert few.select("day").distinct().count() == 2
    many = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(sinks.NAMED_DAYS + 1)]
    assert "isnotnull(day" in partition_filters(sinks.on_days(stored, many)) and sinks.on_days(stored, many).count() == 720
    df = spark.createDataFrame([(d,) for d in many + [dt.date(2040, 1, 1), None]], "day date")
    assert sinks.days_of(df)[0] == many[0] and sinks.days_of(df)[-1] == dt.date(2040, 1, 1)
    # Files of other days may be broken: an append does not touch them.
    for f in (tmp_path / "t" / "day=2026-01-20").glob("*.parquet"):
        f.write_bytes(b"broken")
    assert sinks.append_new(minutes(spark, 0, 30), path, ["site", "ts"], "ts") == {"inserted": 0, "skipped": 30}


def test_a_broken_table_is_not_an_empty_one(spark, tmp_path):
    path = tmp_path / "t"
    path.mkdir()
    (path / "day=2026-01-01").mkdir()
    (path / "day=2026-01-01" / "a.parquet").write_bytes(b"broken")
    with pytest.raises(Exception):
        sinks.append_new(minutes(spark, 0, 3), str(path), ["site", "ts"], "ts")
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(AnalysisException):
        sinks.open_table(spark, str(empty))
    assert sinks.open_table(spark, str(tmp_path / "none")) is None
    other = str(tmp_path / "other")
    minutes(spark, 0, 3).select("site", F.col("ts").cast("string").alias("ts"), F.col("ts").cast("date").alias("day")).write.partitionBy("day").parquet(other)
    with pytest.raises(ValueError, match="stored table has ts as string"):
        sinks.append_new(minutes(spark, 0, 3), other, ["site", "ts"], "ts")
    with pytest.raises(ValueError, match="one of the keys"):
        sinks.append_new(minutes(spark, 0, 3), other, ["site"], "ts")


def test_stream_replay_changes_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for k, (first, n) in enumerate([(0, 30), (20, 30), (0, 60)]):
        minutes(spark, first, n).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("site string, ts timestamp_ntz, kwh double").parquet(str(source))
        # Each start has a checkpoint of its own, so every file so far arrives once more.
        ingest.ingest_new(stream, ["site", "ts"], "ts", "1 minute", out, str(tmp_path / f"c{k}"), ["kwh"]).awaitTermination(120)
    rows = spark.read.parquet(out + "/rows")
    assert rows.select("site", "ts").distinct().count() == 60


def test_snapshots_can_be_replayed(spark, tmp_path):
    path = str(tmp_path / "s")
    day = lambda d, h: dt.datetime(2026, 1, d, h)
    run = lambda c: spark.createDataFrame([(c, "red", 1.0), (c, "green", 2.0)], "kind string, colour string, litres double")
    sinks.write_snapshot(run("voc"), path, "kind", day(1, 8))
    sinks.write_snapshot(run("voc"), path, "kind", day(2, 8))
    sinks.write_snapshot(run("air"), path, "kind", day(2, 9))
    first = spark.read.parquet(path).count()
    sinks.write_snapshot(run("voc"), path, "kind", day(2, 8))
    assert not sinks.write_snapshot(run("voc"), path, "kind", day(3, 8), enabled=False)
    rows = spark.read.parquet(path)
    assert first == rows.count() == 6
    got = {(r.category, r.run_date.day, r.snapshot_ts.hour) for r in rows.collect()}
    assert got == {("voc", 1, 8), ("voc", 2, 8), ("air", 2, 9)}


def test_export_finds_tables_by_column(spark, tmp_path):
    rows = minutes(spark, 0, 72).withColumnRenamed("ts", "Timestamp")
    spark.sql("CREATE DATABASE IF NOT EXISTS labs")
    try:
        rows.write.mode("overwrite").saveAsTable("labs.water")
        rows.write.mode("overwrite").saveAsTable("labs.hood")
        rows.drop("Timestamp").write.mode("overwrite").saveAsTable("labs.sites")
        out = tmp_path / "out"
        assert sorted(sinks.export_database(spark, "2026-01-02", "2026-01-02", str(out), database="labs")) == ["hood", "water"]
        assert sorted(p.name for p in out.iterdir()) == ["hood", "water"]
        assert spark.read.option("header", True).csv(str(out / "water")).count() == 24
    finally:
        spark.sql("DROP DATABASE labs CASCADE")


def test_a_time_range_prunes_days(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_new(minutes(spark, 0, 24 * 10), path, ["site", "ts"], "ts")
    rows = scans.scan_window(spark.read.parquet(path), "ts", "2026-01-03 12:00:00", "2026-01-05", day="day")
    filters = partition_filters(rows)
    assert ">=" in filters and "<=" in filters and "day" in filters
    assert rows.count() == 36 and rows.agg(F.max("ts")).first()[0] == dt.datetime(2026, 1, 4, 23)
