"""Every registered query against its SQL, on plain windows and with chunks forced."""

import os

import pytest

import __spark_entry__ as entry

from .oracle_check import ROOT, compare, connect

FOLDER = f"{ROOT}/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Queries that run on a chunked series: here every path through it is checked again with tiny chunks.
CHUNKED = [
    "meter_delta", "rolling_time", "savgol", "extrema", "gap_segments", "presence_hours", "flag_intervals", "flag_intervals_pad", "mask_events", "substantial_rows",
    "zero_run_errors", "distance_errors", "health_alerts", "failure_bursts", "asof_join", "asof_tolerance", "usage_state", "water_runs", "behaviour_pct",
    "noise_mad", "water_percentiles", "burst_median", "compare_periods",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    rows, problem = compare(spark, con, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None, problem


@pytest.mark.parametrize("name", CHUNKED)
def test_chunked(spark, con, name):
    spark.conf.set("gaugeworks.series.rowsPerChunk", "10")
    try:
        rows, problem = compare(spark, con, QUERIES[name], ORACLES.get(name), FOLDER)
    finally:
        spark.conf.unset("gaugeworks.series.rowsPerChunk")
    assert problem is None, problem
