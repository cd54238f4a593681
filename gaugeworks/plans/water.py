"""Water taps: validity, weekly totals, runs and their length bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sequences, stats
from ..operators.series import Series
from .registry import query
from .sqltext import SEGMENTS, gaps
from .views import DEC, USER

LABELS = ["short", "medium", "long", "very_long"]
EDGES = [0.0, 900.0, 2100.0, 6000.0, 12000.0]

BAND_SQL = """CASE WHEN duration_minutes >= 0 AND duration_minutes < 900 THEN 'short' WHEN duration_minutes >= 900 AND duration_minutes < 2100 THEN 'medium'
    WHEN duration_minutes >= 2100 AND duration_minutes < 6000 THEN 'long' WHEN duration_minutes >= 6000 AND duration_minutes < 12000 THEN 'very_long' END AS band"""

RUNS_SQL = f"""w0 AS (SELECT * FROM readings WHERE water >= 0.1), {gaps('w0', 180_000_000)}, {SEGMENTS},
    rn AS (SELECT user_id, segment AS run, min(ts) AS start_ts, max(ts) AS end_ts, CAST(sum(CAST(water AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS samples,
      (epoch_us(max(ts)) - epoch_us(min(ts)) + coalesce(max(typical), 60000000)) / 60000000.0 AS duration_minutes FROM seg GROUP BY 1, 2),
    ev AS (SELECT *, {BAND_SQL} FROM rn)"""


def runs(t):
    s = Series.plan(t.readings.select("event_id", "user_id", "ts", F.col("water").cast(DEC).alias("water")), USER, "ts", ["event_id"])
    out = sequences.runs(s, F.col("water") >= 0.1, "water")
    return out.withColumn("total", F.col("total").cast("double")).withColumn("band", S.band(F.col("duration_minutes"), EDGES, LABELS)), not s.chunked


@query("water_errors", """SELECT user_id, count(*) FILTER (water < 0 OR abs(water - 6.55) <= 0.01) AS errors, count(*) AS rows FROM readings GROUP BY user_id""")
def water_errors(t):
    flagged = t.readings.withColumn("errors", S.water_error(F.col("water"), 6.55, 0.01))
    return stats.error_counts(flagged, USER, ["errors"])


@query("water_stats", """WITH r AS (SELECT *, CAST(water AS DECIMAL(18,2)) AS w, NOT (water < 50) AS ok, ts >= TIMESTAMP '2024-01-15' AS late, ts >= TIMESTAMP '2024-01-10' AS yr FROM readings)
    SELECT user_id, CASE WHEN count(*) FILTER (late AND ok) > 0 THEN max(water) FILTER (late AND ok) ELSE max(water) FILTER (late) END AS max_value,
    CAST(CASE WHEN count(*) FILTER (late AND ok) > 0 THEN sum(w) FILTER (late AND ok) ELSE sum(w) FILTER (late) END AS DOUBLE) AS total,
    count(*) FILTER (late AND NOT ok) AS errors,
    CAST(CASE WHEN count(*) FILTER (yr AND ok) > 0 THEN sum(w) FILTER (yr AND ok) ELSE sum(w) FILTER (yr) END AS DOUBLE) AS year_total,
    CAST(CASE WHEN count(*) FILTER (yr AND ok) > 0 THEN min(ts) FILTER (yr AND ok) ELSE min(ts) FILTER (yr) END AS DATE) AS year_first_day FROM r GROUP BY user_id""")
def water_stats(t):
    rows = t.readings.select("user_id", "ts", F.col("water").cast(DEC).alias("water"))
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    out = stats.stats_with_fallback(rows, USER, "ts", "water", F.col("water") >= 50, at("2024-01-10"), at("2024-01-15"))
    return out.withColumns({c: F.col(c).cast("double") for c in ("max_value", "total", "year_total")})


@query("weekly_dense", """WITH r AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(value AS DECIMAL(18,2)) AS v FROM events),
    s AS (SELECT user_id, week, CAST(sum(v) AS DOUBLE) AS total FROM r GROUP BY 1, 2),
    g AS (SELECT user_id, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM r GROUP BY user_id)
    SELECT user_id, week, coalesce(total, 0) AS total FROM g LEFT JOIN s USING (user_id, week)""")
def weekly_dense(t):
    rows = t.events.select("user_id", "ts", F.col("value").cast(DEC).alias("value"))
    return stats.weekly_dense(rows, USER, "ts", "value").withColumn("total", F.col("total").cast("double"))


@query("weekly_mean", """WITH r AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(value AS DECIMAL(18,2)) AS v FROM events),
    g AS (SELECT user_id, CAST(sum(v) AS DOUBLE) / ((max(week) - min(week)) // 7 + 1) AS weekly_mean FROM r GROUP BY user_id)
    SELECT user_id, round(weekly_mean, 6) AS weekly_mean FROM g""")
def weekly_mean(t):
    rows = t.events.select("user_id", "ts", F.col("value").cast(DEC).alias("value"))
    dense = stats.weekly_dense(rows, USER, "ts", "value")
    return dense.groupBy("user_id").agg(F.round(F.avg(F.col("total").cast("double")), 6).alias("weekly_mean"))


@query("water_runs", f"WITH {RUNS_SQL} SELECT user_id, run, start_ts, end_ts, total, samples, round(duration_minutes, 5) AS duration_minutes, band FROM ev")
def water_runs(t):
    return runs(t)[0].withColumn("duration_minutes", F.round("duration_minutes", 5))


@query("water_bands", f"""WITH {RUNS_SQL} SELECT band, count(*) AS events, round(sum(total), 2) AS litres, round(median(duration_minutes), 4) AS median_minutes,
    round(sum(total) / (SELECT sum(total) FROM ev WHERE band IS NOT NULL) * 100, 4) AS pct_litres FROM ev WHERE band IS NOT NULL GROUP BY band""")
def water_bands(t):
    rows, small = runs(t)
    out = stats.band_summary(rows, "band", "duration_minutes", "total", small)
    return out.withColumns({"litres": F.round("litres", 2), "median_minutes": F.round("median_minutes", 4), "pct_litres": F.round("pct_litres", 4)})


@query("water_histogram", f"WITH {RUNS_SQL} SELECT CAST(floor(duration_minutes) AS BIGINT) AS minute, count(*) AS events FROM ev GROUP BY 1")
def water_histogram(t):
    return stats.length_histogram(runs(t)[0], "duration_minutes")


@query("water_percentiles", f"WITH {RUNS_SQL} SELECT user_id, round(quantile_cont(duration_minutes, 0.95), 4) AS p95, round(quantile_cont(duration_minutes, 0.99), 4) AS p99 FROM ev GROUP BY user_id")
def water_percentiles(t):
    rows, small = runs(t)
    return stats.length_percentiles(rows, USER, "duration_minutes", small).withColumns({c: F.round(c, 4) for c in ("p95", "p99")})


@query("water_week_band", f"""WITH {RUNS_SQL}, b AS (SELECT CAST(date_trunc('week', start_ts) AS DATE) + 6 AS week_end, band, total FROM ev WHERE band IS NOT NULL)
    SELECT week_end, {', '.join(f"round(coalesce(sum(total) FILTER (band = '{x}'), 0), 2) AS {x}" for x in LABELS)} FROM b GROUP BY week_end""")
def water_week_band(t):
    out = stats.week_band(runs(t)[0], "start_ts", "band", "total", LABELS)
    return out.withColumns({x: F.round(x, 2) for x in LABELS})


@query("interval_volume", """SELECT user_id, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS interval_start, CAST(sum(CAST(water AS DECIMAL(18,2))) AS DOUBLE) AS volume
    FROM readings GROUP BY 1, 2 HAVING sum(water) > 0""")
def interval_volume(t):
    rows = t.readings.select("user_id", "ts", F.col("water").cast(DEC).alias("water"))
    return stats.interval_volume(rows, USER, "ts", "water", seconds=3600).withColumn("volume", F.col("volume").cast("double"))


@query("pool_equivalent", "SELECT user_id, round(sum(water) / 2500000.0, 8) AS pools FROM readings GROUP BY user_id")
def pool_equivalent(t):
    return t.readings.groupBy("user_id").agg(F.round(S.pools(F.sum("water")), 8).alias("pools"))
