"""Queries over rows with gaps in keys, times or dates, listings in order, and chunked twins of the series queries.

A twin runs the same query with small chunks, so that the path for large data is held against the same SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import register
from ..functions import scalars as S
from ..operators import asof, sequences, stats, stock
from ..operators import waste as waste_ops
from ..operators.series import ROWS_PER_CHUNK_CONF, Series
from .inventory import LISTED_SQL, containers
from .registry import ORACLES, QUERIES, query
from .views import USER
from .waste import HPS, LONG_SQL, allocated

CHUNK_ROWS = 20
CHUNKED = [
    "asof_join", "asof_tolerance", "nearest_join", "gap_segments", "presence_hours", "flag_intervals", "mask_events", "zero_run_errors",
    "usage_state", "meter_delta", "rolling_time", "savgol", "extrema", "water_runs", "water_percentiles", "noise_mad", "burst_median", "compare_periods",
    "burst_nulls", "compare_nulls", "noise_nulls", "errors_nulls", "behaviour_pct", "distance_errors", "failure_bursts", "health_alerts", "flag_intervals_pad", "substantial_rows", "presence_week",
]

# A third of the left rows lack a key, another third a time.
GAPS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 3 = 1 THEN NULL ELSE ts END AS ts FROM events WHERE event_type = 'purchase'"


@query("asof_nulls", f"""SELECT p.event_id, p.user_id, p.ts, coalesce(c.value, -1.0) AS matched FROM ({GAPS}) p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_nulls(t):
    third = F.col("event_id") % 3
    left = t.events.where("event_type = 'purchase'").select("event_id", F.when(third != 0, F.col("user_id")).alias("user_id"), F.when(third != 1, F.col("ts")).alias("ts"))
    right = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    return asof.asof_join(left, right, USER, "ts", "ts", ["value"], "event_id", defaults={"value": -1.0}).withColumnRenamed("value", "matched")


# A quarter of the keys are null, and stay a key of their own.
NULL_KEYS = "SELECT CASE WHEN user_id % 4 > 0 THEN user_id END AS user_id, CAST(ts AS DATE) AS d, CASE WHEN event_id % 3 > 0 THEN value ELSE 0.0 END AS v FROM events"


def null_keys(t):
    key = F.when(F.col("user_id") % 4 > 0, F.col("user_id")).alias("user_id")
    return t.events.select(key, F.col("ts").cast("date").alias("d"), F.when(F.col("event_id") % 3 > 0, F.col("value")).otherwise(0.0).alias("v"))


@query("burst_nulls", f"""SELECT user_id, round(CASE WHEN count(v) > 0 THEN coalesce(median(v) FILTER (v <> 0), 0.0) END, 6) AS burst_value FROM ({NULL_KEYS}) GROUP BY user_id""")
def burst_nulls(t):
    return stats.burst_median(null_keys(t), USER, "v").select("user_id", F.round("burst_value", 6).alias("burst_value"))


@query("compare_nulls", f"""WITH n AS ({NULL_KEYS}) SELECT user_id, round(median(v) FILTER (d BETWEEN DATE '2024-01-05' AND DATE '2024-01-14'), 6) AS before_median,
    round(median(v) FILTER (d BETWEEN DATE '2024-01-16' AND DATE '2024-01-25'), 6) AS after_median FROM n
    WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-14' OR d BETWEEN DATE '2024-01-16' AND DATE '2024-01-25' GROUP BY user_id""")
def compare_nulls(t):
    out = stats.compare_periods(null_keys(t), USER, "d", "v", "2024-01-15", "2024-01-15", days=10)
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("before_median", "after_median")])


@query("noise_nulls", f"""WITH n AS ({NULL_KEYS}), m AS (SELECT user_id, median(v) AS mid FROM n GROUP BY user_id),
    a AS (SELECT n.user_id, median(abs(v - mid)) AS mad, stddev_samp(v) AS sd FROM n JOIN m ON n.user_id IS NOT DISTINCT FROM m.user_id GROUP BY n.user_id)
    SELECT user_id, round(CASE WHEN mad > 0 THEN mad * 1.4826 ELSE sd END, 5) AS sigma FROM a""")
def noise_nulls(t):
    return stats.noise_threshold(null_keys(t), USER, "v").select("user_id", F.round("sigma", 5).alias("sigma"))


@query("errors_nulls", f"""WITH n AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 > 0 THEN ts END AS ts, distance FROM readings),
    w AS (SELECT *, max(CASE WHEN distance < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 AS echoed FROM n WHERE user_id IS NOT NULL AND ts IS NOT NULL)
    SELECT event_id, echoed AS distance_error FROM w UNION ALL SELECT event_id, NULL FROM n WHERE user_id IS NULL OR ts IS NULL""")
def errors_nulls(t):
    rows = t.readings.select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 7 > 0, F.col("ts")).alias("ts"), "distance")
    out = sequences.distance_errors(Series.plan(rows, USER, "ts", ["event_id"]), "distance", "distance_error")
    return out.rows().select("event_id", "distance_error")


@query("effective_nulls", """SELECT o_orderkey, CASE WHEN d IS NOT NULL THEN coalesce(h.total_people, 10) END AS total_people
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders) o ASOF LEFT JOIN headcount h ON o.d >= h.effective_date""")
def effective_nulls(t):
    fact = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date")).alias("d"))
    return asof.effective_join(fact, t.headcount, "d", "effective_date", "total_people").select("o_orderkey", "total_people")


@query("red_listing", f"""WITH {LISTED_SQL} SELECT CAST(row_number() OVER (PARTITION BY category ORDER BY round(litres, 6) DESC, name, cas) AS INT) AS place, name, cas, category, round(litres, 6) AS litres
    FROM lv JOIN classes USING (cas) WHERE colour = 'red' AND round(litres, 6) > 0""")
def red_listing(t):
    return stock.red_listing(stock.red_inventory(containers(t), t.solvents, t.classes))


@query("waste_pivot", f"WITH {LONG_SQL} SELECT d, {', '.join(f'''round(coalesce(sum(litres) FILTER (hp = '{h}'), 0), 6) AS {h}''' for h in HPS)} FROM al2 GROUP BY d")
def waste_pivot(t):
    return waste_ops.pivot_volume(allocated(t), HPS).withColumns({h: F.round(h, 6) for h in HPS})


@query("lenient_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders""")
def lenient_dates(t):
    forms = F.array(F.date_format("o_orderdate", "d/M/yyyy"), F.date_format("o_orderdate", "yyyy-M-d"), F.date_format("o_orderdate", " d.M.yyyy "))
    return t.orders.select("o_orderkey", S.parse_date(forms[(F.col("o_orderkey") % 3).cast("int")]).alias("d"))


@query("safe_numbers", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS number, value * 1000 / 300 AS millilitres FROM events""")
def safe_numbers(t):
    text = F.when(F.col("event_type") == "error", "N/A").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return t.events.select("event_id", S.to_num(text).alias("number"), S.pulses_to_ml(F.col("value")).alias("millilitres"))


@query("sql_functions", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - CAST(CASE dayofweek(o_orderdate) WHEN 1 THEN 2 WHEN 0 THEN 2 ELSE 1 END + CASE WHEN dayofweek(o_orderdate) = 1 THEN 1 ELSE 0 END AS INT) AS DATE) AS d FROM orders""")
def sql_functions(t):
    register.register(t.spark)
    return t.orders.select("o_orderkey", F.expr("prev_working_day(cast(o_orderdate AS date))").alias("d"))


def _with_functions(t):
    register.register(t.spark)
    return t


@query("sql_litres")
def sql_litres(t):
    rows = _with_functions(t).containers
    return rows.select("l_orderkey", "l_linenumber", "size", "unit", F.expr("round(to_litres(size, unit), 6)").alias("litres"))


@query("sql_sash")
def sql_sash(t):
    rows = _with_functions(t).readings.join(t.hoods, USER, "left")
    return rows.select("event_id", F.expr("round(sash_percent(distance, closed_mm, open_mm), 4)").alias("sash_pct"))


@query("sql_codes")
def sql_codes(t):
    rows = _with_functions(t).form_codes
    return rows.select("p_partkey", F.size(S.parse_codes(F.col("codes"))).alias("parsed"), F.expr("array_join(normalize_codes(codes), ',')").alias("codes"))


# The functions give what the operators give.
ORACLES |= {"sql_litres": ORACLES["unit_convert"], "sql_sash": ORACLES["calibrate_percent"], "sql_codes": ORACLES["code_list"]}


def _chunked(name: str):
    def run(spark, sf_dir):
        before = spark.conf.get(ROWS_PER_CHUNK_CONF, None)
        spark.conf.set(ROWS_PER_CHUNK_CONF, str(CHUNK_ROWS))
        try:
            return QUERIES[name](spark, sf_dir)  # the layout is fixed while the frame is built
        finally:
            if before is None:
                spark.conf.unset(ROWS_PER_CHUNK_CONF)
            else:
                spark.conf.set(ROWS_PER_CHUNK_CONF, before)

    return run


for _name in CHUNKED:
    QUERIES[f"{_name}_chunked"], ORACLES[f"{_name}_chunked"] = _chunked(_name), ORACLES[_name]
