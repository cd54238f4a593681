"""Electricity: meters, daily energy, power changes and their clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, clusters, sequences, stats
from ..operators.series import DAY, Series
from .registry import query
from .views import USER

SITE = ["site"]


def rounded(df, *cols, n: int = 4):
    return df.withColumns({c: F.round(c, n) for c in cols})


def day_after(t):
    return t.energy_daily.agg(F.date_add(F.max("d"), 1)).scalar()


def minutes(t) -> Series:
    return Series.plan(t.energy_minute, USER, "ts", ["event_id"])


@query("meter_delta", """SELECT event_id, user_id, ts, CAST(cumulative - lag(cumulative) OVER w AS DOUBLE) AS delta FROM meter
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY delta IS NOT NULL""")
def meter_delta(t):
    s = Series.plan(t.meter, USER, "ts", ["event_id"])
    out = sequences.meter_delta(s, "cumulative", "delta")
    return out.select("event_id", "user_id", "ts", F.col("delta").cast("double").alias("delta"))


@query("daily_delta", """WITH f AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_min(cumulative, (ts, event_id)) AS c FROM meter GROUP BY 1, 2)
    SELECT user_id, d, CAST(lead(c) OVER (PARTITION BY user_id ORDER BY d) - c AS DOUBLE) AS daily FROM f""")
def daily_delta(t):
    out = sequences.daily_delta(t.meter, USER, "ts", "event_id", "cumulative", "daily")
    return out.withColumn("daily", F.col("daily").cast("double"))


ROLL_SQL = """d AS (SELECT *, coalesce(v - lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS step FROM src),
    r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {frame} PRECEDING AND CURRENT ROW) AS delta FROM d)"""


@query("rolling_time", f"""WITH src AS (SELECT *, energy_kwh * 60 AS v FROM energy_minute), {ROLL_SQL.format(frame=86399999999)}
    SELECT event_id, round(delta, 6) AS delta FROM r""")
def rolling_time(t):
    out = sequences.rolling_change(minutes(t), S.power_kw(F.col("energy_kwh")), "delta", frame_us=DAY).rows()
    return rounded(out, "delta", n=6).select("event_id", "delta")


@query("active_power", """WITH i AS (SELECT user_id, coalesce(avg(energy_kwh * 60) FILTER (hour(ts) BETWEEN 1 AND 4), 0) AS idle FROM energy_minute GROUP BY 1)
    SELECT event_id, round(energy_kwh * 60, 9) AS kw, round(greatest(energy_kwh * 60 - idle, 0), 9) AS active_kw FROM energy_minute JOIN i USING (user_id)
    WHERE energy_kwh * 60 BETWEEN 0 AND 10""")
def active_power(t):
    rows = t.energy_minute.withColumn("kw", S.power_kw(F.col("energy_kwh"))).where("kw BETWEEN 0 AND 10")
    idle = stats.idle_power(t.energy_minute, USER, "ts", "energy_kwh")
    out = rows.join(idle, USER).withColumn("active_kw", S.active_kw(F.col("kw"), F.col("idle_kw")))
    return rounded(out.select("event_id", "kw", "active_kw"), "kw", "active_kw", n=9)


@query("idle_power", """SELECT user_id, round(coalesce(avg(energy_kwh * 60) FILTER (hour(ts) BETWEEN 1 AND 4), 0), 4) AS idle_kw FROM energy_minute GROUP BY 1""")
def idle_power(t):
    return rounded(stats.idle_power(t.energy_minute, USER, "ts", "energy_kwh"), "idle_kw")


@query("night_rows", "SELECT event_id FROM events WHERE hour(ts) >= 19 OR hour(ts) < 7")
def night_rows(t):
    return t.events.where(S.hour_between(F.col("ts"), 19, 7)).select("event_id")


@query("energy_split", """WITH s AS (SELECT user_id, coalesce(avg(energy_kwh * 60) FILTER (hour(ts) BETWEEN 1 AND 4), 0) AS idle_kw, sum(energy_kwh) AS total FROM energy_minute GROUP BY 1)
    SELECT user_id, round(idle_kw, 6) AS idle_kw, round(total, 6) AS total_kwh, round(idle_kw * 168, 6) AS idle_kwh, round(greatest(total - idle_kw * 168, 0), 6) AS active_kwh,
    round(idle_kw * 168 / total * 100, 6) AS idle_pct, round(greatest(total - idle_kw * 168, 0) / total * 100, 6) AS active_pct FROM s WHERE total > 0""")
def energy_split(t):
    out = stats.energy_split(t.energy_minute, USER, "ts", "energy_kwh")
    return rounded(out, "idle_kw", "total_kwh", "idle_kwh", "active_kwh", "idle_pct", "active_pct", n=6)


@query("kwh_context", """SELECT o_orderkey, round(o_totalprice / 0.1, 2) AS kettles_boiled, round(o_totalprice * 3.0, 2) AS ev_miles, round(o_totalprice / 0.41, 2) AS blue_whale_lifts FROM orders""")
def kwh_context(t):
    out = t.orders.select("o_orderkey", S.kwh_context(F.col("o_totalprice")).alias("_k")).select("o_orderkey", "_k.*")
    return rounded(out, "kettles_boiled", "ev_miles", "blue_whale_lifts", n=2)


@query("prev_working_day", """SELECT o_orderkey, CAST(o_orderdate AS DATE) - CASE isodow(o_orderdate) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS previous_day FROM orders""")
def prev_working_day(t):
    return t.orders.select("o_orderkey", S.prev_working_day(F.col("o_orderdate").cast("date")).alias("previous_day"))


@query("period_labels", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CONCAT(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter,
    year(o_orderdate) AS year, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_end FROM orders""")
def period_labels(t):
    units = ["day", "month", "quarter", "year", "week", "week_end"]
    return t.orders.select("o_orderkey", *[S.period(F.col("o_orderdate"), u).alias(u) for u in units])


@query("monthly_energy", "SELECT site, CAST(date_trunc('month', d) AS DATE) AS month, round(sum(esum), 2) AS total, round(avg(esum), 6) AS mean FROM energy_daily GROUP BY 1, 2")
def monthly_energy(t):
    return rounded(rounded(stats.monthly(t.energy_daily, SITE, "d", "esum"), "mean", n=6), "total", n=2)


@query("rolling7", "SELECT site, d, round(avg(esum) OVER (PARTITION BY site ORDER BY d ROWS 6 PRECEDING), 4) AS mean7 FROM energy_daily")
def rolling7(t):
    out = sequences.rolling_rows(t.energy_daily, SITE, "d", "esum", "mean7")
    return rounded(out, "mean7").select("site", "d", "mean7")


@query("summary_argmax", """SELECT site, round(sum(esum), 2) AS total, round(avg(esum), 4) AS mean, max(esum) AS max_value, arg_min(d, (-esum, d)) AS max_day, count(*) AS days FROM energy_daily GROUP BY site""")
def summary_argmax(t):
    return rounded(rounded(stats.summary_argmax(t.energy_daily, SITE, "d", "esum"), "mean"), "total", n=2)


_BACK = "CASE isodow({0}) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END"


@query("day_change", f"""WITH a AS (SELECT max(d) + 1 AS x FROM energy_daily), b AS (SELECT x - {_BACK.format('x')} AS d1 FROM a), c AS (SELECT d1, d1 - {_BACK.format('d1')} AS d0 FROM b)
    SELECT site, coalesce(max(esum) FILTER (d = d1), 0) AS previous_day, round(coalesce(max(esum) FILTER (d = d1) - max(esum) FILTER (d = d0), 0), 2) AS change FROM energy_daily, c GROUP BY site""")
def day_change(t):
    return rounded(stats.day_change(t.energy_daily, SITE, "d", "esum", day_after(t)), "change", n=2)


@query("trend_pct", """WITH a AS (SELECT max(d) + 1 AS x FROM energy_daily), f AS (SELECT site, count(*) AS days, regr_slope(esum, date_diff('day', DATE '1970-01-01', d)) AS m,
      regr_intercept(esum, date_diff('day', DATE '1970-01-01', d)) AS c, date_diff('day', DATE '1970-01-01', min(d)) AS x0, date_diff('day', DATE '1970-01-01', max(d)) AS x1
      FROM energy_daily, a WHERE d >= x - 365 GROUP BY site)
    SELECT site, days, CASE WHEN c + m * x0 > 0 AND days >= 2 THEN round(m * (x1 - x0) / (c + m * x0) * 100, 4) ELSE 0 END AS trend_pct FROM f""")
def trend_pct(t):
    return rounded(stats.trend_pct(t.energy_daily, SITE, "d", "esum", day_after(t)), "trend_pct")


@query("shutdown_savings", """WITH w AS (SELECT label, 'in' AS part, start_d AS a, end_d AS b FROM windows UNION ALL SELECT label, 'out', start_d - 21, start_d - 1 FROM windows
      UNION ALL SELECT label, 'out', end_d + 1, end_d + 21 FROM windows),
    s AS (SELECT site, label, count(*) FILTER (part = 'in') AS n, count(*) FILTER (part = 'out') AS nb, avg(esum) FILTER (part = 'out') AS base, sum(esum) FILTER (part = 'in') AS actual
      FROM energy_daily JOIN w ON d BETWEEN a AND b GROUP BY 1, 2)
    SELECT site, label, n AS days_with_data, nb AS baseline_days, CASE WHEN n > 0 THEN round(base, 1) END AS baseline_per_day, CASE WHEN n > 0 THEN round(base * n, 1) END AS expected, round(actual, 1) AS actual,
    round(base * n - actual, 1) AS saved, CASE WHEN n > 0 THEN round((base * n - actual) / (base * n) * 100, 1) END AS saved_pct FROM s""")
def shutdown_savings(t):
    return stats.shutdown_savings(t.energy_daily, t.windows, "d", "esum", SITE)


@query("window_join", """SELECT label, site, d FROM energy_daily JOIN windows ON d BETWEEN start_d AND end_d""")
def window_join(t):
    return asof.window_join(t.energy_daily, t.windows, "d").select("label", "site", "d")


@query("compare_periods", """WITH p AS (SELECT site, esum, CASE WHEN d BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' THEN 'b' WHEN d BETWEEN DATE '1998-05-02' AND DATE '1998-07-30' THEN 'a' END AS p FROM energy_daily),
    s AS (SELECT site, count(*) FILTER (p = 'b') AS before_days, sum(esum) FILTER (p = 'b') AS bt, avg(esum) FILTER (p = 'b') AS bm, median(esum) FILTER (p = 'b') AS bmed, min(esum) FILTER (p = 'b') AS before_min, max(esum) FILTER (p = 'b') AS before_max,
      count(*) FILTER (p = 'a') AS after_days, sum(esum) FILTER (p = 'a') AS atot, avg(esum) FILTER (p = 'a') AS am, median(esum) FILTER (p = 'a') AS amed, min(esum) FILTER (p = 'a') AS after_min, max(esum) FILTER (p = 'a') AS after_max FROM p WHERE p IS NOT NULL GROUP BY site)
    SELECT site, before_days, before_min, before_max, after_days, after_min, after_max, round(bt, 2) AS before_total, round(bm, 6) AS before_mean, round(bmed, 6) AS before_median,
    round(atot, 2) AS after_total, round(am, 6) AS after_mean, round(amed, 6) AS after_median, round(atot - bt, 2) AS total_diff, round((atot - bt) / bt * 100, 2) AS total_pct,
    round(am - bm, 6) AS mean_diff, round((am - bm) / bm * 100, 2) AS mean_pct FROM s""")
def compare_periods(t):
    out = stats.compare_periods(t.energy_daily, SITE, "d", "esum", "1998-04-01", "1998-05-01")
    fine = ["before_mean", "before_median", "after_mean", "after_median", "mean_diff"]
    return rounded(rounded(out, *fine, n=6), "before_total", "after_total", "total_diff", "total_pct", "mean_pct", n=2)


@query("daily_table", """SELECT site, strftime(d, '%Y-%m-%d') AS date_text, year(d) AS year, strftime(d, '%b') AS month, round(esum, 2) AS esum, d FROM energy_daily
    WHERE (year(d), strftime(d, '%b')) IN (SELECT DISTINCT year(o_orderdate), strftime(o_orderdate, '%b') FROM orders WHERE o_totalprice > 499000)""")
def daily_table(t):
    day = F.col("o_orderdate")
    wanted = t.orders.where("o_totalprice > 499000").select(F.year(day).alias("year"), F.date_format(day, "MMM").alias("month")).distinct()
    return stats.daily_table(t.energy_daily, "d", "esum", wanted)


@query("noise_mad", """WITH m AS (SELECT user_id, median(value) AS mid, stddev_samp(value) AS sd FROM events GROUP BY 1),
    s AS (SELECT user_id, CASE WHEN median(abs(value - mid)) > 0 THEN 1.4826 * median(abs(value - mid)) ELSE max(sd) END AS sigma FROM events JOIN m USING (user_id) GROUP BY 1)
    SELECT user_id, round(sigma, 6) AS sigma, round(CASE WHEN sigma > 0 THEN 2 * sigma ELSE 0 END, 6) AS threshold FROM s""")
def noise_mad(t):
    return rounded(stats.noise_threshold(t.events, USER, "value"), "sigma", "threshold", n=6)


# Weight of point j for the fitted value at point a of a window centred on 0.
_FIT = "({s4} - {s2} * (a * a + j * j) + {n} * a * a * j * j) / ({n} * {s4} - {s2} * {s2})::DOUBLE + a * j / {s2}::DOUBLE"


def savgol_sql(source: str, value: str) -> str:
    """CTE ``sg``: the source rows with their quadratic smoothing."""
    w9, w7 = _FIT.format(n=9, s2=60, s4=708), _FIT.format(n=7, s2=28, s4=196)
    return f"""q0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {source}),
    q1 AS (SELECT *, CASE WHEN n >= 9 THEN 4 ELSE 3 END AS half FROM q0),
    q2 AS (SELECT *, greatest(half + 1, least(i, n - half)) AS mid FROM q1),
    q3 AS (SELECT x.user_id, x.i, x.n, x.i - x.mid AS a, y.i - x.mid AS j, y.{value} AS v FROM q2 x JOIN q2 y ON x.user_id = y.user_id AND y.i BETWEEN x.mid - x.half AND x.mid + x.half WHERE x.n >= 7),
    q4 AS (SELECT user_id, i, sum(v * CASE WHEN n >= 9 THEN {w9} ELSE {w7} END) AS fit FROM q3 GROUP BY user_id, i),
    sg AS (SELECT q2.*, coalesce(fit, {value}) AS smoothed FROM q2 LEFT JOIN q4 USING (user_id, i))"""


@query("savgol", f"WITH {savgol_sql('events', 'value')} SELECT event_id, round(smoothed, 4) AS smoothed FROM sg")
def savgol(t):
    s = Series.plan(t.events.select("event_id", "user_id", "ts", "value"), USER, "ts", ["event_id"])
    return rounded(sequences.savgol(s, "value", "smoothed").rows(), "smoothed").select("event_id", "smoothed")


@query("extrema", """WITH n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, value, CASE WHEN value >= p AND value > q THEN 'max' ELSE 'min' END AS kind FROM n
    WHERE abs(value) >= 50 AND ((value >= p AND value > q) OR (value <= p AND value < q))""")
def extrema(t):
    s = Series.plan(t.events.select("event_id", "user_id", "ts", "value"), USER, "ts", ["event_id"])
    return sequences.extrema(s, "value", F.lit(50.0)).rows().select("event_id", "value", "kind")


@query("rank_labels", """WITH c AS (SELECT user_id, event_type, avg(value) AS m, count(*) AS members FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, round(m, 6) AS mean_abs, members, chr(CAST(64 + row_number() OVER (PARTITION BY user_id ORDER BY m DESC, event_type) AS INT)) AS label FROM c""")
def rank_labels(t):
    return rounded(clusters.rank_labels(t.events, USER, "event_type", "value"), "mean_abs", n=6)


def dbscan_sql(points: str, noise: str) -> str:
    """CTEs ending in ``lab`` (user_id, event_id, cluster) for points (user_id, event_id, size, here)."""
    return f"""zs AS (SELECT user_id, avg(size) AS mu, coalesce(nullif(stddev_pop(size), 0), 1) AS sd, avg(here) AS hmu, coalesce(nullif(stddev_pop(here), 0), 1) AS hsd FROM {points} GROUP BY 1),
    zp AS (SELECT p.user_id, event_id, (size - mu) / sd AS x, 0.6 * (here - hmu) / hsd AS y, greatest(0.4, 0.33 * threshold / sd) AS eps FROM {points} p JOIN zs USING (user_id) JOIN {noise} USING (user_id)),
    pr AS (SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM zp a JOIN zp b ON a.user_id = b.user_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= a.eps),
    co AS (SELECT user_id, a FROM pr GROUP BY 1, 2 HAVING count(*) >= 3),
    ed AS (SELECT pr.user_id, pr.a, pr.b FROM pr JOIN co x ON x.user_id = pr.user_id AND x.a = pr.a JOIN co y ON y.user_id = pr.user_id AND y.a = pr.b),
    rc AS (SELECT user_id, a, a AS root FROM co UNION SELECT rc.user_id, ed.b, rc.root FROM rc JOIN ed ON ed.user_id = rc.user_id AND ed.a = rc.a),
    cr AS (SELECT user_id, a, min(root) AS root FROM rc GROUP BY 1, 2),
    al AS (SELECT zp.user_id, zp.event_id, coalesce(cr.root, (SELECT min(c2.root) FROM pr JOIN cr c2 ON c2.user_id = pr.user_id AND c2.a = pr.b WHERE pr.user_id = zp.user_id AND pr.a = zp.event_id)) AS root
      FROM zp LEFT JOIN cr ON cr.user_id = zp.user_id AND cr.a = zp.event_id),
    lab AS (SELECT user_id, event_id, CASE WHEN root IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY user_id, root IS NULL ORDER BY root) - 1 END AS cluster FROM al)"""


NOISE_SQL = """mm AS (SELECT user_id, median({v}) AS nz_mid, stddev_samp({v}) AS nz_sd FROM {src} GROUP BY 1),
    nz0 AS (SELECT user_id, CASE WHEN median(abs({v} - nz_mid)) > 0 THEN 1.4826 * median(abs({v} - nz_mid)) ELSE max(mm.nz_sd) END AS sigma FROM {src} JOIN mm USING (user_id) GROUP BY 1),
    nz AS (SELECT user_id, CASE WHEN sigma > 0 THEN {k} * sigma ELSE 0 END AS threshold FROM nz0)"""


@query("density_clusters", f"""WITH RECURSIVE pt AS (SELECT user_id, event_id, value AS size, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS here FROM events),
    {NOISE_SQL.format(v='size', src='pt', k=2)}, {dbscan_sql('pt', 'nz')} SELECT user_id, event_id, cluster FROM lab""")
def density_clusters(t):
    pts = t.events.select("user_id", "event_id", F.col("value").alias("size"), F.col("event_type").isin("view", "click").cast("int").alias("here"))
    noise = stats.noise_threshold(pts, USER, "size").select("user_id", "threshold")
    return clusters.density_clusters(pts, noise, USER, "event_id", "size", "here").select("user_id", "event_id", "cluster")


@query("delta_events", f"""WITH RECURSIVE src AS (SELECT *, energy_kwh * 60 AS v FROM energy_minute), {ROLL_SQL.format(frame=299999999)},
    {savgol_sql('r', 'delta')}, res AS (SELECT *, delta - smoothed AS rs FROM sg), {NOISE_SQL.format(v='rs', src='res', k=0.5)},
    nb AS (SELECT *, lag(smoothed) OVER w AS p, lead(smoothed) OVER w AS q FROM sg WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    ex AS (SELECT nb.*, CASE WHEN smoothed >= p AND smoothed > q THEN 'max' ELSE 'min' END AS kind FROM nb JOIN nz USING (user_id)
      WHERE threshold > 0 AND abs(smoothed) >= threshold AND ((smoothed >= p AND smoothed > q) OR (smoothed <= p AND smoothed < q))),
    lt AS (SELECT user_id, ts, CASE WHEN value > 18 THEN 1 ELSE 0 END AS on_ FROM events WHERE event_type = 'view'),
    pt AS (SELECT ex.user_id, ex.event_id, ex.kind, ex.smoothed AS value, abs(ex.smoothed) AS size,
      CASE WHEN epoch_us(ex.ts) - epoch_us(lt.ts) <= 86400000000 THEN on_ ELSE 0 END AS here FROM ex ASOF LEFT JOIN lt ON ex.user_id = lt.user_id AND ex.ts >= lt.ts),
    {dbscan_sql('pt', 'nz')}, cl AS (SELECT user_id, cluster, avg(size) AS ma, avg(here) AS mp FROM pt JOIN lab USING (user_id, event_id) GROUP BY 1, 2),
    nm AS (SELECT *, chr(CAST(64 + row_number() OVER (PARTITION BY user_id ORDER BY ma DESC, cluster) AS INT)) AS label FROM cl)
    SELECT pt.user_id, event_id, kind, round(value, 4) AS value, here, lab.cluster, label, round(ma, 4) AS mean_abs, round(mp, 4) AS mean_presence
    FROM pt JOIN lab USING (user_id, event_id) JOIN nm ON nm.user_id = pt.user_id AND nm.cluster = lab.cluster""")
def delta_events(t):
    lights = t.events.where("event_type = 'view'").select("event_id", "user_id", "ts", (F.col("value") > 18).cast("int").alias("here"))
    out = clusters.delta_events(t.energy_minute, lights, USER, "ts", "event_id", "energy_kwh", "here", tolerance_us=DAY, noise_factor=0.5)
    return rounded(out.select("user_id", "event_id", "kind", "value", "here", "cluster", "label", "mean_abs", "mean_presence"), "value", "mean_abs", "mean_presence")
