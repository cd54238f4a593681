"""Hood readings: cleaning, presence, usage state, intervals, sensor health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, sequences, stats, usage
from ..operators.series import DAY, Series
from .registry import query
from .sqltext import PRESENCE, SEGMENTS, gaps
from .views import USER

ID = ["event_id"]


def series(df) -> Series:
    return Series.plan(df, USER, "ts", ID)


@query("calibrate_percent", """SELECT event_id, CASE WHEN pct BETWEEN 0 AND 100 THEN round(pct, 4) END AS sash_pct FROM
    (SELECT event_id, (closed_mm - least(distance, closed_mm)) / (closed_mm - open_mm) * 100 AS pct FROM readings LEFT JOIN hoods USING (user_id))""")
def calibrate_percent(t):
    out = usage.calibrate(t.readings, t.hoods, USER, "distance")
    return out.select("event_id", F.round("sash_pct", 4).alias("sash_pct"))


@query("threshold_flag", "SELECT event_id, light > hood_lux AS light_on FROM readings LEFT JOIN hoods USING (user_id)")
def threshold_flag(t):
    return usage.over_threshold(t.readings, t.hoods, USER, "light", "hood_lux", "light_on").select("event_id", "light_on")


def presence_rows(t):
    return usage.presence(t.readings, t.hoods, USER, "light", "room_lux")


@query("presence", f"WITH {PRESENCE} SELECT event_id, user_id, presence FROM pres")
def presence(t):
    return presence_rows(t).select("event_id", "user_id", "presence")


@query("validate_range", """SELECT event_id, CASE WHEN distance BETWEEN 0 AND 700 THEN distance ELSE -1.0 END AS distance,
    CASE WHEN light BETWEEN 0 AND 200 THEN light ELSE -1.0 END AS light FROM readings
    WHERE distance BETWEEN 0 AND 700 OR light BETWEEN 0 AND 200""")
def validate_range(t):
    return usage.validate_range(t.readings, {"distance": (0, 700), "light": (0, 200)}).select("event_id", "distance", "light")


@query("distinct_entities", "SELECT DISTINCT user_id FROM events")
def distinct_entities(t):
    return t.events.select("user_id").distinct()


@query("asof_join", """SELECT p.event_id, p.user_id, coalesce(c.value, -1.0) AS matched FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_join(t):
    kind = lambda k: t.events.where(F.col("event_type") == k).select("event_id", "user_id", "ts", "value")
    out = asof.asof_join(kind("purchase").drop("value"), kind("click"), USER, "ts", "ts", ["value"], "event_id", defaults={"value": -1.0})
    return out.select("event_id", "user_id", F.col("value").alias("matched"))


@query("asof_tolerance", f"""WITH {PRESENCE} SELECT e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(p.ts) <= 43200000000 THEN p.presence ELSE 0 END AS presence
    FROM (SELECT * FROM events WHERE event_type <> 'view') e ASOF LEFT JOIN
    (SELECT pres.* FROM pres JOIN events v ON v.event_id = pres.event_id WHERE v.event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_tolerance(t):
    lights = usage.presence(t.events.where("event_type = 'view'").withColumn("light", F.when(F.col("value") < 60, 0.0).otherwise(F.col("value"))), t.hoods, USER, "light", "room_lux")
    left = t.events.where("event_type <> 'view'").select("event_id", "user_id", "ts")
    out = asof.asof_join(left, lights, USER, "ts", "ts", ["presence"], "event_id", defaults={"presence": 0}, tolerance_us=DAY // 2)
    return out.select("event_id", "presence")


@query("nearest_join", """WITH tg AS (SELECT user_id, min(ts) + INTERVAL 5 DAY AS target FROM events GROUP BY user_id),
    c AS (SELECT tg.user_id, target, e.event_id, e.value, abs(epoch_us(e.ts) - epoch_us(target)) AS d, e.ts FROM tg JOIN events e ON e.user_id = tg.user_id
      AND abs(epoch_us(e.ts) - epoch_us(target)) <= 21600000000)
    SELECT tg.user_id, tg.target, b.event_id, b.value FROM tg LEFT JOIN
    (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, target ORDER BY d, ts, event_id) = 1) b ON b.user_id = tg.user_id AND b.target = tg.target""")
def nearest_join(t):
    targets = t.events.groupBy("user_id").agg((F.min("ts") + F.expr("interval 5 days")).alias("target"))
    out = asof.nearest_join(targets, t.events, "target", "ts", "event_id", ["event_id", "value"], DAY // 4, USER)
    return out.select("user_id", "target", "event_id", "value")


@query("gap_segments", f"WITH {gaps('readings')}, {SEGMENTS} SELECT event_id, user_id, segment FROM seg")
def gap_segments(t):
    return sequences.segments(series(t.readings.select("event_id", "user_id", "ts"))).rows().select("event_id", "user_id", "segment")


@query("presence_hours", f"""WITH {PRESENCE}, {gaps('pres')}, p AS (SELECT user_id, us, next_us FROM g WHERE presence = 1 AND next_us > us AND next_us - us <= lim),
    d AS (SELECT user_id, us, next_us, unnest(generate_series(us // 86400000000, (next_us - 1) // 86400000000)) AS dn FROM p),
    h AS (SELECT user_id, DATE '1970-01-01' + CAST(dn AS INT) AS day, SUM(least(next_us, (dn + 1) * 86400000000) - greatest(us, dn * 86400000000)) AS hus FROM d GROUP BY 1, 2)
    SELECT r.user_id, r.day, round(coalesce(hus, 0) / 3600000000.0, 6) AS hours_present FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM pres) r LEFT JOIN h USING (user_id, day)""")
def presence_hours(t):
    rows = presence_rows(t).select("event_id", "user_id", "ts", "presence")
    out = sequences.presence_hours(series(rows), "presence")
    return out.withColumn("hours_present", F.round("hours_present", 6))


@query("presence_week", f"""WITH {PRESENCE}, {gaps('pres')}, p AS (SELECT user_id, us, next_us FROM g WHERE presence = 1 AND next_us > us AND next_us - us <= lim),
    d AS (SELECT user_id, us, next_us, unnest(generate_series(us // 86400000000, (next_us - 1) // 86400000000)) AS dn FROM p),
    h AS (SELECT user_id, DATE '1970-01-01' + CAST(dn AS INT) AS day, SUM(least(next_us, (dn + 1) * 86400000000) - greatest(us, dn * 86400000000)) AS hus FROM d GROUP BY 1, 2),
    a AS (SELECT r.user_id, r.day, coalesce(hus, 0) AS hus FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM pres) r LEFT JOIN h USING (user_id, day))
    SELECT user_id, CAST(date_trunc('week', day) AS DATE) AS week, round(SUM(hus) / 3600000000.0, 4) AS hours_present FROM a GROUP BY 1, 2""")
def presence_week(t):
    rows = presence_rows(t).select("event_id", "user_id", "ts", "presence")
    daily = sequences.presence_hours(series(rows), "presence")
    return daily.groupBy("user_id", S.period(F.col("day"), "week").alias("week")).agg(F.round(F.sum("hours_present"), 4).alias("hours_present"))


@query("zero_run_errors", """WITH z AS (SELECT *, light = 0 AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
      - row_number() OVER (PARTITION BY user_id, light = 0 ORDER BY ts, event_id) AS run FROM readings)
    SELECT event_id, (z AND count(*) OVER (PARTITION BY user_id, z, run) < 10) OR light > 480 AS is_error FROM z""")
def zero_run_errors(t):
    rows = series(t.readings.select("event_id", "user_id", "ts", "light"))
    return sequences.light_errors(rows, "light", "is_error", high=480.0).rows().select("event_id", "is_error")


@query("distance_errors", """WITH e AS (SELECT event_id, user_id, distance, max(CASE WHEN distance < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) = 1 AS echo FROM readings)
    SELECT event_id, echo OR EXISTS (SELECT 1 FROM ranges x WHERE x.user_id = e.user_id AND e.distance BETWEEN x.low AND x.high) AS is_error FROM e""")
def distance_errors(t):
    rows = series(t.readings.select("event_id", "user_id", "ts", "distance"))
    return sequences.distance_errors(rows, "distance", "is_error", t.ranges).rows().select("event_id", "is_error")


@query("in_excluded_range", """SELECT event_id, EXISTS (SELECT 1 FROM ranges x WHERE x.user_id = r.user_id AND r.distance BETWEEN x.low AND x.high) AS excluded FROM readings r""")
def in_excluded_range(t):
    return asof.in_ranges(t.readings, t.ranges, USER, "distance", "excluded").select("event_id", "excluded")


@query("error_counts", """WITH e AS (SELECT user_id, light = 0 AS dark, distance < 0 AS echo FROM readings)
    SELECT user_id, count(*) FILTER (dark) AS dark, count(*) FILTER (echo) AS echo, count(*) AS rows FROM e GROUP BY user_id""")
def error_counts(t):
    flagged = t.readings.select("user_id", (F.col("light") == 0).alias("dark"), (F.col("distance") < 0).alias("echo"))
    return stats.error_counts(flagged, USER, ["dark", "echo"])


def open_rows(t):
    """Readings with their sash flag."""
    rows = usage.calibrate(t.readings.select("event_id", "user_id", "ts", "distance", "light"), t.hoods, USER, "distance")
    return rows.withColumn("is_open", F.coalesce(F.col("sash_pct") > 5.0, F.lit(False)))


OPEN_SQL = """o AS (SELECT r.*, coalesce(CASE WHEN pct BETWEEN 0 AND 100 THEN pct END > 5, false) AS is_open, CASE WHEN pct BETWEEN 0 AND 100 THEN pct END AS sash_pct FROM
    (SELECT readings.*, (closed_mm - least(distance, closed_mm)) / (closed_mm - open_mm) * 100 AS pct FROM readings LEFT JOIN hoods USING (user_id)) r)"""
NEXT_ON = ", lag(is_open) OVER w AS prev_on, lead(is_open) OVER w AS next_on"


@query("flag_intervals", f"""WITH {OPEN_SQL}, {gaps('o', columns=NEXT_ON)},
    f AS (SELECT *, prev_us IS NULL OR us - prev_us > lim AS cut_before, next_us IS NULL OR next_us - us > lim AS cut_after FROM g),
    i AS (SELECT *, SUM(CASE WHEN is_open AND (cut_before OR NOT prev_on) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
    SELECT user_id, min(ts) AS start_ts, make_timestamp(max(CASE WHEN cut_after THEN us + CAST(trunc(coalesce(typical, 300000000)) AS BIGINT) ELSE next_us END)) AS end_ts, count(*) AS samples
    FROM i WHERE is_open GROUP BY user_id, island""")
def flag_intervals(t):
    return sequences.flag_intervals(series(open_rows(t).select("event_id", "user_id", "ts", "is_open")), "is_open")


@query("flag_intervals_pad", f"""WITH {OPEN_SQL}, {gaps('o', columns=NEXT_ON)},
    f AS (SELECT *, prev_us IS NULL OR us - prev_us > lim AS cut_before FROM g),
    i AS (SELECT *, SUM(CASE WHEN is_open AND (cut_before OR NOT prev_on) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
    SELECT user_id, min(ts) AS start_ts, make_timestamp(max(us + CAST(trunc(coalesce(typical, 300000000)) AS BIGINT))) AS end_ts, count(*) AS samples
    FROM i WHERE is_open GROUP BY user_id, island""")
def flag_intervals_pad(t):
    return sequences.flag_intervals(series(open_rows(t).select("event_id", "user_id", "ts", "is_open")), "is_open", end="pad")


@query("mask_events", f"""WITH {OPEN_SQL}, a AS (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM o WHERE is_open),
    b AS (SELECT *, SUM(CASE WHEN p IS NULL OR epoch_us(ts) - p > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_no FROM a)
    SELECT user_id, event_no, min(ts) AS event_start, max(ts) AS event_end, count(*) AS samples, round(max(sash_pct), 4) AS max_value,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 4) AS duration_minutes, round(median(sash_pct), 4) AS median_value
    FROM b GROUP BY user_id, event_no HAVING count(*) > 3""")
def mask_events(t):
    s = series(open_rows(t).select("event_id", "user_id", "ts", "is_open", "sash_pct"))
    _, summary = sequences.mask_events(s, F.col("is_open"), DAY, "sash_pct", "event_no")
    out = sequences.size_filter(summary, 3, strict=True)
    return out.withColumns({c: F.round(c, 4) for c in ("max_value", "duration_minutes", "median_value")})


@query("substantial_rows", f"""WITH {OPEN_SQL}, a AS (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM o WHERE is_open),
    b AS (SELECT *, SUM(CASE WHEN p IS NULL OR epoch_us(ts) - p > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_no FROM a)
    SELECT event_id, event_no FROM b QUALIFY count(*) OVER (PARTITION BY user_id, event_no) >= 5""")
def substantial_rows(t):
    s = series(open_rows(t).select("event_id", "user_id", "ts", "is_open"))
    rows, summary = sequences.mask_events(s, F.col("is_open"), DAY, None, "event_no")
    return sequences.substantial(rows, summary, 5, strict=False, name="event_no").select("event_id", "event_no")


STATE_SQL = """p AS (SELECT DISTINCT user_id, ts FROM readings JOIN hoods USING (user_id)),
    d AS (SELECT * FROM readings WHERE distance >= 0), l AS (SELECT * FROM readings WHERE light <= 400),
    j AS (SELECT p.user_id, p.ts, d.distance FROM p ASOF LEFT JOIN d ON p.user_id = d.user_id AND p.ts >= d.ts),
    k AS (SELECT j.*, l.light FROM j ASOF LEFT JOIN l ON j.user_id = l.user_id AND j.ts >= l.ts),
    tl AS (SELECT DISTINCT user_id, ts FROM d UNION SELECT DISTINCT user_id, ts FROM l),
    st AS (SELECT k.user_id, k.ts, coalesce((765 - least(distance, 765)) / 665 * 100 BETWEEN 0 AND 100 AND (765 - least(distance, 765)) / 665 * 100 > 5, false) AS sash_open,
      CASE WHEN light > 18 THEN 1 ELSE 0 END AS presence, coalesce(light > 80, false) AS light_on FROM k JOIN tl USING (user_id, ts)),
    state AS (SELECT *, presence = 1 OR (NOT sash_open AND presence = 0) AS good_use, sash_open AND presence = 0 AS bad_use FROM st)"""


def state(t):
    """Readings without echoes below zero, light without glare; only configured hoods."""
    ours = t.readings.join(t.hoods.select("user_id"), "user_id", "left_semi")
    return usage.usage_state(ours.where("distance >= 0"), ours.where("light <= 400"), USER, "ts", "event_id", "distance", "light", t.hoods)


@query("usage_state", f"WITH {STATE_SQL} SELECT user_id, ts, sash_open, presence, light_on, good_use, bad_use FROM state")
def usage_state(t):
    return state(t).rows()


@query("bad_use_hours", f"WITH {STATE_SQL} SELECT user_id, round(avg(CASE WHEN bad_use THEN 1.0 ELSE 0.0 END) * 24, 4) AS bad_hours_per_day FROM state GROUP BY user_id")
def bad_use_hours(t):
    return usage.bad_use_hours(state(t).rows(), USER).withColumn("bad_hours_per_day", F.round("bad_hours_per_day", 4))


@query("bad_use_rows", f"""WITH {STATE_SQL} SELECT d.user_id, d.ts, d.event_id, d.distance FROM d JOIN state s ON s.user_id = d.user_id AND s.ts = d.ts WHERE s.bad_use""")
def bad_use_rows(t):
    return usage.bad_rows(state(t).rows(), t.readings.where("distance >= 0"), USER, "ts", ["event_id", "distance"])


@query("timeline", "SELECT user_id, ts FROM readings WHERE distance >= 0 UNION SELECT user_id, ts FROM readings WHERE light <= 400")
def timeline(t):
    pick = lambda c: t.readings.where(c).select("user_id", "ts")
    return asof.timeline(pick("distance >= 0"), pick("light <= 400"))


@query("share_hours", f"""WITH {OPEN_SQL} SELECT user_id, round(avg(CASE WHEN sash_pct > 5 THEN 1.0 ELSE 0.0 END) * 24, 4) AS hours_per_day,
    round(avg(sash_pct) FILTER (sash_pct > 5), 4) AS mean_above, round(avg(CASE WHEN sash_pct >= 8 THEN 1.0 ELSE 0.0 END) * 100, 4) AS active_pct,
    round(100 - avg(CASE WHEN sash_pct >= 8 THEN 1.0 ELSE 0.0 END) * 100, 4) AS idle_pct, count(*) AS samples FROM o WHERE sash_pct IS NOT NULL GROUP BY user_id""")
def share_hours(t):
    out = stats.share_hours(open_rows(t), USER, "sash_pct", 5.0)
    return out.withColumns({c: F.round(c, 4) for c in ("hours_per_day", "mean_above", "active_pct", "idle_pct")})


def _events_sql(name: str, mask: str, size: str) -> str:
    return f"""{name}0 AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM v WHERE {mask}),
    {name}1 AS (SELECT *, SUM(CASE WHEN p IS NULL OR us - p > cap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM {name}0),
    {name} AS (SELECT user_id, sum(w) AS w FROM (SELECT * FROM {name}1 QUALIFY count(*) OVER (PARTITION BY user_id, e) {size}) GROUP BY user_id)"""


@query("behaviour_pct", f"""WITH {OPEN_SQL}, {gaps('o')}, v AS (SELECT *, greatest(1800000000.0::DOUBLE, coalesce(typical, 60000000) * 3) AS cap,
      greatest(0, least(coalesce(CAST(next_us - us AS DOUBLE), coalesce(typical, 60000000)), greatest(1800000000.0::DOUBLE, coalesce(typical, 60000000) * 3))) AS w,
      light > 120 AS lit, hour(ts) >= 19 OR hour(ts) < 7 AS night FROM g),
    {_events_sql('x', 'is_open', '> 3')}, {_events_sql('y', 'is_open AND night', '>= 4')}, {_events_sql('z', 'lit', '> 3')},
    s AS (SELECT user_id, sum(w) AS total, sum(w) FILTER (night) AS nights, sum(w) FILTER (lit AND night) AS ln FROM v GROUP BY user_id)
    SELECT s.user_id, round(coalesce(x.w, 0) / total * 100, 2) AS pct_open, CASE WHEN nights > 0 THEN round(coalesce(y.w, 0) / nights * 100, 2) END AS pct_open_night,
    round(coalesce(z.w, 0) / total * 100, 2) AS pct_light, CASE WHEN nights > 0 THEN round(coalesce(ln, 0) / nights * 100, 2) END AS pct_light_night,
    round(nights / 3600000000.0, 2) AS night_hours FROM s LEFT JOIN x USING (user_id) LEFT JOIN y USING (user_id) LEFT JOIN z USING (user_id)""")
def behaviour_pct(t):
    rows = open_rows(t).select("event_id", "user_id", "ts", "is_open", (F.col("light") > 120).alias("lit"))
    return stats.weighted_pct(series(rows), "is_open", "lit", open_size=3, night_size=4)


@query("entities_all_days", """SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS rows FROM events
    WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-12') GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) = 2""")
def entities_all_days(t):
    return stats.entities_all_days(t.events, USER, "ts", ["2024-01-05", "2024-01-12"])


@query("pick_entity", """SELECT coalesce((SELECT min(user_id) FROM (SELECT user_id FROM events WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-12')
    GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) = 2)), (SELECT min(user_id) FROM events)) AS user_id""")
def pick_entity(t):
    return stats.pick_entity(t.events, USER, "ts", ["2024-01-05", "2024-01-12"])


@query("pick_fallback", """SELECT coalesce((SELECT min(user_id) FROM (SELECT user_id FROM events WHERE CAST(ts AS DATE) IN (DATE '1999-01-05', DATE '2024-01-12')
    GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) = 2)), (SELECT min(user_id) FROM events)) AS user_id""")
def pick_fallback(t):
    """No entity has rows on both days, so the first one counts."""
    return stats.pick_entity(t.events, USER, "ts", ["1999-01-05", "2024-01-12"])


@query("busiest_entity", "SELECT user_id, count(*) AS rows FROM events GROUP BY user_id ORDER BY rows DESC, user_id LIMIT 1")
def busiest_entity(t):
    return stats.busiest(t.events, USER)


@query("burst_median", """SELECT user_id, CAST(ts AS DATE) AS d, coalesce(round(median(light) FILTER (light <> 0), 4), 0) AS burst_value FROM readings GROUP BY 1, 2""")
def burst_median(t):
    rows = t.readings.select("user_id", F.col("ts").cast("date").alias("d"), "light")
    return stats.burst_median(rows, ["user_id", "d"], "light").withColumn("burst_value", F.round("burst_value", 4))


@query("latest10", """SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events
    QUALIFY rank <= 10""")
def latest10(t):
    return stats.latest_rows(t.events.select("user_id", "event_id", "ts", "value"), USER, "ts", "event_id")


@query("latest_value", """SELECT user_id, coalesce(max_by(distance, ts) FILTER (distance >= 0), max_by(distance, ts)) AS latest_value,
    coalesce(max(ts) FILTER (distance >= 0), max(ts)) AS latest_ts FROM readings GROUP BY user_id""")
def latest_value(t):
    return stats.latest(t.readings, USER, "ts", "event_id", "distance", F.col("distance") >= 0)


@query("baseline_shift", """WITH s AS (SELECT event_type, min(ts) AS t0 FROM events GROUP BY 1),
    m AS (SELECT e.event_type, avg(value) AS v FROM events e JOIN s USING (event_type) WHERE e.ts < s.t0 + INTERVAL 1 DAY GROUP BY 1)
    SELECT event_id, round(CASE WHEN event_type = 'view' THEN value - ((SELECT v FROM m WHERE event_type = 'view') - (SELECT v FROM m WHERE event_type = 'click')) ELSE value END, 4) AS shifted FROM events""")
def baseline_shift(t):
    out = stats.baseline_shift(t.events, "event_type", "ts", "value", "view", "click", "shifted", opening_us=DAY)
    return out.select("event_id", F.round("shifted", 4).alias("shifted"))


@query("window_scale", """WITH m AS (SELECT avg(value) FILTER (event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05')
      / avg(value) FILTER (event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12') AS k FROM events)
    SELECT event_id, round(CASE WHEN event_type = 'view' THEN value * k ELSE value END, 4) AS scaled FROM events CROSS JOIN m""")
def window_scale(t):
    out = stats.window_scale(t.events, "event_type", "ts", "value", "view", ("2024-01-10", "2024-01-12"), "click", ("2024-01-03", "2024-01-05"), "scaled")
    return out.select("event_id", F.round("scaled", 4).alias("scaled"))


@query("padded_limits", """WITH m AS (SELECT user_id, min(light) AS a, max(light) AS b FROM readings GROUP BY user_id)
    SELECT user_id, round(a - CASE WHEN b > a THEN (b - a) * 0.05 ELSE greatest(abs(b) * 0.05, 1.0) END, 4) AS low,
    round(b + CASE WHEN b > a THEN (b - a) * 0.05 ELSE greatest(abs(b) * 0.05, 1.0) END, 4) AS high FROM m""")
def padded_limits(t):
    return stats.padded_limits(t.readings, USER, "light").withColumns({c: F.round(c, 4) for c in ("low", "high")})


@query("time_of_day", "SELECT event_id, TIMESTAMP '2000-01-01' + (ts - date_trunc('day', ts)) AS aligned FROM events")
def time_of_day(t):
    return t.events.select("event_id", S.align_day(F.col("ts"), F.lit("2000-01-01").cast("date")).alias("aligned"))


@query("health_alerts", """WITH r AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN 0.0 ELSE distance END AS distance,
      CASE WHEN e.event_type = 'error' THEN NULL ELSE light END AS light FROM readings JOIN events e USING (event_id, user_id, ts)),
    x AS (SELECT *, lag(light) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM r),
    f AS (SELECT event_id, user_id, ts, rn, unnest([{'rule': 'zero_distance', 'ok': coalesce(distance = 0, false), 'n': 2, 'fresh': false},
        {'rule': 'zero_light', 'ok': coalesce(light = 0, false), 'n': 3, 'fresh': false},
        {'rule': 'identical_light', 'ok': light IS NOT NULL, 'n': 2, 'fresh': coalesce(light <> pl, true)},
        {'rule': 'missing_light', 'ok': light IS NULL, 'n': 2, 'fresh': false}]) AS q FROM x),
    h AS (SELECT event_id, user_id, ts, q.rule AS rule, q.ok AS ok, q.n AS n, rn,
      max(CASE WHEN NOT q.ok THEN rn WHEN q.fresh THEN rn - 1 ELSE 0 END) OVER (PARTITION BY user_id, q.rule ORDER BY rn) AS base FROM f)
    SELECT user_id, ts, event_id, rule, rn - base AS run FROM h WHERE ok AND rn - base >= n""")
def health_alerts(t):
    v = F.col("value")
    rows = t.events.select(
        "event_id",
        "user_id",
        "ts",
        F.when(F.col("event_type") == "view", 0.0).when(F.col("event_type") == "error", -1.0).otherwise(765.0 - 2.0 * v).alias("distance"),
        F.when(F.col("event_type") != "error", F.when(v < 60, 0.0).otherwise(v)).alias("light"),
    )
    return sequences.alerts(series(rows), "distance", "light", zero_distance=2, zero_light=3, same_light=2, missing_light=2)


@query("failure_bursts", """WITH b AS (SELECT event_id, user_id, event_type, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS failures FROM events)
    SELECT event_id, user_id, failures FROM b WHERE event_type = 'error' AND failures >= 3""")
def failure_bursts(t):
    s = series(t.events.select("event_id", "user_id", "ts", "event_type"))
    failed = F.col("event_type") == "error"
    out = sequences.burst_counts(s, failed, "failures", frame_us=DAY).frame
    return out.where(failed & (F.col("failures") >= 3)).select("event_id", "user_id", "failures")
