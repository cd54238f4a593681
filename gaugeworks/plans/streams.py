"""The streams on the test tables: events arrive as files, and what the watermark has settled is held against SQL."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import new_folder
from ..operators.series import DAY, MINUTE
from ..streaming import health, ingest, windows
from .ingest import payloads
from .registry import ORACLES, query
from .views import DEC, USER

DELAY = "1 day"
#: Time up to which all is settled once every row has arrived; watermarks count milliseconds.
MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)"


def arrivals(t) -> DataFrame:
    # As a pattern the path may be one file or a folder of files.
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]")


def settled(t, stream: DataFrame) -> DataFrame:
    """Run an append stream until its input is used up; the rows it gave."""
    out, checkpoint = new_folder(t.spark), new_folder(t.spark)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query("stream_messages", """SELECT CAST(user_id AS INT) AS lab_id, CAST(json_extract(props, '$.k') AS INT) AS sublab_id, value / 1000 AS water, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'click'""")
def stream_messages(t):
    out = new_folder(t.spark)
    ingest.ingest_messages(payloads(SimpleNamespace(events=arrivals(t))), "payload", out, new_folder(t.spark)).awaitTermination()
    return t.spark.read.parquet(f"{out}/water").select("lab_id", "sublab_id", "water", "ts")


@query("stream_rejects", ORACLES["message_rejects"])
def stream_rejects(t):
    out = new_folder(t.spark)
    ingest.ingest_messages(payloads(SimpleNamespace(events=arrivals(t))), "payload", out, new_folder(t.spark)).awaitTermination()
    return t.spark.read.parquet(f"{out}/rejects").groupBy("reject").agg(F.count("*").alias("messages"))


@query("stream_new", "SELECT DISTINCT user_id, ts, CAST(ts AS DATE) AS day FROM events")
def stream_new(t):
    out = new_folder(t.spark)
    for _ in range(2):  # without a common checkpoint every row comes again
        ingest.ingest_new(arrivals(t).select("user_id", "ts", "event_id"), ["user_id", "ts"], "ts", DELAY, out, new_folder(t.spark), ["event_id"]).awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").select("user_id", "ts", "day")


@query("stream_windows", f"""WITH w AS (SELECT user_id, date_trunc('hour', ts) AS start_ts, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS samples FROM events GROUP BY 1, 2)
    SELECT user_id, start_ts, start_ts + INTERVAL 1 HOUR AS end_ts, total, samples FROM w WHERE start_ts + INTERVAL 1 HOUR <= {MARK}""")
def stream_windows(t):
    rows = arrivals(t).select("user_id", "ts", F.col("value").cast(DEC).alias("value"))
    return settled(t, windows.tumbling(rows, USER, "ts", "value", "1 hour", DELAY)).withColumn("total", F.col("total").cast("double"))


@query("stream_sessions", f"""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM x),
    r AS (SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS samples FROM s GROUP BY user_id, run)
    SELECT * FROM r WHERE end_ts + INTERVAL 2 HOUR + INTERVAL 1 MICROSECOND <= {MARK}""")
def stream_sessions(t):
    rows = arrivals(t).select("user_id", "ts", F.col("value").cast(DEC).alias("value"))
    return settled(t, windows.session_runs(rows, USER, "ts", "value", 120 * MINUTE, DELAY)).withColumn("total", F.col("total").cast("double"))


def signals(events: DataFrame) -> DataFrame:
    v = F.col("value")
    return events.select(
        "event_id", "user_id", "ts",
        F.when(F.col("event_type") == "view", 0.0).when(F.col("event_type") == "error", -1.0).otherwise(765.0 - 2.0 * v).alias("distance"),
        F.when(F.col("event_type") != "error", F.when(v < 60, 0.0).otherwise(v)).alias("light"),
    )


@query("stream_health", f"SELECT * FROM ({ORACLES['health_alerts']}) WHERE ts < {MARK}")
def stream_health(t):
    return settled(t, health.health_alerts(signals(arrivals(t)), "user_id", "ts", "event_id", "distance", "light", health.HealthLimits(2, 3, 2, 2), delay=DELAY, idle_us=400 * DAY))


@query("stream_repairs", f"""WITH r AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS fix, event_type = 'view' AS zero FROM events),
    b AS (SELECT *, max(CASE WHEN fix THEN 1 ELSE 0 END) OVER same = 1 AS fixed_now, sum(CASE WHEN fix OR NOT zero THEN 1 ELSE 0 END) OVER w AS stretch FROM r
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, CASE WHEN fix THEN 1 ELSE 0 END, event_id), same AS (PARTITION BY user_id, ts)),
    n AS (SELECT event_id, user_id, ts, zero, count(*) FILTER (zero) OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id) AS run FROM b WHERE NOT fix)
    SELECT user_id, event_id, ts, 'zero_distance' AS rule, run FROM n WHERE zero AND run >= 2 AND ts < {MARK}""")
def stream_repairs(t):
    """Views are zero distances; a purchase is a repair that worked, in a stream of its own."""
    rows = arrivals(t).where("event_type <> 'purchase'")
    readings = rows.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "view", 0.0).otherwise(1.0).alias("distance"), F.col("event_id").cast("double").alias("light"))
    repairs = arrivals(t).where("event_type = 'purchase'").select("user_id", "ts", F.lit("distance").alias("target"))
    limits = health.HealthLimits(2, 10**6, 10**6, 10**6)
    return settled(t, health.health_alerts(readings, "user_id", "ts", "event_id", "distance", "light", limits, repairs=repairs, delay=DELAY, idle_us=400 * DAY))


@query("stream_breaker", f"""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
    c AS (SELECT a.event_id, a.user_id, a.ts, count(*) AS failures FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL 2 DAY AND (b.ts < a.ts OR b.ts = a.ts AND b.event_id <= a.event_id) GROUP BY ALL)
    SELECT user_id, event_id, ts, CASE WHEN failures >= 3 THEN 'open' ELSE 'failed' END AS outcome, failures FROM c WHERE ts < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM e)""")
def stream_breaker(t):
    """Every error is a failed recovery; without a pause all of them count."""
    failed = arrivals(t).where("event_type = 'error'").select("event_id", "user_id", "ts", F.lit(False).alias("ok"))
    return settled(t, health.circuit_breaker(failed, "user_id", "ts", "event_id", "ok", health.BreakerLimits(3, 2 * 86400.0, 0.0), delay=DELAY))
