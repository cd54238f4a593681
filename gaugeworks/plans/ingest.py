"""Scans, message parsing and sinks on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import tables as sinks
from ..sources import messages, scans, sheets
from .registry import query


def payloads(t):
    """Events as sensor messages in their quoted form.

    Error events carry a bare None; sign-ups an unreadable id or time, or nothing but a water reading inside the hood's.
    """
    odd = F.col("event_id") % 3
    signup = F.col("event_type") == "signup"
    lab = F.when(signup & (odd == 0), F.lit("'abc'")).otherwise(F.col("user_id").cast("string"))
    text = F.concat(
        F.lit("{'labId': "), lab, F.lit(", 'sublabId': "), F.get_json_object("props", "$.k"), F.lit(", 'ipAddress': '10.0.0.1', 'sensorReadings': "),
        F.when(F.col("event_type") == "error", "{'water': None}")
        .when(F.col("event_type") == "view", F.concat(F.lit("{'fumehood': {'distance': "), F.col("value"), F.lit(", 'light': 12.5, 'airflow': null}}")))
        .when(F.col("event_type") == "click", F.concat(F.lit("{'water': "), F.col("value"), F.lit("}")))
        .when(signup, F.concat(F.lit("{'fumehood': {'distance': 1.5, 'water': "), F.col("value"), F.lit("}}")))
        .otherwise("{}"),
        F.lit(", 'measureTimestamp': '"), F.when(signup & (odd == 1), F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), F.lit("'}"),
    )
    return t.events.select("event_id", text.alias("payload"))


@query("json_props", """SELECT event_id, CAST(user_id AS INT) AS lab_id, CAST(json_extract(props, '$.k') AS INT) AS sublab_id, value / 1000 AS water, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'click'""")
def json_props(t):
    return messages.water_rows(messages.decode(payloads(t), "payload"), ("event_id",))


@query("message_hoods", """SELECT CAST(user_id AS INT) AS lab_id, CAST(json_extract(props, '$.k') AS INT) AS sublab_id, CASE WHEN event_type = 'view' THEN value ELSE 1.5 END AS distance, CASE WHEN event_type = 'view' THEN 12.5 END AS light, CAST(NULL AS DOUBLE) AS airflow, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'view' OR (event_type = 'signup' AND event_id % 3 = 2)""")
def message_hoods(t):
    return messages.parse_messages(payloads(t), "payload")[1]


@query("message_rejects", """SELECT CASE WHEN event_type = 'error' THEN 'invalid json' WHEN event_type = 'purchase' THEN 'missing field' WHEN event_id % 3 = 0 THEN 'bad id' ELSE 'bad time' END AS reject, count(*) AS messages
    FROM events WHERE event_type IN ('error', 'purchase') OR (event_type = 'signup' AND event_id % 3 < 2) GROUP BY 1""")
def message_rejects(t):
    return messages.parse_messages(payloads(t), "payload")[2].groupBy("reject").agg(F.count("*").alias("messages"))


@query("meter_feed", """SELECT user_id, ts, value AS cumulative_kwh FROM (SELECT user_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts, value FROM events)""")
def meter_feed(t):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string")
    point = F.concat(F.lit("[["), ms, F.lit(", "), F.col("value").cast("string"), F.lit("]]"))
    return messages.parse_meter_feed(t.events.select("user_id", point.alias("body")), "body").drop("pos")


@query("scan_project", "SELECT event_id, ts, value FROM events")
def scan_project(t):
    return scans.read_table(t.spark, f"{t.folder}/events.parquet", ["event_id", "ts", "value"])


@query("scan_window", "SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND event_type = 'click'")
def scan_window(t):
    return scans.scan_window(t.events, "ts", "2024-01-08", "2024-01-15", {"event_type": "click"}).select("event_id", "user_id", "ts")


@query("lookback", """SELECT event_id, ts FROM events WHERE (SELECT max(ts) - min(ts) <= INTERVAL 20 DAY FROM events) OR ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def lookback(t):
    last = t.events.agg(F.max("ts")).scalar()
    return scans.lookback(t.events, "ts", last, max_span_days=20).select("event_id", "ts")


@query("unpivot_measures", """SELECT l_orderkey, l_linenumber, 'line' AS grp, u.m AS metric, l_shipdate AS ts, u.v AS value FROM (SELECT *, unnest([{'m': 'quantity', 'v': l_quantity},
    {'m': 'price', 'v': l_extendedprice}, {'m': 'discount', 'v': l_discount}]) AS u FROM lineitem)""")
def unpivot_measures(t):
    pairs = [("line", "quantity", "l_shipdate", "l_quantity"), ("line", "price", "l_shipdate", "l_extendedprice"), ("line", "discount", "l_shipdate", "l_discount")]
    return sheets.unpivot_pairs(t.lineitem, pairs, ["l_orderkey", "l_linenumber"])


@query("anti_append", """WITH n AS (SELECT user_id, CAST(ts AS DATE) AS d, min(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
    SELECT user_id, d, event_id FROM n WHERE (user_id, d) NOT IN (SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'view')""")
def anti_append(t):
    rows = t.events.select("event_id", "user_id", F.col("ts").cast("date").alias("d"), "event_type")
    fresh, stored = rows.where("event_type <> 'view'").drop("event_type"), rows.where("event_type = 'view'")
    return sinks.unseen(fresh, stored, ["user_id", "d"], ["event_id"])


@query("export_window", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'")
def export_window(t):
    rows = sinks.between_days(t.events.select("event_id", "ts", "value"), "ts", "2024-01-10", "2024-01-12")
    return rows.repartitionByRange("ts").sortWithinPartitions("ts")
