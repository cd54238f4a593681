"""Sensor messages, meter feeds and inventory answers from JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_num

CORRUPT = "_corrupt_record"
MESSAGE = f"""labId string, sublabId string, ipAddress string, measureTimestamp string, sensorReadings string, {CORRUPT} string"""
READINGS = "water string, fumehood string"
HOOD = "distance double, light double, airflow double"
CONTAINER = "id long, name string, location long, size string, unitid long, unit string, substance long, cas string, barcode string, locationtext string"

# An unquoted None is not JSON and spoils the whole message.
BARE_NONE = r"[:\[,]\s*None\s*[,}\]]"


def decode(df: DataFrame, payload: str) -> DataFrame:
    """Messages with parsed fields and ``reject``, the reason a message is refused (null when good).

    The parse sits in a one-element generator, so that filters on its result do not repeat it.
    """
    text = F.translate(F.col(payload), "'", '"')
    spoiled = text.rlike(BARE_NONE)
    m = F.from_json(F.when(~spoiled, text), MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = df.select(*df.columns, F.explode(F.array(m)).alias("_m"))
    bad = F.col("_m").isNull() | F.col(f"_m.{CORRUPT}").isNotNull()
    empty = F.coalesce(F.col("_m.sensorReadings"), F.lit("")).isin("", "{}", "[]", "0", "false")
    lacking = F.col("_m.labId").isNull() | F.col("_m.sublabId").isNull() | (F.coalesce(F.col("_m.measureTimestamp"), F.lit("")) == "") | empty
    lab, sublab = F.col("_m.labId").try_cast("int"), F.col("_m.sublabId").try_cast("int")
    at = F.try_to_timestamp("_m.measureTimestamp").cast("timestamp_ntz")
    reject = F.when(bad, "invalid json").when(lacking, "missing field").when(lab.isNull() | sublab.isNull(), "bad id").when(at.isNull(), "bad time")
    readings = F.from_json(F.col("_m.sensorReadings"), READINGS)
    return out.select(
        *df.columns,
        F.coalesce("_m.ipAddress", F.lit("unknown")).alias("ip_address"),
        lab.alias("lab_id"),
        sublab.alias("sublab_id"),
        at.alias("ts"),
        readings["water"].alias("_water"),
        readings["fumehood"].alias("_hood"),
        F.coalesce(F.array_contains(F.json_object_keys("_m.sensorReadings"), "water"), F.lit(False)).alias("_has_water"),
        reject.alias("reject"),
    )


def _carried(decoded: DataFrame, carry: tuple[str, ...] = ()) -> list[str]:
    return [c for c in carry if c in decoded.columns]


def water_rows(decoded: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Litres from messages with a water reading in millilitres (0 when not a number); ``carry`` names columns to keep."""
    good = decoded.where(F.col("reject").isNull() & F.col("_has_water"))
    return good.select(*_carried(decoded, carry), "lab_id", "sublab_id", (to_num(F.col("_water")) / 1000).alias("water"), "ts")


def hood_rows(decoded: DataFrame) -> DataFrame:
    """Distance, light and airflow from messages whose hood reading is an object."""
    good = decoded.where(F.col("reject").isNull() & F.trim("_hood").startswith("{")).withColumn("_h", F.from_json("_hood", HOOD))
    return good.select("lab_id", "sublab_id", "_h.distance", "_h.light", "_h.airflow", "ts")


def rejects(decoded: DataFrame, payload: str) -> DataFrame:
    return decoded.where(F.col("reject").isNotNull()).select(payload, "reject")


def parse_messages(df: DataFrame, payload: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(water rows, hood rows, rejected messages)."""
    decoded = decode(df, payload)
    return water_rows(decoded), hood_rows(decoded), rejects(decoded, payload)


def parse_meter_feed(df: DataFrame, body: str) -> DataFrame:
    """Rows (ts, cumulative_kwh) of a feed [[milliseconds, kWh or null], ..], in feed order."""
    points = F.from_json(body, "array<array<double>>")
    keep = [c for c in df.columns if c != body]
    rows = df.select(*keep, F.posexplode(points).alias("pos", "_p"))
    ts = F.timestamp_millis(F.col("_p")[0].cast("long")).cast("timestamp_ntz")
    return rows.select(*keep, "pos", ts.alias("ts"), F.col("_p")[1].alias("cumulative_kwh"))


def flatten_containers(df: DataFrame, body: str) -> DataFrame:
    """One row per container of inventory answers; an answer without containers gives none.

    An answer sent as a JSON string of JSON is unwrapped first.
    """
    text = F.when(F.trim(body).startswith('"'), F.get_json_object(F.concat(F.lit('{"a":'), F.col(body), F.lit("}")), "$.a")).otherwise(F.col(body))
    answer = F.from_json(text, f"data struct<containers: array<struct<{_struct(CONTAINER)}>>>")
    keep = [c for c in df.columns if c != body]
    return df.select(*keep, F.inline(answer["data"]["containers"]))


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split() for c in ddl.split(", ")))
