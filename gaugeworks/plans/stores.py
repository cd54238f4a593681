"""Sheets, dimension files and sinks on the test tables: what is written is read again."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import stats
from ..operators.lineage import new_folder
from ..sinks import tables as sinks
from ..sources import dims, scans, sheets
from . import marts
from .registry import query
from .views import USER

HEADINGS = ["Form reference no.", "Chemical name", " Description of waste ", "No. of containers", "Container size", "Note", "Hazard Properties (HP)"]


def grid(t):
    """One raw sheet per brand: a title, the header in the brand's own row, then its parts; the first name column is empty but for every fifth part."""
    start = F.substring("p_brand", 7, 9).cast("int") % 4
    text = lambda c: F.col(c).cast("string")
    flags = F.concat(F.lit("HP0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("; hp"), (F.col("p_size") % 15 + 1).cast("string"))
    cells = F.array(
        F.concat(F.lit(" "), text("p_partkey")), F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")), F.concat(text("p_name"), F.lit("  ")),
        F.when(F.col("p_partkey") % 3 == 0, "some").otherwise(text("p_size")), F.lit(None).cast("string"), F.lit("n"), F.when(F.col("p_partkey") % 4 > 0, flags),
    )
    parts = t.part.select(F.col("p_brand").alias("sheet"), (F.col("p_partkey") + 10).alias("row"), cells.alias("cells"))
    brands = t.part.groupBy("p_brand").agg(F.first(start).alias("at"))
    title = brands.select(F.col("p_brand").alias("sheet"), F.lit(0).cast("long").alias("row"), F.array(F.lit("Waste"), F.lit(None)).alias("cells"))
    head = brands.select(F.col("p_brand").alias("sheet"), (F.col("at") + 1).cast("long").alias("row"), F.array(*map(F.lit, HEADINGS)).alias("cells"))
    return parts.unionByName(title).unionByName(head)


FORM_SQL = """f AS (SELECT p_brand AS sheet, p_partkey + 10 AS row, CAST(p_partkey AS VARCHAR) AS reference, CASE WHEN p_partkey % 5 = 0 THEN trim(p_type) ELSE trim(p_name) END AS chemical_name,
    CASE WHEN p_partkey % 3 = 0 THEN 'some' ELSE CAST(p_size AS VARCHAR) END AS num_containers, CASE WHEN p_partkey % 4 > 0 THEN concat('HP0', p_size % 9 + 1, '; hp', p_size % 15 + 1) END AS hazard_properties FROM part)"""


@query("sheet_columns", f"""WITH {FORM_SQL} SELECT *, CAST(NULL AS VARCHAR) AS container_size, CAST(NULL AS VARCHAR) AS physical_state, CAST(NULL AS VARCHAR) AS hazard_statements FROM f""")
def sheet_columns(t):
    return sheets.sheet_columns(grid(t), "row", "cells", ["sheet"])


@query("sheet_header", """SELECT p_brand AS sheet, CAST(any_value(CAST(substr(p_brand, 7) AS INT) % 4 + 1) AS BIGINT) AS header_row, 7 AS headings FROM part GROUP BY p_brand""")
def sheet_header(t):
    return sheets.sheet_headers(grid(t), "row", "cells", ["sheet"]).withColumn("headings", F.size("headings"))


@query("sheet_frame", """SELECT CAST(p_partkey AS VARCHAR) AS ref, CASE WHEN p_partkey % 5 = 0 THEN trim(p_type) END AS name, trim(p_name) AS waste, 'n' AS note FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)""")
def sheet_frame(t):
    first = t.part.agg(F.min("p_brand")).scalar()
    named = sheets.sheet_frame(grid(t).where(F.col("sheet") == first), "row", "cells")
    return named.select(F.col("`Form reference no.`").alias("ref"), F.col("Chemical name").alias("name"), F.col("Description of waste").alias("waste"), F.col("Note").alias("note"))


CLEAN = ["reference", "chemical_name", "num_containers", "hazard_properties", *sheets.HP_VOCABULARY]
CLEAN_SQL = f"""SELECT reference, chemical_name, CASE WHEN CAST(reference AS INT) % 3 = 0 THEN 0 ELSE CAST(num_containers AS INT) END AS num_containers,
    CASE WHEN hazard_properties IS NULL THEN '' WHEN a = b THEN a ELSE concat(a, ',', b) END AS hazard_properties,
    {', '.join(f"CAST(coalesce(a = '{h}' OR b = '{h}', false) AS INT) AS {h}" for h in sheets.HP_VOCABULARY)}
    FROM (SELECT f.*, concat('HP', p_size % 9 + 1) AS a0, CASE WHEN hazard_properties IS NOT NULL THEN concat('HP', p_size % 9 + 1) END AS a,
        CASE WHEN hazard_properties IS NOT NULL THEN concat('HP', p_size % 15 + 1) END AS b FROM f JOIN part ON p_partkey + 10 = row)"""


@query("form_clean", f"WITH {FORM_SQL} {CLEAN_SQL}")
def form_clean(t):
    rows = sheets.clean_form(sheets.sheet_columns(grid(t), "row", "cells", ["sheet"])).select(*CLEAN)
    return rows.withColumn("hazard_properties", F.array_join("hazard_properties", ","))


def _exported(t, fmt: str):
    path = new_folder(t.spark)
    sinks.write_clean(sheets.clean_form(sheets.sheet_columns(grid(t), "row", "cells", ["sheet"])), path, fmt, date(2024, 1, 1))
    return path


@query("form_json", f"WITH {FORM_SQL} SELECT reference, hazard_properties, DATE '2024-01-01' AS date FROM ({CLEAN_SQL})")
def form_json(t):
    rows = t.spark.read.schema("reference string, hazard_properties array<string>, date date").json(_exported(t, "json"))
    return rows.withColumn("hazard_properties", F.array_join("hazard_properties", ","))


@query("form_csv", f"WITH {FORM_SQL} SELECT reference, hazard_properties, DATE '2024-01-01' AS date FROM ({CLEAN_SQL})")
def form_csv(t):
    rows = t.spark.read.option("header", True).option("escape", '"').csv(_exported(t, "csv"))
    return rows.select("reference", F.array_join(F.from_json("hazard_properties", "array<string>"), ",").alias("hazard_properties"), F.col("date").cast("date"))


@query("positional_names", """SELECT CAST(l_shipdate AS DATE) AS Date, l_orderkey AS Ref, l_quantity AS Size, l_returnflag AS Unit FROM lineitem""")
def positional_names(t):
    rows = t.lineitem.select(F.col("l_shipdate").cast("date").alias("Unnamed: 0"), F.col("l_orderkey").alias("Unnamed: 1"), F.col("l_quantity").alias("Unnamed: 3"), F.col("l_returnflag").alias("Unnamed: 4"))
    return sheets.ensure_columns(rows)


@query("hazard_file", """SELECT p_type AS grp, string_agg(DISTINCT concat('HP', CAST(substr(p_brand, 7) AS INT)), ',' ORDER BY concat('HP', CAST(substr(p_brand, 7) AS INT))) AS codes FROM part GROUP BY p_type""")
def hazard_file(t):
    path = new_folder(t.spark)
    t.part.select(F.col("p_type").alias("grp"), F.concat(F.lit("hp 0"), F.substring("p_brand", 7, 9), F.lit("; HP"), F.substring("p_brand", 7, 9)).alias("code")).write.option("header", True).csv(path)
    return dims.hazard_lists(t.spark, path).withColumn("codes", F.array_join("codes", ","))


@query("listed_file", """SELECT name, cas FROM solvents""")
def listed_file(t):
    path = new_folder(t.spark)
    t.solvents.select("name", "cas").write.option("header", True).csv(path)
    return dims.solvents(t.spark, path)


@query("display_label", """SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 0 THEN c_name ELSE concat('Lab ', c_custkey) END AS label FROM customer""")
def display_label(t):
    names = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("display"))
    return dims.label(t.customer.select(F.col("c_custkey").alias("user_id")), names, USER, F.concat(F.lit("Lab "), F.col("user_id").cast("string")))


def readings_table(t):
    return t.events.select("user_id", "ts", "event_id", "value")


@query("append_days", """SELECT 'first' AS run, count(*) AS inserted, 0 AS skipped FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_id % 3 > 0)
    UNION ALL SELECT 'second', count(*), (SELECT count(*) FROM events) - count(*) FROM (SELECT DISTINCT user_id, ts FROM events EXCEPT SELECT user_id, ts FROM events WHERE event_id % 3 > 0)
    UNION ALL SELECT 'again', 0, count(*) FROM events""")
def append_days(t):
    path, rows, runs = new_folder(t.spark), readings_table(t), []
    for run, part in (("first", rows.where("event_id % 3 > 0").dropDuplicates(["user_id", "ts"])), ("second", rows), ("again", rows)):
        done = sinks.append_new(part, path, ["user_id", "ts"], "ts", ["event_id"])
        runs.append((run, done["inserted"], done["skipped"]))
    return t.spark.createDataFrame(runs, "run string, inserted long, skipped long")


@query("stored_days", """SELECT user_id, ts, min(event_id) AS event_id, CAST(ts AS DATE) AS day FROM events GROUP BY user_id, ts""")
def stored_days(t):
    path, rows = new_folder(t.spark), readings_table(t)
    half = F.pmod(F.xxhash64("user_id", "ts"), F.lit(2))
    for part in (rows.where(half == 0), rows):
        sinks.append_new(part, path, ["user_id", "ts"], "ts", ["event_id"])
    return sinks.open_table(t.spark, path).select("user_id", "ts", "event_id", "day")


@query("scan_days", "SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-08 06:00:00' AND ts < TIMESTAMP '2024-01-15'")
def scan_days(t):
    path = new_folder(t.spark)
    sinks.append(readings_table(t).withColumn("day", F.col("ts").cast("date")), path, ["day"])
    return scans.scan_window(t.spark.read.parquet(path), "ts", "2024-01-08 06:00:00", "2024-01-15", day="day").select("event_id", "user_id", "ts")


@query("append_rows", """SELECT user_id, 2 * count(*) AS rows FROM events GROUP BY user_id""")
def append_rows(t):
    path = new_folder(t.spark)
    for enabled in (True, False, True):
        sinks.append(readings_table(t), path, enabled=enabled)
    return t.spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("rows"))


SNAPSHOT_SQL = """SELECT category, DATE '2024-01-01' + CAST(r.i AS INT) AS run_date, TIMESTAMP '2024-01-01 08:00:00' + INTERVAL (r.i) DAY AS snapshot_ts, colour, count(DISTINCT cas) AS codes
    FROM classes CROSS JOIN (SELECT unnest([0, 1]) AS i) r WHERE r.i = 0 OR category = 'voc' GROUP BY ALL"""


@query("snapshot_rows", SNAPSHOT_SQL)
def snapshot_rows(t):
    path = new_folder(t.spark)
    rows = t.classes.groupBy("category", "colour").agg(F.countDistinct("cas").alias("codes"))
    later = rows.where("category = 'voc'")
    # The second run comes twice, as after a failure.
    for part, day in ((rows, 1), (later, 2), (later, 2)):
        sinks.write_snapshot(part, path, "category", datetime(2024, 1, day, 8))
    return t.spark.read.parquet(path).select("category", "run_date", "snapshot_ts", "colour", "codes")


@query("export_tables", """SELECT 'events' AS name, count(*) AS rows FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'
    UNION ALL SELECT 'readings', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' AND event_type = 'view'""")
def export_tables(t):
    out = new_folder(t.spark)
    views = {"events": t.events, "readings": t.events.where("event_type = 'view'"), "hoods": t.hoods}
    for name, df in views.items():
        df.createOrReplaceTempView(f"gw_export_{name}")
    try:
        found = {n.removeprefix("gw_export_"): df for n, df in sinks.tables_with(t.spark, "ts").items() if n.startswith("gw_export_")}
        done = sinks.export_day(found, "2024-01-10", out, "ts")
    finally:
        for name in views:
            t.spark.catalog.dropTempView(f"gw_export_{name}")
    counts = [t.spark.read.option("header", True).csv(f"{out}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in done]
    return counts[0].unionByName(counts[1]) if len(counts) == 2 else counts[0]


@query("mart_cards", """SELECT user_id, count(*) AS rows, max(ts) AS last_ts FROM events GROUP BY user_id""")
def mart_cards(t):
    folder = new_folder(t.spark)
    latest = stats.latest_rows(t.readings, USER, "ts", "event_id").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    marts.write_marts({"rows": t.readings.groupBy("user_id").agg(F.count("*").alias("rows")), "latest": latest}, folder)
    read = t.spark.read.parquet
    return read(f"{folder}/rows").join(read(f"{folder}/latest"), "user_id")
