"""Operators on small literal inputs with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import register
from gaugeworks.functions import scalars as S
from gaugeworks.operators import asof, sequences, stats, stock, usage, waste
from gaugeworks.operators.series import MINUTE, Series
from gaugeworks.sinks import tables as sinks
from gaugeworks.sources import dims, messages, scans, sheets


def at(text):
    return dt.datetime.fromisoformat(text)


def readings(spark, rows, value="light"):
    data = [(1, i, at(t), float(v) if v is not None else None) for i, (t, v) in enumerate(rows)]
    return spark.createDataFrame(data, f"user_id long, event_id long, ts timestamp_ntz, {value} double")


def series(df, rows=None):
    s = Series.of(df, ["user_id"], "ts", ["event_id"])
    return s.split(rows) if rows else s


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    "rows, litres, skipped",
    [
        ([("1000", "ml"), ("500", "ml")], 1.5, 0),
        ([("N/A", "ml"), ("250", "ml")], 0.25, 1),
        ([("100", "weird"), ("200", "ml")], 0.2, 1),
        ([(" 50 ", " ml"), ("100", "mL"), (None, "ml")], 0.15, 1),
    ],
)
def test_sizes(spark, rows, litres, skipped):
    df = spark.createDataFrame([("c", *r) for r in rows], "cas string, size string, unit string")
    r = one(stock.litres_by_code(df))
    assert r.litres == pytest.approx(litres) and r.skipped == skipped


def test_greek_mu_is_skipped_unless_normalised(spark):
    df = spark.createDataFrame([("5", "μl")], "size string, unit string")
    r = one(df.select(S.to_litres(F.col("size"), F.col("unit")).alias("a"), S.to_litres(F.col("size"), F.col("unit"), normalize_mu=True).alias("b")))
    assert r.a is None and r.b == pytest.approx(5e-6)


def test_to_num_takes_plain_numbers_only(spark):
    df = spark.createDataFrame([(x,) for x in ["12", " 1.5e2 ", "1d", "", None, "abc"]], "x string")
    assert [r[0] for r in df.select(S.to_num(F.col("x"))).collect()] == [12.0, 150.0, 0.0, 0.0, 0.0, 0.0]


def test_traffic_light_from_answer(spark):
    body = '{"data":{"containers":[{"size":"N/A","unit":"ml","location":1,"cas":"c"},{"size":"500","unit":"ml","location":1,"cas":"c"},{"size":"9","unit":"L","location":527895,"cas":"c"}]}}'
    boxes = messages.flatten_containers(spark.createDataFrame([(body,)], "body string"), "body")
    listed = spark.createDataFrame([("a", "c"), ("b", "c")], "name string, cas string")
    classes = spark.createDataFrame([("composite", "red", "c"), ("composite", "red", "c")], "category string, colour string, cas string")
    cells = {(r.category, r.colour): r.litres for r in stock.traffic_light(boxes, listed, classes).collect()}
    assert cells == {("composite", "red"): 1.0, ("composite", "yellow"): 0.0, ("composite", "green"): 0.0}
    deduped = {r.colour: r.litres for r in stock.traffic_light(boxes, listed, classes, dedupe=True).collect()}
    assert deduped["red"] == 0.5
    assert one(stock.skipped_total(boxes, listed)).skipped == 2
    assert stock.red_inventory(boxes, listed, classes).count() == 4  # two names, code twice on the list


def test_answer_wrapped_in_a_string(spark):
    body = '"{\\"data\\":{\\"containers\\":[{\\"name\\":\\"n\\"}]}}"'
    assert messages.flatten_containers(spark.createDataFrame([(body,)], "body string"), "body").count() == 1


def test_presence_alignment(spark):
    target = readings(spark, [("2026-04-20 10:00", 0), ("2026-04-20 10:10", 0), ("2026-04-20 10:40", 0)]).drop("light")
    seen = readings(spark, [("2026-04-20 09:55", 1), ("2026-04-20 10:20", 0)], "presence")
    join = lambda right: [r.presence for r in asof.asof_join(target, right, ["user_id"], "ts", "ts", ["presence"], "event_id", defaults={"presence": 0.0}, tolerance_us=30 * MINUTE).orderBy("ts").collect()]
    assert join(seen) == [1.0, 1.0, 0.0]
    assert join(seen.limit(0)) == [0.0, 0.0, 0.0]


def test_asof_ties_and_matched_null(spark):
    left = readings(spark, [("2026-01-01 10:00", 0), ("2026-01-01 11:00", 0)]).drop("light")
    right = readings(spark, [("2026-01-01 10:00", 1), ("2026-01-01 10:00", 2), ("2026-01-01 10:30", None)], "v")
    out = asof.asof_join(left, right, ["user_id"], "ts", "ts", ["v"], "event_id", defaults={"v": -1.0}).orderBy("ts").collect()
    assert [r.v for r in out] == [2.0, None]


def test_working_day(spark):
    df = spark.createDataFrame([("2026-04-20",), ("2026-04-19",), ("2026-04-18",)], "d string")
    out = df.select(S.prev_working_day(F.col("d").cast("date"))).collect()
    assert [str(r[0]) for r in out] == ["2026-04-17"] * 3


def test_presence_hours(spark):
    hoods = dims.hoods(spark.createDataFrame([(1,)], "user_id long"))
    rows = readings(spark, [("2026-01-01 09:00", 20), ("2026-01-01 10:00", 20), ("2026-01-02 09:00", 0), ("2026-01-02 10:00", 0)])
    for chunk in (None, 3):
        flagged = usage.presence(rows, hoods, ["user_id"], "light", "room_lux")
        out = {str(r.day): r.hours_present for r in sequences.presence_hours(series(flagged, chunk), "presence").collect()}
        assert out == {"2026-01-01": 1.0, "2026-01-02": 0.0}


def test_presence_does_not_carry_over_a_gap(spark):
    rows = readings(spark, [("2026-01-01 09:00", 1), ("2026-01-01 10:00", 1), ("2026-01-01 20:00", 0), ("2026-01-01 21:00", 0)], "presence")
    assert one(sequences.presence_hours(series(rows), "presence")).hours_present == 1.0


def test_presence_over_two_midnights(spark):
    rows = readings(spark, [("2026-01-01 22:00", 1), ("2026-01-03 02:00", 0), ("2026-01-04 06:00", 0)], "presence")
    out = {str(r.day): r.hours_present for r in sequences.presence_hours(series(rows), "presence").collect()}
    assert out == {"2026-01-01": 2.0, "2026-01-03": 2.0, "2026-01-04": 0.0}  # the 2nd has no readings


MESSAGES = [
    "{'labId': 1, 'sublabId': 2, 'ipAddress': 'x', 'sensorReadings': {'water': 1250}, 'measureTimestamp': '2026-07-24 12:00:00'}",
    "{'labId': 1, 'sublabId': 2, 'sensorReadings': {'fumehood': {'distance': 700.5, 'light': 3, 'airflow': 0}}, 'measureTimestamp': '2026-07-24 12:00:05'}",
    "{'labId': 1, 'sublabId': 2, 'sensorReadings': {'fumehood': 5}, 'measureTimestamp': '2026-07-24 12:00:10'}",
    "{'labId': null, 'sublabId': 2, 'sensorReadings': {'water': 1}, 'measureTimestamp': '2026-07-24 12:00:00'}",
    "{'labId': 1, 'sublabId': 2, 'sensorReadings': {'water': None}, 'measureTimestamp': '2026-07-24 12:00:00'}",
    "{'labId': 1, 'sublabId': 2, 'sensorReadings': {}, 'measureTimestamp': '2026-07-24 12:00:00'}",
    "not json",
    "[{'labId': 1, 'sublabId': 2, 'sensorReadings': {'water': 1}, 'measureTimestamp': '2026-07-24 12:00:00'}]",
]


def test_messages(spark):
    water, hood, bad = messages.parse_messages(spark.createDataFrame([(m,) for m in MESSAGES], "payload string"), "payload")
    assert [tuple(r) for r in water.collect()] == [(1, 2, 1.25, at("2026-07-24 12:00:00"))]
    assert [tuple(r) for r in hood.collect()] == [(1, 2, 700.5, 3.0, 0.0, at("2026-07-24 12:00:05"))]
    assert bad.count() == 5


def test_meter_feed_and_deltas(spark):
    feed = spark.createDataFrame([(1, "[[0, 10.0], [60000, 10.5], [120000, null], [180000, 11.0], [240000, 10.0]]")], "user_id long, body string")
    rows = messages.parse_meter_feed(feed, "body").withColumn("event_id", F.col("pos").cast("long"))
    out = sequences.meter_delta(series(rows), "cumulative_kwh", "d").orderBy("ts").collect()
    assert [(r.ts, r.d) for r in out] == [(at("1970-01-01 00:01:00"), 0.5), (at("1970-01-01 00:04:00"), -1.0)]
    two_days = readings(spark, [("2026-01-01 00:00", 5), ("2026-01-02 00:00", 8)], "c")
    daily = sequences.daily_delta(two_days, ["user_id"], "ts", "event_id", "c", "kwh").orderBy("d").collect()
    assert [r.kwh for r in daily] == [3.0, None]


def test_code_lists(spark):
    codes = lambda text: one(spark.createDataFrame([(text,)], "x string").select(S.parse_codes(F.col("x")).alias("p"), S.normalize_codes(S.parse_codes(F.col("x"))).alias("n")))
    assert [codes(x).n for x in ("HP06", "Hp 6", " hp06 ", "euh019")] == [["HP6"], ["HP6"], ["HP6"], ["EUH019"]]
    assert codes("H225; H301+H311,EUH019 /H302").p == ["H225", "H301", "H311", "EUH019", "H302"]
    assert codes("HP06;HP6;hp6;HP06;HP3").n == ["HP6", "HP3"]
    assert codes(None).p == []


def test_form_and_one_hot(spark):
    form = spark.createDataFrame([("1", "HP06;HP3", "1"), ("2", "hp4", "x"), ("x", None, "3"), (None, None, None)], "`Reference no` string, `Hazard properties (HP)` string, `No. of containers` string")
    known = sheets.known_columns(form)
    assert known.columns == ["reference", "num_containers", "hazard_properties"] and known.count() == 3
    rows = sheets.clean_form(known).orderBy("reference").collect()
    assert [(r.reference, r.num_containers, r.HP3, r.HP4, r.HP6) for r in rows] == [("1", 1, 1, 0, 1), ("2", 0, 0, 1, 0)]


def test_an_empty_column_hides_no_other(spark):
    form = spark.createDataFrame([("1", None, " acetone "), ("2", " ", "ether"), ("3", "first", "second")], "Reference string, `Chemical name` string, `Description of waste` string")
    assert [tuple(r) for r in sheets.known_columns(form).orderBy("reference").collect()] == [("1", "acetone"), ("2", "ether"), ("3", "first")]


GRID = [
    ("a", 0, ["Waste form", None, None]),
    ("a", 2, ["Your Reference", "Chemical Name", " Description of waste ", "Note", "Chemical name 2"]),
    ("a", 3, [" 7 ", None, "acetone ", "n"]),
    ("a", 4, ["8", " ", "ether", None, "late"]),
    ("a", 5, [None, "", "  ", "only a note"]),
    ("a", 6, ["reference again"]),
    ("b", 0, ["Reference", "Hazard Properties"]),
    ("b", 1, ["1", "HP06; hp6"]),
    ("c", 23, ["Chemical name", "x"]),
    ("c", 24, ["solvent", "y"]),
    ("d", 1, ["no", "header"]),
    (None, 0, ["reference"]),
    (None, 1, ["9"]),
]


def test_sheet_columns(spark):
    grid = spark.createDataFrame(GRID, "sheet string, row int, cells array<string>").repartition(3)
    out = sheets.sheet_columns(grid, "row", "cells", ["sheet"])
    assert out.columns == ["sheet", "row", *dict.fromkeys(sheets.FORM_RULES.values())]
    got = {(r.sheet, r.row): (r.reference, r.chemical_name, r.hazard_properties) for r in out.collect()}
    assert got == {
        ("a", 3): ("7", "acetone", None),
        ("a", 4): ("8", "ether", None),
        ("a", 6): ("reference again", None, None),
        ("b", 1): ("1", None, "HP06; hp6"),
        ("c", 24): (None, "solvent", None),
        (None, 1): ("9", None, None),
    }
    clean = sheets.clean_form(out).orderBy("reference").collect()
    assert [(r.reference, r.hazard_properties, r.HP6) for r in clean] == [("1", ["HP6"], 1), ("7", [], 0), ("8", [], 0), ("9", [], 0)]
    alone = sheets.sheet_columns(grid.where("sheet = 'b'").drop("sheet"), "row", "cells")
    assert [(r.row, r.reference) for r in alone.collect()] == [(1, "1")]
    assert sheets.sheet_columns(grid.limit(0), "row", "cells", ["sheet"]).count() == 0


def test_sheet_frame(spark):
    rows = [*GRID[1:6], ("a", 7, [None, None, None, None, None, "beyond"])]
    grid = spark.createDataFrame(rows, "sheet string, row int, cells array<string>")
    out = sheets.sheet_frame(grid, "row", "cells")
    # The second column has no values and goes; the last has no heading.
    assert out.columns == ["row", "Your Reference", "Description of waste", "Note", "Chemical name 2", "Unnamed: 5"]
    assert [(r["row"], r["Your Reference"], r["Note"], r["Unnamed: 5"]) for r in out.orderBy("row").collect()] == [(3, "7", "n", None), (4, "8", None, None), (5, None, "only a note", None), (6, "reference again", None, None), (7, None, None, "beyond")]
    twice = spark.createDataFrame([(0, ["reference", "a", "a"]), (1, ["1", "x", "y"])], "row int, cells array<string>")
    assert sheets.sheet_frame(twice, "row", "cells").columns == ["row", "reference", "a", "a (2)"]
    assert sheets.sheet_frame(twice.limit(0), "row", "cells").count() == 0


def test_hazard_lists(spark, tmp_path):
    (tmp_path / "h.csv").write_text("grp,code\nair,H330; h331\nair,H330\n water ,H400\n,H1\n")
    got = {r.grp: r.codes for r in dims.hazard_lists(spark, str(tmp_path / "h.csv")).collect()}
    assert got == {"air": ["H330", "H331"], "water": ["H400"]}


def waste_rows(spark, rows):
    return spark.createDataFrame([(dt.date(2026, 1, d), s, u, *f) for d, s, u, *f in rows], "d date, size double, unit string, HP1 int, HP2 int, HP3 int")


def allocated(df, **kw):
    out = {}
    for r in waste.allocate(df, **kw).collect():
        out[r.hp] = out.get(r.hp, 0) + r.litres
    return out


def test_waste_split(spark):
    split = waste_rows(spark, [(1, 2.5, "L", 1, 0, 1), (1, 2.5, "L", 0, 1, 1), (1, 2.5, "L", 1, 0, 1)])
    assert allocated(split) == pytest.approx({"HP1": 2.5, "HP2": 1.25, "HP3": 3.75})
    assert allocated(split, mode="weighted") == pytest.approx({"HP1": 5.0, "HP2": 2.5, "HP3": 7.5})
    assert allocated(waste_rows(spark, [(1, 2.5, "L", 1, 1, 0)])) == pytest.approx({"HP1": 1.25, "HP2": 1.25, "HP3": 0.0})
    assert allocated(waste_rows(spark, [(1, 2500.0, "ml", 1, 0, 0), (2, 1.0, "odd", 1, 0, 0)]))["HP1"] == pytest.approx(3.5)
    assert allocated(waste_rows(spark, [(1, 2.0, "L", 0, 0, 0)])) == {"HP1": 0.0, "HP2": 0.0, "HP3": 0.0}


def test_waste_positional_names(spark):
    df = spark.createDataFrame([("2026-01-01", "r", 2.5, "L", 1), ("2026-01-02", "r", 1.0, "L", 0)], "`Unnamed: 0` string, `Unnamed: 1` string, `Unnamed: 3` double, `Unnamed: 4` string, HP1 int")
    named = sheets.ensure_columns(df)
    assert {"Date", "Ref", "Size", "Unit"} <= set(named.columns)
    assert {str(r.d): r.litres for r in waste.allocate(named, "Date", "Size", "Unit").collect()} == {"2026-01-01": 2.5, "2026-01-02": 0.0}


def test_headcount_must_be_positive(spark):
    long = spark.createDataFrame([(dt.date(2026, 1, 1), "HP1", 4.0)], "d date, hp string, litres double")
    head = lambda n: spark.createDataFrame([(dt.date(2026, 2, 1), n)], "effective_date date, total_people int")
    assert one(waste.per_head(long, head(2), F.lit("2020-01-01").cast("date"))).litres_per_person == 2.0
    with pytest.raises(Exception, match="must be > 0"):
        waste.per_head(long, head(0), F.lit("2020-01-01").cast("date")).collect()


@pytest.mark.parametrize("zeros, errors", [(9, 9), (10, 0)])
@pytest.mark.parametrize("chunk", [None, 3])
def test_zero_runs(spark, zeros, errors, chunk):
    values = [5] + [0] * zeros + [5, 501]
    rows = readings(spark, [(f"2026-01-01 00:{i:02d}", v) for i, v in enumerate(values)])
    flagged = sequences.light_errors(series(rows, chunk), "light", "bad").rows()
    assert flagged.where("bad AND light = 0").count() == errors
    assert flagged.where("bad AND light > 0").count() == 1


@pytest.mark.parametrize("chunk", [None, 2])
def test_negative_echo_over_chunks(spark, chunk):
    rows = readings(spark, [(f"2026-01-01 00:{i:02d}", -1 if i == 2 else 100) for i in range(10)], "distance")
    bad = lambda **kw: [r.event_id for r in sequences.distance_errors(series(rows, chunk), "distance", "bad", **kw).rows().where("bad").orderBy("event_id").collect()]
    assert bad() == [2, 3, 4, 5, 6]
    assert bad(descending=True) == [0, 1, 2]


@pytest.mark.parametrize("chunk", [None, 2])
def test_rolling_frame_leaves_out_its_left_end(spark, chunk):
    rows = readings(spark, [("2026-01-01 00:00", 1), ("2026-01-01 00:01", 4), ("2026-01-01 00:06", 6)], "kw")
    out = sequences.rolling_change(series(rows, chunk), F.col("kw"), "delta").rows().orderBy("ts").collect()
    assert [r.delta for r in out] == [0.0, 3.0, 2.0]


@pytest.mark.parametrize("n", [6, 7, 8, 9, 20])
def test_savgol_reproduces_a_parabola(spark, n):
    rows = readings(spark, [(f"2026-01-01 00:{i:02d}", i * i) for i in range(n)], "v")
    for chunk in (None, 4):
        out = sequences.savgol(series(rows, chunk), "v", "s").rows().orderBy("ts").collect()
        assert [r.s for r in out] == pytest.approx([float(i * i) for i in range(n)], abs=1e-9)


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.5, 3.5, 10.0, 19.9, 20.0)], "m double")
    out = [r[0] for r in df.select(S.band(F.col("m"), [0.0, 1.5, 3.5, 10.0, 20.0], ["a", "b", "c", "d"])).collect()]
    assert out == ["a", "b", "c", "d", "d", None]


def test_weeks_without_rows_are_zero(spark):
    rows = readings(spark, [("2026-01-05 00:00", 1), ("2026-01-20 00:00", 2)], "v")
    assert [r.total for r in stats.weekly_dense(rows, ["user_id"], "ts", "v").orderBy("week").collect()] == [1.0, 0.0, 2.0]


def test_dates(spark):
    df = spark.createDataFrame([(x,) for x in ("03/04/2024", "04/13/2024", "2024-04-03", "soon", None)], "x string")
    assert [str(r[0]) for r in df.select(S.parse_date(F.col("x"))).collect()] == ["2024-04-03", "2024-04-13", "2024-04-03", "None", "None"]


def test_small_functions(spark):
    df = spark.createDataFrame([(1, 2, 30)], "lab_id int, sublab_id int, n int")
    assert one(df.select(S.pulses_to_ml(F.col("n")).alias("ml"))).ml == 100.0
    names = spark.createDataFrame([(9, "Nine")], "lab_id int, display string")
    assert one(dims.label(df, names, ["lab_id"], F.concat(F.lit("Lab "), F.col("lab_id")))).label == "Lab 1"
    assert dims.units(spark).count() == 17 and dims.hazard_labels(spark).count() == 15 and dims.hazard_groups(spark).count() == 2


def test_drop_empty_columns(spark):
    assert stats.drop_empty_columns(spark.createDataFrame([(1.0, 0.0)], "a double, b double"), ["a", "b"]).columns == ["a"]


def test_scale_fails_without_samples(spark):
    rows = readings(spark, [("2026-01-01 00:00", 1)], "v").withColumn("g", F.lit("bad"))
    window = ("2026-01-01", "2026-01-02")
    with pytest.raises(Exception, match="no samples"):
        stats.window_scale(rows, "g", "ts", "v", "bad", window, "good", window, "s").collect()


def test_sql_functions(spark):
    register.register(spark)
    r = one(spark.sql("SELECT sash_percent(432.5D, 765D, 100D) AS p, to_litres(' 50 ', ' ml') AS l, normalize_codes('hp06; HP6/HP3') AS c, prev_working_day(DATE '2026-04-20') AS d"))
    assert (r.p, r.c, str(r.d)) == (50.0, ["HP6", "HP3"], "2026-04-17") and r.l == pytest.approx(0.05)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", dt.date(2026, 1, d), float(d)) for d in (1, 2, 2)], "site string, d date, kwh double")
    path = str(tmp_path / "t")
    assert sinks.append_new(rows, path, ["site", "d"], "d") == {"inserted": 2, "skipped": 1}
    assert sinks.append_new(rows, path, ["site", "d"], "d") == {"inserted": 0, "skipped": 3}
    assert not sinks.append(rows, path, enabled=False) and spark.read.parquet(path).count() == 2
    assert sinks.append(rows, str(tmp_path / "p"), ["site"])


def test_export(spark, tmp_path):
    rows = readings(spark, [("2026-01-01 00:00", 1), ("2026-01-02 23:59", 2), ("2026-01-03 00:00", 3)]).withColumnRenamed("ts", "Timestamp")
    out = str(tmp_path)
    assert sinks.export_between({"a": rows, "b": rows.drop("Timestamp")}, "2026-01-01", "2026-01-02", out) == ["a"]
    assert spark.read.option("header", True).csv(out + "/a").count() == 2
    sinks.export_day({"a": rows}, "2026-01-03", out)
    assert spark.read.option("header", True).csv(out + "/a").count() == 1
    with pytest.raises(ValueError):
        sinks.export_between({"a": rows}, "2026-01-02", "2026-01-01", out)


def test_write_clean(spark, tmp_path):
    df = spark.createDataFrame([("1", ["HP3"])], "reference string, codes array<string>")
    for fmt in ("json", "csv"):
        sinks.write_clean(df, str(tmp_path / fmt), fmt, dt.date(2026, 1, 1))
    assert spark.read.json(str(tmp_path / "json")).first().codes == ["HP3"]
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().codes == '["HP3"]'


def test_lookback(spark):
    rows = readings(spark, [("2025-01-01 00:00", 1), ("2026-01-01 00:00", 2), ("2026-01-03 00:00", 3)])
    last = F.lit("2026-01-04").cast("timestamp_ntz")
    assert scans.lookback(rows, "ts", last).count() == 2
    assert scans.lookback(rows, "ts", last, max_span_days=400).count() == 3
    assert scans.lookback(rows, "ts", last, window_days=2, month_start=True).count() == 2
    assert scans.last_days(rows, "ts", 2, last).count() == 1 and scans.newest_first(rows, "ts").first().event_id == 2
    assert scans.day_slices(rows, "ts").select("day").distinct().count() == 3
