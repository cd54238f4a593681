"""Chunked series against plain windows on skewed data, exact quantiles, clusters, marts and plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import asof, clusters, lineage, sequences, stats, stock
from gaugeworks.operators.quantiles import exact_quantiles, from_ordered_bits, ordered_bits
from gaugeworks.operators.series import ROWS_PER_CHUNK_CONF, Series
from gaugeworks.plans import marts
from gaugeworks.plans.views import Tables


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, a few sparse keys, tied times."""
    rng, rows = random.Random(3), []
    for i in range(600):
        user = 1 if i % 3 else 2 + i % 7
        second = rng.choice([rng.randint(0, 4000), rng.randint(50000, 60000)])
        rows.append((user, i, second, float(rng.choice([-1, 0, 0, 0, 5, 700])), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "user_id long, event_id long, sec long, v double, on boolean")
    return df.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec").cache()


def rows_of(df):
    cols = sorted(c for c in df.columns if not c.startswith("_"))
    return sorted(map(str, df.select(*cols).collect()))


OPERATORS = {
    "segments": lambda s: sequences.segments(s).rows(),
    "light": lambda s: sequences.light_errors(s, "v", "bad").rows(),
    "distance": lambda s: sequences.distance_errors(s, "v", "bad").rows(),
    "intervals": lambda s: sequences.flag_intervals(s, "on"),
    "padded": lambda s: sequences.flag_intervals(s, "on", end="pad"),
    "rolling": lambda s: sequences.rolling_change(s, F.col("v"), "d").rows(),
    "bursts": lambda s: sequences.burst_counts(s, F.col("on"), "n").rows(),
    "savgol": lambda s: sequences.savgol(s, "v", "m").rows().withColumn("m", F.round("m", 6)),
    "extrema": lambda s: sequences.extrema(s, "v", F.lit(1.0)).rows(),
    "lengths": lambda s: sequences.run_lengths(s, {"a": (F.col("on"), None), "b": (F.col("v") >= 0, "v")}).rows(),
    "runs": lambda s: sequences.runs(s, F.col("on"), "v"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_change_nothing(skewed, name):
    plain = rows_of(OPERATORS[name](Series.of(skewed, ["user_id"], "ts", ["event_id"])))
    for limit in (11, 90):
        chunked = Series.of(skewed.repartition(5), ["user_id"], "ts", ["event_id"]).split(limit)
        assert chunked.chunked and rows_of(OPERATORS[name](chunked)) == plain


def depths(s):
    return {(r.user_id, r["_chunk"]): r["count"] for r in s.frame.groupBy("user_id", "_chunk").count().collect()}


def test_chunks_have_equal_depth(spark, skewed):
    spark.conf.set(ROWS_PER_CHUNK_CONF, "50")
    try:
        found = depths(Series.plan(skewed, ["user_id"], "ts", ["event_id"]))
    finally:
        spark.conf.unset(ROWS_PER_CHUNK_CONF)
    assert max(found.values()) <= 50 and {k for k in found if k[0] > 1} == {(u, 0) for u in range(2, 9)} and len(found) - 7 >= 400 / 50
    assert not Series.plan(skewed, ["user_id"], "ts", ["event_id"]).chunked


def test_equal_times_are_split_and_quiet_keys_are_not(spark):
    at = F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz")
    busy = spark.range(5000).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), at.alias("ts"))
    quiet = spark.range(900).select(F.lit(2).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    s = Series.of(busy.unionByName(quiet).repartition(7), ["user_id"], "ts", ["event_id"]).split(1000)
    found = depths(s)
    assert max(found.values()) <= 1000 and [k for k in found if k[0] == 2] == [(2, 0)]
    numbered = s.scan(prev={"before": F.col("event_id")}, sums={"n": F.lit(1)}).rows().where("user_id = 1")
    assert numbered.where("n <> event_id + 1 OR coalesce(before, -1) <> event_id - 1").count() == 0
    same = Series.of(busy.withColumn("event_id", F.lit(7)), ["user_id"], "ts", ["event_id"]).split(1000)
    assert max(depths(same).values()) <= 1000 and same.scan(sums={"n": F.lit(1)}).rows().agg(F.max("n")).first()[0] == 5000


def test_rows_without_key_or_time_come_back(spark):
    rows = [(1, 1, "2026-01-01 00:00:00", 700.0), (None, 2, "2026-01-01 00:00:00", 700.0), (1, 3, None, -1.0)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    s = Series.plan(df, ["user_id"], "ts", ["event_id"])
    judged = sequences.distance_errors(sequences.light_errors(s, "v", "light_error"), "v", "distance_error").rows()
    assert sorted((r.event_id, r.light_error, r.distance_error) for r in judged.collect()) == [(1, True, False), (2, None, None), (3, None, None)]
    assert sequences.savgol(s, "v", "m").rows().count() == 3
    assert sequences.extrema(sequences.savgol(s, "v", "m"), "m", F.lit(0.1)).rows().count() == 0


def test_sliding_sums_have_no_range_frame(skewed):
    for s in (Series.of(skewed, ["user_id"], "ts", ["event_id"]), Series.of(skewed, ["user_id"], "ts", ["event_id"]).split(50)):
        plan = plan_of(sequences.burst_counts(s, F.col("on"), "n").rows()) + plan_of(sequences.rolling_change(s, F.col("v"), "d").rows())
        assert "RangeFrame, -" not in plan and "sequence(" not in plan


def test_exact_quantiles(skewed):
    qs = {"a": 0.5, "b": 0.95, "c": 0.99, "d": 0.0, "e": 1.0}
    df = skewed.withColumn("x", F.col("v") * F.col("event_id") / 7)
    pair = [exact_quantiles(df, ["user_id"], F.col("x"), qs, small) for small in (True, False)]
    a, b = [{r.user_id: r for r in p.collect()} for p in pair]
    assert a.keys() == b.keys()
    for k in a:
        assert [b[k][q] for q in qs] == pytest.approx([a[k][q] for q in qs])


ODD = [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 1.9999999999999998, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 3.14, 1e-300, 8.5e15]


def test_bits_follow_the_order_of_values(spark):
    import struct

    rng = random.Random(2)
    values = ODD + [s * 2.0**e * f for e in range(-1074, 1024, 3) for s in (1, -1) for f in (1.0, 1 + 2**-52, rng.uniform(1, 2))]
    values += [v for v in (struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(2000)) if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("b"))
    rows = df.withColumn("back", from_ordered_bits(F.col("b"))).collect()
    assert all(r.back == r.v or r.v != r.v and r.back != r.back for r in rows)
    true = lambda v: struct.unpack("q", struct.pack("d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert all(r.b == true(r.v) for r in rows if r.v == r.v)
    assert max(rows, key=lambda r: r.b).v != max(rows, key=lambda r: r.b).v  # NaN is last


def test_quantiles_of_odd_values_and_null_keys(spark):
    rows = [(k, v) for k in (1, 2, None) for v in ODD + [None]] + [(3, 7.0), (4, float("nan")), (5, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    qs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.99, "e": 1.0}
    got = [{r.k: tuple(r[q] for q in qs) for r in exact_quantiles(df, ["k"], F.col("v"), qs, small).collect()} for small in (True, False)]
    assert got[0].keys() == got[1].keys() == {1, 2, None, 3, 4}
    for k in got[0]:
        assert [repr(x) for x in got[0][k]] == [repr(x) for x in got[1][k]] or got[1][k] == pytest.approx(got[0][k], nan_ok=True), k


def test_a_million_values_with_one_prefix(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), (1 + F.col("id") * 2.0**-40).alias("v"))
    r = exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5, "p": 0.999}, False).first()
    assert r.m == pytest.approx(1 + 499_999.5 * 2.0**-40, abs=1e-15) and r.p == pytest.approx(1 + 998_999.001 * 2.0**-40, abs=1e-15)
    # Nothing is ordered but the counts of one prefix.
    plan = plan_of(exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5}, False))
    assert "Window" not in plan and "percentile" not in plan


def test_null_keys_keep_their_statistics(spark):
    rows = [(k, dt.date(2026, 1, d), float(v)) for k in (1, None) for d, v in [(1, 3), (2, 5), (3, 0), (20, 7), (21, 9)]]
    df = spark.createDataFrame(rows, "k int, d date, v double")
    for small in (True, False):
        bursts = {r.k: r.burst_value for r in stats.burst_median(df, ["k"], "v", small).collect()}
        assert bursts == {1: 6.0, None: 6.0}
        noise = {r.k: r.sigma for r in stats.noise_threshold(df, ["k"], "v", small=small).collect()}
        assert noise == {1: pytest.approx(2 * 1.4826), None: pytest.approx(2 * 1.4826)}
        periods = {r.k: (r.before_median, r.after_median) for r in stats.compare_periods(df, ["k"], "d", "v", "2026-01-10", "2026-01-15", small=small).collect()}
        assert periods == {1: (3.0, 8.0), None: (3.0, 8.0)}


def dbscan(points, eps, least=3):
    """Plain clustering of (x, y) points in id order."""
    near = [[j for j, q in enumerate(points) if ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 <= eps] for p in points]
    label, n = [-1] * len(points), 0
    for i in range(len(points)):
        if label[i] != -1 or len(near[i]) < least:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] == -1:
                label[j] = n
                if len(near[j]) >= least:
                    todo += near[j]
        n += 1
    return label


@pytest.mark.parametrize("seed, threshold", [(1, 0.0), (2, 3.0), (3, 1.5)])
def test_clusters(spark, seed, threshold):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.gauss(5, 0.3), rng.gauss(20, 4), rng.uniform(0, 60)]) for _ in range(70)]
    here = [int(rng.random() < 0.4) for _ in sizes]
    df = spark.createDataFrame([(1, i, s, h) for i, (s, h) in enumerate(zip(sizes, here))], "k int, id long, size double, here int")
    noise = spark.createDataFrame([(1, threshold)], "k int, threshold double")
    got = [r.cluster for r in clusters.density_clusters(df, noise, ["k"], "id", "size", "here").orderBy("id").collect()]
    z = lambda v: (sum(v) / len(v), (sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)) ** 0.5)
    (m, sd), (hm, hsd) = z(sizes), z(here)
    want = dbscan([((s - m) / sd, 0.6 * (h - hm) / hsd) for s, h in zip(sizes, here)], max(0.4, 0.33 * threshold / sd))
    assert got == want


def test_long_chain_is_one_component(spark):
    n = 40
    nodes = spark.createDataFrame([(1, i) for i in range(n)], "k int, node long")
    edges = spark.createDataFrame([(1, a, b) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))], "k int, a long, b long")
    out = clusters.components(nodes, edges, ["k"], "node").select("component").distinct().collect()
    assert [r[0] for r in out] == [0]


def test_own_clusters(spark):
    df = spark.createDataFrame([(1, 5, 2.0)], "k int, id long, size double")
    assert clusters.own_clusters(df, ["k"], "id").first().cluster == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_it_needs(spark):
    from gaugeworks.plans import QUERIES

    plan = plan_of(QUERIES["scan_window"](spark, "/root/testdata/sf0.001"))
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_joins_need_no_nested_loops(spark):
    from gaugeworks.plans import QUERIES

    for name in ("asof_join", "nearest_join", "effective_dim", "window_join", "shutdown_savings", "hazard_search", "in_excluded_range", "waste_per_head"):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_hazard_search_deals_items_out_before_their_codes(spark):
    """Items are never sent to every task, nor unrolled in the few tasks that read them."""
    items = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (2, None), (None, ["a"]), (3, ["c", "a", "a"])], "item long, codes array<string>")
    groups = spark.createDataFrame([("g", ["a", "b"]), ("h", ["b"]), (None, ["c"])], "grp string, codes array<string>")
    found = stock.search_any(items, groups, ["item"], "codes")
    assert sorted(map(str, found.collect())) == sorted(["Row(grp='g', item=1)", "Row(grp='h', item=1)", "Row(grp='g', item=None)", "Row(grp='g', item=3)", "Row(grp=None, item=3)"])
    plan = plan_of(found)
    assert "hashpartitioning(item" in plan and "hashpartitioning(grp" not in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_chunked_windows_have_the_chunk_in_their_key(skewed):
    s = Series.of(skewed, ["user_id"], "ts", ["event_id"]).split(60)
    plan = plan_of(s.scan(prev={"p": F.col("v")}, sums={"n": F.lit(1)}).rows())
    assert "hashpartitioning(user_id" in plan and "_chunk" in plan


def test_marts(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    made = marts.hood_marts(t.readings, t.hoods, t.ranges, ["user_id"], "ts", "event_id")
    made |= marts.water_marts(t.readings, ["user_id"], "ts", "event_id", "water", at("2024-01-01"), at("2024-01-10"))
    made |= marts.energy_marts(t.energy_daily, t.energy_minute.withColumnRenamed("user_id", "site"), ["site"], "d", "esum", "ts", "energy_kwh", F.lit("2001-08-02").cast("date"))
    made |= marts.stock_marts(t.containers, t.solvents, t.classes)
    made |= marts.waste_marts(t.waste, ["HP1", "HP2", "HP3"])
    marts.write_marts(made, str(tmp_path))
    counts = {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in made}
    assert len(counts) == 23 and all(counts.values()), counts
    assert counts["hood_cards"] == t.readings.select("user_id").distinct().count()


def test_a_scope_leaves_no_rows_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_folder", lambda s: str(tmp_path))
    t = Tables(spark, "/root/testdata/sf0.001")
    points = t.events.select("user_id", "event_id", F.col("value").alias("size"), (F.col("event_id") % 2).cast("int").alias("here"))
    noise = points.select("user_id").distinct().withColumn("threshold", F.lit(1.0))
    stored = lambda: sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "gaugeworks").iterdir())
    with lineage.scope(spark):
        found = clusters.density_clusters(points, noise, ["user_id"], "event_id", "size", "here").collect()
        assert found and stored() > 0
    assert stored() == 0
    with pytest.raises(ZeroDivisionError), lineage.scope(spark):
        Series.of(points.withColumn("ts", F.lit("2026-01-01").cast("timestamp_ntz")), ["here"], "ts", ["event_id"]).split(50)
        assert stored() > 0
        1 / 0
    assert stored() == 0
