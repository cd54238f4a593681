"""Streams against their batch counterparts, with replays and late rows."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import sequences
from gaugeworks.operators.series import MINUTE, Series
from gaugeworks.streaming import health, ingest, windows

from .test_fixtures import MESSAGES

SCHEMA = "sensor long, id long, ts timestamp_ntz, v double, light double"
T0 = dt.datetime(2026, 1, 1)


def row(i, minute, v=1.0, light=10.0, sensor=1):
    return {"sensor": sensor, "id": i, "ts": (T0 + dt.timedelta(minutes=minute)).isoformat(), "v": v, "light": light}


class Source:
    """A folder of JSON files, one per micro-batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        folder.mkdir()

    def add(self, rows):
        path = self.folder / f"{self.n:03d}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + self.n,) * 2)  # the file source reads in order of modification time
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.folder))

    def batch(self):
        return self.spark.read.schema(SCHEMA).json(str(self.folder))


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / ("c_" + name))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path / "in")


def test_messages_to_tables(spark, tmp_path):
    folder = tmp_path / "text"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.txt").write_text("\n".join(MESSAGES))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second start finds nothing new
        ingest.ingest_messages(stream, "value", out, str(tmp_path / "check")).awaitTermination(120)
    counts = [spark.read.parquet(f"{out}/{t}").count() for t in ("water", "hood", "rejects")]
    assert counts == [2, 2, 10]


def test_idempotent_ingest(spark, source, tmp_path):
    source.add([row(1, 0), row(2, 1), row(3, 1)])
    source.add([row(4, 1), row(5, 2)])
    out = str(tmp_path / "out")
    ingest.ingest_new(source.stream(), ["sensor", "ts"], "ts", "1 hour", out, str(tmp_path / "a"), ["id"]).awaitTermination(120)
    assert sorted(r.ts.minute for r in spark.read.parquet(out + "/rows").collect()) == [0, 1, 2]


def test_tumbling_drops_late_rows(spark, source, tmp_path):
    source.add([row(1, 0, 2.0), row(2, 1, 3.0), row(3, 30, 1.0)])
    source.add([row(7, 31, 1.0)])  # rows count as late against the watermark one batch before
    source.add([row(4, 2, 100.0), row(5, 60, 1.0)])  # minute 2 is later than the watermark
    source.add([row(6, 90, 1.0)])
    out = drain(windows.tumbling(source.stream(), ["sensor"], "ts", "v", "5 minutes", "10 minutes"), "tumbling", tmp_path)
    closed = {r.start_ts: r.total for r in out.collect()}
    assert closed[T0] == 5.0
    kept = source.batch().where("id <> 4")
    expect = {r.start_ts: r.total for r in windows.tumbling(kept, ["sensor"], "ts", "v", "5 minutes", "10 minutes").collect()}
    assert closed and all(expect[k] == v for k, v in closed.items())


def test_sessions_match_batch_runs(spark, source, tmp_path):
    minutes = [0, 2, 5, 9, 20, 21, 40, 80, 81]
    source.add([row(i, m) for i, m in enumerate(minutes[:4])])
    source.add([row(i + 10, m) for i, m in enumerate(minutes[4:])])
    source.add([row(99, 500)])
    out = drain(windows.session_runs(source.stream(), ["sensor"], "ts", "v", 3 * MINUTE, "10 minutes"), "sessions", tmp_path)
    got = sorted((r.start_ts, r.end_ts, r.samples) for r in out.collect())
    s = Series.of(source.batch().where("id <> 99"), ["sensor"], "ts", ["id"])
    _, events = sequences.mask_events(s, F.col("v") > 0, 3 * MINUTE)
    assert got == sorted((r.event_start, r.event_end, r.samples) for r in events.collect())


def run_to_end(df, name, tmp_path):
    """Rows of an append stream, and how many keys its state still holds."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / ("c_" + name))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect(), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def heartbeat(source, minute=100_000):
    """A row of another sensor, so late that the watermark passes all others."""
    source.add([row(-1, minute, sensor=99)])


LIMITS = health.HealthLimits(3, 2, 3, 2)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    return [row(i, i // 2, rng.choice([0.0, 0.0, 1.0, None]), rng.choice([0.0, 0.0, 5.0, 5.0, None]), sensor=rng.randint(0, 2)) for i in range(n)]


def test_health_alerts_out_of_order_match_batch(spark, source, tmp_path):
    rows = random_rows(7)
    random.Random(1).shuffle(rows)
    for k in range(0, 120, 40):
        source.add(rows[k : k + 40])
    heartbeat(source)
    got, keys = run_to_end(health.health_alerts(source.stream(), "sensor", "ts", "id", "v", "light", LIMITS, delay="2 hours"), "health", tmp_path)
    s = Series.of(source.batch(), ["sensor"], "ts", ["id"])
    want = [(r.sensor, r.id, r.ts, r.rule, r.run) for r in sequences.alerts(s, "v", "light", 3, 2, 3, 2).collect()]
    assert sorted((r.sensor, r.id, r.ts, r.rule, r.run) for r in got) == sorted(want) and len(want) > 20
    assert keys == 1  # the silent sensors are forgotten, the heartbeat's waits


def test_late_readings_are_dropped(spark, source, tmp_path):
    source.add([row(i, 60 + i, 0.0) for i in range(3)])
    source.add([row(10, 200)])
    source.add([row(11, 201)])  # judged with the watermark of 200
    source.add([row(3, 62, 0.0), row(4, 5, 0.0)])  # both older than what is settled
    source.add([row(5, 202, 0.0), row(6, 203, 0.0), row(7, 204, 0.0)])
    heartbeat(source)
    df = health.health_alerts(source.stream(), "sensor", "ts", "id", "v", "light", health.HealthLimits(3, 9, 9, 9), delay="10 minutes")
    first, _ = run_to_end(df, "late", tmp_path)
    assert sorted((r.id, r.run) for r in first) == [(2, 3), (7, 3)]


def test_state_survives_a_restart(spark, source, tmp_path):
    out = str(tmp_path / "alerts")
    df = health.health_alerts(source.stream(), "sensor", "ts", "id", "v", "light", health.HealthLimits(3, 9, 9, 9), delay="10 minutes")
    source.add([row(i, 60 + i, 0.0) for i in range(2)])
    for more in ([row(i, 60 + i, 0.0) for i in range(2, 5)], [row(-1, 100_000, sensor=99)], []):
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c_restart")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if more:
            source.add(more)
    assert sorted((r.id, r.run) for r in spark.read.parquet(out).collect()) == [(2, 3), (3, 4), (4, 5)]


def counters_one_by_one(rows, repairs):
    """Alerts by a plain loop; a repair acts after readings of its time."""
    state, out = {}, []
    inputs = [(r["ts"], 0, r["id"], r) for r in rows] + [(r["ts"], 1, 0, r) for r in repairs]
    for ts, side, i, r in sorted(inputs, key=lambda x: x[:3]):
        c = state.setdefault(r["sensor"], {"zd": 0, "zl": 0, "il": 0, "ml": 0, "last": None})
        if side:
            if r["target"] != "light":
                c["zd"] = 0
            if r["target"] != "distance":
                c.update(zl=0, il=0, ml=0, last=None)
            continue
        x = r["light"]
        c["zd"] = c["zd"] + 1 if r["v"] == 0 else 0
        c["zl"] = c["zl"] + 1 if x == 0 else 0
        c["ml"] = c["ml"] + 1 if x is None else 0
        c["il"] = 0 if x is None else c["il"] + 1 if x == c["last"] else 1
        c["last"] = x
        names = {"zd": ("zero_distance", 3), "zl": ("zero_light", 2), "il": ("identical_light", 3), "ml": ("missing_light", 2)}
        out += [(r["sensor"], i, names[k][0], c[k]) for k in names if c[k] >= names[k][1]]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_from_a_second_stream(spark, source, tmp_path, seed):
    rng = random.Random(seed)
    rows, repairs = random_rows(seed), []
    for m in range(0, 60, 3):
        at = (T0 + dt.timedelta(minutes=m)).isoformat()
        repairs.append({"sensor": rng.randint(0, 2), "ts": at, "target": rng.choice(["distance", "light", None])})
    want = counters_one_by_one(rows, repairs)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for k in range(0, 120, 60):
        source.add(shuffled[k : k + 60])
    heartbeat(source)
    folder = tmp_path / "repairs"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in repairs))
    control = spark.readStream.schema("sensor long, ts timestamp_ntz, target string").json(str(folder))
    got, _ = run_to_end(health.health_alerts(source.stream(), "sensor", "ts", "id", "v", "light", LIMITS, repairs=control, delay="2 hours"), f"repair{seed}", tmp_path)
    assert sorted((r.sensor, r.id, r.rule, r.run) for r in got) == want and len(want) > 20


@pytest.mark.parametrize("step", [1, 7, 200])
def test_counters_do_not_depend_on_the_batches(step):
    rng = random.Random(step)
    rows = [(i, rng.choice([0, 0, 0, 0, 1]), i, rng.choice([0.0, 1.0, None]), rng.choice([0.0, 5.0, 5.0, None]), rng.choice(["distance", "light", None])) for i in range(200)]
    memory, parts = (0, 0, 0, 0, None, 0), []
    for k in range(0, 200, step):
        counters, memory = health.health_counters(rows[k : k + step], memory)
        parts.append(counters)
    whole, end = health.health_counters(rows, (0, 0, 0, 0, None, 0))
    reading = [r[1] == 0 for r in rows]
    assert end == memory and [list(c[reading]) for c in whole] == [[v for v, r in zip(c, reading) if r] for c in [sum((list(p[i]) for p in parts), []) for i in range(4)]]


def test_circuit_breaker_out_of_order(spark, source, tmp_path):
    rows = [row(i, m) for i, m in enumerate([0, 1, 2, 4, 6, 8, 9, 20])]
    random.Random(3).shuffle(rows)
    source.add(rows[:3])
    source.add(rows[3:])
    heartbeat(source)
    stream = source.stream().withColumn("ok", F.col("id") == 7)
    got, keys = run_to_end(health.circuit_breaker(stream, "sensor", "ts", "id", "ok", delay="1 hour"), "breaker", tmp_path)
    got = sorted((r.id, r.outcome, r.failures) for r in got if r.sensor == 1)
    assert got == [(0, "failed", 1), (1, "skipped", 1), (2, "failed", 2), (3, "failed", 3), (4, "failed", 4), (5, "open", 5), (6, "skipped", 5), (7, "recovered", 0)]
    assert keys == 1  # the silent key has no state


def test_breaker_state_lasts_as_long_as_its_failures(spark, source, tmp_path):
    source.add([row(0, 0), row(1, 3)])
    source.add([row(2, 9, sensor=5)])  # the failures are judged but still inside the window
    source.add([row(3, 9, sensor=5)])
    stream = source.stream().withColumn("ok", F.lit(False))
    got, keys = run_to_end(health.circuit_breaker(stream, "sensor", "ts", "id", "ok", delay="1 minute"), "kept", tmp_path)
    assert sorted((r.id, r.outcome) for r in got if r.sensor == 1) == [(0, "failed"), (1, "failed")] and keys == 2


def test_waiting_rows_are_one_value_of_the_state(source):
    """Rows that wait are kept as one value, not as a column of arrays for each of their fields."""
    df = health.health_alerts(source.stream(), "sensor", "ts", "id", "v", "light", LIMITS, delay="2 hours")
    plan = df._jdf.queryExecution().logical().toString()
    assert "_waiting" in plan and "ArrayType" not in plan
