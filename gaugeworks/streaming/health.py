"""Stateful sensor-health alerts and the recovery circuit breaker, keyed by sensor, in event-time order."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.series import DAY
from .order import in_event_order


@dataclass(frozen=True)
class HealthLimits:
    """Rows in a row before an alert."""

    zero_distance: int = 10
    zero_light: int = 5
    identical_light: int = 5
    missing_light: int = 3


@dataclass(frozen=True)
class BreakerLimits:
    """Failures that open the breaker, their window and the pause after a failure, in seconds."""

    failures: int = 5
    window: float = 600.0
    backoff: float = 120.0


READING, REPAIR = 0, 1
RULES = ("zero_distance", "zero_light", "identical_light", "missing_light")
MEMORY = "zero_distance int, zero_light int, identical_light int, missing_light int, last_light double, last_us bigint"


def run_since(counts: np.ndarray, stops: np.ndarray, carry: int) -> np.ndarray:
    """Counted rows since the last stop, going on from ``carry`` before the first one; a stop that counts is the first of its run."""
    upto = np.cumsum(counts)
    base = np.maximum.accumulate(np.where(stops, upto, -1)) if len(upto) else upto
    return np.where(base < 0, upto + carry, upto - base)


def health_counters(rows: list[tuple], memory: tuple) -> tuple[np.ndarray, tuple]:
    """Standing of the four counters at each row (one line per rule) and what the next rows need to know.

    ``rows`` are (microseconds, side, tie, distance, light, target) in order; a repair clears the counters of its target.
    """
    carry, last, last_us = list(memory[:4]), memory[4], memory[5]
    if not rows:
        return np.zeros((4, 0), int), memory
    _, side, _, distance, light, target = zip(*rows, strict=True)
    reading = np.array(side) == READING
    d, x = np.array(distance, float), np.array(light, float)
    clears_d = ~reading & np.array([t != "light" for t in target])
    clears_x = ~reading & np.array([t != "distance" for t in target])
    lost = np.isnan(x)

    def run(member: np.ndarray, clears: np.ndarray, before: int) -> np.ndarray:
        member = member & reading
        return run_since(member, clears | (reading & ~member), before)

    at = np.flatnonzero(reading)
    before = np.r_[np.nan if last is None else last, x[at][:-1]] if len(at) else np.zeros(0)
    cleared = np.cumsum(clears_x)[at]
    same = (x[at] == before) & (cleared == np.r_[0, cleared[:-1]] if len(at) else True)
    again = run_since(same, ~same, max(carry[2] - 1, 0))
    identical = np.zeros(len(rows), int)
    identical[at] = np.where(lost[at], 0, again + 1)

    counters = np.array([run(d == 0, clears_d, carry[0]), run(x == 0, clears_x, carry[1]), identical, run(lost, clears_x, carry[3])])
    end = [int(c) for c in counters[:, -1]]
    if len(at):
        fresh = not clears_x[at[-1] :].any()
        end[2] = int(identical[at[-1]]) if fresh else 0
        last = None if lost[at[-1]] or not fresh else float(x[at[-1]])
    elif clears_x.any():
        end[2], last = 0, None
    else:
        end[2] = carry[2]
    return counters, (*end, last, max(last_us, rows[-1][0]))


def health_alerts(
    readings: DataFrame,
    key: str,
    ts: str,
    tie: str,
    distance: str,
    light: str,
    limits: HealthLimits = HealthLimits(),
    repairs: DataFrame | None = None,
    target: str = "target",
    delay: str = "10 minutes",
    idle_us: int = DAY,
) -> DataFrame:
    """One row per rule and reading at which its counter stands at or above the limit.

    ``repairs`` is a second stream with the key, the time and the ``target`` (`distance`, `light`, or null for both) of
    repairs that worked; they clear the target's counters from their time on, after readings of the same time.  Both
    streams meet in one keyed state.  A sensor without rows for ``idle_us`` is forgotten.
    """
    kinds = dict(readings.dtypes)
    rows = readings.select(key, ts, F.lit(READING).alias("_side"), tie, F.col(distance).cast("double").alias("_d"), F.col(light).cast("double").alias("_x"), F.lit(None).cast("string").alias("_target"))
    if repairs is not None:
        none = F.lit(None).cast("double")
        fixed = repairs.select(key, F.col(ts).cast(kinds[ts]).alias(ts), F.lit(REPAIR).alias("_side"), F.lit(0).cast(kinds[tie]).alias(tie), none.alias("_d"), none.alias("_x"), F.col(target).alias("_target"))
        rows = rows.unionByName(fixed)
    least = [getattr(limits, r) for r in RULES]

    def step(k, due, memory):
        counters, memory = health_counters(due, memory)
        hits = np.argwhere((counters >= np.array(least)[:, None]).T & np.array([r[1] == READING for r in due], bool)[:, None])
        found = [(k, due[i][2], pd.Timestamp(due[i][0], unit="us"), RULES[r], int(counters[r, i])) for i, r in hits.tolist()]
        return found, memory, memory[5] + idle_us

    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, {ts} {kinds[ts]}, rule string, run int"
    return in_event_order(rows, key, ts, ["_side", tie], ["_d", "_x", "_target"], delay, MEMORY, (0, 0, 0, 0, None, 0), out, step)


def breaker_outcomes(rows: list[tuple], failed: list[float], until: float, limits: BreakerLimits) -> tuple[list[tuple[str, int]], list[float], float]:
    """Outcome and standing failures of requests (microseconds, tie, success) in order, one after the other as each may cause a pause."""
    found = []
    for us, _, success in rows:
        at = us / 1e6
        if until > at:
            outcome = "skipped"
        elif success is True:
            failed, until, outcome = [], 0.0, "recovered"
        else:
            failed = [f for f in failed if at - f <= limits.window] + [at]
            until = at + limits.backoff
            outcome = "open" if len(failed) >= limits.failures else "failed"
        found.append((outcome, len(failed)))
    return found, failed, until


def circuit_breaker(df: DataFrame, key: str, ts: str, tie: str, success: str, limits: BreakerLimits = BreakerLimits(), delay: str = "10 minutes") -> DataFrame:
    """Outcome of each recovery request: ``skipped`` in a pause, ``recovered``, ``failed`` or ``open``.

    A success clears the failures; ``open`` marks a failure that is at least the limit's number within the
    window, both ends included.  Requests are judged in order of their time.  A key's state goes when its failures
    have left the window and its pause is over.
    """
    kinds = dict(df.dtypes)
    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, {ts} {kinds[ts]}, outcome string, failures int"

    def step(k, due, memory):
        outcomes, failed, until = breaker_outcomes(due, list(memory[0]), memory[1], limits)
        found = [(k, r[1], pd.Timestamp(r[0], unit="us"), *o) for r, o in zip(due, outcomes, strict=True)]
        matters = max(failed[-1] + limits.window if failed else 0.0, until)
        return found, (failed, until), int(matters * 1e6)

    return in_event_order(df, key, ts, [tie], [success], delay, "failed array<double>, until double", ([], 0.0), out, step)
