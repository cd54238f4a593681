"""Keyed state that sees its rows in event-time order, whatever batch they arrive in.

Rows wait in the key's state until the watermark has passed them, then go to the step in order of time; rows later
than the watermark are dropped.  An event-time timer wakes the key when its first waiting row is due, and once more
when the step's memory has nothing more to say, at which the state goes.  What a key holds is bounded by its rows of
one watermark delay and one micro-batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.series import micros

#: step(key, rows in order, memory) -> (result rows, memory, microseconds until which the memory matters)
Step = Callable[[object, list[tuple], tuple], tuple[list[tuple], tuple, int]]


def in_event_order(df: DataFrame, key: str, ts: str, tie: list[str], values: list[str], delay: str, memory: str, start: tuple, out: str, step: Step) -> DataFrame:
    """Run ``step`` over each key's rows in order of (time, tie).

    A row reaches the step as (microseconds, *tie, *values).  ``memory`` and ``out`` are column lists with types,
    ``start`` is the memory of a new key.  Rows without key or time are dropped.
    """
    kinds = dict(df.dtypes)
    fields = ["_us", *tie, *values]
    kinds["_us"] = "bigint"
    made = [c.split()[0] for c in out.split(", ")]
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(key, micros(F.col(ts)).alias("_us"), *tie, *values, F.col(ts).cast("timestamp").alias("_event_time")).withWatermark("_event_time", delay)
    # The waiting rows are one value: as columns of arrays, each batch would convert every field of every row twice.
    state_schema = ", ".join(["_waiting binary", memory, "_done bigint"])

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packed, *known, done = state.get if state.exists else (None, *start, 0)
        waiting, known = pickle.loads(packed) if packed else [], tuple(known)
        for f in frames:
            if len(f):
                waiting += [r for r in zip(*(f[c].tolist() for c in fields), strict=True) if r[0] >= done]
        waiting.sort(key=lambda r: r[: 1 + len(tie)])
        mark = state.getCurrentWatermarkMs()
        due = sum(r[0] < mark * 1000 for r in waiting)
        found, known, until = step(k[0], waiting[:due], known)
        waiting = waiting[due:]
        if waiting or until >= mark * 1000:
            state.update((pickle.dumps(waiting) if waiting else None, *known, max(done, mark * 1000)))
            state.setTimeoutTimestamp(max((waiting[0][0] if waiting else until) // 1000 + 1, mark + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=made)

    return rows.groupBy(key).applyInPandasWithState(run, out, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
