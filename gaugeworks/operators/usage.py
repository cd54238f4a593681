"""Hood usage: calibrated sash, presence, and the combined state over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bad_use, good_use, sash_percent, validate
from .series import Series


def calibrate(df: DataFrame, calibration: DataFrame, keys: list[str], distance: str, name: str = "sash_pct") -> DataFrame:
    """Percent open per entity calibration (closed_mm, open_mm); null without one or out of 0..100."""
    dim = calibration.select(*keys, F.col("closed_mm").alias("_closed"), F.col("open_mm").alias("_open"))
    pct = sash_percent(F.col(distance), F.col("_closed"), F.col("_open"))
    return df.join(dim, keys, "left").withColumn(name, pct).drop("_closed", "_open")


def over_threshold(df: DataFrame, thresholds: DataFrame, keys: list[str], value: str, limit: str, name: str) -> DataFrame:
    """Strictly above the entity's limit; null for entities without one."""
    return df.join(thresholds.select(*keys, F.col(limit).alias("_limit")), keys, "left").withColumn(name, F.col(value) > F.col("_limit")).drop("_limit")


def presence(df: DataFrame, thresholds: DataFrame, keys: list[str], value: str, limit: str, name: str = "presence") -> DataFrame:
    """1 when the room light is above the entity's limit, else 0; entities without a limit give no rows."""
    out = df.join(thresholds.select(*keys, F.col(limit).alias("_limit")), keys)
    return out.withColumn(name, F.coalesce((F.col(value) > F.col("_limit")).cast("int"), F.lit(0))).drop("_limit")


def validate_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Out-of-bounds values become -1; rows with no valid signal at all are dropped."""
    any_ok = None
    for c, (low, high) in bounds.items():
        ok = F.coalesce(F.col(c).between(low, high), F.lit(False))
        any_ok = ok if any_ok is None else any_ok | ok
    return df.where(any_ok).withColumns({c: validate(F.col(c), low, high) for c, (low, high) in bounds.items()})


def usage_state(distances: DataFrame, lights: DataFrame, keys: list[str], ts: str, tie: str, distance_col: str, light_col: str, hoods: DataFrame, open_pct: float = 5.0) -> Series:
    """State at every reading time of either signal: sash_open, presence, light_on, good_use, bad_use.

    ``hoods`` has the keys, closed_mm, open_mm, room_lux and hood_lux (nulls where not configured).  Both
    signals go into one stream of rows and one running "latest" each, instead of one join per signal.
    Only hoods with distance readings give rows, so ``hoods`` should list those.
    """
    d = distances.select(*keys, ts, F.struct(F.col(tie).alias("tie"), F.col(distance_col).alias("v")).alias("_d"))
    x = lights.select(*keys, ts, F.struct(F.col(tie).alias("tie"), F.col(light_col).alias("v")).alias("_l"))
    both = d.unionByName(x, allowMissingColumns=True)
    points = both.groupBy(*keys, ts).agg(F.max("_d").alias("_d"), F.max("_l").alias("_l"))
    s = Series.plan(points, keys, ts).running(lasts={"_d": F.col("_d"), "_l": F.col("_l")}).attach(hoods)
    pct = sash_percent(F.col("_d.v"), F.col("closed_mm"), F.col("open_mm"))
    df = (
        s.frame.withColumn("sash_open", F.coalesce(pct > open_pct, F.lit(False)))
        .withColumn("presence", F.coalesce((F.col("_l.v") > F.col("room_lux")).cast("int"), F.lit(0)))
        .withColumn("light_on", F.coalesce(F.col("_l.v") > F.col("hood_lux"), F.lit(False)))
        .withColumn("good_use", good_use(F.col("sash_open"), F.col("presence")))
        .withColumn("bad_use", bad_use(F.col("sash_open"), F.col("presence")))
    )
    return s.with_frame(df.drop("_d", "_l", *[c for c in hoods.columns if c not in keys]))


def bad_rows(state: DataFrame, distances: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Distance readings taken in the unattended-open state."""
    bad = state.where("bad_use").select(*keys, ts)
    return distances.select(*keys, ts, *columns).join(bad, [*keys, ts])


def bad_use_hours(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.groupBy(*keys).agg((F.avg(F.col("bad_use").cast("double")) * 24).alias("bad_hours_per_day"))
