"""Chemical stock and orders: volumes, impact classes, hazard searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import to_litres, to_num, unit_factor
from .lineage import cut
from .series import is_small

# Fixed value: location id of stock that is only booked, not present.
MISSING_LOCATION = 527895

COLOURS = ["red", "yellow", "green"]


def present_only(df: DataFrame, location: str = "location", missing: int = MISSING_LOCATION) -> DataFrame:
    """Drop rows in the missing-stock location; rows without a location stay."""
    return df.where(~F.col(location).eqNullSafe(F.lit(missing)))


def litres_by_code(containers: DataFrame, code: str = "cas", size: str = "size", unit: str = "unit", **units) -> DataFrame:
    """Litres and number of uncountable containers per substance code."""
    litres = to_litres(F.col(size), F.col(unit), **units)
    return (
        containers.select(code, litres.alias("_l"))
        .groupBy(code)
        .agg(F.coalesce(F.sum("_l"), F.lit(0.0)).alias("litres"), F.count_if(F.col("_l").isNull()).alias("skipped"))
    )


def left_fill(listed: DataFrame, totals: DataFrame, key: str, values: list[str], how: str = "left") -> DataFrame:
    """Every listed item with its totals, zero when there are none; ``how="inner"`` keeps only items with rows."""
    out = listed.join(totals, key, how)
    return out.fillna(0, subset=values)


def classify(df: DataFrame, classes: DataFrame, code: str = "cas") -> DataFrame:
    """Membership in (category, colour) code lists, each list taken as a set."""
    return df.join(classes.select("category", "colour", code).distinct(), code)


def listed_volumes(containers: DataFrame, listed: DataFrame, code: str = "cas", dedupe: bool = False) -> DataFrame:
    """Listed substances with litres and skipped; a code under two names counts under both unless ``dedupe``."""
    totals = litres_by_code(present_only(containers), code)
    names = listed.dropDuplicates([code]) if dedupe else listed
    return left_fill(names, totals, code, ["litres", "skipped"])


def traffic_light(containers: DataFrame, listed: DataFrame, classes: DataFrame, code: str = "cas", dedupe: bool = False) -> DataFrame:
    """Litres per (category, colour); cells without stock are zero.

    Containers shrink to one row per code before any join.
    """
    cells = classes.select("category").distinct().select("category", F.explode(F.array(*map(F.lit, COLOURS))).alias("colour"))
    sums = classify(listed_volumes(containers, listed, code, dedupe), classes, code).groupBy("category", "colour").agg(F.sum("litres").alias("litres"))
    return cells.join(sums, ["category", "colour"], "left").fillna(0.0, subset=["litres"])


def traffic_wide(long: DataFrame) -> DataFrame:
    return long.groupBy("category").pivot("colour", COLOURS).agg(F.sum("litres"))


def skipped_total(containers: DataFrame, listed: DataFrame, code: str = "cas") -> DataFrame:
    return listed_volumes(containers, listed, code).agg(F.sum("skipped").alias("skipped"))


def red_inventory(containers: DataFrame, listed: DataFrame, classes: DataFrame, code: str = "cas") -> DataFrame:
    """Listed substances on a red list with their litres; a code repeated in a red list repeats its row."""
    red = classes.where(F.col("colour") == "red").select("category", code)
    rows = listed_volumes(containers, listed, code).join(red, code)
    return rows.select("name", code, "category", F.round("litres", 6).alias("litres"))


def red_listing(red: DataFrame) -> DataFrame:
    """Red inventory as it is shown: only what is in stock, per category the largest litres first, then by name."""
    order = Window.partitionBy("category").orderBy(F.desc("litres"), "name", "cas")
    return red.where(F.col("litres") > 0).withColumn("place", F.row_number().over(order))


def order_volume(orders: DataFrame, listed: DataFrame, code: str = "cas", size: str = "size", unit: str = "unit", count: str = "number", date: str | None = None, since: Column | None = None, how: str = "left") -> DataFrame:
    """Ordered litres per listed substance: size * count * unit, rows with an unknown unit ignored."""
    if date is not None and since is not None:
        orders = orders.where(F.col(date) >= since)
    litres = to_num(F.col(size), None) * to_num(F.col(count), None) * unit_factor(F.col(unit), mode="null")
    totals = orders.groupBy(code).agg(F.coalesce(F.sum(litres), F.lit(0.0)).alias("litres"))
    return left_fill(listed, totals, code, ["litres"], how)


def search_any(df: DataFrame, groups: DataFrame, item: list[str], codes: str) -> DataFrame:
    """Items holding at least one code of a hazard group, once per group.

    Codes and groups meet on the single code, an equi-join; ``groups`` has grp and a code array ``codes``.  Items are
    dealt out before their codes are unrolled, so what a task holds follows the number of tasks, not the table.
    """
    per_code = cut(groups.select("grp", F.explode("codes").alias("_code")).distinct())
    held = df.select(*item, F.array_distinct(codes).alias("_codes")).repartition(*item)
    held = held.select(*item, F.explode("_codes").alias("_code"))
    return held.join(F.broadcast(per_code) if is_small(per_code) else per_code, "_code").select("grp", *item).distinct()


def lookup(containers: DataFrame, column: str, wanted: DataFrame, location: str = "location") -> DataFrame:
    """Containers whose code or barcode is wanted, missing stock left out."""
    return present_only(containers, location).join(wanted.select(column).distinct(), column, "left_semi")
