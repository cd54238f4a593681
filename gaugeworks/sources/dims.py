"""Dimension tables: fixed small ones as frames, larger ones from files the user names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import LITRES_PER_UNIT, normalize_codes, parse_codes
from ..operators.waste import HP_LABELS

# Light limits of a configured hood and its sash positions in millimetres.
HOOD_LUX, ROOM_LUX = 80.0, 18.0
SASH_CLOSED_MM, SASH_OPEN_MM, SASH_OPEN_PCT = 765.0, 100.0, 5.0

# Hazard statements of the environmental groups.
HAZARD_GROUPS = {
    "enviro_red": ["H400", "H401", "H410", "H411", "H412", "H420", "H441"],
    "enviro_yellow": ["H402", "H413"],
}


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LITRES_PER_UNIT.items()), "unit string, litres double")


def hazard_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HP_LABELS.items()), "hp string, label string")


def hazard_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HAZARD_GROUPS.items()), "grp string, codes array<string>")


def hoods(keys: DataFrame) -> DataFrame:
    """The usual calibration and limits for each listed hood."""
    return keys.select("*", *[F.lit(v).alias(n) for n, v in (("closed_mm", SASH_CLOSED_MM), ("open_mm", SASH_OPEN_MM), ("room_lux", ROOM_LUX), ("hood_lux", HOOD_LUX))])


def solvents(spark: SparkSession, path: str) -> DataFrame:
    """Listed chemicals: CSV with name, cas."""
    return spark.read.schema("name string, cas string").option("header", True).csv(path)


def classes(spark: SparkSession, path: str) -> DataFrame:
    """Impact classes: CSV with category, colour, name, cas."""
    return spark.read.schema("category string, colour string, name string, cas string").option("header", True).csv(path)


def hazard_lists(spark: SparkSession, path: str) -> DataFrame:
    """Hazard groups of a user's file: CSV with grp and code, one code or several separated ones a row; distinct normalised codes."""
    rows = spark.read.schema("grp string, code string").option("header", True).csv(path)
    one_by_one = rows.select(F.trim("grp").alias("grp"), F.explode(normalize_codes(parse_codes(F.col("code")))).alias("code"))
    return one_by_one.where("grp <> ''").groupBy("grp").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def label(df: DataFrame, names: DataFrame, keys: list[str], fallback: Column, name: str = "label") -> DataFrame:
    """Display name of an entity; ``names`` has the keys and ``display``."""
    return df.join(names, keys, "left").withColumn(name, F.coalesce("display", fallback)).drop("display")
