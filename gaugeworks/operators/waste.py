"""Hazardous waste: allocation of volumes over hazard flags, shares and per-head figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import period, to_num, unit_factor
from .asof import check_positive, effective_join

# Names of the hazard properties.
HP_LABELS = {
    "HP1": "Explosive",
    "HP2": "Oxidizing",
    "HP3": "Flammable",
    "HP4": "Irritant",
    "HP5": "Harmful",
    "HP6": "Toxic",
    "HP7": "Carcinogenic",
    "HP8": "Corrosive",
    "HP9": "Infectious",
    "HP10": "Toxic for reproductive",
    "HP11": "Mutagenic",
    "HP12": "Acute toxic gas release",
    "HP13": "Sensitizing",
    "HP14": "Ecotoxic",
    "HP15": "Indirect",
}


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.upper().startswith("HP")]


def _number(df: DataFrame, name: str) -> Column:
    """Numeric column as double with zero for null; text goes through the lenient parser."""
    if dict(df.dtypes)[name] in ("string",):
        return to_num(F.col(name))
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def allocate(df: DataFrame, date: str = "d", size: str = "size", unit: str = "unit", flags: list[str] | None = None, mode: str = "split", since: Column | None = None) -> DataFrame:
    """Litres per (d, hp); every flag appears on every date.

    ``split`` shares a row's litres evenly over its flags above zero (nothing without flags, unknown unit
    counts as litres).  ``weighted`` adds flag * litres unsplit and ignores rows with an unknown unit.
    Rows without a date are dropped.  Days are summed over all flags at once and unrolled afterwards.
    """
    flags = flags or flag_columns(df)
    df = df.where(F.col(date).isNotNull())
    if since is not None:
        df = df.where(F.col(date) >= since)
    flag = {f: _number(df, f) for f in flags}
    amount = _number(df, size) * unit_factor(F.col(unit), mode="null" if mode == "weighted" else "one")
    if mode == "weighted":
        share = {f: F.coalesce(flag[f] * F.col("_l"), F.lit(0.0)) for f in flags}
    else:
        active = sum((F.when(flag[f] > 0, 1).otherwise(0) for f in flags), F.lit(0))
        amount = F.when(active > 0, amount / active).otherwise(F.lit(0.0))
        share = {f: F.when(flag[f] > 0, F.col("_l")).otherwise(F.lit(0.0)) for f in flags}
    daily = df.withColumn("_l", amount).groupBy(F.col(date).cast("date").alias("d")).agg(*[F.sum(share[f]).alias(f) for f in flags])
    cells = F.array(*[F.struct(F.lit(f).alias("hp"), F.col(f).alias("litres")) for f in flags])
    return daily.select("d", F.explode(cells).alias("_c")).select("d", "_c.hp", "_c.litres")


def period_total(long: DataFrame, unit: str = "quarter", value: str = "litres", name: str = "period") -> DataFrame:
    return long.groupBy(period(F.col("d"), unit).alias(name)).agg(F.sum(value).alias(value))


def pivot_share(long: DataFrame, flags: list[str], unit: str = "quarter", value: str = "litres", name: str = "period") -> DataFrame:
    """Percent of the period's total per hazard property, one column each, zeros for empty cells."""
    wide = long.groupBy(period(F.col("d"), unit).alias(name)).pivot("hp", flags).agg(F.sum(value)).fillna(0.0, subset=flags)
    total = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return wide.select(name, *[F.when(total == 0, 0.0).otherwise(F.col(f) / total * 100).alias(f) for f in flags])


def pivot_volume(long: DataFrame, flags: list[str], unit: str | None = None, value: str = "litres", name: str = "d") -> DataFrame:
    """Litres per date, or per period of a unit, one column per hazard property, zeros for empty cells."""
    key = F.col("d").alias(name) if unit is None else period(F.col("d"), unit).alias(name)
    return long.groupBy(key).pivot("hp", flags).agg(F.sum(value)).fillna(0.0, subset=flags)


def top_category(long: DataFrame, value: str = "litres") -> DataFrame:
    """Category with the largest total (first by name on ties) and the number of categories."""
    sums = long.groupBy("hp").agg(F.sum(value).alias("_s"))
    order = F.struct(-F.col("_s"), F.col("hp"))
    return sums.agg(F.min_by("hp", order).alias("top_hp"), F.max("_s").alias(value), F.count("*").alias("categories"))


def per_head(long: DataFrame, headcount: DataFrame, since: Column, value: str = "litres", dim_date: str = "effective_date", people: str = "total_people") -> DataFrame:
    """Allocated litres per person in force on the day, rows before ``since`` dropped."""
    kept = long.where(F.col("d") >= since)
    heads = check_positive(effective_join(kept, headcount, "d", dim_date, people), people)
    return heads.withColumn("litres_per_person", F.col(value) / F.col(people))
