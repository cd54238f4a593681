"""Column functions: calibration, thresholds, units, validity, codes, calendar labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Litres per unit; masses count at 0.8 g/ml.  The micro sign is U+00B5.
LITRES_PER_UNIT = {
    "µl": 0.000001,
    "µL": 0.000001,
    "ul": 0.000001,
    "uL": 0.000001,
    "ml": 0.001,
    "mL": 0.001,
    "l": 1.0,
    "L": 1.0,
    "µg": 0.00000000125,
    "ug": 0.00000000125,
    "mg": 0.00000125,
    "g": 0.00125,
    "kg": 1.25,
    "oz": 0.035436875,
    "lb": 0.56699,
    "lbs": 0.56699,
    "gal": 4.54609,
}

# Number pattern of a plain decimal.
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"

# Separators of hazard code lists.
CODE_SEPARATORS = r"[;,/+|]+"

# kWh of everyday comparisons and the litres of an Olympic pool.
KETTLE_KWH, EV_MILES_PER_KWH, WHALE_KWH = 0.1, 3.0, 0.41
POOL_LITRES = 2_500_000.0


def to_num(c: Column, default: float | None = 0.0) -> Column:
    """Number of a text, ``default`` when missing or not a number."""
    text = c.cast("string")
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def unit_map(units: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in units.items() for x in pair])


def unit_factor(unit: Column, units: dict[str, float] | None = None, mode: str = "skip", normalize_mu: bool = False) -> Column:
    """Litres per unit.

    ``skip``: trimmed, exact then lower case, else null.  ``one``: trimmed and exact, else 1.
    ``null``: exact without trimming, else null.
    """
    table = unit_map(units or LITRES_PER_UNIT)
    if normalize_mu:
        unit = F.translate(unit, "μ", "µ")
    if mode == "null":
        return table[unit]
    unit = F.trim(unit)
    exact = table[unit]
    return F.coalesce(exact, F.lit(1.0)) if mode == "one" else F.coalesce(exact, table[F.lower(unit)])


def to_litres(size: Column, unit: Column, mode: str = "skip", units: dict[str, float] | None = None, normalize_mu: bool = False) -> Column:
    """Litres of a size text in a unit; null marks a container that cannot be counted."""
    factor = unit_factor(unit, units, mode, normalize_mu)
    return to_num(size, 0.0 if mode == "one" else None) * factor


def sash_percent(d: Column, closed: Column, open_: Column) -> Column:
    pct = (closed - F.least(d, closed)) / (closed - open_) * 100
    return F.when(pct.between(0, 100), pct)


def pulses_to_ml(n: Column, factor: float = 5.0) -> Column:
    return n * F.lit(1000.0) / F.lit(factor * 60)


def water_error(x: Column, stuck: float = 0.003, width: float = 5e-4) -> Column:
    return F.coalesce((x < 0) | (F.abs(x - stuck) <= width), F.lit(False))


def power_kw(kwh_per_minute: Column) -> Column:
    return kwh_per_minute * 60


def active_kw(kw: Column, idle_kw: Column) -> Column:
    return F.greatest(kw - idle_kw, F.lit(0.0))


def kwh_context(kwh: Column) -> Column:
    return F.struct(
        (kwh / KETTLE_KWH).alias("kettles_boiled"), (kwh * EV_MILES_PER_KWH).alias("ev_miles"), (kwh / WHALE_KWH).alias("blue_whale_lifts")
    )


def pools(litres: Column) -> Column:
    return litres / POOL_LITRES


def parse_codes(c: Column) -> Column:
    """Separated code text as a list of trimmed, non-empty codes; null gives an empty list."""
    parts = F.filter(F.transform(F.split(c, CODE_SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def normalize_code(x: Column) -> Column:
    bare = F.upper(F.regexp_replace(x, r"[^A-Za-z0-9]", ""))
    return F.regexp_replace(bare, r"^HP0+([0-9]+)$", "HP$1")


def normalize_codes(codes: Column) -> Column:
    """Canonical codes, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(codes, normalize_code), lambda x: x != ""))


def one_hot(codes: Column, vocabulary: list[str]) -> list[Column]:
    return [F.coalesce(F.array_contains(codes, v).cast("int"), F.lit(0)).alias(v) for v in vocabulary]


def parse_date(c: Column) -> Column:
    """Day-first date of a text, month-first when only that fits, ISO as ISO; null otherwise."""
    text = F.trim(c)
    forms = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yyyy", "yyyy-M-d", "yyyy-M-d H:m:s"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in forms])


def composition(*parts: Column) -> list[Column]:
    total = sum(parts[1:], parts[0])
    return [p / F.when(total == 0, F.lit(1.0)).otherwise(total) * 100 for p in parts]


def prev_working_day(d: Column) -> Column:
    back = F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1)
    return F.date_sub(d, back)


def period(ts: Column, unit: str) -> Column:
    """Calendar label: day, month, year, quarter (2024Q1), week (its Monday), week_end (its Sunday)."""
    d = ts.cast("date")
    monday = F.date_sub(d, F.weekday(d))
    return {
        "day": lambda: d,
        "month": lambda: F.trunc(d, "month"),
        "year": lambda: F.year(d),
        "quarter": lambda: F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")),
        "week": lambda: monday,
        "week_end": lambda: F.date_add(monday, 6),
    }[unit]()


def band(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the half-open interval that holds the value, null outside all."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((c >= low) & (c < high), label).otherwise(out)
    return out


def hour_between(ts: Column, start: int, end: int) -> Column:
    """Hour of day in [start, end), wrapping past midnight when start > end."""
    h = F.hour(ts)
    return (h >= start) & (h < end) if start <= end else (h >= start) | (h < end)


def align_day(ts: Column, base: Column) -> Column:
    """Time of day of ``ts`` put on the date ``base``."""
    day = ts.cast("date")
    offset = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(day.cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(base.cast("timestamp")) + offset).cast("timestamp_ntz")


def validate(c: Column, low: float, high: float) -> Column:
    """The value, or -1 when missing or outside the bounds."""
    return F.when(c.between(low, high), c).otherwise(F.lit(-1.0))


def good_use(is_open: Column, present: Column) -> Column:
    return (present == 1) | (~is_open & (present == 0))


def bad_use(is_open: Column, present: Column) -> Column:
    return is_open & (present == 0)
