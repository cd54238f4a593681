"""Worksheet-shaped tables: header detection, column names, wide to long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_codes, one_hot, parse_codes, to_num
from ..operators.series import spread_by_key

# Positional names of a headerless waste sheet.
POSITIONAL = {"Unnamed: 0": "Date", "Unnamed: 1": "Ref", "Unnamed: 3": "Size", "Unnamed: 4": "Unit"}
# Row of the header when none is recognised.
DEFAULT_HEADER_ROW = 23
# Header fragments of the waste form and the names they stand for.
FORM_RULES = {
    "reference": "reference",
    "chemical name": "chemical_name",
    "description of waste": "chemical_name",
    "no. of containers": "num_containers",
    "container size": "container_size",
    "physical state": "physical_state",
    "hazard statements": "hazard_statements",
    "hazard properties": "hazard_properties",
}
HP_VOCABULARY = [f"HP{i}" for i in range(1, 16)]


def ensure_columns(df: DataFrame, fallback: dict[str, str] | None = None) -> DataFrame:
    """Rename positional columns where the wanted name is absent."""
    fallback = fallback or POSITIONAL
    return df.withColumnsRenamed({old: new for old, new in fallback.items() if old in df.columns and new not in df.columns})


def _filled(cell: Column) -> Column:
    """Trimmed text of a cell; null if there is none."""
    text = F.trim(cell.cast("string"))
    return F.when(text != "", text)


def _meaning(heading: Column, rules: dict[str, str]) -> Column:
    """Name that a heading stands for: that of the first rule whose fragment it holds."""
    text = F.lower(F.coalesce(heading, F.lit("")))
    out = F.lit(None).cast("string")
    for part, name in reversed(list(rules.items())):
        out = F.when(text.contains(part), name).otherwise(out)
    return out


def sheet_headers(grid: DataFrame, row: str, cells: str, sheet: list[str], default_row: int = DEFAULT_HEADER_ROW) -> DataFrame:
    """Header of each sheet: the sheet's keys, ``header_row`` and ``headings``.

    It is the first row that mentions "reference", else the row of the default number; a sheet with neither has no headings.
    """
    named = F.lower(F.concat_ws(" ", cells)).contains("reference")
    found = grid.groupBy(*sheet).agg(
        F.min(F.when(named, F.col(row))).alias("_at"),
        F.min_by(cells, F.when(named, F.col(row))).alias("_named"),
        F.min_by(cells, F.when(F.col(row) == default_row, F.lit(0))).alias("_default"),
    )
    none = F.array().cast("array<string>")
    return found.select(*sheet, F.coalesce("_at", F.lit(default_row)).alias("header_row"), F.coalesce(F.when(F.col("_at").isNotNull(), F.col("_named")).otherwise(F.col("_default")), none).alias("headings"))


def sheet_columns(grid: DataFrame, row: str, cells: str, sheet: list[str] | None = None, rules: dict[str, str] | None = None, default_row: int = DEFAULT_HEADER_ROW) -> DataFrame:
    """Rows of raw sheets under canonical column names: the sheet's keys, the row number, one column per name of ``rules``.

    Each sheet is read by its own header.  Cells are trimmed; where several headings mean one name, the first filled cell
    counts, so a column without any values never hides another; a name that a sheet lacks is null; rows above the header
    and rows without any known value are left out.  Only headers, one row per sheet, are joined to the rows.
    """
    rules, keys = rules or FORM_RULES, list(sheet or [])
    names = list(dict.fromkeys(rules.values()))
    if not keys:
        grid, keys = grid.withColumn("_sheet", F.lit(0)), ["_sheet"]
    heads = sheet_headers(grid, row, cells, keys, default_row)
    at = lambda name: F.filter(F.transform("headings", lambda h, i: F.when(_meaning(h, rules) == name, i)), lambda i: i.isNotNull())
    heads = heads.select(*keys, "header_row", *[at(n).alias(f"_at_{n}") for n in names])
    rows = spread_by_key(grid, heads, keys, "inner", null_safe=True).where(F.col(row) > F.col("header_row"))
    first = lambda n: F.get(F.filter(F.transform(f"_at_{n}", lambda i: _filled(F.get(cells, i))), lambda v: v.isNotNull()), F.lit(0))
    out = rows.select(*(sheet or []), row, *[first(n).alias(n) for n in names])
    return out.dropna(how="all", subset=names)


def sheet_frame(grid: DataFrame, row: str, cells: str, default_row: int = DEFAULT_HEADER_ROW) -> DataFrame:
    """One raw sheet as a frame whose columns are named by its header row, all-empty columns left out.

    The schema is found at run time from one row of headings and one of counts.  A heading met again gets a number, an
    empty one its position; rows without any value are left out.
    """
    head = sheet_headers(grid.withColumn("_sheet", F.lit(0)), row, cells, ["_sheet"], default_row).first()
    if head is None:
        return grid.select(row).limit(0)
    data = grid.where(F.col(row) > head["header_row"])
    width = max(len(head["headings"]), data.agg(F.max(F.size(cells))).first()[0] or 0)
    cell = [_filled(F.get(cells, F.lit(i))) for i in range(width)]
    counts = data.agg(F.lit(0), *[F.count(c) for c in cell]).first()[1:]
    named, met = [], {}
    for i in range(width):
        text = (head["headings"][i] if i < len(head["headings"]) else None) or ""
        name = text.strip() or f"Unnamed: {i}"
        met[name] = met.get(name, 0) + 1
        if counts[i]:
            named.append(cell[i].alias(name if met[name] == 1 else f"{name} ({met[name]})"))
    some = F.coalesce(F.lit(None), *[c for c, n in zip(cell, counts, strict=True) if n])
    return data.where(some.isNotNull()).select(row, *named)


def known_columns(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Known columns of a named frame under canonical names, in a fixed order.

    Texts are trimmed.  Where several columns mean one name, the first filled cell of a row counts; names without a
    column are left out, and so are rows without any value.
    """
    rules = rules or FORM_RULES
    found: dict[str, list[Column]] = {}
    for column in df.columns:
        name = next((n for part, n in rules.items() if part in column.lower()), None)
        if name:
            found.setdefault(name, []).append(_filled(F.col(f"`{column}`")))
    picked = [F.coalesce(*found[n]).alias(n) for n in dict.fromkeys(rules.values()) if n in found]
    return df.select(*picked).dropna(how="all")


def unpivot_pairs(df: DataFrame, pairs: list[tuple[str, str, str, str]], keep: list[str] | None = None) -> DataFrame:
    """Paired (time, value) columns to rows (grp, metric, ts, value); unreadable pairs are dropped.

    ``pairs`` lists (grp, metric, time column, value column).
    """
    kinds = dict(df.dtypes)

    def time(c: str):
        return (F.col(c) if kinds[c].startswith(("timestamp", "date")) else F.try_to_timestamp(F.col(c))).cast("timestamp_ntz")

    def number(c: str):
        return F.col(c).try_cast("double")

    cells = [F.struct(F.lit(g).alias("grp"), F.lit(m).alias("metric"), time(t).alias("ts"), number(v).alias("value")) for g, m, t, v in pairs]
    rows = df.select(*(keep or []), F.explode(F.array(*cells)).alias("_c")).select(*(keep or []), "_c.*")
    return rows.dropna(subset=["ts", "value"])


def clean_form(df: DataFrame) -> DataFrame:
    """Waste form rows with a numeric reference: code lists parsed, one 0/1 column per hazard property."""
    df = df.where(to_num(F.col("reference"), None).isNotNull()).withColumn("reference", F.trim("reference"))
    if "hazard_statements" in df.columns:
        df = df.withColumn("hazard_statements", parse_codes(F.col("hazard_statements")))
    properties = normalize_codes(parse_codes(F.col("hazard_properties"))) if "hazard_properties" in df.columns else F.array().cast("array<string>")
    df = df.withColumn("hazard_properties", properties)
    if "num_containers" in df.columns:
        df = df.withColumn("num_containers", to_num(F.col("num_containers")).cast("int"))
    return df.select("*", *one_hot(F.col("hazard_properties"), HP_VOCABULARY))
