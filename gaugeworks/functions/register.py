"""The scalar functions as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scalars import CODE_SEPARATORS, LITRES_PER_UNIT, NUMBER


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_functions() -> dict[str, str]:
    """Signature and body of each function."""
    units = ", ".join(f"{_quote(u)}, CAST({v!r} AS DOUBLE)" for u, v in LITRES_PER_UNIT.items())
    factor = f"coalesce(map({units})[trim(unit)], map({units})[lower(trim(unit))])"
    bare = "upper(regexp_replace(x, '[^A-Za-z0-9]', ''))"
    return {
        "sash_percent(d DOUBLE, closed DOUBLE, opened DOUBLE) RETURNS DOUBLE": (
            "CASE WHEN (closed - least(d, closed)) / (closed - opened) * 100 BETWEEN 0 AND 100 THEN (closed - least(d, closed)) / (closed - opened) * 100 END"
        ),
        "to_litres(size STRING, unit STRING) RETURNS DOUBLE": f"CASE WHEN size RLIKE {_quote(NUMBER)} THEN try_cast(trim(size) AS DOUBLE) * {factor} END",
        "normalize_codes(codes STRING) RETURNS ARRAY<STRING>": (
            f"array_distinct(filter(transform(split(coalesce(codes, ''), {_quote(CODE_SEPARATORS)}), x -> regexp_replace({bare}, '^HP0+([0-9]+)$', 'HP$1')), x -> x <> ''))"
        ),
        "prev_working_day(d DATE) RETURNS DATE": "date_sub(d, CASE weekday(d) WHEN 0 THEN 3 WHEN 6 THEN 2 ELSE 1 END)",
    }


def register(spark: SparkSession) -> list[str]:
    names = []
    for signature, body in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(")[0])
    return names
