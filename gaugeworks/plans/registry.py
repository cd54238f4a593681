"""Named queries with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a query with the derived views it names."""
    body, needed = sql.strip(), []

    def need(text: str) -> None:
        for name, view in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(view)
                needed.append(name)

    need(body)
    if not needed:
        return body
    views = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    head = re.match(r"WITH (RECURSIVE )?", body)
    if head:
        return f"{head[0]}{views}, {body[head.end():]}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with the SQL of the same result where SQL can say it."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
