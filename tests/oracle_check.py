"""Run registered queries beside their SQL in DuckDB: python -m tests.oracle_check [--rows-per-chunk=N] [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = "/root/testdata"


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return "None"
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return str(v)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, folder):
    df = fn(spark, folder)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return len(got), f"{len(got)} rows vs {len(want)}; only ours {sorted(a - b)[:3]} only sql {sorted(b - a)[:3]}"
    return len(got), None


def main() -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tests.conftest import make_session

    args = sys.argv[1:]
    chunk = args.pop(0)[len("--rows-per-chunk=") :] if args and args[0].startswith("--rows-per-chunk=") else None
    folder = f"{ROOT}/{args[0] if args else 'sf0.01'}"
    spark, con = make_session(), connect(folder)
    if chunk:
        spark.conf.set("gaugeworks.series.rowsPerChunk", chunk)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in args[1:] or queries:
        t = time.time()
        try:
            rows, problem = compare(spark, con, queries[name], oracles.get(name), folder)
        except Exception as e:  # report and go on with the next query
            rows, problem = -1, "".join(traceback.format_exception_only(e))[:700]
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{mark:5}{name:24}{rows:8}{time.time() - t:7.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
