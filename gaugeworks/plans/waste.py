"""Hazardous waste volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, waste as ops
from .registry import query

HPS = ["HP1", "HP2", "HP3"]

LITRES = "size * CASE trim(unit) WHEN 'ml' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END"
LONG_SQL = f"""a AS (SELECT d, {LITRES} AS l, HP1 + HP2 + HP3 AS n, HP1, HP2, HP3 FROM waste WHERE d IS NOT NULL),
    al AS (SELECT d, u.hp AS hp, CASE WHEN u.f > 0 THEN l / n ELSE 0 END AS x FROM (SELECT d, l, n, unnest([{{'hp': 'HP1', 'f': HP1}}, {{'hp': 'HP2', 'f': HP2}}, {{'hp': 'HP3', 'f': HP3}}]) AS u FROM a)),
    al2 AS (SELECT d, hp, sum(x) AS litres FROM al GROUP BY d, hp)"""


def allocated(t):
    return ops.allocate(t.waste, flags=HPS)


@query("unit_convert_one", f"SELECT l_orderkey, l_linenumber, round({LITRES}, 6) AS litres FROM waste")
def unit_convert_one(t):
    litres = S.to_litres(F.col("size").cast("string"), F.col("unit"), mode="one")
    return t.waste.select("l_orderkey", "l_linenumber", F.round(litres, 6).alias("litres"))


@query("waste_allocate", f"WITH {LONG_SQL} SELECT d, hp, round(litres, 6) AS litres FROM al2")
def waste_allocate(t):
    return allocated(t).withColumn("litres", F.round("litres", 6))


@query("waste_weighted", """SELECT d, u.hp AS hp, round(sum(coalesce(u.f * size * CASE unit WHEN 'ml' THEN 0.001::DOUBLE WHEN 'L' THEN 1.0::DOUBLE END, 0)), 6) AS litres
    FROM (SELECT d, size, unit, unnest([{'hp': 'HP1', 'f': HP1}, {'hp': 'HP2', 'f': HP2}, {'hp': 'HP3', 'f': HP3}]) AS u FROM waste WHERE d >= DATE '1998-01-01') GROUP BY 1, 2""")
def waste_weighted(t):
    out = ops.allocate(t.waste, flags=HPS, mode="weighted", since=F.lit("1998-01-01").cast("date"))
    return out.withColumn("litres", F.round("litres", 6))


_Q = "CONCAT(year(d), 'Q', quarter(d))"


@query("waste_by_quarter", f"WITH {LONG_SQL} SELECT {_Q} AS period, round(sum(litres), 4) AS litres FROM al2 GROUP BY 1")
def waste_by_quarter(t):
    return ops.period_total(allocated(t)).withColumn("litres", F.round("litres", 4))


@query("waste_by_year", f"WITH {LONG_SQL} SELECT year(d) AS period, round(sum(litres), 4) AS litres FROM al2 GROUP BY 1")
def waste_by_year(t):
    return ops.period_total(allocated(t), "year").withColumn("litres", F.round("litres", 4))


_SHARE = ", ".join(f"round(coalesce(sum({{v}}) FILTER (hp = '{h}'), 0) / sum({{v}}) * 100, 6) AS {h}" for h in HPS)


@query("waste_share", f"WITH {LONG_SQL} SELECT {_Q} AS period, {_SHARE.format(v='litres')} FROM al2 GROUP BY 1")
def waste_share(t):
    return ops.pivot_share(allocated(t), HPS).withColumns({h: F.round(h, 6) for h in HPS})


@query("top_category", f"WITH {LONG_SQL}, s AS (SELECT hp, sum(litres) AS litres FROM al2 GROUP BY hp) SELECT arg_max(hp, litres) AS top_hp, round(max(litres), 4) AS litres, count(*) AS categories FROM s")
def top_category(t):
    return ops.top_category(allocated(t)).withColumn("litres", F.round("litres", 4))


HEAD_SQL = f"""{LONG_SQL}, hd AS (SELECT al2.d, hp, litres, coalesce(h.total_people, 10) AS total_people FROM (SELECT * FROM al2 WHERE d >= DATE '1996-01-01') al2 ASOF LEFT JOIN headcount h ON al2.d >= h.effective_date)"""


def heads(t):
    return ops.per_head(allocated(t), t.headcount, F.lit("1996-01-01").cast("date"))


@query("waste_per_head", f"WITH {HEAD_SQL} SELECT d, hp, total_people, round(litres / total_people, 9) AS litres_per_person FROM hd")
def waste_per_head(t):
    return heads(t).select("d", "hp", "total_people", F.round("litres_per_person", 9).alias("litres_per_person"))


@query("waste_per_head_quarter", f"WITH {HEAD_SQL} SELECT {_Q} AS period, round(sum(litres / total_people), 8) AS litres_per_person FROM hd GROUP BY 1")
def waste_per_head_quarter(t):
    return ops.period_total(heads(t), value="litres_per_person").withColumn("litres_per_person", F.round("litres_per_person", 8))


@query("waste_per_head_share", f"WITH {HEAD_SQL}, z AS (SELECT *, litres / total_people AS y FROM hd) SELECT year(d) AS period, {_SHARE.format(v='y')} FROM z GROUP BY 1")
def waste_per_head_share(t):
    return ops.pivot_share(heads(t), HPS, "year", "litres_per_person").withColumns({h: F.round(h, 6) for h in HPS})


@query("effective_dim", """SELECT o_orderkey, coalesce(h.total_people, 10) AS total_people FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) o ASOF LEFT JOIN headcount h ON o.d >= h.effective_date""")
def effective_dim(t):
    fact = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return asof.effective_join(fact, t.headcount, "d", "effective_date", "total_people").select("o_orderkey", "total_people")
