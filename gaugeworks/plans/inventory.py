"""Chemical stock, hazard codes and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import stock
from ..sources import messages
from .registry import query

ITEM = ["l_orderkey", "l_linenumber"]

# Fixed values of the checking SQL: factors of the units that occur in the containers view.
FACTOR = "CASE lower(trim(unit)) WHEN 'ml' THEN 0.001 WHEN 'l' THEN 1.0 WHEN 'g' THEN 0.00125 WHEN 'kg' THEN 1.25 END"
LITRES = f"TRY_CAST(size AS DOUBLE) * CAST({FACTOR} AS DOUBLE)"

LISTED_SQL = f"""v AS (SELECT cas, coalesce(sum({LITRES}), 0) AS litres, count(*) FILTER (({LITRES}) IS NULL) AS skipped FROM containers WHERE location IS DISTINCT FROM 33 GROUP BY cas),
    lv AS (SELECT s.name, s.cas, coalesce(litres, 0) AS litres, coalesce(skipped, 0) AS skipped FROM solvents s LEFT JOIN v USING (cas))"""
MISSING = 33


def containers(t):
    """Stock outside the missing-stock location."""
    return stock.present_only(t.containers, missing=MISSING)


@query("unit_convert", f"SELECT l_orderkey, l_linenumber, size, unit, round({LITRES}, 6) AS litres FROM containers")
def unit_convert(t):
    litres = F.round(S.to_litres(F.col("size"), F.col("unit")), 6).alias("litres")
    return t.containers.select(*ITEM, "size", "unit", litres)


@query("unit_totals", f"SELECT cas, round(coalesce(sum({LITRES}), 0), 7) AS litres, count(*) FILTER (({LITRES}) IS NULL) AS skipped FROM containers GROUP BY cas")
def unit_totals(t):
    return stock.litres_by_code(t.containers).withColumn("litres", F.round("litres", 7))


@query("flatten_containers", "SELECT cas, count(*) AS containers, count(location) AS located FROM containers GROUP BY cas")
def flatten_containers(t):
    box = F.struct(F.array(F.struct("name", "size", "unit", "cas", "location")).alias("containers"))
    answers = t.containers.select(F.to_json(F.struct(box.alias("data"))).alias("body"))
    rows = messages.flatten_containers(answers, "body")
    return rows.groupBy("cas").agg(F.count("*").alias("containers"), F.count("location").alias("located"))


@query("listed_volumes", f"WITH {LISTED_SQL} SELECT name, cas, round(litres, 7) AS litres, skipped FROM lv")
def listed_volumes(t):
    return stock.listed_volumes(containers(t), t.solvents).withColumn("litres", F.round("litres", 7))


@query("traffic_light", f"""WITH {LISTED_SQL}, cells AS (SELECT category, colour FROM (SELECT DISTINCT category FROM classes) CROSS JOIN (SELECT unnest(['red', 'yellow', 'green']) AS colour)),
    s AS (SELECT category, colour, sum(litres) AS litres FROM lv JOIN classes USING (cas) GROUP BY 1, 2)
    SELECT category, colour, round(coalesce(litres, 0), 7) AS litres FROM cells LEFT JOIN s USING (category, colour)""")
def traffic_light(t):
    return stock.traffic_light(containers(t), t.solvents, t.classes).withColumn("litres", F.round("litres", 7))


@query("traffic_wide", f"""WITH {LISTED_SQL} SELECT category, round(coalesce(sum(litres) FILTER (colour = 'red'), 0), 7) AS red, round(coalesce(sum(litres) FILTER (colour = 'yellow'), 0), 7) AS yellow,
    round(coalesce(sum(litres) FILTER (colour = 'green'), 0), 7) AS green FROM lv JOIN classes USING (cas) GROUP BY 1""")
def traffic_wide(t):
    wide = stock.traffic_wide(stock.traffic_light(containers(t), t.solvents, t.classes))
    return wide.withColumns({c: F.round(c, 7) for c in stock.COLOURS})


@query("skipped_total", f"WITH {LISTED_SQL} SELECT sum(skipped)::BIGINT AS skipped FROM lv")
def skipped_total(t):
    return stock.skipped_total(containers(t), t.solvents)


@query("red_inventory", f"WITH {LISTED_SQL} SELECT name, cas, category, round(litres, 6) AS litres FROM lv JOIN classes USING (cas) WHERE colour = 'red'")
def red_inventory(t):
    return stock.red_inventory(containers(t), t.solvents, t.classes)


ORDERED = """od AS (SELECT CONCAT(p_type, '-', p_brand) AS cas, sum(CASE l_suppkey % 3 WHEN 0 THEN l_quantity * l_linenumber * 0.001::DOUBLE WHEN 1 THEN l_quantity * l_linenumber END) AS litres
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1)"""


def order_rows(t):
    unit = F.element_at(F.array(F.lit("ml"), F.lit("L"), F.lit("jar")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    lines = t.lineitem.select("l_partkey", "l_shipdate", F.col("l_quantity").alias("size"), F.col("l_linenumber").alias("number"), unit.alias("unit"))
    return lines.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(t._cas.alias("cas"), "l_shipdate", "size", "number", "unit")


def _ordered(t, how):
    since = F.lit("1998-06-01").cast("timestamp_ntz")
    out = stock.order_volume(order_rows(t), t.solvents, date="l_shipdate", since=since, how=how)
    return out.withColumn("litres", F.round("litres", 3))


@query("order_volume", f"WITH {ORDERED} SELECT name, cas, round(coalesce(litres, 0), 3) AS litres FROM solvents LEFT JOIN od USING (cas)")
def order_volume(t):
    return _ordered(t, "left")


@query("order_volume_inner", f"WITH {ORDERED} SELECT name, cas, round(coalesce(litres, 0), 3) AS litres FROM solvents JOIN od USING (cas)")
def order_volume_inner(t):
    return _ordered(t, "inner")


LIST_SQL = """cl AS (SELECT p_partkey, coalesce(list_filter(list_transform(regexp_split_to_array(codes, '[;,/+|]+'), lambda x: trim(x)), lambda x: x <> ''), []) AS raw FROM form_codes),
    nl AS (SELECT p_partkey, raw, list_filter(list_transform(raw, lambda x: regexp_replace(upper(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')), '^HP0+([0-9]+)$', 'HP\\1')), lambda x: x <> '') AS nc FROM cl),
    ex AS (SELECT p_partkey, unnest(nc) AS code, generate_subscripts(nc, 1) AS pos FROM nl),
    fs AS (SELECT p_partkey, code, min(pos) AS pos FROM ex GROUP BY 1, 2)"""


def codes(t):
    return t.form_codes.select("p_partkey", S.normalize_codes(S.parse_codes(F.col("codes"))).alias("codes"))


@query("code_list", f"WITH {LIST_SQL} SELECT nl.p_partkey, len(raw) AS parsed, coalesce((SELECT string_agg(code, ',' ORDER BY pos) FROM fs WHERE fs.p_partkey = nl.p_partkey), '') AS codes FROM nl")
def code_list(t):
    raw = S.parse_codes(F.col("codes"))
    return t.form_codes.select("p_partkey", F.size(raw).alias("parsed"), F.array_join(S.normalize_codes(raw), ",").alias("codes"))


VOCABULARY = [f"HP{i}" for i in range(1, 16)]


@query("one_hot_codes", f"WITH {LIST_SQL} SELECT p_partkey, {', '.join(f'CAST(list_contains(nc, {chr(39)}{h}{chr(39)}) AS INT) AS {h}' for h in VOCABULARY)} FROM nl")
def one_hot_codes(t):
    return codes(t).select("p_partkey", *S.one_hot(F.col("codes"), VOCABULARY))


@query("hazard_search", f"WITH {LIST_SQL} SELECT DISTINCT grp, p_partkey FROM ex JOIN (SELECT DISTINCT p_type AS grp, CONCAT('HP', SUBSTR(p_brand, 7)) AS code FROM part WHERE p_size > 45) USING (code)")
def hazard_search(t):
    code = F.concat(F.lit("HP"), F.substring("p_brand", 7, 9))
    groups = t.part.where("p_size > 45").groupBy(F.col("p_type").alias("grp")).agg(F.collect_set(code).alias("codes"))
    return stock.search_any(codes(t), groups, ["p_partkey"], "codes")


@query("container_lookup", """SELECT l_orderkey, l_linenumber, cas, location FROM containers WHERE location IS DISTINCT FROM 33 AND cas IN (SELECT cas FROM classes WHERE category = 'voc' AND colour = 'red')""")
def container_lookup(t):
    wanted = t.classes.where("category = 'voc' AND colour = 'red'")
    return stock.lookup(containers(t), "cas", wanted).select(*ITEM, "cas", "location")


@query("composition", """WITH s AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
    c AS (SELECT l_orderkey, coalesce(a, 0) AS a, coalesce(n, 0) AS n, coalesce(r, 0) AS r FROM s)
    SELECT l_orderkey, round(a / (a + n + r) * 100, 4) AS a_pct, round(n / (a + n + r) * 100, 4) AS n_pct, round(r / (a + n + r) * 100, 4) AS r_pct FROM c""")
def composition(t):
    part = lambda f: F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0)).alias(f)
    sums = t.lineitem.groupBy("l_orderkey").agg(part("A"), part("N"), part("R"))
    pct = S.composition(F.col("A"), F.col("N"), F.col("R"))
    return sums.select("l_orderkey", *[F.round(p, 4).alias(f"{n}_pct") for p, n in zip(pct, "anr")])
