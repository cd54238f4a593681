"""Views that present the test tables as sensor readings, meters, containers and waste rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import Series

DEC = "decimal(18,2)"
USER = ["user_id"]


class Tables:
    """Base tables of one folder and the views over them; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._read = spark, folder, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def readings(self) -> DataFrame:
        v = F.col("value")
        return self.events.select(
            "event_id",
            "user_id",
            "ts",
            F.when(F.col("event_type") == "error", -1.0).otherwise(765.0 - 2.0 * v).alias("distance"),
            F.when(v < 60, 0.0).otherwise(v).alias("light"),
            v.alias("water"),
        )

    @cached_property
    def meter(self) -> DataFrame:
        s = Series.plan(self.events.select("event_id", "user_id", "ts", "value"), USER, "ts", ["event_id"])
        return s.running(sums={"cumulative": F.col("value").cast(DEC)}).rows().drop("value")

    @cached_property
    def energy_minute(self) -> DataFrame:
        return self.events.select("event_id", "user_id", "ts", (F.col("value") / 600.0).alias("energy_kwh"))

    @cached_property
    def energy_daily(self) -> DataFrame:
        return self.orders.groupBy(F.col("o_orderpriority").alias("site"), F.col("o_orderdate").cast("date").alias("d")).agg(
            F.sum(F.col("o_totalprice").cast(DEC)).cast("double").alias("esum")
        )

    @cached_property
    def containers(self) -> DataFrame:
        supp = F.col("l_suppkey")
        unit = F.element_at(F.array(*map(F.lit, ["ml", " mL", "L", "g", "kg", "weird"])), (supp % 6 + 1).cast("int"))
        size = F.when(F.col("l_linenumber") % 7 == 0, "N/A").otherwise(F.col("l_quantity").cast("int").cast("string"))
        lines = self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", size.alias("size"), unit.alias("unit"), F.when(supp % 17 != 0, supp).alias("location"))
        return lines.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            "l_orderkey", "l_linenumber", F.col("p_name").alias("name"), self._cas.alias("cas"), "size", "unit", "location"
        )

    @property
    def _cas(self):
        return F.concat_ws("-", "p_type", "p_brand")

    @cached_property
    def solvents(self) -> DataFrame:
        names = self.part.where("p_size <= 40").select(F.concat_ws(" ", "p_brand", "p_type").alias("name"), self._cas.alias("cas")).distinct()
        aliases = self.part.where("p_brand = 'Brand#2' AND p_type = 'ECONOMY'").select(F.concat(F.lit("alias "), "p_brand").alias("name"), self._cas.alias("cas")).distinct()
        return names.unionByName(aliases)

    @cached_property
    def classes(self) -> DataFrame:
        third = F.substring("p_brand", 7, 9).cast("int") % 3
        colour = F.when(third == 0, "red").when(third == 1, "yellow").otherwise("green")
        category = F.explode(F.array(F.lit("composite"), F.lit("voc")))
        return self.part.select(category.alias("category"), colour.alias("colour"), self._cas.alias("cas")).distinct()

    @cached_property
    def waste(self) -> DataFrame:
        unit = F.when(F.col("l_returnflag") == "A", "L").when(F.col("l_returnflag") == "N", "ml").otherwise("unknown")
        flag = lambda n: (F.col("l_partkey") % n == 0).cast("int")
        return self.lineitem.select(
            "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("d"), F.col("l_quantity").alias("size"), unit.alias("unit"), flag(2).alias("HP1"), flag(3).alias("HP2"), flag(5).alias("HP3")
        )

    @cached_property
    def form_codes(self) -> DataFrame:
        short = lambda to: F.regexp_replace("p_brand", "Brand#", to)
        text = F.concat(short("hp 0"), F.lit("; "), short("HP"), F.lit("+"), "p_type", F.lit(" /"), "p_name")
        return self.part.select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, text).alias("codes"))

    @cached_property
    def hoods(self) -> DataFrame:
        return self.customer.where("c_acctbal > 0").select(
            F.col("c_custkey").alias("user_id"), F.lit(765.0).alias("closed_mm"), F.lit(100.0).alias("open_mm"), F.lit(18.0).alias("room_lux"), F.lit(80.0).alias("hood_lux")
        )

    @cached_property
    def ranges(self) -> DataFrame:
        spans = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in EXCLUDED])
        return self.hoods.select("user_id", F.explode(spans).alias("_r")).select("user_id", "_r.*")

    @cached_property
    def headcount(self) -> DataFrame:
        """People per date; three effective dates as the dimension is small by nature."""
        return self.spark.sql(VIEW_SQL["headcount"])

    @cached_property
    def windows(self) -> DataFrame:
        return self.spark.sql(VIEW_SQL["windows"])


# Distance ranges of known false echoes, in millimetres.
EXCLUDED = [(542.0, 573.0), (271.0, 277.0), (370.0, 373.0)]
HEADCOUNT = [("1996-01-01", 10), ("1998-06-01", 12), ("2000-01-01", 8)]
WINDOWS = [("w1", "1997-12-20", "1998-01-05"), ("w2", "1998-12-20", "1999-01-04")]


def _literal_rows(rows, form) -> str:
    return " UNION ALL ".join(f"SELECT {form(r)}" for r in rows)


def _values(columns: str, rows, form) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({form(r)})' for r in rows)}) AS v({columns})"


VIEW_SQL = {
    "readings": """SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN -1.0 ELSE 765.0 - 2.0 * value END AS distance,
        CASE WHEN value < 60 THEN 0.0 ELSE value END AS light, value AS water FROM events""",
    "meter": """SELECT event_id, user_id, ts, SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cumulative FROM events""",
    "energy_minute": "SELECT event_id, user_id, ts, value / 600.0 AS energy_kwh FROM events",
    "energy_daily": """SELECT o_orderpriority AS site, CAST(o_orderdate AS DATE) AS d, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS esum
        FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "containers": """SELECT l.l_orderkey, l.l_linenumber, p.p_name AS name, CONCAT(p.p_type, '-', p.p_brand) AS cas,
        CASE WHEN l.l_linenumber % 7 = 0 THEN 'N/A' ELSE CAST(CAST(l.l_quantity AS INT) AS STRING) END AS size,
        CASE l.l_suppkey % 6 WHEN 0 THEN 'ml' WHEN 1 THEN ' mL' WHEN 2 THEN 'L' WHEN 3 THEN 'g' WHEN 4 THEN 'kg' ELSE 'weird' END AS unit,
        CASE WHEN l.l_suppkey % 17 = 0 THEN NULL ELSE l.l_suppkey END AS location FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "solvents": """SELECT DISTINCT CONCAT(p_brand, ' ', p_type) AS name, CONCAT(p_type, '-', p_brand) AS cas FROM part WHERE p_size <= 40
        UNION ALL SELECT DISTINCT CONCAT('alias ', p_brand), CONCAT(p_type, '-', p_brand) FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'""",
    "classes": """SELECT DISTINCT c.category, CASE CAST(SUBSTR(p_brand, 7) AS INT) % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'green' END AS colour,
        CONCAT(p_type, '-', p_brand) AS cas FROM part CROSS JOIN (SELECT 'composite' AS category UNION ALL SELECT 'voc') c""",
    "waste": """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, l_quantity AS size,
        CASE l_returnflag WHEN 'A' THEN 'L' WHEN 'N' THEN 'ml' ELSE 'unknown' END AS unit, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS HP1,
        CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS HP2, CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS HP3 FROM lineitem""",
    "form_codes": """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CONCAT(REPLACE(p_brand, 'Brand#', 'hp 0'), '; ',
        REPLACE(p_brand, 'Brand#', 'HP'), '+', p_type, ' /', p_name) END AS codes FROM part""",
    "hoods": """SELECT c_custkey AS user_id, CAST(765 AS DOUBLE) AS closed_mm, CAST(100 AS DOUBLE) AS open_mm, CAST(18 AS DOUBLE) AS room_lux,
        CAST(80 AS DOUBLE) AS hood_lux FROM customer WHERE c_acctbal > 0""",
    "ranges": "SELECT user_id, r.low, r.high FROM hoods CROSS JOIN (" + _literal_rows(EXCLUDED, lambda r: f"CAST({r[0]} AS DOUBLE) AS low, CAST({r[1]} AS DOUBLE) AS high") + ") r",
    "headcount": _values("effective_date, total_people", HEADCOUNT, lambda r: f"DATE '{r[0]}', {r[1]}"),
    "windows": _values("label, start_d, end_d", WINDOWS, lambda r: f"'{r[0]}', DATE '{r[1]}', DATE '{r[2]}'"),
}
