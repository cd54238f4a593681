"""Connected components of an edge table, without collecting links or groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Nodes that a task holds before it hands its stars on.
HELD = 1 << 18


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (x, y, open) with each chain that a task meets drawn to its least end; open if the task met an open edge.

    A task names a node once for each HELD nodes, so few rows of a node are left, and the least end keeps them all.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}
        more = False

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def drawn() -> pd.DataFrame:
            rows = [(x, find(x)) for x in list(parent)]
            parent.clear()
            return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["x", "y"], dtype="int64").assign(open=more)

        for b in batches:
            more = more or bool(b["open"].any())
            for x, y in zip(b["x"].tolist(), b["y"].tolist(), strict=True):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
            if len(parent) >= HELD:
                yield drawn()
        yield drawn()

    return edges.mapInPandas(draw, "x bigint, y bigint, open boolean")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable from each node that has an edge to a smaller one: columns node, component.

    Each round a node takes the least of its ends, its other ends are tied to that one, and every end is replaced by the
    end it has taken itself; before and after, tasks draw the chains they meet to their least end.  Rows of a node are as
    many as the tasks that met it, so grouping by node gathers no hub.  A round is one table in the shared folder.
    """
    ends = edges.select(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y"), F.lit(False).alias("open"))
    e = cut(_stars(ends.where("x <> y")))
    while True:
        up = e.groupBy("x").agg(F.min("y").alias("p"), F.collect_set("y").alias("ys"))
        own = F.array(F.struct(F.col("x"), F.lit(False).alias("tied")))
        others = F.transform(F.filter("ys", lambda y: y != F.col("p")), lambda y: F.struct(y.alias("x"), F.lit(True).alias("tied")))
        rows = up.select("p", F.explode(F.concat(own, others)).alias("s")).select("p", "s.x", "s.tied")
        taken = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
        rows = rows.join(taken, "p", "left").select("x", F.coalesce("q", "p").alias("y"), (F.col("tied") | F.col("q").isNotNull()).alias("open"))
        e = cut(_stars(rows))
        if e.where("open").isEmpty():
            return e.select(F.col("x").alias("node"), F.col("y").alias("component"))
