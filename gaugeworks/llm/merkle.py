"""Merkle manifest of a dataset: a hash tree per key, a tree over the keys' roots, and a proof for every row.

Rows of a key are its leaves in ascending order of id.  A node is the SHA-256 of the digests (as hex text) of up to
``FAN`` consecutive nodes below it.  Only every ``LEVELS``-th level is kept: a task takes the stored nodes of one aligned
subtree (``FAN ** LEVELS`` of them at most, all neighbours) and hands on its top.  Proofs go the other way, from the
root down: a task takes the stored nodes of a subtree once more, together with the path from its top to the root,
makes the missing interior nodes again, emits for each stored node the siblings on its way, and forgets them.

A key of any size is many subtrees, so no task meets more than one subtree; the tree over the keys' roots is built by
the same steps.  Positions come from a range partition by (key, id) and one count per (key, range).

Cases: a null key is a key of its own and comes first; null ids come first within their key; equal ids are ordered by
leaf, and rows equal in all hashed columns have the same leaf, each its own place; a key of one row has that leaf as
its root; other columns are dropped; an empty frame gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

FAN = 8
LEVELS = 4
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(encoded(v) for v in values)).cast("binary"), 256))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``pos``, their place within ``key`` by ``order`` (nulls first), and ``n``, the rows of the key."""
    by = [F.col(c).asc_nulls_first() for c in ("key", *order)]
    dealt = cut(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("key")
    counts = dealt.groupBy("key", "part").agg(F.count("*").alias("c"))
    counts = counts.select(
        F.col("key").alias("k"),
        F.col("part").alias("p"),
        F.sum("c").over(whole).alias("n"),
        (F.sum("c").over(whole.orderBy("part")) - F.col("c")).alias("before"),
    )
    placed = dealt.join(counts, dealt["key"].eqNullSafe(counts["k"]) & (dealt["part"] == counts["p"]))
    within = Window.partitionBy("key", "part").orderBy(*by[1:])
    return placed.withColumn("pos", F.col("before") + F.row_number().over(within) - 1).drop("k", "p", "part", "before")


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def interior(nodes: list[str], fan: int, levels: int, whole: bool) -> list[list[str]]:
    """A subtree's levels from its stored nodes up; a key's only subtree ends with its first lone node."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        if whole and len(below) == 1:
            break
        out.append([_digest("".join(below[i : i + fan])) for i in range(0, len(below), fan)])
    return out


def way(tree: list[list[str]], place: int, fan: int) -> Iterator[tuple[int, str]]:
    """Place in its run and joined siblings of the node and of each of its ancestors within the subtree."""
    for level in tree[:-1]:
        run, at = place // fan * fan, place % fan
        yield at, "".join(level[run : run + at]) + "".join(level[run + at + 1 : run + fan])
        place //= fan


def fold(digest: str, path: list[tuple[int, str]]) -> str:
    """The root that a digest and the siblings on its way make."""
    for at, others in path:
        digest = _digest(others[: 64 * at] + digest + others[64 * at :])
    return digest


def _written(path: list[tuple[int, str]]) -> str:
    return "".join(f"{at}:{others};" for at, others in path)


def _read(path: str) -> list[tuple[int, str]]:
    parts = (p.split(":") for p in path.split(";")[:-1])
    return [(int(at), others) for at, others in parts]


def _subtree(fan: int, levels: int) -> Column:
    return F.expr(f"pos div {fan**levels}L").alias("sub")


def grow(leaves: DataFrame, fan: int = FAN, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels (key, pos, n, node; the lowest is ``leaves``, the next hold unfinished keys only), and the keys' roots (key, node, done)."""
    size = fan**levels

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = int(rows["n"].iloc[0])
        tree = interior([h.hex() for h in rows["node"]], fan, levels, n <= size)
        return pd.DataFrame({"key": rows["key"].iloc[:1], "pos": int(rows["pos"].iloc[0]) // size, "n": -(-n // size), "node": [bytes.fromhex(tree[-1][0])]})

    schema = f"key {leaves.schema['key'].dataType.simpleString()}, pos bigint, n bigint, node binary"
    stored, roots, done = [leaves], leaves.where("n = 1").select("key", "node", F.lit(0).alias("done")), 0
    level = leaves.where("n > 1")
    while level.agg(F.max("n")).first()[0]:
        done += 1
        above = level.select("key", "pos", "n", "node").groupBy("key", _subtree(fan, levels)).applyInPandas(top, schema)
        above = cut(above)
        roots = roots.unionByName(above.where("n = 1").select("key", "node", F.lit(done).alias("done")))
        level = above.where("n > 1")
        stored.append(level)
    return stored[: max(1, done)], roots


def _descend(level: DataFrame, paths: DataFrame, fan: int, levels: int, emit, schema: str) -> DataFrame:
    """Regenerate each subtree of a stored level; ``emit(rows, ways, path row)`` gives what becomes of its nodes."""
    size = fan**levels

    def extract(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        rows = rows.sort_values("pos").reset_index(drop=True)
        tree = interior([h.hex() for h in rows["node"]], fan, levels, int(rows["n"].iloc[0]) <= size)
        up = above.iloc[0]
        return emit(rows, ([*way(tree, i, fan)] for i in range(len(rows))), up)

    ups = paths.select("key", F.col("pos").alias("sub"), "path", "subroot", "root")
    return level.groupBy("key", _subtree(fan, levels)).cogroup(ups.groupBy("key", "sub")).applyInPandas(extract, schema)


def _paths(stored: list[DataFrame], tops: DataFrame, fan: int, levels: int) -> DataFrame:
    """Paths of the tops of the lowest subtrees, from ``tops``: key, done, path, subroot, root of each key."""
    kind = tops.schema["key"].dataType.simpleString()

    def emit(rows: pd.DataFrame, ways, up) -> pd.DataFrame:
        own = [_written(w) + up["path"] for w in ways]
        return pd.DataFrame({"key": rows["key"], "pos": rows["pos"], "path": own, "subroot": up["subroot"], "root": up["root"]})

    tops = tops.withColumn("pos", F.lit(0).cast("long"))
    columns = ["key", "pos", "path", "subroot", "root"]
    paths = tops.where(F.col("done") >= len(stored)).select(*columns)
    for k in range(len(stored) - 1, 0, -1):
        lower = _descend(stored[k], paths, fan, levels, emit, f"key {kind}, pos bigint, path string, subroot string, root string")
        ended = F.col("done") == k if k > 1 else F.col("done") <= 1
        paths = cut(lower).unionByName(tops.where(ended).select(*columns))
    if len(stored) == 1:
        paths = tops.select(*columns)
    return paths


def manifest(rows: DataFrame, id_col: str, key: str, original: Column, received: Column, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Leaves, roots, proofs and their check: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``original`` is the leaf digest (see ``leaf``) the tree is built of, ``received`` the one that is checked with the
    original siblings.
    """
    given = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), original.alias("node"), received.alias("got"))
    given = cut(given.withColumn("row", F.monotonically_increasing_id()))
    # Ids travel as text, as pandas has no whole numbers with nulls.
    leaves = cut(ranked(given, ["id", "node", "row"]).select("key", "pos", "n", F.col("id").cast("string").alias("id"), "node", "got"))
    stored, roots = grow(leaves, fan, levels)

    # The tree over the roots has one key; its leaves are the keys' roots.
    heads = roots.select(F.lit(0).alias("key"), F.col("key").alias("name"), "node", "done")
    heads = cut(ranked(heads, ["name"]))
    upper, last = grow(heads, fan, levels)
    crown = last.select("key", "done", F.lit("").alias("path"), F.lower(F.hex("node")).alias("root"), F.lit("").alias("subroot"))
    kind = leaves.schema["key"].dataType.simpleString()

    def tops(rows: pd.DataFrame, ways, up) -> pd.DataFrame:
        own = [_written(w) + up["path"] for w in ways]
        return pd.DataFrame({"key": rows["name"], "done": rows["done"], "path": own, "subroot": [h.hex() for h in rows["node"]], "root": up["root"]})

    named = _descend(heads, _paths(upper, crown, fan, levels), fan, levels, tops, f"key {kind}, done int, path string, subroot string, root string")
    paths = _paths(stored, cut(named), fan, levels)

    def proofs(rows: pd.DataFrame, ways, up) -> pd.DataFrame:
        above = _read(up["path"])
        rest = "".join(others for _, others in above)
        proof, folded = [], []
        for got, own in zip(rows["got"], ways, strict=True):
            proof.append(_digest("".join(others for _, others in own) + rest))
            folded.append(fold(got.hex(), own + above))
        return pd.DataFrame({"id": rows["id"], "leaf": [h.hex() for h in rows["node"]], "subroot": up["subroot"], "root": up["root"], "proof_sha256": proof, "folded_root": folded})

    found = _descend(leaves, paths, fan, levels, proofs, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    back = F.col("id").cast(given.schema["id"].dataType).alias(id_col)
    return found.select(back, *found.columns[1:], (F.col("folded_root") == F.col("root")).alias("verified"))
