"""Density clustering of power-change extrema, and the pipeline that leads to it.

The features are the z-scored size of an extremum and a weighted 0/1 presence, so the points lie on two
parallel lines.  That lets counting replace pairs: points that share a cell of one radius on a line are
neighbours of each other, so a cell with enough points is core as a whole, and only the at most two points
of a thinner cell are compared with the cells beside theirs.  Cells then link by their end points.  Work
and rows stay proportional to the number of points however densely they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .lineage import cut
from .sequences import extrema, rolling_change, savgol
from .series import SECOND, Series, fits_one_task, spread_by_key
from .stats import noise_threshold

MIN_POINTS = 3
PRESENCE_WEIGHT = 0.6
MIN_RADIUS = 0.4
RADIUS_SHARE = 0.33


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Least node id of each node's connected component, per key.

    ``edges`` (a, b) must hold both directions.  Each round takes the least label around and then the
    label's own label, so the rounds grow with the logarithm of the longest path in practice.
    """
    labels = cut(nodes.select(*keys, F.col(node).alias("_n"), F.col(node).alias("_l")))
    edges = cut(edges.select(*keys, "a", "b"))
    while not edges.isEmpty():
        around = (
            edges.join(labels.withColumnRenamed("_n", "b"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("_n"))
            .agg(F.min("_l").alias("_m"))
        )
        least = labels.join(around, [*keys, "_n"], "left").withColumn("_m", F.least("_l", "_m"))
        jump = least.select(*keys, F.col("_n").alias("_m"), F.col("_m").alias("_j"))
        step = cut(least.join(jump, [*keys, "_m"], "left").select(*keys, "_n", F.least("_m", "_j").alias("_l"), (F.least("_m", "_j") < F.col("_l")).alias("_moved")))
        labels = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    return labels.select(*keys, F.col("_n").alias(node), F.col("_l").alias("component"))


def _scaled(points: DataFrame, noise: DataFrame, keys: list[str], size: str, presence: str) -> DataFrame:
    """Position ``_u`` in radii along the line, line ``_line`` and reach ``_w`` across lines (in radii)."""
    std = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
    stats = points.groupBy(*keys).agg(F.avg(size).alias("_mean"), std(size).alias("_std"), std(presence).alias("_pstd"))
    radius = F.greatest(F.lit(MIN_RADIUS), F.col("threshold") * RADIUS_SHARE / F.col("_std"))
    apart = PRESENCE_WEIGHT / F.col("_pstd") / F.col("_r")
    scale = stats.join(noise, keys).withColumn("_r", radius).withColumn("_w", F.when(apart <= 1, F.greatest(F.sqrt(1 - apart * apart), F.lit(1e-9))))
    u = (F.col(size) - F.col("_mean")) / F.col("_std") / F.col("_r")
    scale = scale.select(*keys, "_mean", "_std", "_r", "_w")
    placed = points.join(scale, keys) if fits_one_task(points) else spread_by_key(points, scale, keys, "inner")
    out = placed.withColumn("_u", u).withColumn("_line", F.col(presence).cast("int"))
    return out.withColumn("_cell", F.floor("_u")).withColumn("_fine", F.floor(F.col("_u") / F.coalesce(F.col("_w"), F.lit(1.0)))).drop("_mean", "_std", "_r")


def _beside(thin: DataFrame, cell: str) -> DataFrame:
    return thin.withColumn(cell, F.explode(F.sequence(F.col(cell) - 1, F.col(cell) + 1)))


def _meet(thin: DataFrame, points: DataFrame, keys: list[str], idc: str, extra: list[str]) -> DataFrame:
    """Thin points with each point within the radius (themselves included), as (key, id, extra columns)."""
    me = thin.select(*keys, F.col(idc).alias("_me"), F.col("_u").alias("_at"), "_line", "_cell", "_fine", "_w")
    other = points.select(*keys, "_u", F.col("_line").alias("_ol"), F.col("_cell"), F.col("_fine"), *extra)
    same = _beside(me.drop("_fine").withColumnRenamed("_line", "_ol"), "_cell").join(other.drop("_fine"), [*keys, "_ol", "_cell"]).where(F.abs(F.col("_u") - F.col("_at")) <= 1)
    across = _beside(me.drop("_cell").where(F.col("_w").isNotNull()).withColumn("_ol", 1 - F.col("_line")), "_fine").join(other.drop("_cell"), [*keys, "_ol", "_fine"]).where(F.abs(F.col("_u") - F.col("_at")) <= F.col("_w"))
    cols = [*keys, "_me", *extra]
    return same.select(*cols).unionByName(across.select(*cols))


def density_clusters(points: DataFrame, noise: DataFrame, keys: list[str], idc: str, size: str, presence: str) -> DataFrame:
    """Add ``cluster`` (0, 1, .. in order of the first core point's id; noise is -1) per key.

    ``noise`` has the keys and ``threshold``.  A border point joins the first cluster it touches.
    """
    pts = cut(_scaled(points, noise, keys, size, presence))
    spot = [*keys, "_line", "_cell"]
    thin_cells = pts.groupBy(*spot).agg(F.count("*").alias("_n")).where(F.col("_n") < MIN_POINTS).select(*spot, F.lit(True).alias("_thin"))
    thin = pts.join(thin_cells, spot)
    lonely = _meet(thin, pts, keys, idc, []).groupBy(*keys, F.col("_me").alias(idc)).agg((F.count("*") < MIN_POINTS).alias("_alone"))
    border = thin.select(*keys, idc).join(lonely, [*keys, idc]).where("_alone")
    marked = cut(pts.join(border, [*keys, idc], "left").withColumn("_core", F.col("_alone").isNull()).drop("_alone"))

    core = marked.where("_core")
    groups = core.groupBy(*keys, "_line", "_fine", "_w").agg(F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
    along = Window.partitionBy(*keys, "_line").orderBy("_fine")  # one row per occupied cell
    step = F.coalesce((F.col("_lo") - F.lag("_hi").over(along) > 1).cast("long"), F.lit(0))
    chains = groups.withColumn("_step", step).withColumn("_chain", F.sum("_step").over(along) * 2 + F.col("_line")).drop("_step")
    chains = cut(chains)
    zero = _beside(chains.where("_line = 0 AND _w IS NOT NULL").select(*keys, "_w", F.col("_fine"), F.col("_lo").alias("_lo0"), F.col("_hi").alias("_hi0"), F.col("_fine").alias("_f0"), F.col("_chain").alias("a")), "_fine")
    one = chains.where("_line = 1").select(*keys, "_fine", "_lo", "_hi", F.col("_chain").alias("b"))
    touch = F.when(F.col("_fine") == F.col("_f0"), True).when(F.col("_fine") > F.col("_f0"), F.col("_lo") - F.col("_hi0") <= F.col("_w")).otherwise(F.col("_lo0") - F.col("_hi") <= F.col("_w"))
    links = zero.join(one, [*keys, "_fine"]).where(touch).select(*keys, "a", "b").distinct()
    links = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    comp = components(chains.select(*keys, "_chain").distinct(), links, keys, "_chain")

    place = chains.select(*keys, "_line", "_fine", "_chain").join(comp, [*keys, "_chain"])
    core = core.join(place, [*keys, "_line", "_fine"])
    first = core.groupBy(*keys, "component").agg(F.min(idc).alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_first")  # one row per cluster
    numbered = first.withColumn("cluster", (F.row_number().over(order) - 1).cast("int")).drop("_first")
    core = core.join(numbered, [*keys, "component"])
    border = _meet(marked.where(~F.col("_core")), core, keys, idc, ["cluster"]).groupBy(*keys, F.col("_me").alias(idc)).agg(F.min("cluster").alias("cluster"))
    labels = core.select(*keys, idc, "cluster").unionByName(border.select(*keys, idc, "cluster"))
    return points.join(labels, [*keys, idc], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def own_clusters(points: DataFrame, keys: list[str], idc: str) -> DataFrame:
    """Without clustering every point stands for itself."""
    return points.withColumn("cluster", F.col(idc))


def letters(n: Column, places: int = 7) -> Column:
    """Letters of a number from 1 on, as spreadsheet columns are named."""
    out, rest = F.lit(""), n.cast("long")
    for _ in range(places):
        out = F.when(rest > 0, F.concat(F.char(F.lit(65) + (rest - 1) % 26), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0))
    return out


def rank_labels(df: DataFrame, keys: list[str], cluster: str, size: str, presence: str | None = None) -> DataFrame:
    """Clusters with mean size (and presence), lettered A, B, .. Z, AA, AB, .. from the largest mean down."""
    aggs = [F.avg(size).alias("mean_abs")] + ([F.avg(presence).alias("mean_presence")] if presence else [])
    stats = df.groupBy(*keys, cluster).agg(*aggs, F.count("*").alias("members"))
    w = Window.partitionBy(*keys).orderBy(F.desc("mean_abs"), cluster)  # one row per cluster
    return stats.withColumn("label", letters(F.row_number().over(w)))


def smooth_deltas(s: Series, kw: str, noise_factor: float = 2.0, small: bool | None = None) -> tuple[Series, DataFrame]:
    """Five-minute power change, its smoothing, and the noise threshold per key."""
    raw = rolling_change(s, F.col(kw), "delta")
    smooth = savgol(raw, "delta", "smoothed")
    smooth = smooth.with_frame(cut(smooth.frame))
    residual = smooth.frame.withColumn("_res", F.col("delta") - F.col("smoothed"))
    return smooth, noise_threshold(residual, list(s.keys), "_res", noise_factor, small)


def delta_events(minutes: DataFrame, presence: DataFrame, keys: list[str], ts: str, tie: str, kwh: str, flag: str, tolerance_us: int = 1800 * SECOND, noise_factor: float = 2.0) -> DataFrame:
    """Significant power changes with presence, cluster and letter, from minute energy and presence."""
    power = minutes.withColumn("power_kw", F.col(kwh) * 60)
    here = asof_join(power, presence, keys, ts, ts, [flag], tie, defaults={flag: 0}, tolerance_us=tolerance_us)
    s = Series.plan(here, keys, ts, (tie,))
    smooth, noise = smooth_deltas(s, "power_kw", noise_factor, small=not s.chunked)
    noise = cut(noise)
    smooth = smooth.attach(noise.select(*keys, "threshold"))
    peaks = extrema(smooth, "smoothed", "threshold").rows().select(*keys, ts, tie, F.col("smoothed").alias("value"), F.abs("smoothed").alias("size"), "kind", flag)
    peaks = cut(peaks)
    found = density_clusters(peaks, noise, keys, tie, "size", flag)
    letters = rank_labels(found, keys, "cluster", "size", flag).select(*keys, "cluster", "mean_abs", "mean_presence", "label")
    return found.join(letters, [*keys, "cluster"])
