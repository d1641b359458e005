"""DBSCAN in space and in space-time, and k-means, as joins and aggregations."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize
from .relational import with_position
from .spatial import places, within_distance


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex that each vertex of (src, dst) reaches.

    Each round a vertex and its label take the least label's label around the vertex, so labels move by whole trees.
    """
    both = materialize(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    found = materialize(both.groupBy(F.col("src").alias("v")).agg(F.least(F.min("dst"), F.col("v")).alias("root"), F.lit(None).cast(both.schema["src"].dataType).alias("old")), "labels")
    while True:
        up = found.select(F.col("v").alias("root"), F.col("root").alias("up"))
        labels = materialize(found.join(up, "root").select("v", "root", "up", "old"), "jumped")
        if not labels.where("old IS NULL OR up <> old").limit(1).count():
            return labels.select("v", "root")
        near = both.join(labels, both["dst"] == labels["v"]).groupBy(F.col("src").alias("v")).agg(F.min("up").alias("near"))
        step = labels.drop("old").join(near, "v").select(F.explode(F.array(F.struct("v", F.least("root", "up", "near").alias("root"), F.col("up").alias("old")), F.struct(F.col("root").alias("v"), F.col("near").alias("root"), F.lit(None).alias("old")))).alias("s"))
        found = materialize(step.groupBy("s.v").agg(F.min("s.root").alias("root"), F.max("s.old").alias("old")), "labels")


#: Cells are this many times smaller than the radius (a little over the root of 5), and than the time between neighbours.
SIDE, TICK = 2.2361, 2.0001
#: Rows that are sent to every task.
FEW = 20_000


def _beside(a: DataFrame, b: DataFrame, axes: list[str], offsets: Iterable[tuple[int, ...]]) -> DataFrame:
    """a's rows with those of b (columns b_...) whose cell lies at one of the offsets from theirs."""
    steps = F.array(*[F.struct(*[F.lit(k).cast("long").alias(c) for c, k in zip(axes, each, strict=True)]) for each in offsets])
    moved = a.withColumn("_o", F.explode(steps)).withColumns({f"b_{c}": F.col(c) + F.col(f"_o.{c}") for c in axes}).drop("_o")
    return moved.join(b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]), [f"b_{c}" for c in axes])


def _relabel(cells: DataFrame, links: DataFrame) -> DataFrame:
    """cells with the smallest root that theirs is linked with by links (src, dst)."""
    up = components(links).select(F.col("v").alias("root"), F.col("root").alias("_up"))
    return materialize(cells.join(up, "root", "left").withColumn("root", F.coalesce("_up", "root")).drop("_up"), "cores")


def _join_far(cores: DataFrame, spots: Callable[[DataFrame], DataFrame], by: list[str], axes: list[str], eps: float, lag: float) -> DataFrame:
    """cores (axes, root) with the roots joined of cells, side by side or not, that hold neighbours; spots: the core places in given cells.

    Of cells with different roots that are near enough, the outermost places are compared first, as most links show there;
    every place only where this leaves two roots.
    """
    parts = cores.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(2).collect()
    if len(parts) < 2:
        return cores
    most = F.lit(parts[0]["root"])
    plane = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if math.hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0)) <= SIDE]
    offsets = plane if len(axes) == 2 else [(*p, k) for p in plane for k in range(-3, 4)]
    sided = cores.select(*axes, "root")
    pairs = materialize(_beside(sided.where(F.col("root") != most), sided, axes, offsets).where((F.col("root") != F.col("b_root")) & ((F.col("b_root") == most) | (F.col("root") < F.col("b_root")))), "pairs")
    seen = pairs.select(*axes).unionAll(pairs.select(*[F.col(f"b_{c}").alias(c) for c in axes])).distinct()
    held = materialize(spots(seen).select(*by, *axes).distinct(), "spots")
    bounds = {c: F.col(c) for c in by} | {"_d": F.col("mx") + F.col("my"), "_e": F.col("mx") - F.col("my")}
    outer = [f(F.struct(*by), c) for c in bounds.values() for f in (F.min_by, F.max_by)]
    ends = materialize(held.groupBy(*axes).agg(F.array(*outer).alias("outer"), F.struct(*[F.min(c).alias(c) for c in by]).alias("low"), F.struct(*[F.max(c).alias(c) for c in by]).alias("high")), "ends")

    def near(gap: dict[str, Column], slack: float = 1.0) -> Column:
        test = F.hypot(gap["mx"], gap["my"]) <= eps * slack
        return test & (F.abs(gap["ts"]) <= lag * slack) if "ts" in gap else test

    zero = F.lit(0.0)
    apart = {c: F.greatest(F.col(f"low.{c}") - F.col(f"b_high.{c}"), F.col(f"b_low.{c}") - F.col(f"high.{c}"), zero) for c in by}
    other = ends.select(*[F.col(c).alias(f"b_{c}") for c in ends.columns])
    shown = F.exists("outer", lambda p: F.exists("b_outer", lambda q: near({c: p[c] - q[c] for c in by})))
    tested = pairs.join(ends, axes).join(other, [f"b_{c}" for c in axes]).where(near(apart, 1 + 1e-9)).withColumn("shown", shown)
    tested = materialize(tested.drop("outer", "b_outer"), "tested")
    cores = _relabel(cores, tested.where("shown").select(F.col("root").alias("src"), F.col("b_root").alias("dst")).distinct())
    now = cores.select(*axes, "root")
    left = tested.where("NOT shown").drop("root", "b_root").join(now, axes).join(now.select(*[F.col(c).alias(f"b_{c}") for c in now.columns]), [f"b_{c}" for c in axes])
    left = materialize(left.where("root <> b_root"), "left")
    if not left.limit(1).count():
        return cores
    beyond = {c: F.greatest(F.col(c) - F.col(f"b_high.{c}"), F.col(f"b_low.{c}") - F.col(c), zero) for c in by}
    some = left.join(held, axes).where(near(beyond, 1 + 1e-9)).join(held.select(*[F.col(c).alias(f"b_{c}") for c in held.columns]), [f"b_{c}" for c in axes])
    return _relabel(cores, some.where(near({c: F.col(c) - F.col(f"b_{c}") for c in by})).select(F.col("root").alias("src"), F.col("b_root").alias("dst")).distinct())


def _clusters(points: DataFrame, eps: float, min_samples: int, lag: float | None = None) -> DataFrame:
    """fid, mx, my[, ts], cluster (from 0 by first core point; noise -1), is_core: neighbours are within eps and, with lag, as near in ts.

    Points of a cell are neighbours, and so are those of cells side by side, one after the other, or both. Where such cells
    hold min_samples, all points are core points and no pair is made; the places of other cells look for theirs. Core cells
    side by side or one after the other are one cluster; only cells that this leaves apart are compared by their places. Last,
    places of cells that are not full look for a core.
    """
    by = ["mx", "my"] + (["ts"] if lag is not None else [])
    cell = {"cx": F.floor(F.col("mx") / (eps / SIDE)), "cy": F.floor(F.col("my") / (eps / SIDE))}
    if lag is not None:
        cell["ct"] = F.floor(F.col("ts") / (lag / TICK))
    axes = list(cell)
    sound = functools.reduce(operator.and_, [F.abs(c) < F.lit(1e300) for c in by])  # what is null or no number has no neighbours
    points = materialize(points.select("fid", *by).withColumns({c: F.when(sound, v) for c, v in cell.items()}), "points")
    placed = points.where("cx IS NOT NULL")

    def near(many: DataFrame, few: DataFrame) -> DataFrame:
        return within_distance(many, few, eps, lag=None if lag is None else ("ts", lag), few=few.count() <= FEW)

    cells = materialize(placed.groupBy(*axes).agg(F.count("*").alias("n"), F.min("fid").alias("first")), "cells")
    cross = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    sure = cross if lag is None else [(*p, k) for p in cross for k in (-1, 0, 1)]
    around = _beside(cells.where(F.col("n") < min_samples).select(*axes), cells.select(*axes, "n"), axes, sure).groupBy(*axes).agg(F.sum("b_n").alias("around"))
    cells = materialize(cells.join(around, axes, "left").select(*axes, "first", (F.coalesce("around", "n") >= min_samples).alias("full")), "cells")
    some = materialize(places(placed.join(cells.where("NOT full").select(*axes), axes, "left_semi"), [*by, *axes]), "some")
    enough = near(placed.select("fid", *by), some.select("fid", *by)).groupBy("bid").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples)
    lone = materialize(some.join(enough, some["fid"] == enough["bid"], "left_semi").select("fid", *by, *axes), "lone")
    cores = cells.where("full").unionAll(lone.groupBy(*axes).agg(F.min("fid").alias("first"), F.lit(False).alias("full")).select(*axes, "first", "full"))
    # cells one after the other along the last axis are one vertex of the graph
    *rest, last = axes
    row = Window.partitionBy(*rest).orderBy(last)
    runs = cores.withColumn("_new", F.when(F.col(last) - F.lag(last).over(row) == 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(row))
    cores = materialize(runs.select(*axes, "full", F.min("first").over(Window.partitionBy(*rest, "_run")).alias("root")), "cores")
    steps = [tuple(int(c == d) for d in axes) for c in rest]
    links = _beside(cores.select(*axes, "root"), cores.select(*axes, "root"), axes, steps).select(F.col("root").alias("src"), F.col("b_root").alias("dst")).distinct()
    cores = _relabel(cores, links)

    def spots(seen: DataFrame) -> DataFrame:
        whole = placed.join(cells.where("full").join(seen, axes, "left_semi").select(*axes), axes, "left_semi").select(*by, *axes)
        return whole.unionAll(lone.join(seen, axes, "left_semi").select(*by, *axes))

    cores = _join_far(cores, spots, by, axes, eps, lag)
    numbers = with_position(cores.select("root").distinct(), [F.col("root")], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    numbered = materialize(cores.join(numbers, "root").select(*axes, "full", "cluster"), "numbered")
    whole = numbered.where("full").select(*axes, "cluster")
    sure_points = placed.join(whole, axes).select("fid", *by, "cluster")
    lone_cores = lone.join(numbered, axes).select("fid", *by, "cluster")
    other = materialize(some.join(lone.select("fid"), "fid", "left_anti").select("fid", *by), "other")
    border = near(sure_points.unionAll(lone_cores), other).groupBy("bid").agg(F.min("a_cluster").alias("cluster"))
    found = lone_cores.select(*by, "cluster", F.lit(True).alias("is_core")).unionAll(other.join(border, other["fid"] == border["bid"]).select(*by, "cluster", F.lit(False)))
    loose = points.join(whole, axes, "left_anti").join(found, by, "left").select("fid", *by, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
    return sure_points.withColumn("is_core", F.lit(True)).unionAll(loose)


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """points (fid, mx, my). A border point joins the lowest-numbered cluster that has a core point within eps."""
    return _clusters(points, eps, min_samples).select("fid", "cluster", "is_core")


def st_dbscan(points: DataFrame, eps_m: float, eps_s: float, min_samples: int) -> DataFrame:
    """points (fid, mx, my, ts in seconds): neighbours are within eps_m metres and eps_s seconds."""
    return _clusters(points, eps_m, min_samples, eps_s).select("fid", "cluster", "is_core")


def kmeans(points: DataFrame, k: int, features: list[str], seed: int = 42, rounds: int = 20) -> DataFrame:
    """fid, cluster: Spark's k-means over the columns, k clamped to the number of points; clusters numbered by their smallest fid."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    n = points.limit(k).count()
    data = VectorAssembler(inputCols=features, outputCol="features").transform(points.select("fid", *features))
    got = KMeans(k=max(2, min(k, n)), seed=seed, maxIter=rounds).fit(data).transform(data).select("fid", "prediction")
    order = got.groupBy("prediction").agg(F.min("fid").alias("first")).withColumn("cluster", F.row_number().over(Window.orderBy("first")) - 1)  # k rows
    return got.join(F.broadcast(order), "prediction").select("fid", "cluster")


def space_time_hotspots(points: DataFrame, eps_m: float = 1000.0, eps_s: float = 3600.0, min_samples: int = 5) -> DataFrame:
    """cluster, n, mx, my, first, last: the clusters of st_dbscan with their centres and time spans."""
    got = _clusters(points, eps_m, min_samples, eps_s).where("cluster >= 0")
    return got.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("mx").alias("mx"), F.avg("my").alias("my"), F.min("ts").alias("first"), F.max("ts").alias("last"))
