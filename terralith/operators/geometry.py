"""Operators that make geometries: hulls, buffers, Voronoi cells, clips, repairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RING, disc, edges, signed_area

_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _ring(points: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def buffer_points(points: DataFrame, distance: Column | float, quadrant: int = 16, x: str = "mx", y: str = "my") -> DataFrame:
    """Points with the disc around each as `ring`."""
    return points.withColumn("ring", disc(F.col(x), F.col(y), distance, quadrant))


def ring_buffers(points: DataFrame, distances: list[float] | None = None, x: str = "mx", y: str = "my") -> DataFrame:
    """Per point and ascending positive distance the disc as `ring` and, but for the first, the disc before as `hole`; the ring's area."""
    ds = sorted({float(d) for d in (distances or [500, 1000, 1500]) if d > 0})
    steps = F.explode(F.array(*[F.struct(F.lit(d).alias("distance"), F.lit(p).cast("double").alias("inner")) for p, d in zip([None, *ds[:-1]], ds, strict=True)]))
    rows = points.withColumn("_s", steps).select(*points.columns, "_s.distance", "_s.inner")
    outer = disc(F.col(x), F.col(y), F.col("distance"), 32)
    hole = F.when(F.col("inner").isNotNull(), disc(F.col(x), F.col(y), F.col("inner"), 32))
    return rows.withColumns({"ring": outer, "hole": hole}).withColumn("area", F.abs(signed_area(F.col("ring"))) - F.coalesce(F.abs(signed_area(F.col("hole"))), F.lit(0.0))).drop("inner")


def buffer_shapes(shapes: DataFrame, distance: float, by: list[str] | None = None, quadrant: int = 8, unit: float = 1e-4) -> DataFrame:
    """fid (or the columns `by`, over whose shapes the buffers are dissolved), ring, holes, area: all within `distance` of each shape (fid, kind, parts; planar).

    kind is point, line or polygon (a shell and holes). A negative distance takes a border off polygons; points and lines
    are then gone, as is a polygon that is thinner. Bends are discs of 4 * quadrant corners. Parts are rectangles along the segments and
    discs at the vertices, united by their noded edges; null and empty shapes give nothing. Without `by`, equal shapes are worked on once.
    """
    from .planar import alike, combine

    if not by:
        same = alike(shapes, "fid", ["kind", "parts"])
        ones = shapes.join(same.where("fid = _one").select("fid"), "fid", "left_semi")
        got = buffer_shapes(ones, distance, ["fid"], quadrant, unit).withColumnRenamed("fid", "_one")
        return same.join(got, "_one").select("fid", "ring", "holes", "area")
    keys = by
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    named = shapes.withColumn("key", key)
    some = named.where(F.size("parts") > 0)
    d = abs(float(distance))
    solid = some.where(F.col("kind") == "polygon").select("key", F.lit(0).alias("layer"), F.col("parts")[0].alias("ring"), F.slice("parts", 2, F.size("parts")).alias("holes"))
    if d == 0:
        bodies = solid
    else:
        some = some if distance > 0 else some.where(F.col("kind") == "polygon")
        parts = some.select("key", "kind", F.explode("parts").alias("p")).where(F.size("p") > 0)
        layer = F.lit(0 if distance > 0 else 1).alias("layer")
        none = F.lit(None).cast(f"array<{RING}>").alias("holes")
        spots = parts.select("key", F.explode("p").alias("q")).distinct().select("key", layer, disc(F.col("q.x"), F.col("q.y"), d, quadrant).alias("ring"), none)
        n = F.size("p")
        open_ = F.zip_with(F.slice("p", 1, n - 1), F.slice("p", 2, n - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
        along = parts.where((F.col("kind") != "point") & (n > 1)).select("key", F.explode(F.when(F.col("kind") == "polygon", edges(F.col("p"))).otherwise(open_)).alias("e")).select("key", "e.*").where("x1 <> x2 OR y1 <> y2").distinct()
        length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
        u, v = (F.col("y1") - F.col("y2")) / length * d, (F.col("x2") - F.col("x1")) / length * d
        corner = lambda i, s: F.struct((F.col(f"x{i}") + s * u).alias("x"), (F.col(f"y{i}") + s * v).alias("y"))
        strips = along.select("key", layer, F.array(corner(1, -1), corner(2, -1), corner(2, 1), corner(1, 1)).alias("ring"), none)
        bodies = solid.unionByName(spots).unionByName(strips)
    got = combine(bodies, "union" if distance >= 0 else "difference", unit)
    return got.join(named.select("key", *keys).dropDuplicates(["key"]), "key").select(*keys, "ring", "holes", "area")


def impact_zones(points: DataFrame, direct: float = 500.0, indirect: float = 1500.0) -> DataFrame:
    """A direct disc and an indirect ring with a hole around each point."""
    return ring_buffers(points, [direct, indirect]).withColumn("zone", F.when(F.col("hole").isNull(), "direct").otherwise("indirect"))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without collinear vertices."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(pts)[:-1] + half(pts[::-1])[:-1])


def convex_hull(points: DataFrame, by: str, x: str = "mx", y: str = "my") -> DataFrame:
    """Hull and area per group; groups without area are left out. Each task first reduces its points of a group to their hull."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            rows = [(k, *p) for k, g in frame.groupby("g", dropna=False) for p in hull(g[["x", "y"]].to_numpy())]
            if rows:
                g, px, py = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, batch.schema.field(0).type), pa.array(px, pa.float64()), pa.array(py, pa.float64())], ["g", "x", "y"])

    def final(key: tuple, table: pa.Table) -> pa.Table:
        h = hull(np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()]))
        rows = [_ring(np.vstack([h, h[:1]]))] if len(h) > 2 else []
        return pa.table({"g": pa.array([key[0].as_py()] * len(rows), table.schema.field("g").type), "ring": pa.array(rows, _RING)})

    kind = points.schema[by].dataType.simpleString()
    flat = points.select(F.col(by).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    got = flat.mapInArrow(partial, f"g {kind}, x double, y double").groupBy("g").applyInArrow(final, f"g {kind}, ring {RING}")
    return got.select(F.col("g").alias(by), "ring", F.abs(signed_area(F.col("ring"))).alias("area"))


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Part of a ring within a convex counter-clockwise ring (open rings of vertices), by half planes."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, s2 = np.roll(out, -1, axis=0), np.roll(side, -1)
        rows: list[np.ndarray] = []
        for p, q, s, t in zip(out, nxt, side, s2, strict=True):
            if s >= 0:
                rows.append(p)
            if s * t < 0:
                rows.append(p + (q - p) * (s / (s - t)))
        out = np.array(rows) if rows else np.zeros((0, 2))
    return out


def _open(points: list[dict]) -> np.ndarray:
    a = np.array([(p["x"], p["y"]) for p in points])
    return a[:-1] if len(a) > 1 and (a[0] == a[-1]).all() else a


def overlay(a: DataFrame, b: DataFrame, how: str = "intersection", cell: float = 0.1) -> DataFrame:
    """aid, bid and the common part of polygons (aid/bid, ring) as `ring`; b's rings must be convex and counter-clockwise.

    difference gives each a with its area outside all b (which must not overlap each other) instead of a ring.
    """
    from .spatial import _cells
    from ..functions.geo import ring_bbox

    def celled(df: DataFrame, name: str) -> DataFrame:
        d = df.select(F.col(name), F.col("ring").alias(f"{name}_ring")).withColumn("_b", ring_bbox(F.col(f"{name}_ring")))
        return d.withColumn("_cx", F.explode(_cells(F.col("_b.x0"), F.col("_b.x1"), cell))).withColumn("_cy", F.explode(_cells(F.col("_b.y0"), F.col("_b.y1"), cell))).drop("_b")

    pairs = celled(a, "aid").join(celled(b, "bid"), ["_cx", "_cy"]).select("aid", "bid", "aid_ring", "bid_ring").dropDuplicates(["aid", "bid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, j, ra, rb in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                got = clip_convex(_open(ra), _open(rb))
                if len(got) > 2:
                    rows.append((i, j, _ring(np.vstack([got, got[:1]]))))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], batch.schema.field(1).type), pa.array(columns[2], _RING)], ["aid", "bid", "ring"])

    ka, kb = a.schema["aid"].dataType.simpleString(), b.schema["bid"].dataType.simpleString()
    common = pairs.mapInArrow(run, f"aid {ka}, bid {kb}, ring {RING}").withColumn("area", F.abs(signed_area(F.col("ring")))).where("area > 0")
    if how == "intersection":
        return common
    if how == "difference":
        left = a.withColumn("whole", F.abs(signed_area(F.col("ring")))).select("aid", "whole").join(common.groupBy("aid").agg(F.sum("area").alias("cut")), "aid", "left")
        return left.select("aid", (F.col("whole") - F.coalesce("cut", F.lit(0.0))).alias("area"))
    raise ValueError(f"unknown overlay {how}")


def voronoi(seeds: DataFrame, box: tuple[float, float, float, float], x: str = "mx", y: str = "my", near: int = 24) -> DataFrame:
    """Voronoi cells of points (fid) within a box, as `ring` and `area`: half planes against the nearest seeds.

    A cell is done when its farthest vertex is nearer than half the distance to the last seed looked at; the others
    are cut again with twice as many neighbours. Seeds at one place share a cell, given to the smallest fid.
    """
    from ..sources.store import materialize
    from .spatial import nearest

    one = materialize(seeds.groupBy(F.col(x).alias("mx"), F.col(y).alias("my")).agg(F.min("fid").alias("fid")), "seeds")
    n = one.count()
    x0, y0, x1, y1 = box

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fids, rings, done = [], [], []
            for fid, px, py, others in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                cell, p = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float), np.array([px, py])
                far = 0.0
                for o in sorted(others, key=lambda o: o["d"]):
                    q, far = np.array([o["x"], o["y"]]), o["d"]
                    middle, normal = (p + q) / 2, q - p
                    side = (cell - middle) @ normal
                    if (side <= 0).all():
                        continue
                    rows = []
                    for a, b, s, t in zip(cell, np.roll(cell, -1, axis=0), side, np.roll(side, -1), strict=True):
                        if s <= 0:
                            rows.append(a)
                        if s * t < 0:
                            rows.append(a + (b - a) * (s / (s - t)))
                    cell = np.array(rows).reshape(-1, 2)
                    if not len(cell):
                        break
                if not len(cell):  # a seed outside the box may have no part of it
                    cell = np.array([p])
                fids.append(fid)
                rings.append(_ring(np.vstack([cell, cell[:1]])))
                done.append(bool(2 * np.hypot(*(cell - p).T).max() <= far) or len(others) >= n - 1)
            yield pa.RecordBatch.from_arrays([pa.array(fids, pa.int64()), pa.array(rings, _RING), pa.array(done)], ["fid", "ring", "done"])

    left, out = one, None
    while True:
        k = min(near, n - 1)
        pairs = nearest(left, one, k, by_self=True).join(one.select(F.col("fid").alias("bid"), F.col("mx").alias("bx"), F.col("my").alias("by")), "bid")
        around = pairs.groupBy(F.col("aid").alias("fid")).agg(F.collect_list(F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), "d")).alias("others"))
        cells = materialize(left.join(around, "fid").select("fid", "mx", "my", "others").mapInArrow(cut, f"fid long, ring {RING}, done boolean"), "cells")
        ready = cells.where("done").select("fid", "ring")
        out = ready if out is None else out.unionAll(ready)
        left = left.join(cells.where("not done").select("fid"), "fid", "left_semi")
        if not left.limit(1).count():
            return out.withColumn("area", F.abs(signed_area(F.col("ring"))))
        near *= 2


def simplify_grid(ring: Column, tolerance: float) -> Column:
    """Vertices on a grid of `tolerance`, repeated neighbours dropped, the ring closed."""
    snapped = F.transform(ring, lambda p: F.struct((F.rint(p["x"] / tolerance) * tolerance).alias("x"), (F.rint(p["y"] / tolerance) * tolerance).alias("y")))
    kept = F.filter(edges(snapped), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    start = F.transform(kept, lambda e: F.struct(e["x1"].alias("x"), e["y1"].alias("y")))
    return F.concat(start, F.slice(start, 1, 1))
