"""Overlays of polygon layers of any simple shape, as convex parts.

A ring is cut into triangles where it is not convex; parts of two layers that share a cell are clipped against each
other by half planes. What a layer keeps outside the other is cut off part by part, so every result is a set of
disjoint convex parts with the ids of the polygons they come from. Parts of one polygon that were one piece of it are
not merged again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RING, ring_bbox, signed_area
from ..sources.store import materialize
from .geometry import _RING, _open, _ring
from .spatial import _cells

#: Area below which a part counts as nothing, in squared units of the layer.
LEAST_AREA = 1e-14


def _area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def _turns(p: np.ndarray) -> np.ndarray:
    """Cross product at each vertex; positive for a left turn."""
    a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def convex_parts(ring: np.ndarray) -> list[np.ndarray]:
    """A simple ring (open, either way round) as convex counter-clockwise parts: itself, or triangles by cutting ears."""
    if len(ring) < 3:
        return []
    p = ring if _area(ring) > 0 else ring[::-1]
    if (_turns(p) >= 0).all():
        return [p] if _area(p) > 0 else []
    left, out = list(range(len(p))), []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            triangle = p[[i, j, m]]
            if _area(triangle) <= 0:
                continue
            others = p[[o for o in left if o not in (i, j, m)]]
            inside = np.ones(len(others), bool)
            for a, b in zip(triangle, np.roll(triangle, -1, axis=0), strict=True):
                inside &= (b[0] - a[0]) * (others[:, 1] - a[1]) - (b[1] - a[1]) * (others[:, 0] - a[0]) >= 0
            if not inside.any():
                out.append(triangle)
                left.pop(k)
                break
        else:  # no ear: a vertex without area is left out
            left.pop(int(np.argmin(np.abs(_turns(p[left])))))
    out.append(p[left])
    return [t for t in out if _area(t) > LEAST_AREA]


def _half(p: np.ndarray, a: np.ndarray, b: np.ndarray, keep: int) -> np.ndarray:
    """The part of a convex ring left (keep 1) or right (keep -1) of the line from a to b."""
    side = keep * ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]))
    rows: list[np.ndarray] = []
    for u, v, s, t in zip(p, np.roll(p, -1, axis=0), side, np.roll(side, -1), strict=True):
        if s >= 0:
            rows.append(u)
        if s * t < 0:
            rows.append(u + (v - u) * (s / (s - t)))
    return np.array(rows).reshape(-1, 2)


def _split(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(what p has within convex q, the convex parts of p outside q)."""
    outside = []
    for a, b in zip(q, np.roll(q, -1, axis=0), strict=True):
        if len(p) < 3:
            break
        off = _half(p, a, b, -1)
        if len(off) > 2 and abs(_area(off)) > LEAST_AREA:
            outside.append(off)
        p = _half(p, a, b, 1)
    return (p if len(p) > 2 and abs(_area(p)) > LEAST_AREA else np.zeros((0, 2))), outside


def _celled(df: DataFrame, name: str, cell: float) -> DataFrame:
    d = df.select(F.col(name), F.col("ring").alias(f"{name}_ring"), ring_bbox(F.col("ring")).alias("_b"))
    return d.withColumn("_cx", F.explode(_cells(F.col("_b.x0"), F.col("_b.x1"), cell))).withColumn("_cy", F.explode(_cells(F.col("_b.y0"), F.col("_b.y1"), cell))).drop("_b")


def _parts_of(pairs: DataFrame, own: str, other: str, outside: bool) -> DataFrame:
    """pairs of one layer's ring with the array of the other's (ids, rings): parts within each, or outside all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, others, rings = [], [], []
            for i, ring, around in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                left = convex_parts(_open(ring)) if ring else []
                for o in around or ():
                    rest = []
                    for p in left:
                        pieces = [p]
                        for q in convex_parts(_open(o["ring"])) if o["ring"] else ():
                            further = []
                            for piece in pieces:
                                inner, off = _split(piece, q)
                                if len(inner) and not outside:
                                    ids.append(i)
                                    others.append(o["id"])
                                    rings.append(_ring(np.vstack([inner, inner[:1]])))
                                further += off
                            pieces = further
                        rest += pieces
                    if outside:
                        left = rest
                if outside:
                    for p in left:
                        ids.append(i)
                        others.append(None)
                        rings.append(_ring(np.vstack([p, p[:1]])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(others, batch.column(2).type.value_type.field("id").type), pa.array(rings, _RING)], [own, other, "ring"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return pairs.select(own, "ring", "around").mapInArrow(run, f"{own} {kinds[own]}, {other} {pairs.schema['around'].dataType.elementType['id'].dataType.simpleString()}, ring {RING}")


def overlay_parts(a: DataFrame, b: DataFrame, how: str = "intersection", cell: float = 0.1) -> DataFrame:
    """aid, bid, ring, area: convex parts of the overlay of a (aid, ring) and b (bid, ring), by how:

    intersection (both ids), difference (a outside b: bid null), identity (a cut by b: both of these), union (identity
    and b outside a) and symmetric_difference (what is outside the other, of either). Polygons of one layer are taken
    not to overlap each other where `outside` areas are wanted of the other.
    """
    pairs = _celled(a, "aid", cell).join(_celled(b, "bid", cell), ["_cx", "_cy"]).select("aid", "aid_ring", "bid", "bid_ring").dropDuplicates(["aid", "bid"])
    of_a = pairs.groupBy("aid").agg(F.collect_list(F.struct(F.col("bid").alias("id"), F.col("bid_ring").alias("ring"))).alias("around"))
    of_b = pairs.groupBy("bid").agg(F.collect_list(F.struct(F.col("aid").alias("id"), F.col("aid_ring").alias("ring"))).alias("around"))
    within = lambda: _parts_of(a.join(of_a, "aid"), "aid", "bid", outside=False)
    only_a = lambda: _parts_of(a.join(of_a, "aid", "left"), "aid", "bid", outside=True)
    only_b = lambda: _parts_of(b.join(of_b, "bid", "left"), "bid", "aid", outside=True).select("aid", "bid", "ring")
    wanted = {"intersection": [within], "difference": [only_a], "identity": [within, only_a], "union": [within, only_a, only_b], "symmetric_difference": [only_a, only_b]}
    if how not in wanted:
        raise ValueError(f"unknown overlay {how}")
    out = None
    for f in wanted[how]:
        out = f() if out is None else out.unionByName(f())
    return out.withColumn("area", F.abs(signed_area(F.col("ring"))))


def baseline(features: DataFrame, area: list[tuple[float, float]], columns: list[str]) -> DataFrame:
    """One row: features (ring) that meet an area, and the means of their numeric columns, 4 places.

    A feature meets the area if it has a part within it, however small, touching borders left aside: two convex parts
    do unless a side of one has the other wholly on or beyond it.
    """
    mask = convex_parts(np.array(area, float))
    x0, y0, x1, y1 = (float(f(p[i] for p in area)) for f, i in ((min, 0), (min, 1), (max, 0), (max, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [any(_overlap(p, q) for p in convex_parts(_open(ring)) for q in mask) for ring in batch.column("ring").to_pylist()]
            yield batch.filter(pa.array(met, pa.bool_())).select(columns)

    box = ring_bbox(F.col("ring"))
    near = features.select("ring", *columns).where((box["x0"] < x1) & (box["x1"] > x0) & (box["y0"] < y1) & (box["y1"] > y0))
    kept = near.mapInArrow(run, near.select(*columns).schema)
    return kept.agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).try_cast("double")), 4).alias(c) for c in columns])


def _overlap(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two convex counter-clockwise rings share more than a border."""
    for one, other in ((p, q), (q, p)):
        for a, b in zip(one, np.roll(one, -1, axis=0), strict=True):
            if ((b[0] - a[0]) * (other[:, 1] - a[1]) - (b[1] - a[1]) * (other[:, 0] - a[0]) <= 0).all():
                return False
    return True
