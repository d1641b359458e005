"""Spatial joins between points, lines and polygons by any predicate of their interiors, boundaries and exteriors.

A shape is (kind, parts): `point` with its points as parts of one place each, `line` with its lines, `polygon` with a
shell and holes. Boxes meet by cells of the larger one's own size (a power of two), and a pair is told in one cell
only, that of the lower left corner that the two boxes have in common. The pair is then related by segments: the
edges of each are cut where they meet the other's, and the pieces' middles lie in, on or outside of it.
Null and empty shapes meet nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREDICATES = ("intersects", "within", "contains", "touches", "crosses", "overlaps", "equals")
_DIMENSION = {"point": 0, "line": 1, "polygon": 2}
TOLERANCE = 1e-9


def _signed(p: np.ndarray) -> float:
    q = p - p[0]
    return float(q[:, 0] @ np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) @ q[:, 1])


class Shape:
    """Segments (x1, y1, x2, y2), a polygon's with its interior on their left, or places."""

    def __init__(self, kind: str, parts: list[np.ndarray]):
        self.dimension = _DIMENSION[kind]
        self.places, self.ends = np.zeros((0, 2)), np.zeros((0, 2))
        segments = []
        if kind == "point":
            self.places = np.unique(np.vstack(parts), axis=0)
        elif kind == "line":
            segments = [np.hstack([p[:-1], p[1:]]) for p in parts if len(p) > 1]
            ends, times = np.unique(np.vstack([p[[0, -1]] for p in parts if len(p) > 1] or [self.ends]), axis=0, return_counts=True)
            self.ends = ends[times % 2 == 1]
        else:
            for i, p in enumerate(parts):
                p = p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p
                if len(p) > 2:
                    p = p if (_signed(p) > 0) == (i == 0) else p[::-1]
                    segments.append(np.hstack([p, np.roll(p, -1, axis=0)]))
        s = np.vstack(segments) if segments else np.zeros((0, 4))
        self.segments = s[(s[:, :2] != s[:, 2:]).any(axis=1)]
        self.empty = not len(self.segments) and not len(self.places)

    def distances(self, p: np.ndarray) -> np.ndarray:
        """From each place to each segment."""
        a, d = self.segments[:, :2], self.segments[:, 2:] - self.segments[:, :2]
        w = p[:, None] - a
        t = np.clip((w * d).sum(axis=2) / (d * d).sum(axis=1), 0, 1)
        return np.hypot(*np.moveaxis(w - t[:, :, None] * d, 2, 0))

    def locate(self, p: np.ndarray) -> np.ndarray:
        """0 outside, 1 on (a polygon's boundary, a line, a place), 2 within a polygon."""
        if not len(p):
            return np.zeros(0, np.int8)
        if self.dimension == 0:
            return (np.hypot(*np.moveaxis(p[:, None] - self.places, 2, 0)) <= TOLERANCE).any(axis=1).astype(np.int8)
        on = (self.distances(p) <= TOLERANCE).any(axis=1)
        if self.dimension == 1:
            return on.astype(np.int8)
        x1, y1, x2, y2 = self.segments.T
        x, y = p[:, :1], p[:, 1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        return np.where(on, 1, np.where(crossed.sum(axis=1) % 2 == 1, 2, 0)).astype(np.int8)

    def is_end(self, p: np.ndarray) -> np.ndarray:
        return (np.hypot(*np.moveaxis(p[:, None] - self.ends, 2, 0)) <= TOLERANCE).any(axis=1) if len(self.ends) else np.zeros(len(p), bool)


def _pieces(a: Shape, b: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(middles, directions) of a's segments cut where b's meet them, and the places where they meet."""
    p, d = a.segments[:, :2], a.segments[:, 2:] - a.segments[:, :2]
    q, e = b.segments[:, :2], b.segments[:, 2:] - b.segments[:, :2]
    w = q[None] - p[:, None]
    across = d[:, None, 0] * e[None, :, 1] - d[:, None, 1] * e[None, :, 0]
    scale = np.hypot(*d.T)[:, None] * np.hypot(*e.T)[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[:, :, 0] * e[None, :, 1] - w[:, :, 1] * e[None, :, 0]) / across
        u = (w[:, :, 0] * d[:, None, 1] - w[:, :, 1] * d[:, None, 0]) / across
    cut = (np.abs(across) > 1e-12 * scale) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
    which, other = np.nonzero(cut)
    where = t[which, other]
    ends = np.vstack([q, q + e])
    touching, end = np.nonzero(a.distances(ends).T <= TOLERANCE)  # ends of b that lie on a's segments
    along = ((ends[end] - p[touching]) * d[touching]).sum(axis=1) / (d[touching] ** 2).sum(axis=1)
    rows = np.concatenate([which, touching, np.arange(len(p)), np.arange(len(p))])
    at = np.concatenate([where, np.clip(along, 0, 1), np.zeros(len(p)), np.ones(len(p))])
    order = np.lexsort((at, rows))
    rows, at = rows[order], at[order]
    same = (rows[1:] == rows[:-1]) & ((at[1:] - at[:-1]) * np.hypot(*d.T)[rows[1:]] > 2 * TOLERANCE)
    middles = p[rows[1:][same]] + ((at[1:] + at[:-1]) / 2)[same][:, None] * d[rows[1:][same]]
    own = np.vstack([p, p + d])
    met = np.vstack([p[which] + where[:, None] * d[which], ends[end], own[(b.distances(own) <= TOLERANCE).any(axis=1)]])
    return middles, d[rows[1:][same]], met


@dataclass
class Relation:
    """Which meet: interiors, a's interior and b's outside, a's outside and b's interior; anything at all; and whether interiors meet in single places only."""

    ii: bool
    ie: bool
    ei: bool
    contact: bool
    in_places: bool = False

    def turned(self) -> Relation:
        return Relation(self.ii, self.ei, self.ie, self.contact, self.in_places)


def relate(a: Shape, b: Shape) -> Relation:
    if a.empty or b.empty:
        return Relation(False, not a.empty, not b.empty, False)
    if a.dimension > b.dimension:
        return relate(b, a).turned()
    if a.dimension == 0:
        found = b.locate(a.places)
        inner = found == 2 if b.dimension == 2 else (found == 1) & ~b.is_end(a.places)
        beyond = b.dimension > 0 or bool((a.locate(b.places) == 0).any())
        return Relation(bool(inner.any()), bool((found == 0).any()), beyond, bool((found > 0).any()), True)
    middles, way, met = _pieces(a, b)
    found = b.locate(middles)
    if b.dimension == 1:
        back, _, _ = _pieces(b, a)
        shared = bool((found == 1).any())
        crossing = bool((~a.is_end(met) & ~b.is_end(met)).any()) if len(met) else False
        return Relation(shared or crossing, bool((found == 0).any()), bool((a.locate(back) == 0).any()), shared or len(met) > 0, not shared)
    if a.dimension == 1:
        return Relation(bool((found == 2).any()), bool((found == 0).any()), True, bool((found > 0).any()) or len(met) > 0)
    back, _, _ = _pieces(b, a)
    other = a.locate(back)
    on = found == 1
    edge = b.segments[np.argmin(b.distances(middles[on]), axis=1)] if on.any() else np.zeros((0, 4))
    along = (way[on] * (edge[:, 2:] - edge[:, :2])).sum(axis=1) > 0
    ii = bool((found == 2).any() or (other == 2).any() or along.any())
    ie = bool((found == 0).any() or (other == 2).any() or (~along).any())
    ei = bool((other == 0).any() or (found == 2).any() or (~along).any())
    return Relation(ii, ie, ei, ii or bool(on.any()) or len(met) > 0)


def holds(predicate: str, r: Relation, da: int, db: int) -> bool:
    """A predicate of shapes of dimensions da and db, in the usual sense (contains and within need interiors that meet)."""
    match predicate:
        case "intersects":
            return r.contact
        case "within":
            return r.ii and not r.ie
        case "contains":
            return r.ii and not r.ei
        case "touches":
            return r.contact and not r.ii and (da > 0 or db > 0)
        case "equals":
            return r.ii and not r.ie and not r.ei and da == db
        case "overlaps":
            return da == db and r.ii and r.ie and r.ei and not (da == 1 and r.in_places)
        case "crosses":
            if da == db:
                return da == 1 and r.ii and r.in_places
            return r.ii and (r.ie if da < db else r.ei)
    raise ValueError(f"unknown predicate {predicate}; there are {', '.join(PREDICATES)}")


def _boxed(shapes: DataFrame, name: str) -> DataFrame:
    flat = F.flatten("parts")
    side = lambda k, f: f(F.transform(flat, lambda p: p[k]))
    boxed = shapes.select(F.col("fid").alias(f"{name}id"), F.col("kind").alias(f"{name}kind"), F.col("parts").alias(f"{name}parts"), *(side(k, f).alias(f"{name}{k}{i}") for k in "xy" for i, f in ((0, F.array_min), (1, F.array_max))))
    size = F.greatest(F.col(f"{name}x1") - F.col(f"{name}x0"), F.col(f"{name}y1") - F.col(f"{name}y0"))
    return boxed.where(f"{name}x0 IS NOT NULL").withColumn(f"{name}level", F.when(size > 0, F.greatest(F.lit(-40), F.ceil(F.log2(size)))).otherwise(-40).cast("int"))


def _dealt(boxed: DataFrame, name: str, level: Column) -> DataFrame:
    size = F.pow(F.lit(2.0), level)
    cells = lambda k: F.explode(F.sequence(F.floor(F.col(f"{name}{k}0") / size), F.floor(F.col(f"{name}{k}1") / size)))
    return boxed.withColumn("level", level).withColumn("cx", cells("x")).withColumn("cy", cells("y"))


def shape_join(a: DataFrame, b: DataFrame, predicate: str = "intersects", how: str = "inner") -> DataFrame:
    """aid, bid of shapes (fid, kind, parts) for which `predicate` holds from a to b; left, right and full keep those without a partner, beside null.

    fid is unique in each table.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate {predicate}; there are {', '.join(PREDICATES)}")
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join {how}")
    left, right = _boxed(a, "a"), _boxed(b, "b")
    levels = lambda df, name: [r[0] for r in df.select(f"{name}level").distinct().collect()]  # noqa: E731  a few dozen at most
    la, lb = levels(left, "a"), levels(right, "b")

    def above(boxed: DataFrame, name: str, other: list[int], strictly: bool) -> DataFrame:
        known = F.array(*map(F.lit, other)).cast("array<int>")
        up = F.filter(known, lambda k: k > F.col(f"{name}level") if strictly else k >= F.col(f"{name}level"))
        return _dealt(boxed.withColumn("up", F.explode(up)), name, F.col("up")).drop("up")

    size = F.pow(F.lit(2.0), F.col("level"))
    first = lambda k: F.floor(F.greatest(F.col(f"a{k}0"), F.col(f"b{k}0")) / size)
    test = "ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1"
    keys = ["level", "cx", "cy"]
    small_a = above(left, "a", lb, False).join(_dealt(right, "b", F.col("blevel")), keys)
    small_b = _dealt(left, "a", F.col("alevel")).join(above(right, "b", la, True), keys)
    columns = ["aid", "akind", "aparts", "bid", "bkind", "bparts"]
    near = small_a.select(*columns, *keys, "ax0", "ay0", "bx0", "by0", "ax1", "ay1", "bx1", "by1").unionByName(small_b.select(*columns, *keys, "ax0", "ay0", "bx0", "by0", "ax1", "ay1", "bx1", "by1"))
    near = near.where(test).where((F.col("cx") == first("x")) & (F.col("cy") == first("y"))).select(*columns)
    kinds = {c: near.schema[c].dataType.simpleString() for c in ("aid", "bid")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ak, ap, bk, bp in zip(*(batch.column(c).to_pylist() for c in ("akind", "aparts", "bkind", "bparts")), strict=True):
                shapes = [Shape(kind, [np.array([(q["x"], q["y"]) for q in p], np.float64) for p in parts if p]) for kind, parts in ((ak, ap), (bk, bp))]
                keep.append(holds(predicate, relate(*shapes), shapes[0].dimension, shapes[1].dimension))
            yield batch.select(["aid", "bid"]).filter(pa.array(keep, pa.bool_()))

    pairs = near.mapInArrow(run, f"aid {kinds['aid']}, bid {kinds['bid']}")
    if how in ("left", "full"):
        pairs = a.select(F.col("fid").alias("aid")).join(pairs, "aid", "left")
    if how in ("right", "full"):
        pairs = pairs.join(b.select(F.col("fid").alias("bid")), "bid", "full" if how == "full" else "right")
    return pairs.select("aid", "bid")
