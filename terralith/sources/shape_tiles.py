"""Vector tiles (MVT 2.1) of lines and polygons: clipped, brought to whole tile units, encoded.

Features have fid and `parts`, an array of arrays of (x, y) in degrees: the lines of a line feature, or a polygon's
shell and holes. Longitudes that jump by more than 180 degrees go on across the antimeridian; what reaches beyond the map
comes in again at its other side. A feature goes down the tile pyramid by clipping to the four tiles below, so only
tiles that it meets are made, and a large one is dealt out again half way down. A tile keeps `BUFFER` units around
it. Lines are cut by Liang-Barsky, rings by Sutherland-Hodgman. Rings without area and lines of one place vanish from a tile;
features that look the same in it are one (the smallest fid). So a tile is bounded by what can be told apart in
it. Null and empty parts give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_tiles import EXTENT, _varint, _zigzag, encode_layer

BUFFER = 64
_PIECE = "array<array<struct<x:double,y:double>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def clip_line(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """The stretches of a polyline within a box."""
    if len(p) < 2:
        return []
    a, d = p[:-1], np.diff(p, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        enter, leave = (low - a) / d, (high - a) / d
    enter, leave = np.where(d < 0, leave, enter), np.where(d < 0, enter, leave)
    flat, within = d == 0, (a >= low) & (a <= high)
    enter[flat], leave[flat] = np.where(within, -np.inf, np.inf)[flat], np.where(within, np.inf, -np.inf)[flat]
    t0, t1 = np.maximum(enter.max(axis=1), 0.0), np.minimum(leave.min(axis=1), 1.0)
    out: list[list[np.ndarray]] = []
    open_ = False
    for i in np.flatnonzero(t0 <= t1):
        if not (open_ and t0[i] == 0 and i == last + 1):  # noqa: F821
            out.append([a[i] + t0[i] * d[i]])
        out[-1].append(p[i + 1] if t1[i] == 1 else a[i] + t1[i] * d[i])
        open_, last = t1[i] == 1, i
    return [np.array(x) for x in out]


def clip_ring(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An open ring within a box."""
    for axis in (0, 1):
        for bound, side in ((low[axis], 1), (high[axis], -1)):
            if not len(p):
                return p
            s = side * (p[:, axis] - bound)
            q, t = np.roll(p, -1, axis=0), np.roll(s, -1)
            crossed = s * t < 0
            cut = p + (q - p) * np.where(crossed, s / np.where(crossed, s - t, 1), 0)[:, None]
            cut[:, axis] = np.where(crossed, bound, cut[:, axis])
            p = np.stack([p, cut], axis=1).reshape(-1, 2)[np.stack([s >= 0, crossed], axis=1).ravel()]
    return p


def _clipped(parts: list[np.ndarray], polygon: bool, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    if not polygon:
        return [x for p in parts for x in clip_line(p, low, high)]
    shell = clip_ring(parts[0], low, high)
    return [] if len(shell) < 3 else [shell, *(h for p in parts[1:] if len(h := clip_ring(p, low, high)) > 2)]


def _area(p: np.ndarray) -> float:
    return float(p[:, 0] @ np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) @ p[:, 1]) / 2


def quantised(parts: list[np.ndarray], polygon: bool, z: int, tx: int, ty: int) -> list[np.ndarray]:
    """Parts in whole tile units; shells clockwise as seen on the map (positive area with y down), holes the other way."""
    out = []
    for i, p in enumerate(parts):
        q = np.rint((p * (1 << z) - (tx, ty)) * EXTENT).astype(np.int64)
        q = q[np.append(True, (np.diff(q, axis=0) != 0).any(axis=1))]
        if polygon:
            q = q[:-1] if len(q) > 1 and (q[0] == q[-1]).all() else q
            size = _area(q) if len(q) > 2 else 0
            if size == 0:
                if i == 0:
                    return []
                continue
            q = q if (size > 0) == (i == 0) else q[::-1]
        elif len(q) < 2:
            continue
        out.append(q)
    return out


def commands(parts: list[np.ndarray], polygon: bool) -> bytes:
    """MoveTo, LineTo and ClosePath with steps from the place before."""
    out, x, y = bytearray(), 0, 0
    for p in parts:
        for i, (px, py) in enumerate(p.tolist()):
            if i < 2:
                out += _varint(1 << 3 | 1 if i == 0 else (len(p) - 1) << 3 | 2)
            out += _varint(_zigzag(px - x)) + _varint(_zigzag(py - y))
            x, y = px, py
        if polygon:
            out += _varint(1 << 3 | 7)
    return bytes(out)


def _descend(polygon: bool, zooms: list[int], start: int, stop: int):
    """Pieces (fid, tx, ty, parts) at zoom `start` to their pieces at the zooms up to `stop`; parts are in units of the world."""
    margin = BUFFER / EXTENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            values = [pa.array([r[i] for r in rows], k) for i, k in enumerate((batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(_POINT))))]
            rows.clear()
            return pa.RecordBatch.from_arrays(values, ["fid", "z", "tx", "ty", "parts"])

        for batch in batches:
            for fid, tx, ty, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                todo = [(start, tx, ty, [np.array([(q["x"], q["y"]) for q in p]) for p in parts if p])]
                while todo:
                    z, tx, ty, p = todo.pop()
                    low, high = (np.array([tx, ty]) - margin) / (1 << z), (np.array([tx + 1, ty + 1]) + margin) / (1 << z)
                    p = _clipped(p, polygon, low, high) if p else []
                    if not p:
                        continue
                    if z in zooms or z == stop:
                        rows.append((fid, z, tx, ty, [[{"x": a, "y": b} for a, b in q.tolist()] for q in p]))
                    if z < stop:
                        todo += [(z + 1, 2 * tx + i, 2 * ty + j, p) for i in (0, 1) for j in (0, 1)]
                    if len(rows) >= 512:
                        yield packed()
            if rows:
                yield packed()

    return run


def shape_pieces(features: DataFrame, zooms: list[int], polygon: bool) -> DataFrame:
    """fid, z, tx, ty, parts: each feature clipped to each tile it meets, parts in units of the world (0 to 1, y down)."""
    kind = features.schema["fid"].dataType.simpleString()
    ddl = f"fid {kind}, z int, tx long, ty long, parts {_PIECE}"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shifts, out = [], [], []
            for fid, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                world, first = [], None
                for part in parts or ():
                    p = np.array([(q["x"], q["y"]) for q in part or ()], np.float64).reshape(-1, 2)
                    p = p[np.isfinite(p).all(axis=1)]
                    p = p[:-1] if polygon and len(p) > 1 and (p[0] == p[-1]).all() else p
                    if len(p) < (3 if polygon else 2):
                        if polygon and not world:
                            break
                        continue
                    x = p[0, 0] + np.append(0.0, np.cumsum((np.diff(p[:, 0]) + 180.0) % 360.0 - 180.0)) if (np.abs(np.diff(p[:, 0])) > 180).any() else p[:, 0]
                    first = x[0] if first is None else first
                    x = x + 360.0 * np.rint((first - x[0]) / 360.0) if polygon else x  # a hole lies with its shell
                    y = np.radians(np.clip(p[:, 1], -85.0511287798066, 85.0511287798066))
                    world.append(np.stack([x / 360.0 + 0.5, 0.5 - np.log(np.tan(np.pi / 4 + y / 2)) / (2 * np.pi)], axis=1))
                if not world:
                    continue
                for shift in (-1.0, 0.0, 1.0):
                    if min(p[:, 0].min() for p in world) + shift <= 1 + BUFFER / EXTENT and max(p[:, 0].max() for p in world) + shift >= -BUFFER / EXTENT:
                        ids.append(fid)
                        shifts.append(0)
                        out.append([[{"x": a + shift, "y": b} for a, b in p.tolist()] for p in world])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(shifts, pa.int64()), pa.array(shifts, pa.int64()), pa.array(out, pa.list_(pa.list_(_POINT)))], ["fid", "tx", "ty", "parts"])

    deepest = max(zooms)
    half = max(0, deepest - 4)
    world = features.select("fid", "parts").mapInArrow(placed, f"fid {kind}, tx long, ty long, parts {_PIECE}")
    upper = world.mapInArrow(_descend(polygon, zooms, 0, half), ddl)
    if half == 0:
        lower = world.mapInArrow(_descend(polygon, zooms, 0, deepest), ddl)
        return lower
    again = upper.where(F.col("z") == half).repartition("fid", "tx", "ty").select("fid", "tx", "ty", "parts").mapInArrow(_descend(polygon, zooms, half, deepest), ddl)
    return upper.where((F.col("z") < half) & F.col("z").isin(zooms)).unionAll(again)


def tile_parts(features: DataFrame, zooms: list[int], polygon: bool) -> DataFrame:
    """fid, z, tx, ty, parts (array of arrays of whole tile units), shape (the MVT commands)."""
    pieces = shape_pieces(features, zooms, polygon)
    kind = features.schema["fid"].dataType.simpleString()
    unit = pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, parts, shapes = [], [], []
            for i, (z, tx, ty, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("z", "tx", "ty", "parts")), strict=True)):
                got = quantised([np.array([(q["x"], q["y"]) for q in p]) for p in raw], polygon, z, tx, ty)
                if got:
                    keep.append(i)
                    parts.append([[{"x": a, "y": b} for a, b in p.tolist()] for p in got])
                    shapes.append(commands(got, polygon))
            some = batch.select(["fid", "z", "tx", "ty"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(parts, unit), pa.array(shapes, pa.binary())], ["fid", "z", "tx", "ty", "parts", "shape"])

    return pieces.mapInArrow(run, f"fid {kind}, z int, tx long, ty long, parts array<array<struct<x:int,y:int>>>, shape binary")


def shape_tiles(features: DataFrame, zooms: list[int], polygon: bool, name: str = "layer", properties: list[str] | None = None) -> DataFrame:
    """z, tx, ty, n, tile: a binary tile per row that has a feature."""
    parts = tile_parts(features, zooms, polygon)
    attrs = F.create_map(*[x for c in (properties or []) for x in (F.lit(c), F.col(c).cast("string"))]) if properties else F.create_map().cast("map<string,string>")
    shown = parts.groupBy("z", "tx", "ty", "shape").agg(F.min("fid").alias("fid")).join(features.select("fid", F.map_entries(attrs).alias("attrs")).dropDuplicates(["fid"]), "fid")
    tiles = shown.groupBy("z", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct("fid", "shape", "attrs"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, n = [], []
            for rows in batch.column(3).to_pylist():
                n.append(len(rows))
                tiles.append(encode_layer(name, [(r["fid"], 3 if polygon else 2, r["shape"], {a["key"]: a["value"] for a in r["attrs"] if a["value"] is not None}) for r in rows]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(tiles, pa.binary())], ["z", "tx", "ty", "n", "tile"])

    return tiles.mapInArrow(run, "z int, tx long, ty long, n long, tile binary")
