"""Reprojection and resampling against NumPy over the whole array, over tile borders and missing pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions.geo import project
from terralith.operators.raster import RasterLimitError
from terralith.operators.warp import Grid, target_grid, warp

SOURCE = Grid("EPSG:4326", 116.0, 40.0, 0.01, 0.01, 37, 45)


def raster(seed=3, gaps=40):
    r = np.random.default_rng(seed)
    v = np.sin(np.arange(37)[:, None] / 5) * 10 + np.cos(np.arange(45) / 4) * 7 + r.normal(size=(37, 45))
    v[r.integers(0, 37, gaps), r.integers(0, 45, gaps)] = np.nan
    return v


def frame(spark, v):
    return spark.createDataFrame([(r, c, None if math.isnan(v[r, c]) else float(v[r, c])) for r in range(v.shape[0]) for c in range(v.shape[1])], "row long, col long, v double").repartition(4)


def places(target):
    """Mercator back to degrees, in plain Python."""
    out = {}
    for row in range(target.rows):
        for col in range(target.cols):
            x, y = target.x0 + (col + 0.5) * target.dx, target.y0 - (row + 0.5) * target.dy
            lon, lat = math.degrees(x / 6378137.0), math.degrees(2 * math.atan(math.exp(y / 6378137.0)) - math.pi / 2)
            out[row, col] = ((SOURCE.y0 - lat) / SOURCE.dy, (lon - SOURCE.x0) / SOURCE.dx)
    return out


def weight(how, d):
    d = abs(d)
    if how == "bilinear":
        return max(1 - d, 0)
    return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0


def brute(v, r, c, how):
    if not (0 <= r < v.shape[0] and 0 <= c < v.shape[1]) or math.isnan(v[int(r), int(c)]):
        return None
    if how == "nearest":
        return v[int(r), int(c)]
    total = value = 0.0
    for i in range(math.floor(r - 0.5) - 1, math.floor(r - 0.5) + 3):
        for j in range(math.floor(c - 0.5) - 1, math.floor(c - 0.5) + 3):
            if 0 <= i < v.shape[0] and 0 <= j < v.shape[1] and not math.isnan(v[i, j]):
                w = weight(how, r - 0.5 - i) * weight(how, c - 0.5 - j)
                total, value = total + w, value + w * v[i, j]
    return value / total if total > 1e-6 else None


@pytest.mark.parametrize("how", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("resolution", [450.0, 4000.0])
def test_reprojection(spark, how, resolution):
    v = raster()
    target = target_grid(spark, SOURCE, resolution, "EPSG:3857")
    got = {(x["row"], x["col"]): x["v"] for x in warp(frame(spark, v), SOURCE, target, how, tile=8).collect()}
    want = {k: brute(v, r, c, how) for k, (r, c) in places(target).items()}
    assert got.keys() == want.keys() and sum(x is not None for x in want.values()) > 50
    assert all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) < 1e-8) for k, a in got.items())


def test_tiles_do_not_matter_and_cubics_are_kept(spark):
    """Any tile size gives the same; a cubic convolution reproduces a linear surface exactly inside."""
    plane = np.add.outer(np.arange(37) * 2.0, np.arange(45) * 3.0)
    target = Grid("EPSG:4326", 116.05, 39.95, 0.0037, 0.0029, 80, 90)
    small, large = ({(x["row"], x["col"]): x["v"] for x in warp(frame(spark, plane), SOURCE, target, "cubic", tile=t).collect()} for t in (5, 128))
    assert small == large
    for (row, col), v in small.items():
        r, c = (SOURCE.y0 - (target.y0 - (row + 0.5) * target.dy)) / 0.01 - 0.5, (target.x0 + (col + 0.5) * target.dx - SOURCE.x0) / 0.01 - 0.5
        assert abs(v - (2 * r + 3 * c)) < 1e-6


@pytest.mark.parametrize("how", ["average", "mode"])
def test_gathering(spark, how):
    v = np.round(raster())
    target = Grid("EPSG:4326", 116.0, 40.0, 0.0351, 0.0273, 14, 13)
    got = {(x["row"], x["col"]): x["v"] for x in warp(frame(spark, v), SOURCE, target, how).collect()}
    held = {}
    for r in range(37):
        for c in range(45):
            if not math.isnan(v[r, c]):
                held.setdefault((int((r + 0.5) * 0.01 / 0.0273), int((c + 0.5) * 0.01 / 0.0351)), []).append(v[r, c])
    for k, values in held.items():
        want = np.mean(values) if how == "average" else min(set(values), key=lambda x: (-values.count(x), x))
        assert abs(got[k] - want) < 1e-9
    assert len(got) == 14 * 13


def test_guard_and_systems(spark):
    with pytest.raises(RasterLimitError):
        target_grid(spark, SOURCE, 0.5, "EPSG:3857")
    with pytest.raises(ValueError):
        target_grid(spark, SOURCE, 0.0)
    with pytest.raises(ValueError):
        project(F.lit(1.0), F.lit(1.0), "EPSG:4326", "EPSG:2000")
    there = spark.range(50).select((F.lit(-170.0) + F.col("id") * 7).alias("x"), (F.lit(-60.0) + F.col("id") * 2.5).alias("y"))
    for crs in ("EPSG:3857", "EPSG:32650", "EPSG:32733"):
        near = there.where("x BETWEEN 114 AND 120") if crs.endswith("50") else there.where("x BETWEEN 12 AND 20") if crs.endswith("33") else there
        px, py = project(*project(F.col("x"), F.col("y"), "EPSG:4326", crs), crs, "EPSG:4326")
        assert near.where((F.abs(px - F.col("x")) > 1e-7) | (F.abs(py - F.col("y")) > 1e-7)).count() == 0


def test_empty_raster(spark):
    got = warp(spark.createDataFrame([], "row long, col long, v double"), SOURCE, Grid("EPSG:4326", 116.0, 40.0, 0.1, 0.1, 3, 4), "cubic").collect()
    assert len(got) == 12 and all(x["v"] is None for x in got)
