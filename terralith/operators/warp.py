"""Rasters on other grids: resampling to any resolution and reprojection, over tiles with a halo.

A raster is a pixel table (row, col, v) with a `Grid` that says where its pixels lie; a missing value is null or has no
row. Each pixel of the target is mapped back through the projections (column expressions) to a place among the source's
pixels. Source pixels are dealt into tiles of `TILE` by `TILE`, with copies of the two rows and columns around;
the target's pixels go to the tile of their place in groups of one target tile, so that a task's group holds a tile of
either raster at most, whatever the sizes of the rasters and however much finer the target is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import project
from .raster import guard

TILE = 128
HALO = 2
METHODS = ("nearest", "bilinear", "cubic", "average", "mode")


@dataclass(frozen=True)
class Grid:
    """A grid from its upper left corner (x0, y0), columns to the right by dx, rows down by dy."""

    crs: str
    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.x0) + (col + F.lit(0.5)) * F.lit(self.dx), F.lit(self.y0) - (row + F.lit(0.5)) * F.lit(self.dy)

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column as real numbers: 0 at the upper left corner."""
        return (F.lit(self.y0) - y) / F.lit(self.dy), (x - F.lit(self.x0)) / F.lit(self.dx)


def target_grid(spark: SparkSession, source: Grid, resolution: float, crs: str | None = None, max_pixels: int = 100_000_000) -> Grid:
    """The grid of square pixels that holds the source's outline (32 points a side) in another system; too many pixels raise."""
    if not resolution > 0:
        raise ValueError(f"a resolution is positive, not {resolution}")
    crs = crs or source.crs
    sides = spark.range(4 * 33).select((F.col("id") % 4).alias("side"), (F.floor(F.col("id") / 4) / F.lit(32.0)).alias("t"))
    along = lambda a, b, c, d: F.when(F.col("side") == 0, a).when(F.col("side") == 1, b).when(F.col("side") == 2, c).otherwise(d)
    x1, y1 = source.x0 + source.cols * source.dx, source.y0 - source.rows * source.dy
    x = along(F.lit(source.x0), F.lit(x1), source.x0 + F.col("t") * (x1 - source.x0), source.x0 + F.col("t") * (x1 - source.x0))
    y = along(y1 + F.col("t") * (source.y0 - y1), y1 + F.col("t") * (source.y0 - y1), F.lit(source.y0), F.lit(y1))
    px, py = project(x, y, source.crs, crs)
    box = sides.select(px.alias("x"), py.alias("y")).agg(F.min("x"), F.max("y"), F.max("x"), F.min("y")).head()
    rows, cols = (max(1, math.ceil(n / resolution - 1e-9)) for n in (box[1] - box[3], box[2] - box[0]))
    guard(rows, cols, 1.0, max_pixels)
    return Grid(crs, box[0], box[1], resolution, resolution, rows, cols)


def kernel(how: str, t: np.ndarray) -> np.ndarray:
    """Weights of the taps at -1, 0, 1 and 2 from the pixel before a place that is t beyond its centre: linear, or cubic convolution with a = -1/2."""
    d = np.abs(t[:, None] - np.arange(-1, 3))
    if how == "bilinear":
        return np.maximum(1 - d, 0)
    return np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0))


def sample(values: np.ndarray, r: np.ndarray, c: np.ndarray, how: str) -> np.ndarray:
    """values (nan: missing) at places (r, c), 0 being the upper left corner of the first pixel; nan beside a missing pixel's own place.

    Taps that are missing drop out and the weights of the others are scaled to 1.
    """
    around = np.pad(values, HALO, constant_values=np.nan)
    r0, c0 = np.floor(r - 0.5).astype(np.int64), np.floor(c - 0.5).astype(np.int64)
    taps = np.arange(-1, 3)
    found = around[(r0[:, None] + taps + HALO)[:, :, None], (c0[:, None] + taps + HALO)[:, None, :]]
    weights = kernel(how, r - 0.5 - r0)[:, :, None] * kernel(how, c - 0.5 - c0)[:, None, :]
    weights[np.isnan(found)] = 0
    total = weights.sum(axis=(1, 2))
    out = np.where(total > 1e-6, np.nansum(found * weights, axis=(1, 2)) / np.where(total > 1e-6, total, 1), np.nan)
    out[np.isnan(around[np.floor(r).astype(np.int64) + HALO, np.floor(c).astype(np.int64) + HALO])] = np.nan
    return out


def _source_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """ty, tx, rows, cols, vs: each tile's pixels and its halo's, places counted from the tile's corner."""
    tiles = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - HALO) / size), F.floor(F.col(c) / size), F.floor((F.col(c) + HALO) / size)))
    dealt = pixels.where("v IS NOT NULL").select("row", "col", F.col("v").cast("double").alias("v"), F.explode(tiles("row")).alias("ty"), "col").select("row", "v", "ty", pixels["col"], F.explode(tiles("col")).alias("tx"))
    return dealt.groupBy("ty", "tx").agg(F.collect_list(F.struct((F.col("row") - F.col("ty") * size).alias("r"), (F.col("col") - F.col("tx") * size).alias("c"), "v")).alias("held"))


def _targets(spark: SparkSession, source: Grid, target: Grid) -> DataFrame:
    """row, col of each target pixel and its place (r, c) among the source's pixels; null places outside."""
    ids = spark.range(target.rows * target.cols).select(F.floor(F.col("id") / target.cols).alias("row"), (F.col("id") % target.cols).alias("col"))
    x, y = target.centre(F.col("row"), F.col("col"))
    at = ids.select("row", "col", *(p.alias(n) for p, n in zip(source.place(*project(x, y, target.crs, source.crs)), "rc", strict=True)))
    inside = (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < source.rows) & (F.col("c") < source.cols)
    return at.select("row", "col", *(F.when(inside, F.col(n)).alias(n) for n in "rc"))


def warp(pixels: DataFrame, source: Grid, target: Grid, how: str = "bilinear", tile: int = TILE) -> DataFrame:
    """Every pixel (row, col, v) of the target grid; v is null outside the source and where its nearest pixel is missing.

    nearest, bilinear and cubic take values at the target's centres. average and mode (ties: the smaller value) gather
    the source pixels whose centres a target pixel holds; one that holds none takes the nearest.
    """
    if how not in METHODS:
        raise ValueError(f"unknown resampling {how}; there are {', '.join(METHODS)}")
    spark = pixels.sparkSession
    every = _targets(spark, source, target)
    if how in ("bilinear", "cubic"):
        return _interpolated(every, pixels, how, tile)
    near = every.select("row", "col", F.floor("r").alias("_r"), F.floor("c").alias("_c"))
    values = pixels.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").cast("double").alias("v"))
    nearest = near.join(values, ["_r", "_c"], "left").select("row", "col", "v")
    if how == "nearest":
        return nearest
    r, c = target.place(*project(*source.centre(F.col("row"), F.col("col")), source.crs, target.crs))
    placed = pixels.where("v IS NOT NULL").select(F.floor(r).alias("row"), F.floor(c).alias("col"), F.col("v").cast("double").alias("v"))
    if how == "average":
        held = placed.groupBy("row", "col").agg(F.avg("v").alias("held"))
    else:
        held = placed.groupBy("row", "col", "v").agg(F.count("*").alias("n")).groupBy("row", "col").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("held"))
    return nearest.join(held, ["row", "col"], "left").select("row", "col", F.coalesce("held", "v").alias("v"))


def _interpolated(every: DataFrame, pixels: DataFrame, how: str, tile: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column("asked"), batch.column("held"), strict=True):
                asked = asked.values
                row, col, r, c = (asked.field(k).to_numpy() for k in range(4))
                values = np.full((tile + 2 * HALO, tile + 2 * HALO), np.nan)
                if held.is_valid:
                    at = held.values
                    values[at.field(0).to_numpy() + HALO, at.field(1).to_numpy() + HALO] = at.field(2).to_numpy()
                got = sample(values, r + HALO, c + HALO, how)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(got, from_pandas=True)], ["row", "col", "v"])

    inside = every.where("r IS NOT NULL")
    ty, tx = F.floor(F.col("r") / tile), F.floor(F.col("c") / tile)
    # A tile answers for the places within it: their taps reach two pixels beyond.
    asked = inside.groupBy(ty.alias("ty"), tx.alias("tx"), F.floor(F.col("row") / tile).alias("by"), F.floor(F.col("col") / tile).alias("bx"))
    asked = asked.agg(F.collect_list(F.struct("row", "col", (F.col("r") - ty * tile).alias("r"), (F.col("c") - tx * tile).alias("c"))).alias("asked"))
    got = asked.join(_source_tiles(pixels, tile), ["ty", "tx"], "left").select("asked", "held").mapInArrow(run, "row long, col long, v double")
    return got.unionAll(every.where("r IS NULL").select("row", "col", F.lit(None).cast("double").alias("v")))
