"""Rasters as pixel tables (row, col, v); a missing value is null. Every operator keeps pixels as rows."""

from __future__ import annotations

import ast
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import spatial_join


def reclassify(pixels: DataFrame, scheme: list[tuple[float | None, float | None, float]], value: str = "v") -> DataFrame:
    """(min, max, new) rules, both ends inclusive, a missing end open, the first match wins; no match is null."""
    v, out = F.col(value), F.lit(None).cast("double")
    for low, high, new in reversed(scheme):
        hit = v.isNotNull()
        hit = hit & (v >= low) if low is not None else hit
        hit = hit & (v <= high) if high is not None else hit
        out = F.when(hit, F.lit(float(new))).otherwise(out)
    return pixels.withColumn(value, out)


def calculator(a: DataFrame, b: DataFrame | None, expression) -> DataFrame:
    """expression(A, B) per pixel of a, B being b's pixel there; null where either is missing or the result is not finite."""
    joined = a.select("row", "col", F.col("v").alias("_a"))
    joined = joined.join(b.select("row", "col", F.col("v").alias("_b")), ["row", "col"], "left") if b is not None else joined.withColumn("_b", F.lit(0.0))
    out = expression(F.col("_a").cast("double"), F.col("_b").cast("double"))
    return joined.select("row", "col", F.when(F.isnan(out) | (F.abs(out) == float("inf")), None).otherwise(out).alias("v"))


#: What an expression may call, besides A and B.
_CALLS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arctan": F.atan, "where": lambda c, a, b: F.when(c, a).otherwise(b)}


def calculate(a: DataFrame, b: DataFrame | None, expression: str, constant: float | None = None) -> DataFrame:
    """calculator() of an expression text over A and B (or a constant B): numbers, + - * / ** %, comparisons, & | ~ and a few functions.

    B's pixels are those nearest to A's in a raster of another size over the same extent.
    """
    tree = ast.parse(expression, mode="eval")
    operations = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: F.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.USub: operator.neg, ast.Invert: operator.invert}

    def column(node: ast.AST, names: dict[str, Column]) -> Column:
        match node:
            case ast.Expression(body=body):
                return column(body, names)
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name) if name in names:
                return names[name]
            case ast.BinOp(left=x, op=op, right=y) if type(op) in operations:
                return operations[type(op)](column(x, names), column(y, names))
            case ast.Compare(left=x, ops=[op], comparators=[y]) if type(op) in operations:
                return operations[type(op)](column(x, names), column(y, names))
            case ast.UnaryOp(op=op, operand=x) if type(op) in operations:
                return operations[type(op)](column(x, names))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
                return _CALLS[name](*[column(x, names) for x in args])
        raise ValueError(f"not part of an expression: {ast.unparse(node)}")

    if b is not None:
        b = nearest_to(a, b)
    return calculator(a, b, lambda x, y: column(tree, {"A": x, "B": F.lit(float(constant)) if constant is not None else y}))


def nearest_to(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's pixels (row, col, v) on a's grid: each pixel of a takes the one of b whose share of the extent holds its centre."""
    size = lambda df, p: df.agg((F.max("row") + 1).alias(f"{p}r"), (F.max("col") + 1).alias(f"{p}c"))
    sizes = size(a, "a").join(size(b, "b"))  # one row
    at = a.select("row", "col").join(F.broadcast(sizes)).select("row", "col", F.floor((F.col("row") + 0.5) * F.col("br") / F.col("ar")).alias("_r"), F.floor((F.col("col") + 0.5) * F.col("bc") / F.col("ac")).alias("_c"))
    return at.join(b.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "v"), ["_r", "_c"]).select("row", "col", "v")


def resample(pixels: DataFrame, factor: int, how: str = "average") -> DataFrame:
    """Coarser by a whole factor: average, mode (ties: the smaller value) or nearest (the block's middle pixel)."""
    block = pixels.withColumn("r", F.floor(F.col("row") / factor)).withColumn("c", F.floor(F.col("col") / factor))
    if how == "average":
        out = block.groupBy("r", "c").agg(F.avg("v").alias("v"))
    elif how == "mode":
        counts = block.where("v is not null").groupBy("r", "c", "v").agg(F.count("*").alias("n"))
        out = counts.groupBy("r", "c").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v"))
    elif how == "nearest":
        middle = factor // 2
        out = block.where((F.col("row") % factor == middle) & (F.col("col") % factor == middle)).select("r", "c", "v")
    else:
        raise ValueError(f"unknown resampling {how}")
    return out.select(F.col("r").alias("row"), F.col("c").alias("col"), "v")


def upsample_bilinear(pixels: DataFrame, factor: int) -> DataFrame:
    """Finer by a whole factor: each new pixel centre weighs the up to four old centres around it; missing ones drop out."""
    half = (factor - 1) / 2
    offsets = F.sequence(F.lit(-factor), F.lit(factor - 1))
    w = lambda d: 1 - F.abs(d) / factor
    base_r, base_c = F.col("row") * factor + F.lit(half), F.col("col") * factor + F.lit(half)
    spread = pixels.where("v is not null").withColumn("dr", F.explode(offsets)).withColumn("dc", F.explode(offsets))
    shift = 0.0 if factor % 2 else 0.5
    spread = spread.select((base_r + F.col("dr") + shift).cast("long").alias("row"), (base_c + F.col("dc") + shift).cast("long").alias("col"), (w(F.col("dr") + shift) * w(F.col("dc") + shift)).alias("w"), "v").where("w > 0")
    box = pixels.agg((F.max("row") * factor + factor).alias("rows"), (F.max("col") * factor + factor).alias("cols"))
    return spread.join(F.broadcast(box)).where("row >= 0 and col >= 0 and row < rows and col < cols").groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


class RasterLimitError(ValueError):
    """An output raster would be too large; says which resolution would fit."""


def guard(rows: int, cols: int, factor: float, max_pixels: int = 100_000_000) -> None:
    n = rows * cols * factor * factor
    if n > max_pixels:
        raise RasterLimitError(f"{n:.0f} pixels; the limit is {max_pixels}, reached at a factor of {math.sqrt(max_pixels / (rows * cols)):.4g}")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def index(name: str, bands: dict[str, Column]) -> Column:
    """ndvi, ndwi, nbr or evi of band columns; null where the denominator is not positive. evi takes reflectances."""
    if name == "ndvi":
        return _ratio(bands["nir"] - bands["red"], bands["nir"] + bands["red"])
    if name == "ndwi":
        return _ratio(bands["green"] - bands["nir"], bands["green"] + bands["nir"])
    if name == "nbr":
        return _ratio(bands["nir"] - bands["swir"], bands["nir"] + bands["swir"])
    if name == "evi":
        return 2.5 * _ratio(bands["nir"] - bands["red"], bands["nir"] + 6 * bands["red"] - 7.5 * bands["blue"] + 1)
    raise ValueError(f"unknown index {name}")


def _around(pixels: DataFrame) -> DataFrame:
    """Each pixel with the columns n_{dr}_{dc} of its 3 by 3 neighbourhood, edges repeated; two windows, one shuffle each."""
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    a = pixels.select("row", "col", "v", F.coalesce(F.lag("v").over(across), F.col("v")).alias("w"), F.coalesce(F.lead("v").over(across), F.col("v")).alias("e"))
    out = []
    for dr, step in ((-1, F.lag), (0, None), (1, F.lead)):
        for dc, c in ((-1, "w"), (0, "v"), (1, "e")):
            out.append((F.coalesce(step(c).over(down), F.col(c)) if step else F.col(c)).alias(f"n{dr + 1}{dc + 1}"))
    return a.select("row", "col", *out)


def terrain(dem: DataFrame, cell: float, cell_x: float | None = None, azimuth: float = 315, altitude: float = 45) -> DataFrame:
    """slope (degrees), aspect (compass degrees downhill, null on flat ground) and hillshade (0 to 255) of a full grid.

    Slope weighs the middle row or column by 1/2 and the outer ones by 1/4 before halving, as 2-cell differences;
    aspect and hillshade use central differences.
    """
    dx = cell_x or cell
    g = _around(dem)
    n = lambda r, c: F.col(f"n{r}{c}")
    zx = ((n(1, 2) - n(1, 0)) / (2 * dx) + (n(0, 2) - n(0, 0)) / (4 * dx) + (n(2, 2) - n(2, 0)) / (4 * dx)) / 2
    zy = ((n(2, 1) - n(0, 1)) / (2 * cell) + (n(2, 0) - n(0, 0)) / (4 * cell) + (n(2, 2) - n(0, 2)) / (4 * cell)) / 2
    cx, cy = (n(1, 2) - n(1, 0)) / (2 * dx), (n(2, 1) - n(0, 1)) / (2 * cell)
    flat = (cx == 0) & (cy == 0)
    steep, alt, az = F.atan(F.sqrt(cx * cx + cy * cy)), math.radians(altitude), math.radians(azimuth)
    light = math.sin(alt) * F.cos(steep) + math.cos(alt) * F.sin(steep) * F.cos(F.lit(az) - F.atan2(-cx, cy))
    return g.select("row", "col", F.degrees(F.atan(F.sqrt(zx * zx + zy * zy))).alias("slope"), F.when(~flat, F.pmod(F.degrees(F.atan2(-cx, cy)), F.lit(360.0))).alias("aspect"), F.least(F.lit(255.0), F.greatest(F.lit(0.0), 255 * light)).alias("hillshade"))


def raster_stats(pixels: DataFrame, circular: bool = False) -> DataFrame:
    """One row: valid share in percent, min, max, mean (circular for directions), population std."""
    v = F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(F.col("v"))
    mean = F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians("x"))), F.avg(F.cos(F.radians("x"))))), F.lit(360.0)) if circular else F.avg("x")
    return pixels.select(v.alias("x")).agg(F.count("*").alias("n"), (100.0 * F.count("x") / F.count("*")).alias("valid_pct"), F.min("x").alias("min"), F.max("x").alias("max"), mean.alias("mean"), F.stddev_pop("x").alias("std"))


def zonal(pixels: DataFrame, zones: DataFrame, key: str, x: Column, y: Column, cell: float = 0.1) -> DataFrame:
    """Per zone count, mean, sum, max, min of the pixels whose centres (x, y) it holds; zones without any have count 0."""
    centres = pixels.where("v is not null").select(x.alias("x"), y.alias("y"), "v")
    got = spatial_join(centres, zones.select(key, "ring"), cell=cell).groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.sum("v").alias("sum"), F.max("v").alias("max"), F.min("v").alias("min"))
    return zones.select(key).join(got, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def change_class(delta: Column, threshold: float) -> Column:
    """Five ways by threshold: from significant_improvement (2 thresholds or more) down to significant_degradation."""
    return (
        F.when(delta >= 2 * threshold, "significant_improvement").when(delta >= threshold, "slight_improvement").when(delta > -threshold, "no_change").when(delta > -2 * threshold, "slight_degradation").when(delta.isNotNull(), "significant_degradation")
    )


def change(t1: DataFrame, t2: DataFrame, threshold: float) -> DataFrame:
    """Pixels of both epochs by change class: count and share in percent."""
    both = t1.select("row", "col", F.col("v").alias("a")).join(t2.select("row", "col", F.col("v").alias("b")), ["row", "col"]).where("a is not null and b is not null")
    counts = both.groupBy(change_class(F.col("b") - F.col("a"), threshold).alias("class")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("class", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def difference_stats(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """One row over t2 - t1: pixels, mean, population std, min, max."""
    d = t1.select("row", "col", F.col("v").alias("a")).join(t2.select("row", "col", F.col("v").alias("b")), ["row", "col"]).select((F.col("b") - F.col("a")).alias("d")).where("d is not null")
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.min("d").alias("min"), F.max("d").alias("max"))


def series_stats(series: DataFrame, by: str = "scene") -> DataFrame:
    """Per slice of (scene, row, col, v): valid pixels, mean, std, min, max."""
    return series.groupBy(by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def time_slice(series: DataFrame, time: str, start=None, end=None) -> DataFrame:
    """Slices within the closed bounds, an absent bound open."""
    if start is not None:
        series = series.where(F.col(time) >= F.lit(start))
    return series.where(F.col(time) <= F.lit(end)) if end is not None else series


def tiles(pixels: DataFrame, size: int = 256) -> DataFrame:
    """Pixels gathered by tile (tx, ty): an array of (i, v) with i = row within the tile times size plus column."""
    i = (F.col("row") % size) * size + F.col("col") % size
    return pixels.groupBy(F.floor(F.col("col") / size).alias("tx"), F.floor(F.col("row") / size).alias("ty")).agg(F.array_sort(F.collect_list(F.struct(i.alias("i"), "v"))).alias("pixels"))
