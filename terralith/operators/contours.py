"""Contours of a surface on a grid, as polygons of what lies at or above each level.

Marching squares over the cells between pixel centres: along a cell's outline the level is crossed downwards and
upwards in turn, and a segment goes from each downward crossing to an upward one, the higher side on its left. A
saddle joins its high corners if the mean of the four reaches the level. Cells are made by one aggregation of pixels to the
cells around them; segments of all cells are chained into rings, and holes put into their shells, by joins
(`planar`), so no band or level comes together in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planar import _SEG, _canonical, _polygons

#: Corners of a cell as (row, col), counter-clockwise with rows going up.
_CORNERS = [(0, 0), (0, 1), (1, 1), (1, 0)]


def contour_segments(pixels: DataFrame, levels: list[float], outside: float = 0.0) -> DataFrame:
    """key (the level), ax, ay, bx, by: directed segments in units of pixels from the centre of the first; missing pixels and those around the grid are `outside`."""
    if not levels or min(levels) <= outside:
        raise ValueError("levels lie above what is outside")
    v = pixels.where(F.col("v").isNotNull() & ~F.isnan("v")).select("row", "col", F.col("v").cast("double").alias("v"))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).alias("r"), F.lit(c).alias("c")) for i, (r, c) in enumerate(_CORNERS))))
    spread = v.select("*", corner.alias("k")).select((F.col("row") - F.col("k.r")).alias("row"), (F.col("col") - F.col("k.c")).alias("col"), F.col("k.i").alias("i"), "v")
    cells = spread.groupBy("row", "col").agg(*(F.coalesce(F.max(F.when(F.col("i") == i, F.col("v"))), F.lit(float(outside))).alias(f"v{i}") for i in range(4)))
    cells = cells.withColumn("key", F.explode(F.array(*(F.lit(float(x)) for x in sorted(set(levels))))))
    cells = cells.where((F.greatest("v0", "v1", "v2", "v3") >= F.col("key")) & (F.least("v0", "v1", "v2", "v3") < F.col("key")))
    high = [F.col(f"v{i}") >= F.col("key") for i in range(4)]
    share = lambda a, b: (F.col("key") - F.col(a)) / (F.col(b) - F.col(a))  # noqa: E731  always from the lower row or column
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    at = [(x + share("v0", "v1"), y), (x + 1, y + share("v1", "v2")), (x + share("v3", "v2"), y + 1), (x, y + share("v0", "v3"))]
    place = [F.struct(a.alias("x"), b.alias("y")) for a, b in at]
    falls = [high[i] & ~high[(i + 1) % 4] for i in range(4)]
    rises = [~high[i] & high[(i + 1) % 4] for i in range(4)]
    joined = (F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")) / 4 >= F.col("key")

    def first(order: list[int]):
        return reduce(lambda rest, i: F.when(rises[i], place[i]).otherwise(rest), reversed(order), F.lit(None))

    found = [F.when(falls[i], F.struct(place[i].alias("a"), F.when(joined, first([(i + n) % 4 for n in (1, 2, 3)])).otherwise(first([(i + n) % 4 for n in (3, 2, 1)])).alias("b"))) for i in range(4)]
    each = cells.select("key", F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("s"))
    return each.select("key", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def contours(pixels: DataFrame, levels: list[float], x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0, outside: float = 0.0, unit: float = 1e-6) -> DataFrame:
    """level, ring, holes, area of pixels (row, col, v): the polygons at or above each level, in coordinates x0 + dx * col, y0 + dy * row of pixel centres.

    Points are snapped to `unit`; what then cancels out is left away. Levels that nothing reaches have no row.
    """
    snapped = contour_segments(pixels, levels, outside)
    grid = {"ax": (x0, dx), "bx": (x0, dx), "ay": (y0, dy), "by": (y0, dy)}
    snapped = snapped.select("key", *(F.rint((F.lit(o) + F.col(c) * F.lit(d)) / F.lit(unit)).cast("long").alias(c) for c, (o, d) in grid.items()))
    whole = _canonical(snapped.select("key", *_SEG).where("ax <> bx OR ay <> by"))
    kept = whole.groupBy("key", *_SEG).agg((F.sum("sign") * (1 if dx * dy > 0 else -1)).alias("sign")).where("sign <> 0")
    turned = lambda a, b: F.when(F.col("sign") > 0, F.col(a)).otherwise(F.col(b)).alias(a)
    bounds = kept.select("key", turned("ax", "bx"), turned("ay", "by"), turned("bx", "ax"), turned("by", "ay"))
    return _polygons(bounds, unit).withColumnRenamed("key", "level")
