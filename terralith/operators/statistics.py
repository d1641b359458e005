"""Spatial statistics over weights tables (aid, bid[, w]) and class breaks over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import normal_cdf
from ..sources.store import materialize
from .spatial import nearest, neighbour_sums, places, within_distance


def knn_weights(points: DataFrame, k: int = 8) -> DataFrame:
    """Binary weights (aid, bid): the k nearest others of each point (fid, mx, my)."""
    return nearest(points, points, k, by_self=True).select("aid", "bid")


def moran(points: DataFrame, weights: DataFrame, value: str, permutations: int = 0, seed: int = 42) -> DataFrame:
    """One row: global Moran's I, its expectation, and with permutations the two-sided pseudo p (ge + 1) / (permutations + 1).

    A permutation deals the values anew by the order of a seeded hash, all permutations in one job.
    """
    stats = points.agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count(value).alias("n"))
    z = points.join(F.broadcast(stats)).select("fid", (F.col(value) - F.col("m")).alias("z"))
    a, b = z.select(F.col("fid").alias("aid"), F.col("z").alias("za")), z.select(F.col("fid").alias("bid"), F.col("z").alias("zb"))
    cross = weights.join(a, "aid").join(b, "bid").agg(F.sum(F.col("za") * F.col("zb")).alias("num"), F.count("*").cast("double").alias("s0"))
    out = cross.join(stats).select(F.round(F.col("n") / F.col("s0") * F.col("num") / (F.col("n") * F.col("v")), 6).alias("moran_i"), F.round(-1.0 / (F.col("n") - 1), 6).alias("expected_i"), "n")
    if not permutations:
        return out
    # both the places and the shuffled values are numbered per permutation, by two orders of the same rows
    many = z.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    place = many.select("p", "fid", F.row_number().over(Window.partitionBy("p").orderBy("fid")).alias("k"))
    dealt = many.select("p", "z", F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64(F.lit(seed), "p", "fid"), "fid")).alias("k"))
    shuffled = materialize(place.join(dealt, ["p", "k"]).select("p", "fid", "z"), "permutations")
    pa = shuffled.select("p", F.col("fid").alias("aid"), F.col("z").alias("za"))
    pb = shuffled.select("p", F.col("fid").alias("bid"), F.col("z").alias("zb"))
    nums = weights.join(pa, "aid").join(pb, ["p", "bid"]).groupBy("p").agg(F.sum(F.col("za") * F.col("zb")).alias("num"))
    scaled = nums.join(F.broadcast(cross.select("s0"))).join(F.broadcast(stats)).select((F.col("n") / F.col("s0") * F.col("num") / (F.col("n") * F.col("v"))).alias("i"))
    extreme = F.sum(F.when(F.abs(F.col("i") - F.col("expected_i")) >= F.abs(F.col("moran_i") - F.col("expected_i")), 1).otherwise(0))
    p = scaled.join(F.broadcast(out)).agg(((extreme + 1) / (permutations + 1)).alias("p_value"))
    pattern = F.when(F.col("p_value") < 0.05, F.when(F.col("moran_i") > F.col("expected_i"), "clustering").otherwise("dispersion")).otherwise("random")
    return out.join(p).withColumn("pattern", pattern)


def getis_ord(points: DataFrame, value: str, band: float) -> DataFrame:
    """Gi* of every point (fid, mx, my) over the points within `band`, itself included; p two-sided, labels at 99, 95 and 90 %."""
    stats = points.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count("*").alias("n"))
    sums = neighbour_sums(points, band, value).select("fid", F.col("n").alias("w"), F.col("sum").alias("wx"))
    inner = (F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1)
    den = F.when(inner > 0, F.col("s") * F.sqrt(inner)).otherwise(0.0)
    g = sums.join(F.broadcast(stats)).withColumn("gi", F.when(den != 0, (F.col("wx") - F.col("m") * F.col("w")) / den).otherwise(0.0))
    p = 2 * (1 - normal_cdf(F.abs("gi")))
    return g.withColumn("p", p).select(
        "fid", F.round("gi", 4).alias("gi_star"), F.round("p", 5).alias("p_value"), F.when(F.col("p") < 0.1, F.when(F.col("gi") > 0, "Hot Spot").otherwise("Cold Spot")).otherwise("Not Significant").alias("kind"), F.when(F.col("p") < 0.01, "99%").when(F.col("p") < 0.05, "95%").when(F.col("p") < 0.1, "90%").otherwise("Not Significant").alias("confidence")
    )


def mean_knn_distance(points: DataFrame, k: int = 8) -> float:
    """Mean distance to the k-th nearest other point: the default band of Gi*."""
    return nearest(points, points, k, by_self=True).where(F.col("rank") == k).agg(F.avg("d")).head()[0]


HEX_NEIGHBOURS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def lisa(cells: DataFrame, value: str, permutations: int = 0, seed: int = 42) -> DataFrame:
    """Local Moran of hexagons (q, r) with row-standardised contiguity: lag, I and quadrant; with permutations the pseudo p and NS where it is 0.05 or more.

    A permutation keeps a cell's own value and deals the others' by a seeded hash of (cell, permutation, place).
    """
    cells = materialize(cells.select("q", "r", value), "cells")
    stats = cells.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    z = cells.join(F.broadcast(stats)).where("s > 0").select("q", "r", ((F.col(value) - F.col("m")) / F.col("s")).alias("z"))
    around = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in HEX_NEIGHBOURS])
    links = z.select("q", "r", F.explode(around).alias("o")).select("q", "r", (F.col("q") + F.col("o.dq")).alias("nq"), (F.col("r") + F.col("o.dr")).alias("nr"))
    near = links.join(z.select(F.col("q").alias("nq"), F.col("r").alias("nr"), F.col("z").alias("zn")), ["nq", "nr"]).groupBy("q", "r").agg(F.avg("zn").alias("lag"), F.count("*").alias("n_near"))
    local = z.join(near, ["q", "r"], "left").withColumn("lag", F.coalesce("lag", F.lit(0.0))).withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    quadrant = F.when((F.col("z") >= 0) & (F.col("lag") >= 0), "HH").when((F.col("z") < 0) & (F.col("lag") >= 0), "LH").when((F.col("z") < 0) & (F.col("lag") < 0), "LL").otherwise("HL")
    out = local.select("q", "r", "z", "n_near", "lag", (F.col("z") * F.col("lag")).alias("i"), quadrant.alias("quadrant"))
    if not permutations:
        return out.select("q", "r", F.round("lag", 6).alias("lag"), F.round("i", 6).alias("local_i"), "quadrant")
    from .relational import with_position

    pool = with_position(z.select("q", "r", F.col("z").alias("zp")), [F.col("q"), F.col("r")], "at").select("at", "zp")
    n = z.count()
    draws = out.where("n_near > 0").withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_near"))))
    drawn = draws.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "q", "r", "p", "k"), F.lit(n))).join(pool, "at")
    sims = drawn.groupBy("q", "r", "p").agg((F.first("z") * F.avg("zp")).alias("sim"), F.first("i").alias("i"))
    larger = sims.groupBy("q", "r").agg(F.sum(F.when(F.col("sim") >= F.col("i"), 1).otherwise(0)).alias("ge"))
    p = (F.least(F.col("ge"), F.lit(permutations) - F.col("ge")) + 1) / F.lit(permutations + 1)
    return out.join(larger.withColumn("p_value", p), ["q", "r"], "left").select("q", "r", F.round("lag", 6).alias("lag"), F.round("i", 6).alias("local_i"), "p_value", F.when(F.col("p_value") < 0.05, F.col("quadrant")).otherwise("NS").alias("quadrant"))


def deviational_ellipse(points: DataFrame, x: str = "mx", y: str = "my") -> DataFrame:
    """One row: centre, semi-axes √(2 Σ / n) along the rotated axes, angle in degrees and direction."""
    c = points.agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    d = points.join(F.broadcast(c)).select("cx", "cy", (F.col(x) - F.col("cx")).alias("dx"), (F.col(y) - F.col("cy")).alias("dy"))
    s = d.groupBy("cx", "cy").agg(F.sum(F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("dy") * F.col("dy")).alias("yy"), F.sum(F.col("dx") * F.col("dy")).alias("xy"), F.count("*").alias("n")).where("n >= 3")
    theta = F.when(F.col("xx") == F.col("yy"), F.signum("xy") * (math.pi / 4)).otherwise(0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))
    co, si = F.cos("theta"), F.sin("theta")
    along = F.sqrt(2 * (F.col("xx") * co * co + 2 * F.col("xy") * co * si + F.col("yy") * si * si) / F.col("n"))
    across = F.sqrt(2 * (F.col("xx") * si * si - 2 * F.col("xy") * co * si + F.col("yy") * co * co) / F.col("n"))
    deg = F.pmod(F.degrees("theta"), F.lit(180.0))
    name = F.when((deg >= 67.5) & (deg < 112.5), "North-South").when((deg >= 22.5) & (deg < 67.5), "North-East to South-West").when((deg >= 112.5) & (deg < 157.5), "North-West to South-East").otherwise("East-West")
    return s.withColumn("theta", theta).select(F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"), F.round(along, 3).alias("sigma_x"), F.round(across, 3).alias("sigma_y"), F.round(deg, 4).alias("angle_deg"), name.alias("direction"))


def nearest_neighbour_index(points: DataFrame) -> DataFrame:
    """One row: mean nearest distance over its expectation in the bounding box; under 0.7 clustered, over 1.3 dispersed."""
    d = nearest(points, points, 1, by_self=True)
    box = points.agg(((F.max("mx") - F.min("mx")) * (F.max("my") - F.min("my"))).alias("area"), F.count("*").alias("n"))
    r = F.col("mean") / (0.5 * F.sqrt(F.col("area") / F.col("n")))
    return d.agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std")).join(box).select(F.round("mean", 4).alias("mean_distance"), F.round("std", 4).alias("std_distance"), F.round(r, 4).alias("ratio"), F.when(r < 0.7, "clustered").when(r > 1.3, "dispersed").otherwise("random").alias("pattern"))


def mean_centre(points: DataFrame) -> DataFrame:
    return points.agg(F.round(F.avg("x"), 9).alias("x"), F.round(F.avg("y"), 9).alias("y"), F.count("*").alias("n"))


def central_feature(points: DataFrame, side: int = 64) -> DataFrame:
    """The point with the smallest sum of distances to all others, ties by fid.

    Places are compared, with the rows there as their weight. The distance to the mean of a grid cell's points is never
    more than their mean distance, so sums over at most side * side cells bound those of all places from below: the
    place of the lowest bound is summed exactly, then all whose bound does not exceed that sum.
    """
    spots = materialize(places(points, ["mx", "my"]), "spots").where("mx is not null and my is not null")
    x0, x1, y0, y1 = spots.agg(F.min("mx"), F.max("mx"), F.min("my"), F.max("my")).head()
    width = max((x1 - x0) / side, (y1 - y0) / side, 1e-9) * 1.000001 if x0 is not None else 1.0
    at = [F.floor((F.col("mx") - F.lit(x0)) / width).alias("cx"), F.floor((F.col("my") - F.lit(y0)) / width).alias("cy")]
    cells = spots.groupBy(*at).agg(F.sum("n").alias("cn"), (F.sum(F.col("mx") * F.col("n")) / F.sum("n")).alias("ox"), (F.sum(F.col("my") * F.col("n")) / F.sum("n")).alias("oy"))
    far = F.hypot(F.col("mx") - F.col("ox"), F.col("my") - F.col("oy"))
    bounds = materialize(spots.select("fid", "mx", "my").join(F.broadcast(cells.select("cn", "ox", "oy"))).groupBy("fid", "mx", "my").agg(F.sum(F.col("cn") * far).alias("low")), "bounds")
    others = spots.select(F.col("mx").alias("ox"), F.col("my").alias("oy"), F.col("n").alias("cn"))

    def totals(some: DataFrame) -> DataFrame:
        return others.join(some.select("fid", "mx", "my")).groupBy("fid").agg(F.sum(F.col("cn") * far).alias("total"))

    best = totals(bounds.orderBy("low", "fid").limit(1)).agg(F.max("total")).head()[0] or 0.0
    sums = totals(bounds.where(F.col("low") <= best * (1 + 1e-9)))
    return sums.orderBy("total", "fid").limit(1).select("fid", F.round("total", 3).alias("total"))


# class breaks


def breaks(df: DataFrame, value: str, method: str = "quantiles", k: int = 5) -> list[float]:
    """Class limits, k + 1 at most, from aggregates of the whole column: quantiles, equal, std_dev, head_tail, jenks."""
    v = df.select(F.col(value).try_cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    low, high, mean, sd, n = v.agg(F.min("v"), F.max("v"), F.avg("v"), F.stddev_pop("v"), F.count("*")).head()
    if not n:
        return []
    if high <= low:
        return [low, high]
    if method == "quantiles":
        got = v.agg(F.percentile("v", F.array(*[F.lit(i / k) for i in range(k + 1)]))).head()[0]
        return sorted(set(got))
    if method == "equal":
        return [low + (high - low) * i / k for i in range(k + 1)]
    if method == "std_dev":
        inner = max(1, k - 1)
        steps = [s * 0.5 * j for j in range(1, inner // 2 + 1) for s in (1, -1)] + ([(inner // 2 + 1) * 0.5] if inner % 2 else [])
        return [low, *sorted(x for x in (mean + m * sd for m in steps) if low < x < high), high]
    if method == "head_tail":
        found, part, here = [], v, n
        while len(found) < k - 1:
            m = part.agg(F.avg("v")).head()[0]
            kept = part.where(F.col("v") <= m)
            count = kept.count()
            if not 0 < count < here:
                break
            found.append(m)
            part, here = kept, count
            if here < 8:
                break
        return [low, *sorted(found), high]
    if method == "jenks":
        return jenks(histogram(v, JENKS_BINS), k)
    raise ValueError(f"unknown method {method}")


#: Classes that the dynamic programme of natural breaks tells apart.
JENKS_BINS = 1000


def histogram(v: DataFrame, bins: int, rounds: int = 5) -> list[tuple[float, float, int, float, float]]:
    """(smallest, largest, rows, mean, sum of squared deviations) of all values v in ascending classes: one for each distinct value, or at most `bins`.

    Where there are more distinct values, classes start from quantiles and equal widths, a quarter of the bins each; round by
    round those with the largest deviations are split by width while bins are left. So neither an outlier nor a
    crowd of values makes the others coarse: what the classes of natural breaks can differ by from those of all
    values is where, within the last and smallest bins, a break lies.
    """

    from pyspark.ml.feature import Bucketizer

    def summary(rows: DataFrame) -> list[tuple]:
        got = rows.groupBy("bin").agg(F.min("v"), F.max("v"), F.count("*"), F.avg("v"), F.var_pop("v") * F.count("*"))
        return sorted(tuple(r[1:]) for r in got.collect())  # at most `bins` rows

    if v.select("v").distinct().limit(bins + 1).count() <= bins:
        return summary(v.withColumn("bin", F.col("v")))
    low, high = v.agg(F.min("v"), F.max("v")).head()
    share = max(bins // 4, 2)
    edges = set(v.agg(F.percentile_approx("v", [i / share for i in range(1, share)], 50 * share)).head()[0])
    edges |= {low + (high - low) * i / share for i in range(1, share)}
    while True:
        inner = sorted(e for e in edges if low < e < high)
        found = summary(Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="v", outputCol="bin").transform(v))
        room = bins - len(found)
        wide = [c for c in sorted(found, key=lambda c: -c[4]) if c[0] < c[1]][: room // 3]
        rounds -= 1
        if not wide or rounds < 0:
            return found
        for a, b, *_ in wide:
            edges |= {a + (b - a) * i / 4 for i in (1, 2, 3)}


def jenks(classes: list[tuple[float, float, int, float, float]], k: int) -> list[float]:
    """Natural breaks over the classes of a `histogram` by dynamic programming; of equal costs the first split wins."""
    import numpy as np

    n = len(classes)
    if n <= k:
        return sorted({c[1] for c in classes} | {classes[0][0]} if classes else set())
    low, x, rows, mean, spread = (np.array(c, np.longdouble) for c in zip(*classes, strict=True))
    off = mean - (rows * mean).sum() / rows.sum()
    s, q = np.append(np.longdouble(0), np.cumsum(rows * off)), np.append(np.longdouble(0), np.cumsum(spread + rows * off**2))
    so_far = np.append(np.longdouble(0), np.cumsum(rows))
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]
    width = np.where(j >= i, so_far[1:][None, :] - so_far[:-1][:, None], 1.0)
    cost = np.where(j >= i, (q[1:][None, :] - q[:-1][:, None]) - (s[1:][None, :] - s[:-1][:, None]) ** 2 / width, np.inf)  # of one class from i to j
    best, cuts = cost[0].copy(), []
    for _ in range(1, k):
        options = np.full((n, n), np.inf, np.longdouble)
        options[1:] = best[:-1][:, None] + cost[1:]
        cut = options.argmin(axis=0)
        best = options[cut, np.arange(n)]
        cuts.append(cut)
    at, limits = n - 1, [float(x[-1])]
    for cut in reversed(cuts):
        first = int(cut[at])
        limits.append(float(x[first - 1]))
        at = first - 1
    return sorted({*limits, float(low[0])})


def classify(df: DataFrame, value: str, limits: list[float]) -> DataFrame:
    """Adds `class` from 0: the first class whose upper limit is not below the value; null for no number."""
    v = F.col(value).try_cast("double")
    out: Column = F.lit(None).cast("int")
    for i in range(len(limits) - 1, 0, -1):
        out = F.when(v <= limits[i], F.lit(i - 1)).otherwise(out)
    return df.withColumn("class", F.when(v.isNull() | F.isnan(v) | (v < limits[0]), F.lit(None)).otherwise(out))


def categories(df: DataFrame, value: str, k: int, order: str) -> DataFrame:
    """value, class, n: categories in the order of their first row; those past k share class k as `__other__`."""
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("string").alias("value")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = seen.orderBy("first", "value").limit(k).withColumn("class", F.row_number().over(Window.orderBy("first", "value")) - 1)  # k rows
    rest = seen.join(first.select("value"), "value", "left_anti").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("__other__").alias("value"), F.lit(k).alias("class"), "n")
    return first.select("value", "class", "n").unionAll(rest)


# surfaces


def kde(points: DataFrame, cells: DataFrame, bandwidth: float | None = None, weight: str | None = None, keep: float = 0.1) -> DataFrame:
    """Gaussian density at cell centres (fid, cx, cy), cells of `keep` of the maximum or more; contributions end at 4 bandwidths.

    Default bandwidth: Scott's n^(-1/6) times the mean of the axes' standard deviations.
    """
    w = F.abs(F.col(weight)) if weight else F.lit(1.0)
    n, sx, sy, total = points.agg(F.count("*"), F.stddev_samp("mx"), F.stddev_samp("my"), F.sum(w)).head()
    if not n or not total:
        return cells.limit(0).select("fid", F.lit(0.0).alias("density"))
    if not bandwidth and (n < 2 or not sx + sy):
        raise ValueError("a density of one place needs a bandwidth")
    h = bandwidth or n ** (-1 / 6) * (sx + sy) / 2
    pairs = within_distance(cells.select("fid", F.col("cx").alias("mx"), F.col("cy").alias("my")), points.select("fid", "mx", "my", w.alias("w")), 4 * h)
    dens = pairs.groupBy(F.col("aid").alias("fid")).agg((F.sum(F.col("b_w") * F.exp(-F.col("d") * F.col("d") / (2 * h * h))) / (2 * math.pi * h * h * total)).alias("density"))
    return dens.join(F.broadcast(dens.agg(F.max("density").alias("most")))).where(F.col("density") >= keep * F.col("most")).drop("most")


def idw(points: DataFrame, cells: DataFrame, value: str, k: int = 5, power: float = 2.0) -> DataFrame:
    """Inverse-distance mean of the k nearest points at each cell; points at one place count by their mean, an exact hit gives its value."""
    merged = points.groupBy("mx", "my").agg(F.avg(value).alias("v"), F.min("fid").alias("fid"))
    near = nearest(cells.select("fid", F.col("cx").alias("mx"), F.col("cy").alias("my")), merged, k).join(merged.select(F.col("fid").alias("bid"), "v"), "bid")
    w = F.pow(F.col("d"), -power)
    exact = F.max(F.when(F.col("d") < 1e-9, F.col("v")))
    return near.groupBy(F.col("aid").alias("fid")).agg(F.coalesce(exact, F.sum(F.when(F.col("d") >= 1e-9, F.col("v") * w)) / F.sum(F.when(F.col("d") >= 1e-9, w))).alias("estimate"))


# legends


def legend(df: DataFrame, value: str, kind: str, k: int = 5, method: str = "quantiles") -> DataFrame:
    """Entries of a map legend over all values, a row each: class, low, high, label, n and the place in the palette (0 to 1).

    graduated: the classes of `breaks`, the first with its lower end; categorical: values in the order of their
    frequency, those past k as `__other__`; continuous: the ends; divergent: the ends moved to equal distance from the
    middle of zero, with the middle.
    """
    spark = df.sparkSession
    kind_of = "class int, low double, high double, label string, n long, position double"
    if kind == "categorical":
        counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("string").alias("label")).agg(F.count("*").alias("n"))
        first = counts.orderBy(F.desc("n"), "label").limit(k).withColumn("class", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).cast("int"))  # k rows
        rest = counts.join(first.select("label"), "label", "left_anti").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("__other__").alias("label"), "n", F.lit(k).alias("class"))
        none = F.lit(None).cast("double")
        return first.select("label", "n", "class").unionAll(rest).select("class", none.alias("low"), none.alias("high"), "label", "n", (F.col("class") / F.lit(float(k))).alias("position"))
    v = df.select(F.col(value).try_cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    if kind == "graduated":
        limits = breaks(df, value, method, k)
        classed = classify(v, "v", limits).groupBy("class").agg(F.count("*").alias("n"))
        rows = [(i, a, b, f"{a:.6g} - {b:.6g}", (i / (len(limits) - 2)) if len(limits) > 2 else 0.0) for i, (a, b) in enumerate(zip(limits, limits[1:], strict=False))]
        spec = spark.createDataFrame(rows, "class int, low double, high double, label string, position double")  # k rows
        return spec.join(classed, "class", "left").select("class", "low", "high", "label", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "position")
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("*")).head()
    if not n:
        return spark.createDataFrame([], kind_of)
    if kind == "divergent":
        high = max(abs(low), abs(high))
        low = -high
    ends = [(low, 0.0), (high, 1.0)] if kind == "continuous" else [(low, 0.0), (0.0, 0.5), (high, 1.0)]
    return spark.createDataFrame([(i, x, x, f"{x:.6g}", n, p) for i, (x, p) in enumerate(ends)], kind_of)
