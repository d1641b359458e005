"""Operators without SQL against plain Python over small layers."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.functions import geo
from terralith.operators import clustering, geometry, network, quality, raster, spatial, statistics, temporal
from terralith.sources.vector_tiles import tile_points


@pytest.fixture(scope="module")
def places():
    r = random.Random(11)
    return [(i, r.gauss(5, 2) * 1000, r.gauss(5, 2) * 1000, float(r.randrange(1, 9)), float(r.randrange(0, 40_000))) for i in range(120)]


def layer(spark, rows):
    return spark.createDataFrame(rows, "fid long, mx double, my double, value double, ts double").repartition(3)


def test_heatmap_smooth(spark):
    r = random.Random(2)
    n = {(r.randrange(12), r.randrange(9)): r.randrange(1, 9) for _ in range(25)}
    grid = spark.createDataFrame([(c, w, k) for (c, w), k in n.items()], "col long, row long, n long")
    got = {(x["col"], x["row"]): x["intensity"] for x in spatial.heatmap_smooth(grid, 100.0, 200.0).collect()}
    sigma, reach = 2.0, 6
    around = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    k = lambda i, j: math.exp(-(i * i + j * j) / (2 * sigma * sigma))
    total, v = sum(k(*d) for d in around), {}
    for (c, w), m in n.items():
        for i, j in around:
            v[c + i, w + j] = v.get((c + i, w + j), 0) + m * k(i, j) / total
    kept = {p: x for p, x in v.items() if x >= 0.02 * max(v.values())}
    scale = np.percentile(list(kept.values()), 98)
    assert got.keys() == kept.keys() and all(abs(got[p] - min(1, x / scale)) < 1e-9 for p, x in kept.items())


def test_hull_and_voronoi(spark, places):
    rows = [(*p, "ab"[p[0] % 2]) for p in places] + [(500, 1.0, 1.0, 1.0, 1.0, "c"), (501, 2.0, 2.0, 1.0, 1.0, "c")]
    hulls = {x["kind"]: x for x in geometry.convex_hull(spark.createDataFrame(rows, "fid long, mx double, my double, value double, ts double, kind string").repartition(4), "kind").collect()}
    assert hulls.keys() == {"a", "b"}
    for kind, h in hulls.items():
        ring, mine = [(p["x"], p["y"]) for p in h["ring"]], [(p[1], p[2]) for p in rows if p[5] == kind]
        ring = ring[:-1] if ring[0] == ring[-1] else ring
        assert set(ring) <= set(mine)
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        assert all(turn(a, b, p) >= -1e-6 for a, b in zip(ring, ring[1:] + ring[:1]) for p in mine)
    box = (-4000.0, -4000.0, 14_000.0, 14_000.0)
    cells = {x["fid"]: x for x in geometry.voronoi(layer(spark, places), box).collect()}
    assert len(cells) == len(places) and abs(sum(c["area"] for c in cells.values()) - 18_000.0**2) < 1
    r = random.Random(3)
    for _ in range(300):
        x, y = r.uniform(-4000, 14_000), r.uniform(-4000, 14_000)
        near = sorted(places, key=lambda p: math.hypot(p[1] - x, p[2] - y))
        if math.hypot(near[1][1] - x, near[1][2] - y) - math.hypot(near[0][1] - x, near[0][2] - y) > 1:
            ring = cells[near[0][0]]["ring"]
            assert sum((a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"] for a, b in zip(ring, [*ring[1:], ring[0]])) % 2 == 1


def test_datums(spark):
    """The published pair of Beijing's centre, and the way back."""
    p = spark.createDataFrame([(116.404, 39.915), (2.35, 48.85)], "x double, y double")
    gx, gy = geo.wgs_to_gcj(F.col("x"), F.col("y"))
    p = p.withColumns({"gx": gx, "gy": gy})
    bx, by = geo.gcj_to_bd(F.col("gx"), F.col("gy"))
    wx, wy = geo.gcj_to_wgs(F.col("gx"), F.col("gy"))
    beijing, paris = p.select("gx", "gy", bx.alias("bx"), by.alias("by"), wx.alias("wx"), wy.alias("wy")).orderBy(F.desc("gx")).collect()
    assert np.allclose([beijing["gx"], beijing["gy"]], [116.41024449916938, 39.91640428150164], atol=1e-9)
    assert np.allclose([beijing["bx"], beijing["by"]], [116.41662724378733, 39.922699552216216], atol=1e-8)
    assert np.allclose([beijing["wx"], beijing["wy"]], [116.404, 39.915], atol=1e-7)
    assert (paris["gx"], paris["gy"], paris["wx"]) == (2.35, 48.85, 2.35)


def test_moran_and_neighbours(spark, places):
    """Values that follow the place cluster; dealt at random they do not; the index and the statistic by definition."""
    ordered = [(i, x, y, x + y, t) for i, x, y, _, t in places]
    frame = layer(spark, ordered)
    weights = statistics.knn_weights(frame)
    got = statistics.moran(frame, weights, "value", permutations=99).head()
    near = {p[0]: [q[0] for q in sorted((q for q in places if q[0] != p[0]), key=lambda q: (math.hypot(q[1] - p[1], q[2] - p[2]), q[0]))[:8]] for p in places}
    z = {p[0]: p[3] - np.mean([q[3] for q in ordered]) for p in ordered}
    want = sum(z[i] * z[j] for i, js in near.items() for j in js) / (8 * len(z)) / np.mean([v * v for v in z.values()])
    assert abs(got["moran_i"] - want) < 1e-5 and got["p_value"] == 0.01 and got["pattern"] == "clustering"
    r = random.Random(5)
    mixed = layer(spark, [(i, x, y, r.random(), t) for i, x, y, _, t in places])
    assert 0.02 < statistics.moran(mixed, weights, "value", permutations=99).head()["p_value"] <= 1
    d = [min(math.hypot(p[1] - q[1], p[2] - q[2]) for q in places if q is not p) for p in places]
    side = [max(p[k] for p in places) - min(p[k] for p in places) for k in (1, 2)]
    index = statistics.nearest_neighbour_index(frame).head()
    assert abs(index["mean_distance"] - np.mean(d)) < 1e-3 and abs(index["ratio"] - np.mean(d) / (0.5 * math.sqrt(side[0] * side[1] / len(d)))) < 1e-3
    cells = spark.createDataFrame([(q, w, 10.0 if q < 0 else 1.0 + (q * w % 3) / 10) for q in range(-6, 7) for w in range(-6, 7)], "q long, r long, stat double")
    local = {(x["q"], x["r"]): x for x in statistics.lisa(cells, "stat", permutations=99).collect()}
    assert local[-4, 0]["quadrant"] == "HH" and local[4, 1]["quadrant"] == "LL"
    assert local[-4, 0]["p_value"] < 0.05 and all(0 < x["p_value"] <= 1 for x in local.values())


def test_space_time_clusters(spark, places):
    eps, wait, least = 900.0, 9000.0, 4
    close = {p[0]: {q[0] for q in places if math.hypot(p[1] - q[1], p[2] - q[2]) <= eps and abs(p[4] - q[4]) <= wait} for p in places}
    cores = {i for i, n in close.items() if len(n) >= least}
    seen, parts = set(), []
    for c in sorted(cores):
        if c not in seen:
            part, todo = set(), [c]
            while todo:
                i = todo.pop()
                if i not in part:
                    part.add(i)
                    todo += [j for j in close[i] & cores if j not in part]
            seen |= part
            parts.append(part)
    number = {i: k for k, part in enumerate(parts) for i in part}
    want = {i: number[i] if i in cores else min((number[j] for j in close[i] & cores), default=-1) for i in close}
    got = clustering.st_dbscan(layer(spark, places), eps, wait, least).collect()
    assert {x["fid"]: x["cluster"] for x in got} == want and {x["fid"] for x in got if x["is_core"]} == cores and len(parts) > 1
    spots = {x["cluster"]: x for x in clustering.space_time_hotspots(layer(spark, places), eps, wait, least).collect()}
    for k, s in spots.items():
        mine = [p for p in places if want[p[0]] == k]
        assert s["n"] == len(mine) and abs(s["mx"] - np.mean([p[1] for p in mine])) < 1e-6 and (s["first"], s["last"]) == (min(p[4] for p in mine), max(p[4] for p in mine))
    assert spots.keys() == set(range(len(parts)))


def test_kmeans(spark):
    """Well separated crowds are told apart, numbered by their first member; k is at most the number of points."""
    r = random.Random(1)
    rows = [(i, 1000.0 * (i % 3) + r.random(), 500.0 * (i % 3) + r.random(), 1.0, 0.0) for i in range(60)]
    got = {x["fid"]: x["cluster"] for x in clustering.kmeans(layer(spark, rows), 3, ["mx", "my"]).collect()}
    assert got == {i: i % 3 for i in range(60)}


def test_grids_and_tiles(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(5, 6))
    for factor in (2, 3):
        got = {(x["row"], x["col"]): x["v"] for x in raster.upsample_bilinear(spark.createDataFrame([(i, j, float(v[i, j])) for i in range(5) for j in range(6)], "row long, col long, v double"), factor).collect()}
        assert len(got) == 30 * factor * factor
        for (row, col), x in got.items():
            a, b = (row + 0.5) / factor - 0.5, (col + 0.5) / factor - 0.5
            w = {(i, j): max(0, 1 - abs(a - i)) * max(0, 1 - abs(b - j)) for i in range(5) for j in range(6)}
            assert abs(x - sum(w[k] * v[k] for k in w) / sum(w.values())) < 1e-9
    points = [(i, x, y) for i, (x, y) in enumerate([(116.4, 39.9), (-73.9, 40.7), (0.0, 0.0), (179.999, -85.0), (12.5, 55.6)])]
    for t in tile_points(spark.createDataFrame(points, "fid long, x double, y double"), [0, 9]).collect():
        _, x, y = points[t["fid"]]
        n = 2 ** t["z"]
        u, w = (x + 180) / 360 * n, (1 - math.asinh(math.tan(math.radians(y))) / math.pi) / 2 * n
        assert (t["tx"], t["ty"]) == (int(u), int(w)) and abs((u - t["tx"]) * 4096 - t["px"]) <= 1 and abs((w - t["ty"]) * 4096 - t["py"]) <= 1


def streets():
    """Lines of a crooked grid, one-way and slow ones among them."""
    r = random.Random(8)
    place = {(i, j): (116 + 0.01 * i + r.uniform(0, 0.003), 39 + 0.01 * j + r.uniform(0, 0.003)) for i in range(5) for j in range(5)}
    lines = [[place[i, j] for j in range(5)] for i in range(5)] + [[place[i, j] for i in range(5)] for j in range(5)]
    return [(k, [{"x": x, "y": y} for x, y in p], ["no", "yes", "-1", None][k % 4], [50.0, 0.0, None][k % 3]) for k, p in enumerate(lines)]


def metres(a, b):
    d = [math.radians(b[k] - a[k]) for k in "xy"]
    h = math.sin(d[1] / 2) ** 2 + math.cos(math.radians(a["y"])) * math.cos(math.radians(b["y"])) * math.sin(d[0] / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def test_network_of_lines(spark):
    rows = streets()
    nodes, edges = network.build_edges(spark.createDataFrame(rows, "fid long, points array<struct<x:double,y:double>>, one_way string, speed_kmh double"))
    want = {}
    for _, points, one, speed in rows:
        for a, b in itertools.pairwise(points):
            for u, v in [(a, b)] if one == "yes" else [(a, b), (b, a)]:
                key = tuple(":".join(str(round(p[k] / 1e-5)) for k in "xy") for p in (u, v))
                want.setdefault(key, (metres(a, b), metres(a, b) / ((speed or 40.0) / 3.6)))
    got = {(e["u"], e["v"]): (e["length_m"], e["time_s"]) for e in edges.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want) and nodes.count() == 25

    timed = edges.select("u", "v", F.col("time_s").alias("cost"))
    some = sorted(want)[::7]
    barriers = spark.createDataFrame([(u, v, None if i % 2 else 3.0) for i, (u, v) in enumerate(some)], "u string, v string, factor double")
    hard = {k: c[1] * (3.0 if k in some else 1.0) for k, c in want.items() if k not in some or some.index(k) % 2 == 0}
    got = {(e["u"], e["v"]): e["cost"] for e in network.apply_barriers(timed, barriers).collect()}
    assert got.keys() == hard.keys() and all(abs(got[k] - hard[k]) < 1e-9 for k in hard)

    # the cheapest way with turns, by a search over (node, node before)
    at = {n["node"]: n for n in nodes.collect()}
    heading = lambda u, v: math.degrees(math.atan2((at[v]["x"] - at[u]["x"]) * math.cos(math.radians((at[u]["y"] + at[v]["y"]) / 2)), at[v]["y"] - at[u]["y"])) % 360
    bend = lambda a, b: abs((b - a + 180) % 360 - 180)
    origin, destination = min(at), max(at)
    queue, done = [(0.0, origin, "")], {}
    while queue:
        cost, u, before = heapq.heappop(queue)
        if (u, before) in done:
            continue
        done[u, before] = cost
        for (a, v), (_, step) in want.items():
            if a == u:
                heapq.heappush(queue, (cost + step + (20.0 if before and bend(heading(before, u), heading(u, v)) > 25 else 0.0), v, u))
    path = network.turn_aware_path(nodes, timed, origin, destination, 20.0).orderBy("seq").collect()
    assert (origin, path[0]["node"]) in want and path[-1]["node"] == destination
    assert abs(path[-1]["cost"] - min(c for (n, _), c in done.items() if n == destination)) < 1e-6
    line = network.turn_edges(nodes, timed, 20.0).collect()
    assert len(line) == sum(1 for a, b in want for c, d in want if b == c)


def test_small_helpers(spark, places):
    assert [network.break_cutoff(2, u) for u in ("minutes", "seconds", "m", "km")] == [120, 2, 2, 2000]
    with pytest.raises(raster.RasterLimitError):
        raster.guard(20_000, 20_000, 1.0)
    raster.guard(100, 100, 2.0)
    years = temporal.year_axis(spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("a", "2021-01-01 06:00:00"), ("b", "1999-05-05 00:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t")), "t", ["k"])
    assert sorted((x["k"], round(x["years"], 6)) for x in years.collect()) == [("a", 0.0), ("a", round(366.25 / 365.25, 6)), ("b", 0.0)]
    areas = network.travel_areas(layer(spark, places[:2]), 10.0, "walking").collect()
    for a in areas:
        assert abs(max(p["x"] for p in a["ring"]) - a["mx"] - network.AREA_SPEEDS["walking"] * 1000 / 6) < 1e-6


def _grouped(points, eps, wait, least):
    """Cluster by point of (fid, mx, my, ts) and the core points: neighbours by comparing all pairs."""
    fid, at, t = np.array([p[0] for p in points]), np.array([p[1:3] for p in points]), np.array([p[3] for p in points])
    close = (np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)) <= eps) & (np.abs(t[:, None] - t[None]) <= wait)
    core = close.sum(1) >= least
    number, n = np.full(len(fid), -1), 0
    for i in np.argsort(fid):
        if core[i] and number[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if number[j] < 0:
                    number[j] = n
                    todo += list(np.flatnonzero(close[j] & core & (number < 0)))
            n += 1
    edge = {i: min((number[j] for j in np.flatnonzero(close[i] & core)), default=-1) for i in np.flatnonzero(~core)}
    return {int(fid[i]): int(edge.get(i, number[i])) for i in range(len(fid))}, {int(f) for f in fid[core]}


def test_space_time_clusters_by_cells(spark):
    """Areas from sparse to dense, strips apart by about the reach in space and in time, and points of no place."""
    r = random.Random(11)
    eps, wait, least = 10.0, 100.0, 4
    rows = []
    for area, (n, wide, long) in enumerate([(150, 80, 400), (150, 45, 300), (150, 30, 250), (120, 20, 100), (60, 3, 50)]):
        rows += [(1000.0 * area + r.random() * wide, r.random() * wide, r.random() * long) for _ in range(n)]
    rows += [(7000 + k * 10.5 + r.random() * 1.5, r.random() * 9, r.random() * 40) for k in range(8) for _ in range(20)]
    rows += [(8000 + r.random() * 9, r.random() * 9, k * 104 + r.random() * 16) for k in range(8) for _ in range(15)]
    rows += [(9000 + k * 8 + r.random() * 1.2, k * 8 + r.random() * 1.2, k * 60 + r.random() * 10) for k in range(12) for _ in range(8)]
    r.shuffle(rows)
    points = [(i, *p) for i, p in enumerate(rows)]
    want, cores = _grouped(points, eps, wait, least)
    odd = [(len(points), None, 1.0, 1.0), (len(points) + 1, float("nan"), 1.0, 1.0)]
    frame = spark.createDataFrame(points + odd, "fid long, mx double, my double, ts double")
    got = clustering.st_dbscan(frame, eps, wait, least).collect()
    assert {x["fid"]: x["cluster"] for x in got} == want | {p[0]: -1 for p in odd} and {x["fid"] for x in got if x["is_core"]} == cores
    assert len(set(want.values())) > 10 and -1 in want.values()
