"""Unions, differences and repairs of polygons against rasters of unit cells and points drawn at random."""

import random

import pytest
from pyspark.sql import functions as F

from terralith.functions.geo import RING
from terralith.operators.geometry import buffer_shapes
from terralith.operators.planar import combine, dissolve_union, make_valid

SHAPE = f"key string, layer int, ring {RING}"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def points(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def area(ring):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:])) / 2


def inside(x, y, ring):
    return sum((a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"] for a, b in zip(ring, [*ring[1:], ring[0]])) % 2 == 1


def holds(rows, x, y):
    return sum(inside(x, y, r["ring"]) and not any(inside(x, y, h) for h in r["holes"]) for r in rows)


def proper(rows):
    for r in rows:
        assert area(r["ring"]) > 0 and all(area(h) < 0 for h in r["holes"]) and r["ring"][0] == r["ring"][-1]
        assert abs(area(r["ring"]) + sum(map(area, r["holes"])) - r["area"]) < 1e-9


@pytest.mark.parametrize("how", ["intersection", "difference", "symmetric_difference"])
def test_boxes(spark, how):
    """Overlapping, touching, repeated and nested boxes of whole numbers: the same unit cells as counted one by one."""
    r = random.Random(4)
    rows = []
    for key in "abc":
        for i in range(25):
            x, y, w, h = r.randrange(20), r.randrange(20), r.randrange(1, 7), r.randrange(1, 7)
            rows.append((key, i % 2, box(x, y, x + w, y + h)[:: r.choice([1, -1])]))
    rows += [("d", 0, box(0, 0, 9, 9)), ("d", 0, box(0, 0, 9, 9)), ("d", 1, box(2, 2, 4, 4)), ("d", 1, box(4, 4, 6, 6)), ("e", 0, [(0, 0), (1, 0)]), ("e", 0, None)]
    frame = spark.createDataFrame([(k, n, points(x) if x else None) for k, n, x in rows], SHAPE).repartition(5)
    got = combine(frame, how, 1e-3).collect()
    proper(got)
    rule = {"intersection": lambda a, b: a and b, "difference": lambda a, b: a and not b, "symmetric_difference": lambda a, b: a != b}[how]
    for key in "abcd":
        mine = [x for x in got if x["key"] == key]
        cells = [(i, j) for i in range(27) for j in range(27) if rule(*(any(min(p[0] for p in s) <= i < max(p[0] for p in s) and min(p[1] for p in s) <= j < max(p[1] for p in s) for k, n, s in rows if k == key and n == layer) for layer in (0, 1)))]
        assert abs(sum(x["area"] for x in mine) - len(cells)) < 1e-6
        assert all(holds(mine, i + 0.5, j + 0.5) == ((i, j) in set(cells)) for i in range(27) for j in range(27))
    if how == "difference":
        assert [len(x["holes"]) for x in got if x["key"] == "d"] == [1]  # two that touch in a point are one ring, so that what is left stays whole


@pytest.mark.parametrize("how", ["union", "difference"])
def test_triangles(spark, how):
    """Random triangles, some long and thin: points belong to the result where they should, and to one polygon only."""
    r = random.Random(8)
    rows = [(k, i % 2, [(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(3)]) for k in "pq" for i in range(14)]
    got = combine(spark.createDataFrame([(k, n, points(x)) for k, n, x in rows], SHAPE), how, 1e-6).collect()
    proper(got)
    rule = {"union": lambda a, b: a or b, "difference": lambda a, b: a and not b}[how]
    for key in "pq":
        mine = [x for x in got if x["key"] == key]
        for _ in range(3000):
            x, y = r.uniform(0, 10), r.uniform(0, 10)
            a, b = (any(inside(x, y, points(s)) for k, n, s in rows if k == key and n == layer) for layer in (0, 1))
            assert holds(mine, x, y) == int(rule(a, b))


def test_dissolve_shared_borders_and_corners(spark):
    """A ring of cells around a gap, corners that touch, borders shared in part; null keys are a group."""
    cells = [(1, x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(2, 0, 0), (2, 1, 1), (None, 0, 0), (None, 1, 0)]
    rows = [(k, "t", points(box(x * 0.1, y * 0.1, x * 0.1 + 0.1, y * 0.1 + 0.1))) for k, x, y in cells] + [(3, "t", points(box(0, 0, 2, 1))), (3, "t", points(box(0, 1, 1, 2))), (3, "t", points(box(1, 1, 1.5, 3)))]
    got = dissolve_union(spark.createDataFrame(rows, f"k int, tag string, ring {RING}"), ["k", "tag"]).collect()
    by = {}
    for x in got:
        by.setdefault(x["k"], []).append((len(x["ring"]) - 1, len(x["holes"]), round(x["area"], 6)))
    assert by == {1: [(4, 1, 0.08)], 2: [(4, 0, 0.01)] * 2, None: [(4, 0, 0.02)], 3: [(8, 0, 4.0)]}


def test_make_valid(spark):
    star = [(0, 3), (2, -3), (-3, 1), (3, 1), (-2, -3)]
    rows = [
        (1, box(0, 0, 2, 2), 4.0, 1, 0),
        (2, [(0, 0), (2, 2), (2, 0), (0, 2)], 2.0, 2, 0),  # bow tie
        (3, [(0, 0), (4, 0), (4, 4), (6, 4), (4, 4), (0, 4)], 16.0, 1, 0),  # spike
        (4, [(0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2)], 32.0, 1, 1),  # a hole on a string
        (5, [(0, 0), (1, 0), (2, 0)], 0.0, 0, 0),
        (6, [], 0.0, 0, 0),
    ]
    got = make_valid(spark.createDataFrame([(i, points(x)) for i, x, *_ in rows] + [(7, points(star)), (8, None)], f"fid int, ring {RING}"), unit=1e-6).collect()
    proper(got)
    for i, _, size, parts, holes in rows:
        mine = [x for x in got if x["fid"] == i]
        assert (round(sum(x["area"] for x in mine), 6), len(mine), sum(len(x["holes"]) for x in mine)) == (size, parts, holes), i
    mine, r = [x for x in got if x["fid"] == 7], random.Random(2)
    assert len(mine) == 5 and not [x for x in got if x["fid"] == 8]
    for _ in range(2000):
        x, y = r.uniform(-3, 3), r.uniform(-3, 3)
        assert holds(mine, x, y) == int(inside(x, y, points(star)))


def test_make_valid_with_rings_in_rings(spark):
    rows = [(1, points(box(0, 0, 10, 10)), [points(box(2, 2, 8, 8)), points(box(4, 4, 6, 6))]), (2, points(box(0, 0, 10, 10)), [points(box(5, 5, 15, 8))])]
    got = make_valid(spark.createDataFrame(rows, f"fid int, ring {RING}, holes array<{RING}>"), unit=1e-6).select("fid", F.round("area", 6), F.size("holes")).collect()
    assert sorted(map(tuple, got)) == [(1, 4.0, 0), (1, 64.0, 1), (2, 15.0, 0), (2, 85.0, 0)]


def test_nothing(spark):
    none = spark.createDataFrame([], SHAPE)
    assert combine(none).count() == 0 and make_valid(none.select(F.lit(1).alias("fid"), "ring")).count() == 0


def test_buffers(spark):
    """Points drawn at random are within the buffer if their distance says so; borders come off polygons; dissolved by a column."""
    import math

    r = random.Random(3)
    bent, square, gap = [(0, 0), (10, 0), (10, 8), (4, 3)], box(0, 0, 20, 20), box(6, 6, 12, 12)
    rows = [(1, "line", [bent], "a"), (2, "polygon", [square, gap], "a"), (3, "point", [[(30, 30)], [(31, 30)]], None), (4, "polygon", [box(0, 0, 1, 1)], "b"), (5, "line", None, "b"), (6, "polygon", [], "c")]
    shapes = spark.createDataFrame([(i, k, None if p is None else [points(q) for q in p], t) for i, k, p, t in rows], f"fid int, kind string, parts array<{RING}>, tag string")

    def gap_to(x, y, lines):
        def far(a, b):
            t = max(0, min(1, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / (math.dist(a, b) ** 2 or 1)))
            return math.hypot(a[0] + t * (b[0] - a[0]) - x, a[1] + t * (b[1] - a[1]) - y)

        return min(far(a, b) for p in lines for a, b in zip(p, p[1:] or p))

    wide, less = (buffer_shapes(shapes, d).collect() for d in (2.0, -1.0))
    proper(wide + less)
    assert {x["fid"] for x in wide} == {1, 2, 3, 4} and {x["fid"] for x in less} == {2}
    assert len(less) == 1 and abs(less[0]["area"] - (18 * 18 - 6 * 6 - 4 * 6 - 16 * math.sin(2 * math.pi / 32))) < 1e-3
    for _ in range(2500):
        i, k, p, _ = rows[r.randrange(3)]
        x, y = r.uniform(-3, 34), r.uniform(-3, 34)
        d, solid = gap_to(x, y, p), k == "polygon" and inside(x, y, points(square)) and not inside(x, y, points(gap))
        if not 2 * math.cos(math.pi / 32) - 1e-3 <= d <= 2.001:
            assert holds([w for w in wide if w["fid"] == i], x, y) == int(solid or d < 2)
        if k == "polygon" and not math.cos(math.pi / 32) - 1e-3 <= d <= 1.001:
            assert holds(less, x, y) == int(solid and d > 1)
    both = buffer_shapes(shapes, 2.0, by=["tag"]).collect()
    assert {x["tag"] for x in both} == {"a", "b", None} and len([x for x in both if x["tag"] is None]) == 1
