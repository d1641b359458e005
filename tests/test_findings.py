"""Cases that reviews of larger tables found."""

import math

import pytest
from pyspark.sql import functions as F

from terralith.functions.geo import rectangle
from terralith.operators import geometry, network, overlays, planar, relational
from terralith.plans import extras, places, surfaces
from terralith.sources.vector_tiles import vector_tiles

from .compare import differences, duck


def test_baseline_counts_slivers(spark):
    """A box that reaches over the border by no more than a rounding error counts, one that ends at the border does not."""
    rows = spark.createDataFrame([(math.nextafter(116.15, 117), 1.0), (116.15, 9.0)], "x1 double, v double")
    boxes = rows.select(rectangle(F.lit(116.12), F.lit(39.6), F.col("x1"), F.lit(39.62)).alias("ring"), "v")
    got = overlays.baseline(boxes, [(116.15, 39.55), (116.65, 39.55), (116.65, 39.95), (116.15, 39.95)], ["v"]).collect()
    assert [tuple(r) for r in got] == [(1, 1.0)]


def test_points_beside_a_side(spark):
    """Points on or a rounding error off the sides of a triangle: the sign of the products decides."""
    triangle = [(116.1, 39.6), (116.9, 39.7), (116.5, 40.3)]
    ends = list(zip(triangle, triangle[1:] + triangle[:1], strict=True))
    at = [(116.0 + (100 + 8 * k) / 1000.0, 39.5 + (100 + k) / 1000.0) for k in range(101)] + [(116.0 + (900 - 2 * k) / 1000.0, 39.5 + (200 + 3 * k) / 1000.0) for k in range(201)]
    want = {i for i, (x, y) in enumerate(at) if min((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in ends) > 0}
    pois = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "fid long, x double, y double")
    for polygon in (triangle, [*triangle, triangle[0]]):
        assert {r["fid"] for r in relational.poi_filter(pois, polygon=polygon).collect()} == want


def test_star_is_not_convex():
    star = [(0.0, 3.0), (2.0, -3.0), (-3.0, 1.0), (3.0, 1.0), (-2.0, -3.0)]
    assert relational._convex_sides(F.lit(0.0), F.lit(0.0), star) is None


def test_contour_levels_without_area(spark, monkeypatch, sf):
    monkeypatch.setattr(surfaces, "LEVELS", [20.0, 1e6])
    assert {r["level"]: r["area"] > 0 for r in surfaces._contours(spark, sf).collect()} == {20.0: True, 1e6: False}


def test_tile_of_many_points(spark):
    points = spark.range(110_000).select(F.col("id").alias("fid"), (F.col("id") % 400 / 400.0).alias("x"), (F.floor(F.col("id") / 400) / 400.0).alias("y"))
    got = vector_tiles(points, [7], slice_rows=1000).select("n", F.length("tile").alias("bytes")).collect()
    assert sum(r["n"] for r in got) == 110_000 and all(r["bytes"] > 8 * r["n"] for r in got)


def test_first_sites(spark):
    got = network.first_sites(spark.range(20).select(F.col("id").alias("did"), (F.col("id") % 2).alias("node")), 3)
    assert sorted(r["did"] for r in got.collect()) == [0, 1, 2, 3, 4, 5]


@pytest.fixture
def squares(spark):
    return spark.range(60).select(F.col("id").alias("fid"), rectangle(*(F.lit(v) + F.col("id") % 2 * 5.0 for v in (0.0, 0.0, 2.0, 2.0))).alias("ring"))


def test_equal_shapes_once(squares):
    same = planar.alike(squares, "fid", ["ring"])
    assert {tuple(r) for r in same.groupBy("_one").count().collect()} == {(0, 30), (1, 30)}
    assert {tuple(r) for r in planar.make_valid(squares, unit=1e-3).groupBy(F.round("area", 6)).count().collect()} == {(4.0, 60)}
    shapes = squares.select("fid", F.lit("polygon").alias("kind"), F.array("ring").alias("parts"))
    assert {tuple(r) for r in geometry.buffer_shapes(shapes, -0.5).groupBy(F.round("area", 3)).count().collect()} == {(1.0, 60)}


def _suppliers(spark, folder, n):
    spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey")).coalesce(1).write.parquet(f"{folder}/part")
    (folder / "supplier.parquet").symlink_to(next((folder / "part").glob("*.parquet")))
    return str(folder)


def test_streets_beyond_the_others(spark, tmp_path):
    """Of 1000 facilities some stand east of the end of every street from west to east; lines have no end, so their streets are cut too."""
    query, sql = extras.PLANS["network_crossings"]
    at = _suppliers(spark, tmp_path, 1000)
    assert differences(query(spark, at), duck(at), sql) == ""


def test_cut_streets(spark):
    """Lines at one place or at a street's end, and those that run the same way, make no vertex."""
    streets = spark.createDataFrame([(1, True, 0.0, 1.0), (2, True, 0.0, 1.0), (3, True, 0.5, 3.0), (4, False, 0.0, 1.0), (5, False, 8.0, 9.0)], "fid long, across boolean, low double, high double")
    lines = spark.createDataFrame([(False, 0.2), (False, 0.2), (False, 0.7), (False, 1.0), (True, 0.5)], "across boolean, at double")
    assert {tuple(r) for r in network.cut_streets(streets, lines).collect()} == {(1, 4), (2, 4), (3, 4), (4, 3), (5, 2)}


def test_crossings_by_other_lines(spark):
    line = lambda fid, *ends: (fid, [{"x": x, "y": y} for x, y in ends])
    kind = "fid long, points array<struct<x double, y double>>"
    a = spark.createDataFrame([line(1, (0.0, 0.0), (1.0, 1.0), (2.0, 0.0)), line(2, (0.0, 1.0), (1.0, 0.0))], kind)
    b = spark.createDataFrame([line(1, (0.75, -1.0), (0.75, 3.0))], kind)
    cut = lambda by: {r["fid"]: [(round(p["x"], 6), round(p["y"], 6)) for p in r["points"]] for r in network.split_crossings(a, 0.1, by).collect()}
    assert cut(b) == {1: [(0.0, 0.0), (0.75, 0.75), (1.0, 1.0), (2.0, 0.0)], 2: [(0.0, 1.0), (0.75, 0.25), (1.0, 0.0)]}
    assert cut(None) == {1: [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (2.0, 0.0)], 2: [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)]}


def test_streets_of_many_facilities(spark, tmp_path):
    """20 000 facilities: streets and lines grow with the table, their product (hundreds of millions of vertices) is not written."""
    query, sql = extras.PLANS["network_crossings"]
    at = _suppliers(spark, tmp_path, 20_000)
    assert differences(query(spark, at), duck(at), sql) == ""


def test_customers_at_places_of_their_own(spark, tmp_path):
    """Customers a thousand keys apart stood at one place, so that at any size 1000 places were paired."""
    query, sql = places.PLANS["distance_band"]
    keys = spark.range(400).select((F.col("id") * 1000).alias("c_custkey"), F.lit(1.0).alias("c_acctbal"), F.lit("x").alias("c_mktsegment"))
    keys.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "customer.parquet").symlink_to(next((tmp_path / "part").glob("*.parquet")))
    got = query(spark, str(tmp_path))
    assert differences(got, duck(str(tmp_path)), sql) == ""
    assert got.agg(F.max("n")).head()[0] < 20 and got.where("n > 1 AND total = 0").count() == 0
