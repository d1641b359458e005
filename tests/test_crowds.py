"""Many rows at few places: operators pair places, so that crowds neither fail nor multiply."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terralith.operators import clustering, quality, spatial, statistics

N = 30_000


@pytest.fixture(scope="module")
def crowd(spark):
    """Rows at five places (0, 0), (10, 0), ... (40, 0) in turn, an eighth of a second apart."""
    return spark.range(N).select(F.col("id").alias("fid"), (F.col("id") % 5 * 10).cast("double").alias("mx"), F.lit(0.0).alias("my"), F.lit(2.0).alias("value"), (F.col("id") / 8).alias("ts"))


def test_nearest(spark, crowd):
    got = spatial.nearest(crowd, crowd, 3, by_self=True)
    assert got.count() == 3 * N
    one = {r["aid"]: r["near"] for r in got.where("aid IN (0, 5, 29999)").groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("rank", "bid", "d"))).alias("near")).collect()}
    assert {k: [(n["rank"], n["bid"], n["d"]) for n in v] for k, v in one.items()} == {0: [(1, 5, 0.0), (2, 10, 0.0), (3, 15, 0.0)], 5: [(1, 0, 0.0), (2, 10, 0.0), (3, 15, 0.0)], 29999: [(1, 4, 0.0), (2, 9, 0.0), (3, 14, 0.0)]}


def test_neighbour_sums(crowd):
    each = N // 5
    got = {tuple(r) for r in spatial.neighbour_sums(crowd, 10.0, "value").where("fid IN (0, 1)").collect()}
    assert got == {(0, 2 * each, 10.0 * each, 4.0 * each), (1, 3 * each, 20.0 * each, 6.0 * each)}


def test_neighbour_sums_with_lag(crowd):
    assert {tuple(r) for r in spatial.neighbour_sums(crowd, 5.0, lag=("ts", 1.25)).where("fid IN (0, 100)").select("fid", "n").collect()} == {(0, 3), (100, 5)}


def test_hot_spots(crowd):
    gi = statistics.getis_ord(crowd.withColumn("value", F.col("mx")), "value", 1.0)
    assert gi.count() == N


def test_dbscan(crowd):
    got = clustering.dbscan(crowd, 5.0, N // 5).groupBy("cluster", "is_core").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.collect()} == {(k, True, N // 5) for k in range(5)}


def test_st_dbscan(crowd):
    got = clustering.st_dbscan(crowd, 5.0, 1.25, 5).groupBy("cluster").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.collect()} == {(k, N // 5) for k in range(5)}


def test_dangling_ends(spark, crowd):
    far = spark.createDataFrame([(N, 500.0, 0.0), (N + 1, 45.0, 0.0)], "fid long, mx double, my double")
    assert [r[0] for r in quality.dangling_ends(crowd.select("fid", "mx", "my").unionAll(far), 6.0).collect()] == [N]


def test_central_feature(spark):
    r = random.Random(4)
    rows = [(i, float(r.randrange(60)), float(r.randrange(60))) for i in range(6000)]
    got = statistics.central_feature(spark.createDataFrame(rows, "fid long, mx double, my double")).collect()
    spots = {}
    for i, x, y in rows:
        spots.setdefault((x, y), []).append(i)
    total, fid = min((sum(len(v) * math.hypot(x - a, y - b) for (a, b), v in spots.items()), ids[0]) for (x, y), ids in spots.items())
    assert got[0]["fid"] == fid and got[0]["total"] == pytest.approx(total, abs=0.01)


def test_overlapping(spark):
    box = lambda x: [(x, 0.0), (x + 0.4, 0.0), (x + 0.4, 0.4), (x, 0.4), (x, 0.0)]
    rows = [(i, [{"x": a, "y": b} for a, b in box([0.0, 0.1, 3.0][i % 3])]) for i in range(12)]
    df = spark.createDataFrame(rows, "fid long, ring array<struct<x double, y double>>")
    group = lambda i: i % 3 // 2
    want = sorted((a, b) for a in range(12) for b in range(a + 1, 12) if group(a) == group(b))
    assert sorted(tuple(r) for r in quality.overlapping(df).collect()) == want


def test_st_dbscan_where_all_differ(spark):
    """60 000 points, no two at one place or time, some 10^9 pairs of them neighbours: cells decide, no pair is made."""
    points = spark.range(2 * N).select(F.col("id").alias("fid"), (F.col("id") * 7919 % 100_003 / 5000.0).alias("mx"), (F.col("id") * 104_729 % 99_991 / 5000.0).alias("my"), (F.col("id") / 300).alias("ts"))
    got = clustering.st_dbscan(points, 15.0, 100.0, 5).groupBy("cluster", "is_core").agg(F.count("*").alias("n"))
    assert [tuple(r) for r in got.collect()] == [(0, True, 2 * N)]


def test_neighbour_sums_by_blocks(spark, monkeypatch):
    """Several blocks in a cell, places of many rows, distances of exactly the limit, and a row of no place."""
    monkeypatch.setattr(spatial, "BLOCK", 60)
    r = random.Random(8)
    rows = [(i, float(r.randrange(-20, 45)), float(r.randrange(12)) * 0.5) for i in range(2500)]
    got = {x["fid"]: (x["n"], x["total"]) for x in spatial.neighbour_sums(spark.createDataFrame([*rows, (2500, float("nan"), 0.0)], "fid long, mx double, my double"), 5.0).collect()}
    assert got.keys() == set(range(2500))
    for i, x, y in rows[:150]:
        near = [d for d in (math.sqrt((x - a) ** 2 + (y - b) ** 2) for _, a, b in rows) if d <= 5.0]
        assert got[i] == (len(near), pytest.approx(sum(near), rel=1e-12))
