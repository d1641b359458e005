"""Contours against the pixels themselves, interpolated crossings and known areas."""

import math

import numpy as np
import pytest

from terralith.operators.contours import contours

from .test_planar import holds, proper


def frame(spark, v):
    return spark.createDataFrame([(r, c, float(v[r, c])) for r in range(v.shape[0]) for c in range(v.shape[1]) if not math.isnan(v[r, c])], "row long, col long, v double").repartition(4)


def test_random_surface(spark):
    """Each pixel is inside where it reaches the level, each crossing between neighbours lies on a ring; gaps and flat parts."""
    r = np.random.default_rng(4)
    v = r.integers(0, 6, (14, 17)).astype(float)  # whole numbers: many values equal a level
    v[r.integers(0, 14, 20), r.integers(0, 17, 20)] = np.nan
    levels = [1.0, 2.5, 4.0]
    got = contours(frame(spark, v), levels, unit=1e-5).collect()
    proper(got)
    full = np.pad(np.nan_to_num(v), 1)
    for level in levels:
        mine = [x for x in got if x["level"] == level]
        steps = np.array([(a["x"], a["y"], b["x"], b["y"]) for x in mine for ring in (x["ring"], *x["holes"]) for a, b in zip(ring, ring[1:])])

        def off(x, y, a=steps[:, :2], d=steps[:, 2:] - steps[:, :2]):
            t = np.clip((((x, y) - a) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
            return np.hypot(*((x, y) - a - t[:, None] * d).T).min()

        for row in range(-1, 15):
            for col in range(-1, 18):
                here = full[row + 1, col + 1]
                if here != level:
                    assert holds(mine, col + 1e-7, row + 1.3e-7) == int(here > level), (level, row, col)
                if col < 17 and (here - level) * (full[row + 1, col + 2] - level) < 0:
                    assert off(col + (level - here) / (full[row + 1, col + 2] - here), row) < 1e-4


def test_cone(spark):
    y, x = np.mgrid[0:61, 0:61]
    v = 30 - np.hypot(x - 30, y - 30)
    ring = np.where(np.hypot(x - 30, y - 30) < 8, 0.0, v)
    got = {x["level"]: x for x in contours(frame(spark, v), [5.0, 20.0], x0=100.0, y0=50.0, dx=0.5, dy=-0.5).collect()}
    proper(got.values())
    assert abs(got[5.0]["area"] - math.pi * 12.5**2) < 3 and abs(got[20.0]["area"] - math.pi * 25) < 1
    assert abs(np.mean([p["x"] for p in got[20.0]["ring"][:-1]]) - 115) < 0.1 and abs(np.mean([p["y"] for p in got[20.0]["ring"][:-1]]) - 35) < 0.1
    (one,) = contours(frame(spark, ring), [15.0]).collect()
    assert len(one["holes"]) == 1
    with pytest.raises(ValueError):
        contours(frame(spark, v), [0.0])


def test_nothing(spark):
    assert contours(spark.createDataFrame([], "row long, col long, v double"), [1.0]).count() == 0
