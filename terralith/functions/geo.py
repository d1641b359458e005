"""Geometry as column expressions. A ring is an array of (x, y) structs, closed or not; a point is two doubles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def haversine_m(x1, y1, x2, y2) -> Column:
    """Great-circle metres between points in degrees."""
    x1, y1, x2, y2 = map(_d, (x1, y1, x2, y2))
    a = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bbox_intersects(a: list[Column], b: list[Column]) -> Column:
    """Closed boxes [minx, miny, maxx, maxy] that share a point."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def in_bbox(x: Column, y: Column, box) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def ring(points) -> Column:
    """A literal ring."""
    return F.array(*[F.struct(_d(a).alias("x"), _d(b).alias("y")) for a, b in points])


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])


def edges(r: Column) -> Column:
    """Array of (x1, y1, x2, y2), the closing edge included."""
    n = F.size(r)
    following = F.concat(F.slice(r, 2, F.greatest(n - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.zip_with(r, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def on_boundary(x: Column, y: Column, r: Column) -> Column:
    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return F.exists(edges(r), touches)


def inside_ring(x: Column, y: Column, r: Column) -> Column:
    """Parity of crossings; points on the boundary may go either way."""

    def crosses(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    return F.size(F.filter(edges(r), lambda e: (e["y1"] != e["y2"]) & crosses(e))) % 2 == 1


def point_in_ring(x: Column, y: Column, r: Column, boundary: bool = True) -> Column:
    """Within the ring; with `boundary`, its edge counts (intersects), else it does not (within)."""
    edge = on_boundary(x, y, r)
    return (edge | inside_ring(x, y, r)) if boundary else (~edge & inside_ring(x, y, r))


def ring_bbox(r: Column) -> Column:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def signed_area(r: Column) -> Column:
    """Shoelace area in squared units; counter-clockwise is positive."""
    return F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def perimeter(r: Column) -> Column:
    return F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def ring_centroid(r: Column) -> Column:
    """Area centroid, summed from the first vertex; the mean vertex of a ring without area."""
    a, first = signed_area(r), F.element_at(r, 1)
    near = F.transform(r, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))

    def moment(u: str) -> Column:
        return F.aggregate(edges(near), F.lit(0.0), lambda s, e: s + (e[f"{u}1"] + e[f"{u}2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]))

    def mean(u: str) -> Column:
        return F.aggregate(r, F.lit(0.0), lambda s, p: s + p[u]) / F.size(r)

    return F.struct(*[F.when(a == 0, mean(u)).otherwise(first[u] + moment(u) / (6 * a)).alias(u) for u in "xy"])


def spherical_area_km2(r: Column) -> Column:
    """Area of a ring in degrees on the sphere (authalic sum over edges)."""
    total = F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + F.radians(e["x2"] - e["x1"]) * (2 + F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"]))))
    return F.abs(total) * (6371.0088**2) / 2


def line_length_m(points: Column) -> Column:
    """Great-circle length of an open line in degrees."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: haversine_m(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def disc(x: Column, y: Column, radius, quadrant: int = 16) -> Column:
    """Ring of 4 * quadrant + 1 vertices around a planar point, clockwise from east."""
    n = 4 * quadrant
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.struct((x + _d(radius) * F.cos(-2 * math.pi * (k % n) / n)).alias("x"), (y + _d(radius) * F.sin(-2 * math.pi * (k % n) / n)).alias("y")))


# Web Mercator

_MERCATOR_R = 6378137.0


def to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    lat = F.greatest(F.least(y, F.lit(85.0511287798066)), F.lit(-85.0511287798066))
    return F.radians(x) * _MERCATOR_R, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * _MERCATOR_R


def from_mercator(mx: Column, my: Column) -> tuple[Column, Column]:
    return F.degrees(mx / _MERCATOR_R), F.degrees(2 * F.atan(F.exp(my / _MERCATOR_R)) - math.pi / 2)


# Universal Transverse Mercator (Krueger series on WGS84)

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
_K0, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0


def utm_zone(x: float) -> int:
    return min(60, max(1, int((x + 180) // 6) + 1))


def to_utm(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    lat, lon = F.radians(y), F.radians(x - (6.0 * zone - 183.0))
    t = F.sinh(F.atanh(F.sin(lat)) - _ECC * F.atanh(_ECC * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(lon)), F.asinh(F.sin(lon) / F.sqrt(t * t + F.pow(F.cos(lon), 2)))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    up = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0))
    return _EAST + _K0 * _RECT * east, (0.0 if north else _SOUTH) + _K0 * _RECT * up


def from_utm(e: Column, n: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    xi, eta = (n - (0.0 if north else _SOUTH)) / (_K0 * _RECT), (e - _EAST) / (_K0 * _RECT)
    xi2 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    eta2 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1)), F.lit(0.0))
    return (6.0 * zone - 183.0) + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(lat)


def project(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """A point from one system to another: EPSG:4326 (degrees), EPSG:3857 (Web Mercator), EPSG:326zz and EPSG:327zz (UTM)."""
    if source == target:
        return x, y
    return _from_degrees(*_to_degrees(x, y, _code(source)), _code(target))


def _code(crs: str) -> int:
    code = crs.upper().removeprefix("EPSG:")
    known = code in ("4326", "3857", "900913") or code[:3] in ("326", "327") and code[3:].isdigit() and 1 <= int(code[3:]) <= 60
    if not known:
        raise ValueError(f"unknown coordinate system {crs}")
    return 3857 if code == "900913" else int(code)


def _to_degrees(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    if code == 4326:
        return x, y
    return from_mercator(x, y) if code == 3857 else from_utm(x, y, code % 100, code < 32700)


def _from_degrees(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    if code == 4326:
        return x, y
    return to_mercator(x, y) if code == 3857 else to_utm(x, y, code % 100, code < 32700)


# Chinese datums. The published constants of the GCJ-02 and BD-09 transformations.

_GCJ_A, _GCJ_EE = 6378245.0, 0.00669342162296594323
_BD_PI = math.pi * 3000.0 / 180.0


def in_china(x: Column, y: Column) -> Column:
    return x.between(72.004, 137.8347) & y.between(0.8293, 55.8271)


def _gcj_shift(x: Column, y: Column) -> tuple[Column, Column]:
    u, v, pi = x - 105.0, y - 35.0, math.pi
    waves = lambda s: (20.0 * F.sin(6.0 * s * pi) + 20.0 * F.sin(2.0 * s * pi)) * 2.0 / 3.0
    dlat = -100.0 + 2.0 * u + 3.0 * v + 0.2 * v * v + 0.1 * u * v + 0.2 * F.sqrt(F.abs(u)) + waves(u) + (20.0 * F.sin(v * pi) + 40.0 * F.sin(v / 3.0 * pi)) * 2.0 / 3.0 + (160.0 * F.sin(v / 12.0 * pi) + 320.0 * F.sin(v * pi / 30.0)) * 2.0 / 3.0
    dlng = 300.0 + u + 2.0 * v + 0.1 * u * u + 0.1 * u * v + 0.1 * F.sqrt(F.abs(u)) + waves(u) + (20.0 * F.sin(u * pi) + 40.0 * F.sin(u / 3.0 * pi)) * 2.0 / 3.0 + (150.0 * F.sin(u / 12.0 * pi) + 300.0 * F.sin(u / 30.0 * pi)) * 2.0 / 3.0
    rad = y / 180.0 * pi
    magic = 1 - _GCJ_EE * F.pow(F.sin(rad), 2)
    return dlng * 180.0 / (_GCJ_A / F.sqrt(magic) * F.cos(rad) * pi), dlat * 180.0 / ((_GCJ_A * (1 - _GCJ_EE)) / (magic * F.sqrt(magic)) * pi)


def wgs_to_gcj(x: Column, y: Column) -> tuple[Column, Column]:
    dx, dy = _gcj_shift(x, y)
    inside = in_china(x, y)
    return F.when(inside, x + dx).otherwise(x), F.when(inside, y + dy).otherwise(y)


def gcj_to_wgs(x: Column, y: Column, rounds: int = 3) -> tuple[Column, Column]:
    """Inverse by fixed-point steps; outside China unchanged."""
    start = F.struct(x.alias("x"), y.alias("y"))

    def step(p: Column, _k: Column) -> Column:
        dx, dy = _gcj_shift(p["x"], p["y"])
        return F.struct((x - dx).alias("x"), (y - dy).alias("y"))

    got = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    inside = in_china(x, y)
    return F.when(inside, got["x"]).otherwise(x), F.when(inside, got["y"]).otherwise(y)


def gcj_to_bd(x: Column, y: Column) -> tuple[Column, Column]:
    z = F.hypot(x, y) + 0.00002 * F.sin(y * _BD_PI)
    theta = F.atan2(y, x) + 0.000003 * F.cos(x * _BD_PI)
    return z * F.cos(theta) + 0.0065, z * F.sin(theta) + 0.006


def bd_to_gcj(x: Column, y: Column) -> tuple[Column, Column]:
    u, v = x - 0.0065, y - 0.006
    z = F.hypot(u, v) - 0.00002 * F.sin(v * _BD_PI)
    theta = F.atan2(v, u) - 0.000003 * F.cos(u * _BD_PI)
    return z * F.cos(theta), z * F.sin(theta)


def hex_cell(mx: Column, my: Column, size: float) -> Column:
    """Axial (q, r) of the pointy-top hexagon of side `size` that holds a planar point, by cube rounding."""
    q, r = (mx * (math.sqrt(3) / 3) - my / 3) / size, (my * (2 / 3)) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q2 = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r2 = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return F.struct(q2.cast("long").alias("q"), r2.cast("long").alias("r"))


def hex_centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    return size * math.sqrt(3) * (q + r / 2), size * 1.5 * r


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution (Abramowitz and Stegun 26.2.17, error under 7.5e-8)."""
    a = F.abs(z)
    k = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)
