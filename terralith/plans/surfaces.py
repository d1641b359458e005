"""Rasters on other grids; unions, differences and repairs of polygons."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import registry
from ..functions.geo import rectangle, signed_area
from ..operators import planar as P
from ..operators import warp as W
from ..operators.contours import contours
from ..operators.geometry import buffer_shapes
from ..operators.relate import shape_join
from ..sources.geotiff import geotiff_blocks, geotiff_info, geotiff_pixels
from ..sources.osm import osm_theme
from ..sources.shape_tiles import tile_parts
from . import inputs as I
from .inputs import sql, table

#: The pixel layer's place on earth, and grids to bring it to.
SOURCE = W.Grid("EPSG:4326", 116.0, 40.5, 1 / 64, 1 / 64, 64, 64)
MERCATOR = W.Grid("EPSG:3857", 12913000.0, 4938500.0, 2100.0, 2100.0, 68, 54)
COARSE = W.Grid("EPSG:4326", 116.0, 40.5, 0.0437, 0.0391, 26, 23)


def _warp(how, target=MERCATOR):
    return lambda s, d: W.warp(I.pixels(s, d), SOURCE, target, how).withColumn("v", F.round("v", 4))


_TARGETS = f"""t AS (SELECT id // {MERCATOR.cols} AS row, id % {MERCATOR.cols} AS col, {MERCATOR.x0}::DOUBLE + (id % {MERCATOR.cols} + 0.5::DOUBLE) * {MERCATOR.dx}::DOUBLE AS mx, {MERCATOR.y0}::DOUBLE - (id // {MERCATOR.cols} + 0.5::DOUBLE) * {MERCATOR.dy}::DOUBLE AS my FROM range({MERCATOR.rows * MERCATOR.cols}) g(id)),
spots AS (SELECT row, col, (40.5::DOUBLE - degrees(2 * atan(exp(my / 6378137.0::DOUBLE)) - pi() / 2)) * 64 AS r, (degrees(mx / 6378137.0::DOUBLE) - 116.0::DOUBLE) * 64 AS c FROM t)"""
_NEAREST = f"WITH {_TARGETS} SELECT a.row, a.col, round(v, 4) AS v FROM spots a LEFT JOIN pixels p ON p.row = floor(r) AND p.col = floor(c) AND r >= 0 AND c >= 0 AND r < 64 AND c < 64"
_LINEAR = "greatest(1 - abs({d}), 0)"
_CUBIC = "(CASE WHEN abs({d}) <= 1 THEN (1.5::DOUBLE * abs({d}) - 2.5::DOUBLE) * abs({d}) * abs({d}) + 1 WHEN abs({d}) < 2 THEN ((-0.5::DOUBLE * abs({d}) + 2.5::DOUBLE) * abs({d}) - 4) * abs({d}) + 2 ELSE 0 END)"


def _kernel_sql(weight: str) -> str:
    return f"""WITH {_TARGETS}, ok AS (SELECT a.* FROM spots a JOIN pixels p ON p.row = floor(r) AND p.col = floor(c) WHERE r >= 0 AND c >= 0),
taps AS (SELECT o.row, o.col, p.v, {weight.format(d='(r - 0.5::DOUBLE - p.row)')} * {weight.format(d='(c - 0.5::DOUBLE - p.col)')} AS w FROM ok o, range(-1, 3) i(i), range(-1, 3) j(j) JOIN pixels p ON p.row = floor(r - 0.5::DOUBLE) + i AND p.col = floor(c - 0.5::DOUBLE) + j),
s AS (SELECT row, col, CASE WHEN sum(w) > 1e-6 THEN sum(w * v) / sum(w) END AS v FROM taps GROUP BY 1, 2)
SELECT t.row, t.col, round(s.v, 4) AS v FROM t LEFT JOIN s ON s.row = t.row AND s.col = t.col"""


_AVERAGE = f"""WITH t AS (SELECT id // {COARSE.cols} AS row, id % {COARSE.cols} AS col FROM range({COARSE.rows * COARSE.cols}) g(id)),
h AS (SELECT CAST(floor((40.5::DOUBLE - (40.5::DOUBLE - (row + 0.5::DOUBLE) / 64)) / {COARSE.dy}::DOUBLE) AS BIGINT) AS row, CAST(floor((116.0::DOUBLE + (col + 0.5::DOUBLE) / 64 - 116.0::DOUBLE) / {COARSE.dx}::DOUBLE) AS BIGINT) AS col, avg(v) AS v FROM pixels GROUP BY 1, 2)
SELECT t.row, t.col, round(h.v, 4) AS v FROM t LEFT JOIN h ON h.row = t.row AND h.col = t.col"""


def _cell(col, row, w, h, side=1000.0):
    x, y = (lambda c: F.lit(116.0) + c / F.lit(side)), (lambda c: F.lit(39.5) + c / F.lit(side))
    return rectangle(x(col), y(row), x(col + w), y(row + h))


def _dissolved(s, d):
    """Unit cells by market segment, as polygons: how many, with how many holes, of what size."""
    c = table(s, d, "customer")
    cells = c.select(F.col("c_mktsegment").alias("segment"), _cell(F.col("c_custkey") % 50, F.floor(F.col("c_custkey") / 50), F.lit(1), F.lit(1)).alias("ring"))
    got = P.dissolve_union(cells, ["segment"])
    return got.groupBy("segment").agg(F.count("*").alias("n_polygons"), F.sum(F.size("holes")).alias("n_holes"), F.round(F.sum("area") * 1e6, 2).alias("cells"))


_DISSOLVED = """WITH RECURSIVE c AS (SELECT c_custkey AS id, c_custkey % 50 AS x, c_custkey // 50 AS y, c_mktsegment AS k FROM customer),
adj AS (SELECT a.id AS a, b.id AS b, a.k FROM c a JOIN c b ON b.k = a.k AND b.x = a.x + 1 AND b.y = a.y UNION ALL SELECT a.id, b.id, a.k FROM c a JOIN c b ON b.k = a.k AND b.x = a.x AND b.y = a.y + 1),
ways AS (SELECT a, b FROM adj UNION ALL SELECT b, a FROM adj), reach(v, r) AS (SELECT id, id FROM c UNION SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.v),
roots AS (SELECT v, min(r) AS root FROM reach GROUP BY 1), parts AS (SELECT k, count(DISTINCT root) AS n, count(*) AS cells FROM roots JOIN c ON c.id = v GROUP BY 1),
blocks AS (SELECT a.k, count(*) AS n FROM c a JOIN c b ON b.k = a.k AND b.x = a.x + 1 AND b.y = a.y JOIN c e ON e.k = a.k AND e.x = a.x AND e.y = a.y + 1 JOIN c f ON f.k = a.k AND f.x = a.x + 1 AND f.y = a.y + 1 GROUP BY 1),
links AS (SELECT k, count(*) AS n FROM adj GROUP BY 1)
SELECT p.k AS segment, p.n AS n_polygons, p.n - p.cells + coalesce(l.n, 0) - coalesce(b.n, 0) AS n_holes, p.cells::DOUBLE AS cells FROM parts p LEFT JOIN links l ON l.k = p.k LEFT JOIN blocks b ON b.k = p.k"""


def _layers(s, d):
    """By region its nations' rectangles (layer 0) and boxes of all suppliers (layer 1), in hundredths of a degree."""
    nations = I.polygons(s, d).select(F.col("region").alias("key"), F.lit(0).alias("layer"), "ring")
    k = table(s, d, "supplier").select(F.col("s_suppkey").alias("k")).join(table(s, d, "region").select(F.col("r_regionkey").alias("key")))  # five regions
    boxes = k.select("key", F.lit(1).alias("layer"), _cell(F.col("k") * 61 % 100, F.col("k") * 89 % 100, 1 + F.col("k") % 7, 1 + F.col("k") % 5, 100.0).alias("ring"))
    return nations.unionAll(boxes)


def _combined(how):
    return lambda s, d: P.combine(_layers(s, d), how).groupBy("key").agg(F.round(F.sum("area") * 1e4, 2).alias("cells"))


_COVER = """WITH u AS (SELECT id % 110 AS x, id // 110 AS y FROM range(12100) g(id)), n AS (SELECT n_regionkey AS key, (n_nationkey % 5)*20 AS x0, (n_nationkey // 5)*20 AS y0 FROM nation),
a AS (SELECT DISTINCT key, u.x, u.y FROM n JOIN u ON u.x >= x0 AND u.x < x0 + 20 AND u.y >= y0 AND u.y < y0 + 20),
s AS (SELECT s_suppkey*61 % 100 AS x0, s_suppkey*89 % 100 AS y0, 1 + s_suppkey % 7 AS w, 1 + s_suppkey % 5 AS h FROM supplier), b AS (SELECT DISTINCT u.x, u.y FROM s JOIN u ON u.x >= x0 AND u.x < x0 + w AND u.y >= y0 AND u.y < y0 + h)
"""


def _valid(s, d):
    """Bow ties, polygons with a spike, and holes on a string, by part."""
    a, p = (1 + F.col("p_size") % 7).cast("double"), F.col("p_partkey")
    ring = lambda *points: F.array(*(F.struct((a * x).alias("x"), (a * y).alias("y")) for x, y in points))
    shape = F.when(p % 3 == 0, ring((0, 0), (2, 2), (2, 0), (0, 2))).when(p % 3 == 1, ring((0, 0), (2, 0), (2, 2), (3, 2), (2, 2), (0, 2))).otherwise(ring((0, 0), (3, 0), (3, 3), (0, 3), (0, 0), (1, 1), (1, 2), (2, 2), (2, 1), (1, 1)))
    got = P.make_valid(table(s, d, "part").select(F.col("p_partkey").alias("fid"), shape.alias("ring")), unit=1e-3)
    return got.groupBy("fid").agg(F.count("*").alias("n_polygons"), F.sum(F.size("holes")).alias("n_holes"), F.round(F.sum("area"), 4).alias("area"))


def _boxes(s, d):
    """Suppliers as boxes of whole hundredths: fid, x0, y0, x1, y1 as numbers."""
    k = F.col("s_suppkey")
    b = table(s, d, "supplier").select(k.alias("fid"), (k * 61 % 100).alias("x0"), (k * 89 % 100).alias("y0"), (1 + k % 7).alias("w"), (1 + k % 5).alias("h"))
    return b.select("fid", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


def _point(x, y):
    return F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


_RING4 = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]


def _as_polygons(boxes):
    return boxes.select("fid", F.lit("polygon").alias("kind"), F.array(F.array(*(_point(*c) for c in _RING4))).alias("parts"))


def _predicates(s, d):
    """How many suppliers' boxes and lines meet each nation's square in which way."""
    n = F.col("n_nationkey")
    nations = table(s, d, "nation").select(n.alias("fid"), (n % 5 * 20).alias("x0"), (F.floor(n / 5) * 20).alias("y0")).withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 20})
    squares = _as_polygons(nations)
    lines = _boxes(s, d).select("fid", F.lit("line").alias("kind"), F.array(F.array(_point("x0", "y0"), _point("x1", "y0"))).alias("parts"))
    asked = [("polygon", _as_polygons(_boxes(s, d)), p) for p in ("within", "touches", "overlaps")] + [("line", lines, p) for p in ("within", "touches", "crosses")]
    out = None
    for kind, shapes, predicate in asked:
        one = shape_join(shapes, squares, predicate).groupBy(F.col("bid").cast("long").alias("nation")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(predicate).alias("predicate"), "nation", "n")
        out = one if out is None else out.unionAll(one)
    return out


_SBOX = "s AS (SELECT s_suppkey AS fid, s_suppkey*61 % 100 AS x0, s_suppkey*89 % 100 AS y0, s_suppkey*61 % 100 + 1 + s_suppkey % 7 AS x1, s_suppkey*89 % 100 + 1 + s_suppkey % 5 AS y1 FROM supplier)"
_PREDICATES = f"""WITH {_SBOX}, n AS (SELECT n_nationkey::BIGINT AS nation, (n_nationkey % 5)*20 AS a0, (n_nationkey // 5)*20 AS b0, (n_nationkey % 5)*20+20 AS a1, (n_nationkey // 5)*20+20 AS b1 FROM nation),
p AS (SELECT nation, x0 < a1 AND a0 < x1 AND y0 < b1 AND b0 < y1 AS ii, x0 <= a1 AND a0 <= x1 AND y0 <= b1 AND b0 <= y1 AS meet, x0 >= a0 AND x1 <= a1 AND y0 >= b0 AND y1 <= b1 AS inner_, 'polygon' AS kind FROM s, n
  UNION ALL SELECT nation, y0 > b0 AND y0 < b1 AND x0 < a1 AND a0 < x1, y0 >= b0 AND y0 <= b1 AND x0 <= a1 AND a0 <= x1, x0 >= a0 AND x1 <= a1, 'line' FROM s, n)
SELECT kind, 'within' AS predicate, nation, count(*) AS n FROM p WHERE ii AND inner_ GROUP BY ALL UNION ALL SELECT kind, 'touches', nation, count(*) FROM p WHERE meet AND NOT ii GROUP BY ALL
UNION ALL SELECT kind, CASE kind WHEN 'line' THEN 'crosses' ELSE 'overlaps' END, nation, count(*) FROM p WHERE ii AND NOT inner_ GROUP BY ALL"""


def _buffers(s, d):
    """Areas of the suppliers' boxes with a border of 0.75 around and one of 1 taken off, and all of them dissolved."""
    shapes = _as_polygons(_boxes(s, d))
    more = buffer_shapes(shapes, 0.75).groupBy("fid").agg(F.round(F.sum("area"), 3).alias("area")).select("fid", F.lit("out").alias("way"), "area")
    less = buffer_shapes(shapes, -1.0).groupBy("fid").agg(F.round(F.sum("area"), 3).alias("area")).select("fid", F.lit("in").alias("way"), "area")
    return more.unionAll(less)


_DISC = 16 * 0.75 * 0.75 * math.sin(2 * math.pi / 32)
_BUFFERS = f"WITH {_SBOX} SELECT fid, 'out' AS way, round((x1-x0)*(y1-y0) + 1.5::DOUBLE*(x1-x0+y1-y0) + {_DISC!r}::DOUBLE, 3) AS area FROM s UNION ALL SELECT fid, 'in', ((x1-x0-2)*(y1-y0-2))::DOUBLE FROM s WHERE x1-x0 > 2 AND y1-y0 > 2"

LEVELS = [20.0, 26.5]


def _contours(s, d):
    got = contours(I.pixels(s, d), LEVELS, unit=1e-7)
    areas = got.groupBy("level").agg(F.round(F.sum("area"), 3).alias("area"))
    every = s.createDataFrame([(x,) for x in LEVELS], "level double")  # a level that nothing reaches has no area
    return every.join(areas, "level", "left").select("level", F.coalesce("area", F.lit(0.0)).alias("area"))


_CONTOURS = """WITH l AS (SELECT * FROM (VALUES (20.0::DOUBLE), (26.5::DOUBLE)) t(level)), g AS (SELECT id // 65 - 1 AS row, id % 65 - 1 AS col FROM range(65*65) g(id)),
c AS (SELECT g.row, g.col, level, coalesce(a.v, 0) AS a, coalesce(b.v, 0) AS b, coalesce(c.v, 0) AS c, coalesce(d.v, 0) AS d FROM g, l LEFT JOIN pixels a ON a.row = g.row AND a.col = g.col LEFT JOIN pixels b ON b.row = g.row AND b.col = g.col + 1 LEFT JOIN pixels c ON c.row = g.row + 1 AND c.col = g.col + 1 LEFT JOIN pixels d ON d.row = g.row + 1 AND d.col = g.col),
s AS (SELECT level, a >= level AS ha, b >= level AS hb, c >= level AS hc, d >= level AS hd, (a+b+c+d)/4 >= level AS joined, (level-a)/(b-a) AS t, (level-b)/(c-b) AS u, (level-d)/(c-d) AS v, (level-a)/(d-a) AS w FROM c),
p AS (SELECT *, list_filter([CASE WHEN ha THEN {'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE} END, CASE WHEN ha <> hb THEN {'x': t, 'y': 0.0::DOUBLE} END, CASE WHEN hb THEN {'x': 1.0::DOUBLE, 'y': 0.0::DOUBLE} END, CASE WHEN hb <> hc THEN {'x': 1.0::DOUBLE, 'y': u} END, CASE WHEN hc THEN {'x': 1.0::DOUBLE, 'y': 1.0::DOUBLE} END, CASE WHEN hc <> hd THEN {'x': v, 'y': 1.0::DOUBLE} END, CASE WHEN hd THEN {'x': 0.0::DOUBLE, 'y': 1.0::DOUBLE} END, CASE WHEN hd <> ha THEN {'x': 0.0::DOUBLE, 'y': w} END], lambda q: q IS NOT NULL) AS q FROM s)
SELECT level, round(sum(CASE WHEN len(q) = 0 THEN 0 WHEN NOT joined AND ha AND hc AND NOT hb AND NOT hd THEN t*w/2 + (1-u)*(1-v)/2 WHEN NOT joined AND hb AND hd AND NOT ha AND NOT hc THEN (1-t)*u/2 + v*(1-w)/2
  ELSE list_sum(list_transform(range(1, len(q)+1), lambda i: q[i].x*q[i % len(q) + 1].y - q[i % len(q) + 1].x*q[i].y))/2 END), 3) AS area FROM p GROUP BY 1"""

def _geotiff(s, d):
    """The pixel layer as GeoTIFF blocks, read back."""
    blocks = geotiff_blocks(I.pixels(s, d), SOURCE, 24)
    at = geotiff_info(blocks).select("path", F.rint((F.lit(SOURCE.y0) - F.col("y0")) / SOURCE.dy).cast("long").alias("down"), F.rint((F.col("x0") - F.lit(SOURCE.x0)) / SOURCE.dx).cast("long").alias("right"))
    return geotiff_pixels(blocks).where("v IS NOT NULL").join(at, "path").select((F.col("row") + F.col("down")).alias("row"), (F.col("col") + F.col("right")).alias("col"), F.round("v", 6).alias("v"))


def _osm(s, d):
    """Roads over the facilities as nodes: an order is a way along three of them, some of which are not there."""
    nodes = I.facilities(s, d).select(F.lit("node").alias("kind"), F.col("fid").alias("id"), "x", "y", F.lit(None).cast("array<long>").alias("refs"), F.create_map().cast("map<string,string>").alias("tags"))
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    refs = F.array(1 + k % 100, 1 + k * 7 % 130, 1 + k * 13 % 100)
    tags = F.when(k % 3 == 0, F.create_map(F.lit("highway"), F.col("o_orderpriority"))).otherwise(F.create_map(F.lit("railway"), F.lit("rail")))
    ways = o.select(F.lit("way").alias("kind"), k.alias("id"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), refs.alias("refs"), tags.alias("tags"))
    got = osm_theme(nodes.unionByName(ways), "roads")
    return got.select("osm_id", "category", "x", "y", F.size("points").cast("long").alias("n"), F.round(F.aggregate("points", F.lit(0.0), lambda t, p: t + p["x"]), 6).alias("sum_x"))


_OSM = """WITH w AS (SELECT o_orderkey AS k, o_orderpriority AS category, unnest([1 + o_orderkey % 100, 1 + o_orderkey*7 % 130, 1 + o_orderkey*13 % 100]) AS ref, unnest([1, 2, 3]) AS nth FROM orders WHERE o_orderkey % 3 = 0),
p AS (SELECT k, category, nth, x, y FROM w JOIN facilities ON fid = ref)
SELECT k AS osm_id, any_value(category) AS category, arg_min(x, nth) AS x, arg_min(y, nth) AS y, count(*) AS n, round(sum(x), 6) AS sum_x FROM p GROUP BY k HAVING count(*) > 1"""

def _udtf_sessions(s, d):
    """Sessions of users by a table function over their events: more than two hours part them."""
    registry.register(s, ["sessions"])
    e = table(s, d, "events").select(F.col("user_id").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    got = s.sql("SELECT * FROM sessions(TABLE({e}) PARTITION BY k ORDER BY (at), 7200000000.0D)", e=e)
    return got.groupBy("k").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("most"))


_SESSIONS = """WITH e AS (SELECT user_id AS k, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT k, sum(CASE WHEN gap > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts) AS session FROM e), n AS (SELECT k, session, count(*) AS n FROM s GROUP BY 1, 2)
SELECT k, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS most FROM n GROUP BY 1"""


def _sql_functions(s, d):
    registry.register(s, ["great_circle_m", "mercator_y"])
    return s.sql("SELECT fid, round(great_circle_m(x, y, 116.4D, 39.9D), 2) AS metres, round(mercator_y(y), 2) AS my FROM {p}", p=I.demand(s, d))


ZOOMS = [4, 7, 9]


def _polygon_tiles(s, d):
    """By tile: features, vertices and area in tile units of the nations' rectangles."""
    nations = I.polygons(s, d).select(F.col("pid").cast("long").alias("fid"), F.array("ring").alias("parts"))
    parts = tile_parts(nations, ZOOMS, polygon=True)
    whole = F.transform(F.col("parts")[0], lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return parts.groupBy(F.col("z").cast("long").alias("z"), "tx", "ty").agg(F.count("*").alias("n"), F.sum(F.size(whole)).alias("vertices"), F.sum(signed_area(whole)).alias("area"))


_RECT_TILES = """WITH w AS (SELECT pid, x0/360.0::DOUBLE+0.5 AS u0, x1/360.0::DOUBLE+0.5 AS u1, 0.5-ln(tan(pi()/4+radians(y1)/2))/(2*pi()) AS v0, 0.5-ln(tan(pi()/4+radians(y0)/2))/(2*pi()) AS v1 FROM polys),
z AS (SELECT z, CAST(1::BIGINT << z AS DOUBLE) AS n FROM (VALUES (4), (7), (9)) t(z)), b AS (SELECT z, u0*n AS u0, u1*n AS u1, v0*n AS v0, v1*n AS v1, pid FROM w, z),
t AS (SELECT *, unnest(range(CAST(floor(u0-1/64.0::DOUBLE) AS BIGINT), CAST(floor(u1+1/64.0::DOUBLE) AS BIGINT)+1)) AS tx FROM b), r AS (SELECT *, unnest(range(CAST(floor(v0-1/64.0::DOUBLE) AS BIGINT), CAST(floor(v1+1/64.0::DOUBLE) AS BIGINT)+1)) AS ty FROM t),
c AS (SELECT z, tx, ty, round_even(greatest(-64, (u0-tx)*4096),0) AS a, round_even(least(4160, (u1-tx)*4096),0) AS e, round_even(greatest(-64, (v0-ty)*4096),0) AS f, round_even(least(4160, (v1-ty)*4096),0) AS g FROM r)
SELECT z::BIGINT AS z, tx, ty, count(*) AS n, 4*count(*) AS vertices, sum((e-a)*(g-f))::DOUBLE AS area FROM c WHERE e > a AND g > f GROUP BY 1, 2, 3"""

PLANS = {
    "udtf_sessions": (_udtf_sessions, _SESSIONS),
    "sql_functions": (_sql_functions, sql("SELECT fid, round(2*6371000.0::DOUBLE*asin(sqrt(pow(sin(radians(39.9::DOUBLE-y)/2),2)+cos(radians(y))*cos(radians(39.9::DOUBLE))*pow(sin(radians(116.4::DOUBLE-x)/2),2))),2) AS metres, round(ln(tan(pi()/4+radians(y)/2))*6378137.0::DOUBLE,2) AS my FROM demand", "demand")),
    "osm_roads": (_osm, sql(_OSM, "facilities")),
    "geotiff_round_trip": (_geotiff, sql("SELECT row, col, round(v, 6) AS v FROM pixels", "pixels")),
    "contours": (_contours, sql(_CONTOURS, "pixels")),
    "spatial_join_predicates": (_predicates, _PREDICATES),
    "shape_buffers": (_buffers, _BUFFERS),
    "vector_tiles_polygons": (_polygon_tiles, sql(_RECT_TILES, "polys")),
    "raster_reproject_nearest": (_warp("nearest"), sql(_NEAREST, "pixels")),
    "raster_reproject_bilinear": (_warp("bilinear"), sql(_kernel_sql(_LINEAR), "pixels")),
    "raster_reproject_cubic": (_warp("cubic"), sql(_kernel_sql(_CUBIC), "pixels")),
    "raster_resample_to_grid": (_warp("average", COARSE), sql(_AVERAGE, "pixels")),
    "dissolve_union": (_dissolved, _DISSOLVED),
    "polygon_difference": (_combined("difference"), _COVER + "SELECT key, count(*)::DOUBLE AS cells FROM a WHERE (x, y) NOT IN (SELECT (x, y) FROM b) GROUP BY 1"),
    "polygon_intersection": (_combined("intersection"), _COVER + "SELECT key, count(*)::DOUBLE AS cells FROM a WHERE (x, y) IN (SELECT (x, y) FROM b) GROUP BY 1"),
    "make_valid": (_valid, "SELECT p_partkey AS fid, CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 1 END::BIGINT AS n_polygons, CASE p_partkey % 3 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS n_holes, (CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END * (1 + p_size % 7) * (1 + p_size % 7))::DOUBLE AS area FROM part"),
}
