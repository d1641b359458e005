"""Spatial joins, aggregations, statistics and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import clustering as C
from ..operators import geometry as G
from ..operators import spatial as S
from ..operators import statistics as ST
from ..sources.files import feature_json
from ..sources.store import materialize
from ..sources.vector_tiles import tile_points, vector_tiles
from . import inputs as I
from .inputs import settled, settled_sql, sql, table

_IN = "p.x BETWEEN q.x0 AND q.x1 AND p.y BETWEEN q.y0 AND q.y1"
HEX = 5000.0
BAND = 2000.0


def _r(df, n, *cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _stats(s, d):
    got = S.polygon_stats(I.points(s, d), I.polygons(s, d), "pid", "value", cell=0.1, places=2)
    return got.withColumns({c: settled(F.col(c), 4) for c in ("sum", "mean", "max", "min")})


def _nearest(s, d):
    got = S.nearest(I.demand(s, d).select("fid", "mx", "my"), I.facilities(s, d).select("fid", "mx", "my"))
    return got.select(F.col("aid").alias("demand"), F.col("bid").alias("facility"), F.round("d", 2).alias("distance"))


def _fishnet(s, d):
    """Cells over the demand's width, from 116 degrees on."""
    right = I.demand(s, d).agg(F.max("x")).head()[0]
    return _r(S.fishnet(s, (116.0, 39.5, right, 40.3), 0.03), 9, "x0", "y0", "x1", "y1")


def _hexes(s, d):
    return S.hex_bin(I.points(s, d), HEX, "value", "mean", places=2)


_SUM = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"
_HEXQ = f"""WITH f AS (SELECT *, (mx*{3**0.5 / 3!r}::DOUBLE - my/3)/{HEX} AS q0, (my*{2 / 3!r}::DOUBLE)/{HEX} AS r0 FROM points), g AS (SELECT *, round_even(q0,0) AS rq, round_even(r0,0) AS rr, round_even(-q0-r0,0) AS rs FROM f),
h AS (SELECT *, abs(rq-q0) AS dq, abs(rr-r0) AS dr, abs(rs-(-q0-r0)) AS ds FROM g),
hexes AS (SELECT CAST(CASE WHEN dq>dr AND dq>ds THEN -rr-rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT (dq>dr AND dq>ds) AND dr>ds THEN -rq-rs ELSE rr END AS BIGINT) AS r, count(*) AS n, {_SUM} / count(value) AS stat FROM h GROUP BY 1, 2)"""

_PAIRS = "pairs AS (SELECT a.fid AS aid, b.fid AS bid, sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)) AS d, b.value AS bv FROM demand_v a JOIN demand_v b ON abs(a.mx-b.mx) <= {band} AND abs(a.my-b.my) <= {band} WHERE sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)) <= {band})"
_DV = "demand_v AS (SELECT fid, mx, my, balance AS value FROM demand)"


def _gi(s, d):
    got = ST.getis_ord(I.demand(s, d), "balance", BAND)
    return got.select("fid", F.round("gi_star", 3).alias("gi_star"), "kind", "confidence")


_CDF = "(2*(1-(1-exp(-z*z/2)/2.5066282746310002::DOUBLE*k*(0.319381530+k*(-0.356563782+k*(1.781477937+k*(-1.821255978+k*1.330274429)))))))"
_GI = f"""WITH {_DV}, {_PAIRS.format(band=BAND)}, st AS (SELECT avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM demand_v), w AS (SELECT aid AS fid, count(*) AS w, sum(bv) AS wx FROM pairs GROUP BY 1),
g AS (SELECT fid, CASE WHEN (n*w-w*w)/(n-1) > 0 THEN (wx-m*w)/(s*sqrt((n*w-w*w)::DOUBLE/(n-1))) ELSE 0 END AS gi FROM w, st), p AS (SELECT fid, gi, abs(gi) AS z, 1/(1+0.2316419::DOUBLE*abs(gi)) AS k FROM g), q AS (SELECT fid, gi, {_CDF} AS p FROM p)
SELECT fid, round(round(gi,4),3) AS gi_star, CASE WHEN p < 0.1 THEN CASE WHEN gi > 0 THEN 'Hot Spot' ELSE 'Cold Spot' END ELSE 'Not Significant' END AS kind, CASE WHEN p < 0.01 THEN '99%' WHEN p < 0.05 THEN '95%' WHEN p < 0.1 THEN '90%' ELSE 'Not Significant' END AS confidence FROM q"""

_KNN = "knn AS (SELECT aid, bid, d, rk FROM (SELECT a.fid AS aid, b.fid AS bid, sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)) AS d, row_number() OVER (PARTITION BY a.fid ORDER BY sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)), b.fid) AS rk FROM {t} a JOIN {t} b ON a.fid <> b.fid) WHERE rk <= {k})"


def _moran(s, d):
    f = I.facilities(s, d)
    return ST.moran(f, ST.knn_weights(f), "capacity").select(F.round("moran_i", 5).alias("moran_i"), F.round("expected_i", 5).alias("expected_i"), "n")


def _moran_p(s, d):
    f = I.facilities(s, d)
    return ST.moran(f, ST.knn_weights(f), "capacity", permutations=99)


def _breaks(method, k=5):
    def run(s, d):
        got = ST.breaks(table(s, d, "orders"), "o_totalprice", method, k)
        return s.createDataFrame([(i, round(float(b), 4)) for i, b in enumerate(got)], "i long, upper double")

    return run


def _classes(s, d):
    o = table(s, d, "orders")
    limits = ST.breaks(o, "o_totalprice", "quantiles", 4)
    return ST.classify(o, "o_totalprice", limits).groupBy(F.col("class").cast("long").alias("class")).agg(F.count("*").alias("n"))


def _dbscan(s, d):
    return C.dbscan(I.facilities(s, d), 6000.0, 3).select("fid", F.col("cluster").cast("long").alias("cluster"), "is_core")


_DBSCAN = """WITH RECURSIVE nb AS (SELECT a.fid AS aid, b.fid AS bid FROM facilities a, facilities b WHERE sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)) <= 6000.0),
core AS (SELECT aid AS c FROM nb GROUP BY 1 HAVING count(*) >= 3), link AS (SELECT aid, bid FROM nb WHERE aid IN (FROM core) AND bid IN (FROM core)),
reach(v, r) AS (SELECT c, c FROM core UNION SELECT l.bid, reach.r FROM reach JOIN link l ON l.aid = reach.v), roots AS (SELECT v, min(r) AS root FROM reach GROUP BY 1),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM roots)), cc AS (SELECT v, cluster FROM roots JOIN num USING (root)),
bd AS (SELECT aid, min(cluster) AS near FROM nb JOIN cc ON bid = v GROUP BY 1)
SELECT f.fid, coalesce(cc.cluster, bd.near, -1) AS cluster, cc.v IS NOT NULL AS is_core FROM facilities f LEFT JOIN cc ON cc.v = f.fid LEFT JOIN bd ON bd.aid = f.fid"""


def _st_dbscan(s, d):
    p = I.points(s, d).withColumn("ts", F.unix_micros(F.col("t").cast("timestamp")) / F.lit(1e6))
    return C.st_dbscan(p, 1500.0, 6 * 3600.0, 3)


def _kde(s, d):
    cells = S.fishnet(s, (410000, 4370000, 510000, 4490000), 5000.0).select("fid", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return ST.kde(I.facilities(s, d), cells, 4000.0, "capacity").select("fid", F.round(F.col("density") * 1e9, 4).alias("density"))


_CELLS = "cells AS (SELECT id AS fid, 410000 + (id // 24)*5000.0::DOUBLE + 2500 AS cx, 4370000 + (id % 24)*5000.0::DOUBLE + 2500 AS cy FROM range(480) r(id))"
_KDE = f"""WITH {_CELLS}, dn AS (SELECT c.fid, sum(capacity*exp(-(pow(cx-mx,2)+pow(cy-my,2))/(2*4000.0::DOUBLE*4000.0))) / (2*pi()*4000.0*4000.0*(SELECT sum(capacity) FROM facilities)) AS density FROM cells c JOIN facilities f ON sqrt(pow(cx-mx,2)+pow(cy-my,2)) <= 16000 GROUP BY 1)
SELECT fid, round(density*1e9,4) AS density FROM dn WHERE density >= 0.1::DOUBLE*(SELECT max(density) FROM dn)"""


def _idw(s, d):
    cells = S.fishnet(s, (410000, 4370000, 510000, 4490000), 5000.0).select("fid", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return ST.idw(I.facilities(s, d), cells, "capacity").select("fid", F.round("estimate", 5).alias("estimate"))


_IDW = f"""WITH {_CELLS}, m AS (SELECT mx, my, avg(capacity) AS v, min(fid) AS k FROM facilities GROUP BY 1, 2), n AS (SELECT c.fid, sqrt(pow(cx-mx,2)+pow(cy-my,2)) AS d, v, row_number() OVER (PARTITION BY c.fid ORDER BY sqrt(pow(cx-mx,2)+pow(cy-my,2)), k) AS rk FROM cells c, m)
SELECT fid, round(sum(v/(d*d))/sum(1/(d*d)),5) AS estimate FROM n WHERE rk <= 5 GROUP BY 1"""


def _datum(s, d):
    p = I.demand(s, d)
    gx, gy = geo.wgs_to_gcj(F.col("x"), F.col("y"))
    p = p.withColumns({"gx": gx, "gy": gy})
    bx, by = geo.gcj_to_bd(F.col("gx"), F.col("gy"))
    wx, wy = geo.gcj_to_wgs(F.col("gx"), F.col("gy"))
    rx, ry = geo.bd_to_gcj(bx, by)
    near = lambda a, b: F.abs(a - b) < 1e-5
    return p.select("fid", F.round("gx", 7).alias("gx"), F.round("gy", 7).alias("gy"), F.round(bx, 7).alias("bx"), F.round(by, 7).alias("by"), (near(wx, F.col("x")) & near(wy, F.col("y")) & near(rx, F.col("gx")) & near(ry, F.col("gy"))).alias("returns"))


def _utm(s, d):
    p = I.demand(s, d)
    bx, by = geo.from_utm(F.col("mx"), F.col("my"), I.ZONE)
    mx, my = geo.to_mercator(F.col("x"), F.col("y"))
    return p.select("fid", F.round("mx", 3).alias("e"), F.round("my", 3).alias("n"), F.round(mx, 3).alias("merc_x"), F.round(my, 3).alias("merc_y"), ((F.abs(bx - F.col("x")) < 1e-8) & (F.abs(by - F.col("y")) < 1e-8)).alias("returns"))


def _measures(s, d):
    r = F.col("ring")
    c = geo.ring_centroid(r)
    return I.polygons(s, d).select("pid", F.round(geo.signed_area(r), 9).alias("area"), F.round(geo.perimeter(r), 9).alias("perimeter"), F.round(c["x"], 9).alias("cx"), F.round(c["y"], 9).alias("cy"), F.round(geo.spherical_area_km2(r), 4).alias("km2"), F.round(geo.line_length_m(r), 3).alias("boundary_m"))


_HAV = "2*6371000.0::DOUBLE*asin(sqrt(pow(sin(radians({y2}-{y1})/2),2)+cos(radians({y1}))*cos(radians({y2}))*pow(sin(radians({x2}-{x1})/2),2)))"
_SIDE = lambda x1, y1, x2, y2: _HAV.format(x1=x1, y1=y1, x2=x2, y2=y2)


def _rings(s, d):
    got = G.ring_buffers(I.facilities(s, d).select("fid", "mx", "my"), [1500, 500, 1000, -3])
    return got.select("fid", "distance", F.round("area", 0).alias("area"), F.size("ring").cast("long").alias("vertices"))


def _voronoi(s, d):
    f = I.facilities(s, d)
    return G.voronoi(f, (400000, 4360000, 520000, 4500000)).select("fid", F.round("area", 1).alias("area"))


def _clip(s, d):
    a = I.polygons(s, d).select(F.col("pid").alias("aid"), "ring")
    b = s.createDataFrame([(1, 116.05, 39.55, 116.35, 39.95), (2, 116.5, 39.9, 117.5, 40.0)], "bid long, x0 double, y0 double, x1 double, y1 double")
    return G.overlay(a, b.select("bid", geo.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("ring"))).select("aid", "bid", F.round("area", 9).alias("area"))


def _difference(s, d):
    a = I.polygons(s, d).select(F.col("pid").alias("aid"), "ring")
    b = s.createDataFrame([(1, 116.05, 39.55, 116.35, 39.95), (2, 116.5, 39.9, 117.5, 40.0)], "bid long, x0 double, y0 double, x1 double, y1 double")
    return G.overlay(a, b.select("bid", geo.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("ring")), "difference").select("aid", F.round("area", 9).alias("area"))


_MASK = "m(bid,x0,y0,x1,y1) AS (VALUES (1,116.05::DOUBLE,39.55::DOUBLE,116.35::DOUBLE,39.95::DOUBLE),(2,116.5::DOUBLE,39.9::DOUBLE,117.5::DOUBLE,40.0::DOUBLE)), c AS (SELECT pid AS aid, CAST(bid AS BIGINT) AS bid, (least(p.x1,m.x1)-greatest(p.x0,m.x0))*(least(p.y1,m.y1)-greatest(p.y0,m.y0)) AS area FROM polys p JOIN m ON p.x0 < m.x1 - 1e-12 AND p.x1 > m.x0 + 1e-12 AND p.y0 < m.y1 - 1e-12 AND p.y1 > m.y0 + 1e-12)"


def _snap(s, d):
    n, e = I.grid_edges(s, d)
    ux, uy = geo.to_utm(F.col("x"), F.col("y"), I.ZONE)
    n = n.withColumns({"mx": ux, "my": uy})
    a, b = n.select(F.col("node").alias("u"), F.col("mx").alias("x1"), F.col("my").alias("y1")), n.select(F.col("node").alias("v"), F.col("mx").alias("x2"), F.col("my").alias("y2"))
    seg = e.where("u < v").join(a, "u").join(b, "v").withColumn("sid", F.col("u") * 1000 + F.col("v"))
    got = S.snap_to_edges(I.demand(s, d), seg, 1500.0)
    return got.select("fid", "sid", F.round("fraction", 5).alias("fraction"), F.round("distance", 3).alias("distance"), "node", F.round("confidence", 5).alias("confidence"))


_SNAP = """WITH mnodes AS (SELECT node, {e} AS mx, {n} AS my FROM nodes), seg AS (SELECT e.u, e.v, e.u*1000+e.v AS sid, a.mx AS x1, a.my AS y1, b.mx AS x2, b.my AS y2 FROM edges e JOIN mnodes a ON a.node=e.u JOIN mnodes b ON b.node=e.v WHERE e.u < e.v),
t AS (SELECT fid, sid, u, v, x1, y1, x2, y2, mx, my, least(1.0, greatest(0.0, ((mx-x1)*(x2-x1)+(my-y1)*(y2-y1))/(pow(x2-x1,2)+pow(y2-y1,2)))) AS f FROM demand, seg WHERE mx BETWEEN least(x1,x2)-1500 AND greatest(x1,x2)+1500 AND my BETWEEN least(y1,y2)-1500 AND greatest(y1,y2)+1500),
d AS (SELECT *, sqrt(pow(x1+f*(x2-x1)-mx,2)+pow(y1+f*(y2-y1)-my,2)) AS dist FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY dist, sid) AS rk FROM d WHERE dist <= 1500)
SELECT fid, sid, round(f,5) AS fraction, round(dist,3) AS distance, CASE WHEN f <= 0.5 THEN u ELSE v END AS node, round(1-dist/1500,5) AS confidence FROM b WHERE rk = 1"""


def _buffer_join(s, d):
    """How much demand each facility's disc holds: places of demand in discs around places of facilities."""
    sites = materialize(I.facilities(s, d).select("fid", "mx", "my"), "sites")
    discs = G.buffer_points(materialize(S.places(sites, ["mx", "my"]).select("mx", "my"), "spots"), 5000.0)
    people = materialize(S.places(I.demand(s, d), ["mx", "my"]).select(F.col("mx").alias("x"), F.col("my").alias("y"), "n"), "people")
    held = S.spatial_join(people, discs, cell=5000.0, shuffle=True).groupBy("mx", "my").agg(F.sum("n").alias("n"))
    return sites.join(held, ["mx", "my"]).select("fid", "n")


def _hull(s, d):
    return G.convex_hull(I.points(s, d), "kind").select("kind", F.round("area", 0).alias("area"), F.size("ring").cast("long").alias("vertices"))


def _tiles(s, d):
    return vector_tiles(I.points(s, d), [6, 8, 10], "events", ["kind"]).select(F.col("z").cast("long").alias("z"), "tx", "ty", "n")


_TILE = """WITH u AS (SELECT fid, (radians(x)*6378137.0::DOUBLE+20037508.342789244::DOUBLE)/(2*20037508.342789244::DOUBLE) AS u, (20037508.342789244::DOUBLE-ln(tan(pi()/4+radians(y)/2))*6378137.0::DOUBLE)/(2*20037508.342789244::DOUBLE) AS v FROM points), z AS (SELECT fid, z, u*pow(2,z) AS u, v*pow(2,z) AS v FROM u, (VALUES (6),(8),(10)) t(z))
SELECT CAST(z AS BIGINT) AS z, CAST(floor(u) AS BIGINT) AS tx, CAST(floor(v) AS BIGINT) AS ty, count(DISTINCT (CAST(floor((u-floor(u))*4096) AS BIGINT), CAST(floor((v-floor(v))*4096) AS BIGINT))) AS n FROM z GROUP BY 1, 2, 3"""

PLANS = {
    "spatial_join_inner": (lambda s, d: S.spatial_join(I.points(s, d), I.polygons(s, d)).select("fid", "pid"), sql(f"SELECT fid, pid FROM points p JOIN polys q ON {_IN}", "points", "polys")),
    "spatial_join_left_within": (lambda s, d: S.spatial_join(I.points(s, d), I.polygons(s, d).where("region = 2"), "left", "within").select("fid", "pid"), sql("SELECT fid, pid FROM points p LEFT JOIN (SELECT * FROM polys WHERE region = 2) q ON p.x > q.x0 AND p.x < q.x1 AND p.y > q.y0 AND p.y < q.y1", "points", "polys")),
    "polygon_stats": (_stats, sql(f"SELECT pid, count(fid) AS n, {settled_sql(_SUM, 4)} AS sum, {settled_sql(_SUM + ' / count(value)', 4)} AS mean, {settled_sql('max(value)', 4)} AS max, {settled_sql('min(value)', 4)} AS min, count(fid) > 0 AS has_data FROM polys q LEFT JOIN points p ON {_IN} GROUP BY 1", "points", "polys")),
    "nearest_facility": (_nearest, sql("WITH k AS (SELECT a.fid AS demand, b.fid AS facility, sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)) AS d, row_number() OVER (PARTITION BY a.fid ORDER BY sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)), b.fid) AS rk FROM demand a, facilities b) SELECT demand, facility, round(d,2) AS distance FROM k WHERE rk = 1", "demand", "facilities")),
    "knn_weights": (lambda s, d: (lambda p: S.nearest(p, p, 8, by_self=True))(I.demand(s, d).select("fid", "mx", "my")).select("aid", "bid", F.col("rank").cast("long").alias("rank")), sql(f"WITH {_KNN.format(t='demand', k=8)} SELECT aid, bid, rk AS rank FROM knn", "demand")),
    "distance_band": (lambda s, d: S.neighbour_sums(I.customers(s, d), BAND).select(F.col("fid").alias("aid"), "n", F.round("total", 2).alias("total")), sql(f"WITH {_DV.replace('FROM demand', 'FROM customers')}, {_PAIRS.format(band=BAND)} SELECT aid, count(*) AS n, round(sum(d),2) AS total FROM pairs GROUP BY 1", "customers")),
    "space_time_pairs": (
        lambda s, d: S.neighbour_sums(I.points(s, d).select("fid", "mx", "my", (F.unix_micros(F.col("t").cast("timestamp")) / F.lit(1e6)).alias("ts")), 1500.0, lag=("ts", 21600.0)).select(F.col("fid").alias("aid"), "n"),
        sql("SELECT a.fid AS aid, count(*) AS n FROM points a JOIN points b ON abs(a.mx-b.mx) <= 1500 AND abs(a.my-b.my) <= 1500 AND sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)) <= 1500 AND abs(epoch_us(a.t)-epoch_us(b.t)) <= 21600000000 GROUP BY 1", "points"),
    ),
    "point_probe": (lambda s, d: S.probe(I.points(s, d), 116.5, 40.0, 2000.0).select("fid", F.round("distance_m", 3).alias("distance_m")), sql(f"SELECT fid, round({_HAV.format(x1='x', y1='y', x2='116.5::DOUBLE', y2='40.0::DOUBLE')},3) AS distance_m FROM points WHERE {_HAV.format(x1='x', y1='y', x2='116.5::DOUBLE', y2='40.0::DOUBLE')} <= 2000", "points")),
    "hex_binning": (lambda s, d: _hexes(s, d).withColumn("stat", settled(F.col("stat"), 4)), sql(f"{_HEXQ} SELECT q, r, n, {settled_sql('stat', 4)} AS stat FROM hexes", "points")),
    "fishnet": (_fishnet, "SELECT id AS fid, id // 27 AS col, id % 27 AS row, round(116.0::DOUBLE+(id//27)*0.03::DOUBLE,9) AS x0, round(39.5::DOUBLE+(id%27)*0.03::DOUBLE,9) AS y0, round(116.0::DOUBLE+(id//27)*0.03::DOUBLE+0.03::DOUBLE,9) AS x1, round(39.5::DOUBLE+(id%27)*0.03::DOUBLE+0.03::DOUBLE,9) AS y1 FROM range(2000) r(id) WHERE id // 27 < (SELECT greatest(1, ceil(((116.0::DOUBLE + max(c_custkey*41 % 1000)/1000.0::DOUBLE) - 116.0::DOUBLE) / 0.03::DOUBLE)) FROM customer)"),
    "heatmap_grid": (lambda s, d: _r(S.heatmap_grid(I.points(s, d), 3000.0), 6, "weight"), sql("WITH c AS (SELECT CAST(floor((mx-(SELECT min(mx) FROM points))/3000) AS BIGINT) AS col, CAST(floor((my-(SELECT min(my) FROM points))/3000) AS BIGINT) AS row, count(*) AS n FROM points GROUP BY 1, 2) SELECT col, row, n, round(n/(SELECT max(n) FROM c),6) AS weight FROM c", "points")),
    "heatmap_smooth": (lambda s, d: _r(S.heatmap_smooth(S.heatmap_grid(I.points(s, d), 3000.0), 3000.0, 6000.0), 6, "intensity"), None),
    "describe_values": (lambda s, d: _r(S.describe(table(s, d, "events"), "value"), 4, "mean", "std", "min", "p25", "p50", "p75", "max"), "SELECT count(value) AS count, round(avg(value),4) AS mean, round(stddev_samp(value),4) AS std, round(min(value),4) AS min, round(quantile_cont(value,0.25),4) AS p25, round(quantile_cont(value,0.5),4) AS p50, round(quantile_cont(value,0.75),4) AS p75, round(max(value),4) AS max FROM events"),
    "snap_to_edges": (_snap, sql(_SNAP.format(e=I.utm_sql("x", "y")[0], n=I.utm_sql("x", "y")[1]), "nodes", "edges", "demand")),
    "dissolve": (lambda s, d: S.dissolve(I.polygons(s, d), ["region"], "pid").select("region", "pid", "name", "n_parts", F.size("rings").cast("long").alias("n_rings")), "SELECT n_regionkey AS region, min(n_nationkey) AS pid, arg_min(n_name, n_nationkey) AS name, count(*) AS n_parts, count(*) AS n_rings FROM nation GROUP BY 1"),
    "convex_hull": (_hull, None),
    "voronoi_cells": (_voronoi, None),
    "overlay_intersection": (_clip, sql(f"WITH {_MASK} SELECT aid, bid, round(area,9) AS area FROM c", "polys")),
    "overlay_difference": (_difference, sql(f"WITH {_MASK} SELECT pid AS aid, round((x1-x0)*(y1-y0)-coalesce((SELECT sum(area) FROM c WHERE aid = pid),0),9) AS area FROM polys", "polys")),
    "multi_ring_buffer": (_rings, sql("SELECT fid, d AS distance, round(128*0.5*sin(2*pi()/128)*(d*d - i*i),0) AS area, 129::BIGINT AS vertices FROM facilities, (VALUES (500.0::DOUBLE,0.0::DOUBLE),(1000.0::DOUBLE,500.0::DOUBLE),(1500.0::DOUBLE,1000.0::DOUBLE)) t(d,i)", "facilities")),
    "impact_zones": (lambda s, d: G.impact_zones(I.facilities(s, d).select("fid", "mx", "my")).select("fid", "zone", F.round("area", 0).alias("area")), sql("SELECT fid, z AS zone, round(128*0.5*sin(2*pi()/128)*(d*d - i*i),0) AS area FROM facilities, (VALUES ('direct',500.0::DOUBLE,0.0::DOUBLE),('indirect',1500.0::DOUBLE,500.0::DOUBLE)) t(z,d,i)", "facilities")),
    "point_buffer_join": (
        _buffer_join,
        sql("WITH p AS (SELECT f.fid, sqrt(pow(d.mx-f.mx,2)+pow(d.my-f.my,2)) AS r, atan2(d.my-f.my, d.mx-f.mx)+pi() AS a FROM facilities f JOIN demand d ON abs(d.mx-f.mx) <= 5000 AND abs(d.my-f.my) <= 5000) SELECT fid, count(*) AS n FROM p WHERE r*cos(a - floor(a*32/pi())*pi()/32 - pi()/64) <= 5000*cos(pi()/64) GROUP BY 1", "facilities", "demand"),
    ),
    "datum_transform": (_datum, None),
    "utm_mercator": (_utm, sql("SELECT fid, round(mx,3) AS e, round(my,3) AS n, round(radians(x)*6378137.0::DOUBLE,3) AS merc_x, round(ln(tan(pi()/4+radians(y)/2))*6378137.0::DOUBLE,3) AS merc_y, true AS returns FROM demand", "demand")),
    "ring_measures": (
        _measures,
        sql(f"SELECT pid, round((x1-x0)*(y1-y0),9) AS area, round(2*(x1-x0)+2*(y1-y0),9) AS perimeter, round((x0+x1)/2,9) AS cx, round((y0+y1)/2,9) AS cy, round(radians(x1-x0)*2*(sin(radians(y1))-sin(radians(y0)))*pow(6371.0088::DOUBLE,2)/2,4) AS km2, round({_SIDE('x0', 'y0', 'x1', 'y0')}+{_SIDE('x1', 'y0', 'x1', 'y1')}+{_SIDE('x1', 'y1', 'x0', 'y1')}+{_SIDE('x0', 'y1', 'x0', 'y0')},3) AS boundary_m FROM polys", "polys"),
    ),
    "moran_i": (
        _moran,
        sql(f"WITH {_KNN.format(t='facilities', k=8)}, st AS (SELECT avg(capacity) AS m, var_pop(capacity) AS v, count(*) AS n FROM facilities) SELECT round(round(max(n)/count(*)*sum((a.capacity-m)*(b.capacity-m))/(max(n)*max(v)),6),5) AS moran_i, round(round(-1.0::DOUBLE/(max(n)-1),6),5) AS expected_i, max(n) AS n FROM knn JOIN facilities a ON a.fid = aid JOIN facilities b ON b.fid = bid, st", "facilities"),
    ),
    "moran_permutation": (_moran_p, None),
    "getis_ord_gi": (_gi, sql(_GI, "demand")),
    "lisa_quadrants": (
        lambda s, d: ST.lisa(_hexes(s, d), "stat").select("q", "r", settled(F.col("local_i"), 4).alias("local_i"), "quadrant"),
        sql(f"{_HEXQ}, z AS (SELECT q, r, (stat-(SELECT avg(stat) FROM hexes))/(SELECT stddev_pop(stat) FROM hexes) AS z FROM hexes), l AS (SELECT a.q, a.r, a.z, coalesce(avg(b.z),0) AS lag FROM z a LEFT JOIN z b ON (b.q-a.q, b.r-a.r) IN ((1,0),(1,-1),(0,-1),(-1,0),(-1,1),(0,1)) GROUP BY 1, 2, 3) SELECT q, r, {settled_sql('round(z*lag,6)', 4)} AS local_i, CASE WHEN z >= 0 AND lag >= 0 THEN 'HH' WHEN z < 0 AND lag >= 0 THEN 'LH' WHEN z < 0 AND lag < 0 THEN 'LL' ELSE 'HL' END AS quadrant FROM l", "points"),
    ),
    "lisa_permutation": (lambda s, d: ST.lisa(_hexes(s, d), "stat", permutations=99), None),
    "deviational_ellipse": (
        lambda s, d: _r(ST.deviational_ellipse(I.points(s, d)), 2, "cx", "cy", "sigma_x", "sigma_y", "angle_deg"),
        sql("""WITH c AS (SELECT avg(mx) AS cx, avg(my) AS cy FROM points), m AS (SELECT max(cx) AS cx, max(cy) AS cy, sum(pow(mx-cx,2)) AS xx, sum(pow(my-cy,2)) AS yy, sum((mx-cx)*(my-cy)) AS xy, count(*) AS n FROM points, c), t AS (SELECT *, 0.5*atan2(2*xy, xx-yy) AS th FROM m)
        SELECT round(cx,2) AS cx, round(cy,2) AS cy, round(sqrt(2*(xx*cos(th)*cos(th)+2*xy*cos(th)*sin(th)+yy*sin(th)*sin(th))/n),2) AS sigma_x, round(sqrt(2*(xx*sin(th)*sin(th)-2*xy*cos(th)*sin(th)+yy*cos(th)*cos(th))/n),2) AS sigma_y, round(((degrees(th)+180) % 180),2) AS angle_deg,
        CASE WHEN (degrees(th)+180) % 180 BETWEEN 67.5 AND 112.5 THEN 'North-South' WHEN (degrees(th)+180) % 180 BETWEEN 22.5 AND 67.5 THEN 'North-East to South-West' WHEN (degrees(th)+180) % 180 BETWEEN 112.5 AND 157.5 THEN 'North-West to South-East' ELSE 'East-West' END AS direction FROM t""", "points"),
    ),
    "nearest_neighbour_index": (lambda s, d: _r(ST.nearest_neighbour_index(I.demand(s, d).dropDuplicates(["x", "y"])), 3, "mean_distance", "std_distance", "ratio").select("mean_distance", "ratio", "pattern"), None),
    "mean_centre": (lambda s, d: ST.mean_centre(I.points(s, d)).withColumns({"x": F.round("x", 7), "y": F.round("y", 7)}), sql("SELECT round(avg(x),7) AS x, round(avg(y),7) AS y, count(*) AS n FROM points", "points")),
    "central_feature": (lambda s, d: ST.central_feature(I.facilities(s, d)).withColumn("total", F.round("total", 1)), sql("SELECT a.fid, round(sum(sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2))),1) AS total FROM facilities a, facilities b GROUP BY 1 ORDER BY sum(sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2))), 1 LIMIT 1", "facilities")),
    "breaks_quantiles": (_breaks("quantiles"), "SELECT unnest(range(6)) AS i, unnest(list_transform(quantile_cont(o_totalprice, [0.0,0.2,0.4,0.6,0.8,1.0]), lambda v: round(v,4))) AS upper FROM orders"),
    "breaks_equal": (_breaks("equal"), "SELECT i, round(min(o_totalprice)+(max(o_totalprice)-min(o_totalprice))*i/5,4) AS upper FROM orders, range(6) r(i) GROUP BY i"),
    "breaks_std_dev": (_breaks("std_dev", 6), "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT lo AS v FROM s UNION ALL SELECT hi FROM s UNION ALL SELECT m+k*0.5::DOUBLE*sd FROM s, (VALUES (-2),(-1),(1),(2),(3)) t(k) WHERE m+k*0.5::DOUBLE*sd > lo AND m+k*0.5::DOUBLE*sd < hi) SELECT row_number() OVER (ORDER BY v) - 1 AS i, round(v,4) AS upper FROM b"),
    "breaks_head_tail": (_breaks("head_tail"), "WITH RECURSIVE h(k, m) AS (SELECT 1, (SELECT avg(o_totalprice) FROM orders) UNION ALL SELECT k+1, (SELECT avg(o_totalprice) FROM orders WHERE o_totalprice <= m) FROM h WHERE k < 4), b AS (SELECT m AS v FROM h UNION ALL SELECT min(o_totalprice) FROM orders UNION ALL SELECT max(o_totalprice) FROM orders) SELECT row_number() OVER (ORDER BY v) - 1 AS i, round(v,4) AS upper FROM b"),
    "breaks_jenks": (_breaks("jenks"), None),
    "classify_values": (_classes, "WITH q AS (SELECT quantile_cont(o_totalprice,0.25) AS a, quantile_cont(o_totalprice,0.5) AS b, quantile_cont(o_totalprice,0.75) AS c FROM orders) SELECT CAST(CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= c THEN 2 ELSE 3 END AS BIGINT) AS class, count(*) AS n FROM orders, q GROUP BY 1"),
    "thematic_categories": (lambda s, d: ST.categories(table(s, d, "events"), "event_type", 3, "event_id").withColumn("class", F.col("class").cast("long")), "WITH c AS (SELECT event_type AS value, count(*) AS n, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS k FROM events GROUP BY 1) SELECT value, k AS class, n FROM c WHERE k < 3 UNION ALL SELECT '__other__', 3, CAST(sum(n) AS BIGINT) FROM c WHERE k >= 3"),
    "dbscan": (_dbscan, sql(_DBSCAN.replace("WITH RECURSIVE", "WITH"), "facilities", recursive=True)),
    "st_dbscan": (_st_dbscan, None),
    "kmeans": (lambda s, d: C.kmeans(I.demand(s, d), 5, ["mx", "my"]), None),
    "kde_surface": (_kde, sql(_KDE, "facilities")),
    "idw_surface": (_idw, sql(_IDW, "facilities")),
    "geojson_export": (lambda s, d: feature_json(I.facilities(s, d).select("fid", "x", "y", "nation")).select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.geometry.type").alias("kind"), F.get_json_object("value", "$.properties.nation").alias("nation")), sql("SELECT CAST(fid AS VARCHAR) AS id, 'Point' AS kind, CAST(nation AS VARCHAR) AS nation FROM facilities", "facilities")),
    "vector_tiles": (_tiles, sql(_TILE, "points")),
    "tile_assignment": (lambda s, d: tile_points(I.facilities(s, d), [9]).select("fid", "tx", "ty"), None),
}
