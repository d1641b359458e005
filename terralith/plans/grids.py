"""Rasters and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as N
from ..operators import raster as R
from . import inputs as I
from .inputs import sql, table


def _round(df, n, *cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _terrain(s, d):
    return _round(R.terrain(I.pixels(s, d), 30.0), 3, "slope", "aspect", "hillshade")


_TERRAIN = """WITH a AS (SELECT row, col, v, coalesce(lag(v) OVER x, v) AS w, coalesce(lead(v) OVER x, v) AS e FROM pixels WINDOW x AS (PARTITION BY row ORDER BY col)),
g AS (SELECT row, col, coalesce(lag(w) OVER y, w) AS n00, coalesce(lag(v) OVER y, v) AS n01, coalesce(lag(e) OVER y, e) AS n02, w AS n10, v AS n11, e AS n12, coalesce(lead(w) OVER y, w) AS n20, coalesce(lead(v) OVER y, v) AS n21, coalesce(lead(e) OVER y, e) AS n22 FROM a WINDOW y AS (PARTITION BY col ORDER BY row)),
h AS (SELECT row, col, ((n12-n10)/60+(n02-n00)/120+(n22-n20)/120)/2 AS zx, ((n21-n01)/60+(n20-n00)/120+(n22-n02)/120)/2 AS zy, (n12-n10)/60 AS cx, (n21-n01)/60 AS cy FROM g)
SELECT row, col, round(degrees(atan(sqrt(zx*zx+zy*zy))),3) AS slope, CASE WHEN NOT (cx = 0 AND cy = 0) THEN round((degrees(atan2(-cx, cy))+360) % 360, 3) END AS aspect, round(least(255.0, greatest(0.0, 255*(sin(radians(45))*cos(atan(sqrt(cx*cx+cy*cy)))+cos(radians(45))*sin(atan(sqrt(cx*cx+cy*cy)))*cos(radians(315)-atan2(-cx,cy))))),3) AS hillshade FROM h"""


def _bands(s, d):
    line = table(s, d, "lineitem")
    return line.groupBy((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(F.avg("l_quantity").alias("red"), F.avg(F.col("l_extendedprice") / 1000).alias("nir"), F.avg(F.col("l_discount") * 100).alias("green"), F.avg(F.col("l_tax") * 100).alias("blue"), F.avg(F.col("l_quantity") - 20).alias("swir"))


_BANDS = "bands AS (SELECT l_orderkey % 64 AS row, l_partkey % 64 AS col, avg(l_quantity) AS red, avg(l_extendedprice/1000) AS nir, avg(l_discount*100) AS green, avg(l_tax*100) AS blue, avg(l_quantity-20) AS swir FROM lineitem GROUP BY 1, 2)"


def _indices(s, d):
    b = _bands(s, d)
    cols = {c: F.col(c) for c in ("red", "nir", "green", "blue", "swir")}
    return b.select("row", "col", *[F.round(R.index(n, cols), 5).alias(n) for n in ("ndvi", "ndwi", "nbr", "evi")])


def _zonal(s, d):
    x, y = F.lit(116.0) + (F.col("col") + F.lit(0.5)) / F.lit(64.0), F.lit(39.5) + (F.col("row") + F.lit(0.5)) / F.lit(64.0)
    return _round(R.zonal(I.pixels(s, d), I.polygons(s, d), "pid", x, y), 4, "mean", "sum", "max", "min")


def _series(s, d):
    line = table(s, d, "lineitem")
    return line.groupBy(F.year("l_shipdate").cast("long").alias("scene"), (F.col("l_orderkey") % 16).alias("row"), (F.col("l_partkey") % 16).alias("col")).agg(F.avg("l_quantity").alias("v"))


_SERIES = "series AS (SELECT year(l_shipdate) AS scene, l_orderkey % 16 AS row, l_partkey % 16 AS col, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


def _raster_trend(s, d):
    from ..operators.temporal import regression

    got = R.series_stats(_series(s, d)).withColumns({"k": F.lit("aoi"), "x": F.col("scene").cast("double")})
    return regression(got, "x", "mean", ["k"]).select("k", "n", F.round("slope", 4).alias("slope"))


def _placed(s, d, which, idc):
    """Facilities or demand at the nearest grid node, by rounding to the grid."""
    f = which(s, d)
    c = F.least(F.lit(19), F.greatest(F.lit(0), F.rint((F.col("x") - F.lit(116.0)) / F.lit(0.05)).cast("long")))
    r = F.least(F.lit(19), F.greatest(F.lit(0), F.rint((F.col("y") - F.lit(39.5)) / F.lit(0.05)).cast("long")))
    return f.withColumn("node", r * 20 + c).withColumnRenamed("fid", idc)


_PLACED = "{n} AS (SELECT *, least(19, greatest(0, CAST(round_even((y-39.5::DOUBLE)/0.05::DOUBLE,0) AS BIGINT)))*20 + least(19, greatest(0, CAST(round_even((x-116.0::DOUBLE)/0.05::DOUBLE,0) AS BIGINT))) AS node FROM {t})"


def _on_grid(s, d):
    """(edges, demand, facilities) of the street grid, each at its node."""
    _, e = I.grid_edges(s, d)
    return e, _placed(s, d, I.demand, "oid").select("oid", "node", "weight"), _placed(s, d, I.facilities, "did").select("did", "node", "capacity")


_COSTS = """dist(o, node, cost, k) AS (SELECT DISTINCT node, node, 0.0::DOUBLE, 0 FROM fp UNION ALL
  SELECT o, node, min(cost), max(k) FROM (SELECT d.o, e.v AS node, d.cost + e.cost AS cost, d.k + 1 AS k FROM dist d JOIN edges e ON e.u = d.node WHERE d.k < 60) GROUP BY o, node),
best AS (SELECT o, node, min(cost) AS cost FROM dist GROUP BY 1, 2), od AS (SELECT dp.fid AS oid, fp.fid AS did, cost FROM fp JOIN best ON best.o = fp.node JOIN dp ON dp.node = best.node)"""
_NET = f"WITH {_PLACED.format(n='fp', t='facilities')}, {_PLACED.format(n='dp', t='demand')}, {_COSTS}"


def _od_query(s, d):
    return N.od_totals(*_on_grid(s, d)).select("oid", "n", F.round("total", 2).alias("total"))


def _closest(s, d):
    return _long(N.closest_on_network(*_on_grid(s, d), 2), "rank")


def _access(method):
    def run(s, d):
        got = N.node_accessibility(*_on_grid(s, d), 900.0, method)
        return got.select("oid", F.round("score", 6).alias("score"), "least", "served")

    return run


def _coverage(s, d):
    return _round(N.coverage(N.node_accessibility(*_on_grid(s, d), 600.0, "circle")), 3, "pct", "mean_cost")


def _allocate(problem):
    """Demand by node, and of the facilities at a node as many as can be chosen: the same sums and sites from as many rows as nodes."""

    def run(s, d):
        e, dem, fac = _on_grid(s, d)
        fac = N.first_sites(fac, 3)
        zones = dem.groupBy(F.col("node").alias("oid")).agg(F.sum("weight").alias("weight"))
        od = N.od_matrix(e, fac.select(F.col("did").alias("oid"), "node"), zones.select(F.col("oid").alias("did"), F.col("oid").alias("node"))).select(F.col("did").alias("oid"), F.col("oid").alias("did"), "cost")
        chosen, score = N.allocate(od, zones, None, 3, problem)
        return s.createDataFrame([(c, round(score, 1)) for c in sorted(chosen)], "did long, score double")

    return run


def _path(s, d):
    _, e = I.grid_edges(s, d)
    got = N.shortest_path(e, 0, 399)
    return got.agg(F.count("*").alias("n"), F.round(F.max("cost"), 3).alias("cost"), F.min(F.col("node") >= 0).alias("ok"))


def _service(s, d):
    _, e = I.grid_edges(s, d)
    fac = _placed(s, d, I.facilities, "did").select("node").distinct()
    return _round(N.service_area(e, fac, [300.0, 900.0]), 2, "reach")


def _barriers(s, d):
    _, e = I.grid_edges(s, d)
    b = s.createDataFrame([(0, 1, None), (1, 0, None), (0, 20, 5.0)], "u long, v long, factor double")
    got = N.costs(N.apply_barriers(e, b), s.createDataFrame([(0,)], "node long"))
    return got.select("node", F.round("cost", 3).alias("cost"))


def _built(s, d):
    rows = table(s, d, "orders").select((F.col("o_orderkey") % 40).alias("id")).distinct().select(F.col("id").alias("fid"), F.when(F.col("id") % 5 == 0, "yes").otherwise("-1").alias("one_way"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(50.0).alias("speed_kmh"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.struct(F.when(F.col("id") < 20, 116.0 + k * 0.05).otherwise(116.0 + (F.col("id") - 20) * 0.05).alias("x"), F.when(F.col("id") < 20, 39.5 + F.col("id") * 0.05).otherwise(39.5 + k * 0.05).alias("y"))).alias("points"))
    nodes, edges = N.build_edges(rows)
    return edges.agg(F.count("*").alias("n_edges"), F.round(F.sum("length_m"), 0).alias("metres")).join(nodes.agg(F.count("*").alias("n_nodes")))


def _route(s, d):
    e, _, fac = _on_grid(s, d)
    stops = [r[0] for r in fac.select("node").distinct().orderBy("node").collect()]  # at most the grid's nodes
    pts = s.createDataFrame([(i, n) for i, n in enumerate(stops)], "oid long, node long")
    m = {(r[0], r[1]): r[2] for r in N.od_matrix(e, pts, pts.withColumnRenamed("oid", "did")).collect()}  # a stop table, square of its stops
    tour, length = N.route([[m[i, j] for j in range(len(stops))] for i in range(len(stops))])
    return s.createDataFrame([(k, stops[i], round(length, 2)) for k, i in enumerate(tour)], "seq long, node long, total double")


def _turns(s, d):
    n, e = I.grid_edges(s, d)
    line = N.turn_edges(n, e, 30.0)
    return line.agg(F.count("*").alias("n"), F.round(F.sum("cost"), 0).alias("total"))


PLANS = {
    "raster_reclassify": (lambda s, d: R.reclassify(I.pixels(s, d), [(None, 20, 1), (20, 30, 2), (28, 40, 3)]), sql("SELECT row, col, CASE WHEN v <= 20 THEN 1.0 WHEN v BETWEEN 20 AND 30 THEN 2.0 WHEN v BETWEEN 28 AND 40 THEN 3.0 END::DOUBLE AS v FROM pixels", "pixels")),
    "raster_calculator": (lambda s, d: _round(R.calculator(I.pixels(s, d), I.pixels(s, d, "A"), lambda a, b: F.when(b != 20, (a - b) / (b - 20))), 5, "v"), sql("SELECT p.row, p.col, round(CASE WHEN q.v <> 20 THEN (p.v-q.v)/(q.v-20) END,5) AS v FROM pixels p LEFT JOIN pixels_a q ON p.row = q.row AND p.col = q.col", "pixels", "pixels_a")),
    "raster_resample_average": (lambda s, d: _round(R.resample(I.pixels(s, d), 4), 5, "v"), sql("SELECT row//4 AS row, col//4 AS col, round(avg(v),5) AS v FROM pixels GROUP BY 1, 2", "pixels")),
    "raster_resample_mode": (lambda s, d: R.resample(I.pixels(s, d).withColumn("v", F.rint(F.col("v") / 5)), 4, "mode"), sql("WITH c AS (SELECT row//4 AS row, col//4 AS col, round_even(v/5,0) AS v, count(*) AS n FROM pixels GROUP BY 1, 2, 3) SELECT row, col, arg_max(v, (n, -v)) AS v FROM c GROUP BY 1, 2", "pixels")),
    "raster_upsample": (lambda s, d: _round(R.upsample_bilinear(I.pixels(s, d), 2), 4, "v"), None),
    "raster_indices": (_indices, f"WITH {_BANDS} SELECT row, col, round(CASE WHEN nir+red > 0 THEN (nir-red)/(nir+red) END,5) AS ndvi, round(CASE WHEN green+nir > 0 THEN (green-nir)/(green+nir) END,5) AS ndwi, round(CASE WHEN nir+swir > 0 THEN (nir-swir)/(nir+swir) END,5) AS nbr, round(CASE WHEN nir+6*red-7.5::DOUBLE*blue+1 > 0 THEN 2.5::DOUBLE*((nir-red)/(nir+6*red-7.5::DOUBLE*blue+1)) END,5) AS evi FROM bands"),
    "raster_terrain": (_terrain, sql(_TERRAIN, "pixels")),
    "raster_stats": (lambda s, d: _round(R.raster_stats(I.pixels(s, d)), 4, "valid_pct", "min", "max", "mean", "std"), sql("SELECT count(*) AS n, round(100.0::DOUBLE*count(v)/count(*),4) AS valid_pct, round(min(v),4) AS min, round(max(v),4) AS max, round(avg(v),4) AS mean, round(stddev_pop(v),4) AS std FROM pixels", "pixels")),
    "raster_circular_mean": (lambda s, d: R.raster_stats(I.pixels(s, d).withColumn("v", F.col("v") * 7), circular=True).select(F.round("mean", 3).alias("mean")), sql("SELECT round((degrees(atan2(avg(sin(radians(v*7))), avg(cos(radians(v*7)))))+360) % 360, 3) AS mean FROM pixels", "pixels")),
    "zonal_statistics": (_zonal, sql("WITH c AS (SELECT v, 116.0::DOUBLE+(col+0.5::DOUBLE)/64.0::DOUBLE AS x, 39.5::DOUBLE+(row+0.5::DOUBLE)/64.0::DOUBLE AS y FROM pixels) SELECT pid, count(v) AS n, round(avg(v),4) AS mean, round(sum(v),4) AS sum, round(max(v),4) AS max, round(min(v),4) AS min FROM polys q LEFT JOIN c p ON p.x BETWEEN q.x0 AND q.x1 AND p.y BETWEEN q.y0 AND q.y1 GROUP BY 1", "pixels", "polys")),
    "raster_change": (lambda s, d: R.change(I.pixels(s, d), I.pixels(s, d, "A"), 3.0), sql("WITH c AS (SELECT q.v-p.v AS d FROM pixels p JOIN pixels_a q ON p.row=q.row AND p.col=q.col), k AS (SELECT CASE WHEN d >= 6 THEN 'significant_improvement' WHEN d >= 3 THEN 'slight_improvement' WHEN d > -3 THEN 'no_change' WHEN d > -6 THEN 'slight_degradation' ELSE 'significant_degradation' END AS class FROM c) SELECT class, count(*) AS n, round(100.0::DOUBLE*count(*)/(SELECT count(*) FROM k),2) AS pct FROM k GROUP BY 1", "pixels", "pixels_a")),
    "raster_difference": (lambda s, d: _round(R.difference_stats(I.pixels(s, d), I.pixels(s, d, "A")), 4, "mean", "std", "min", "max"), sql("SELECT count(*) AS n, round(avg(q.v-p.v),4) AS mean, round(stddev_pop(q.v-p.v),4) AS std, round(min(q.v-p.v),4) AS min, round(max(q.v-p.v),4) AS max FROM pixels p JOIN pixels_a q ON p.row=q.row AND p.col=q.col", "pixels", "pixels_a")),
    "raster_series": (lambda s, d: _round(R.series_stats(R.time_slice(_series(s, d), "scene", 1993, 1996)), 4, "mean", "std", "min", "max"), f"WITH {_SERIES} SELECT scene, count(v) AS n, round(avg(v),4) AS mean, round(stddev_pop(v),4) AS std, round(min(v),4) AS min, round(max(v),4) AS max FROM series WHERE scene BETWEEN 1993 AND 1996 GROUP BY 1"),
    "raster_trend": (_raster_trend, f"WITH {_SERIES}, m AS (SELECT scene, avg(v) AS v FROM series GROUP BY 1) SELECT 'aoi' AS k, count(*) AS n, round(round(regr_slope(v, scene),6),4) AS slope FROM m"),
    "raster_tiles": (lambda s, d: R.tiles(I.pixels(s, d), 16).select("tx", "ty", F.size("pixels").cast("long").alias("n"), F.round(F.element_at("pixels", 1)["v"], 4).alias("first")), sql("SELECT col//16 AS tx, row//16 AS ty, count(*) AS n, round(arg_min(v, (row%16)*16+col%16),4) AS first FROM pixels GROUP BY 1, 2", "pixels")),
    "network_build": (_built, "WITH l AS (SELECT DISTINCT o_orderkey % 40 AS id FROM orders), p AS (SELECT id, k, CASE WHEN id < 20 THEN 116.0::DOUBLE + k*0.05::DOUBLE ELSE 116.0::DOUBLE + (id-20)*0.05::DOUBLE END AS x, CASE WHEN id < 20 THEN 39.5::DOUBLE + id*0.05::DOUBLE ELSE 39.5::DOUBLE + k*0.05::DOUBLE END AS y FROM l, range(20) r(k)), e AS (SELECT id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY id ORDER BY k)), d AS (SELECT CASE WHEN id % 5 = 0 THEN 1 ELSE 2 END AS ways, 2*6371000.0::DOUBLE*asin(sqrt(pow(sin(radians(y2-y)/2),2)+cos(radians(y))*cos(radians(y2))*pow(sin(radians(x2-x)/2),2))) AS m FROM e WHERE x2 IS NOT NULL) SELECT CAST(sum(ways) AS BIGINT) AS n_edges, round(sum(ways*m),0) AS metres, (SELECT count(DISTINCT (round(x,6), round(y,6))) FROM p) AS n_nodes FROM d"),
    "network_od": (_od_query, sql(_NET + " SELECT oid, count(*) AS n, round(sum(cost),2) AS total FROM od GROUP BY 1", "edges", "facilities", "demand", recursive=True)),
    "closest_facility": (_closest, sql(_NET + ", r AS (SELECT oid, did, round(cost,3) AS cost, row_number() OVER (PARTITION BY oid ORDER BY round(cost,3), did) AS rank FROM od) SELECT * FROM r WHERE rank <= 2", "edges", "facilities", "demand", recursive=True)),
    "accessibility_2sfca": (_access("2sfca"), sql(_NET + ", near AS (SELECT oid, did, round(cost,3) AS cost FROM od WHERE round(cost,3) <= 900), ratio AS (SELECT did, any_value(capacity)/sum(weight) AS ratio FROM near JOIN dp ON dp.fid = oid JOIN fp ON fp.fid = did GROUP BY 1), g AS (SELECT oid, sum(ratio) AS score, min(cost) AS least FROM near JOIN ratio USING (did) GROUP BY 1) SELECT fid AS oid, round(coalesce(score,0),6) AS score, least, coalesce(score,0) > 0 AS served FROM dp LEFT JOIN g ON oid = fid", "edges", "facilities", "demand", recursive=True)),
    "accessibility_circle": (_access("15min_circle"), sql(_NET + ", g AS (SELECT oid, min(round(cost,3)) AS least FROM od WHERE round(cost,3) <= 900 GROUP BY 1) SELECT fid AS oid, CASE WHEN least IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score, least, least IS NOT NULL AS served FROM dp LEFT JOIN g ON oid = fid", "edges", "facilities", "demand", recursive=True)),
    "accessibility_coverage": (_coverage, sql(_NET + ", g AS (SELECT oid, min(round(cost,3)) AS least FROM od WHERE round(cost,3) <= 600 GROUP BY 1) SELECT sum(CASE WHEN least IS NOT NULL THEN weight ELSE 0 END) AS served, sum(weight) AS total, round(100.0::DOUBLE*sum(CASE WHEN least IS NOT NULL THEN weight ELSE 0 END)/sum(weight),3) AS pct, round(sum(weight*least)/sum(CASE WHEN least IS NOT NULL THEN weight ELSE 0 END),3) AS mean_cost FROM dp LEFT JOIN g ON oid = fid", "edges", "facilities", "demand", recursive=True)),
    "allocation_p_median": (_allocate("p_median"), None),
    "allocation_max_coverage": (_allocate("max_coverage"), None),
    "network_shortest_path": (_path, None),
    "network_service_area": (_service, sql(_NET + " SELECT o AS facility, brk AS break, count(DISTINCT best.node) AS n_nodes, round(sum(least(e.cost, brk-best.cost)),2) AS reach FROM best JOIN (VALUES (300.0::DOUBLE),(900.0::DOUBLE)) b(brk) ON best.cost <= brk LEFT JOIN edges e ON e.u = best.node GROUP BY 1, 2", "edges", "facilities", "demand", recursive=True)),
    "network_barriers": (_barriers, sql("WITH hard AS (SELECT u, v, CASE WHEN u = 0 AND v = 20 THEN cost*5 ELSE cost END AS cost FROM edges WHERE NOT (u = 0 AND v = 1) AND NOT (u = 1 AND v = 0)), dist(node, cost, k) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0 UNION ALL SELECT node, min(cost), max(k) FROM (SELECT e.v AS node, d.cost + e.cost AS cost, d.k + 1 AS k FROM dist d JOIN hard e ON e.u = d.node WHERE d.k < 60) GROUP BY node) SELECT node, round(min(cost), 3) AS cost FROM dist GROUP BY 1", "edges", recursive=True)),
    "network_route": (_route, None),
    "network_turns": (_turns, None),
}
