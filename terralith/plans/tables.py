"""Relational and temporal queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import temporal as T
from ..functions.predicates import attribute_filter, layer_filter, safe_where
from . import inputs as I
from .inputs import settled, settled_sql, sql, table

BOX = (116.2, 39.6, 116.7, 40.2)
SPEC = R.QuerySpec(bbox=BOX, where="value > 50", columns=["fid", "x", "y", "value"], limit=500, offset=100)
_BOX_SQL = "x BETWEEN 116.2::DOUBLE AND 116.7::DOUBLE AND y BETWEEN 39.6::DOUBLE AND 40.2::DOUBLE"


def _events(spark, d):
    return table(spark, d, "events")


def _bucket(unit):
    def run(spark, d):
        got = T.temporal_aggregate(_events(spark, d), "ts", unit, "value", ["event_type"], "event_id", places=2)
        return got.select("event_type", "bucket", "n_rows", "n_values", *[settled(F.col(c), 4).alias(c) for c in ("mean", "sum", "min", "max", "std", "first", "last")])

    return run


def _bucket_sql(key):
    s, q, n = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)", "CAST(sum(CAST(value AS DECIMAL(14,2)) * CAST(value AS DECIMAL(14,2))) AS DOUBLE)", "count(value)"
    r = lambda x: settled_sql(x, 4)
    std = f"coalesce(CASE WHEN {n} > 1 THEN sqrt(greatest(({q} - {s} * {s} / {n}) / ({n} - 1), 0)) END, CASE WHEN {n} = 1 THEN 0.0 END)"
    return f"""SELECT event_type, {key} AS bucket, count(*) AS n_rows, {n} AS n_values, {r(f"{s} / {n}")} AS mean, {r(s)} AS sum, {r("min(value)")} AS min, {r("max(value)")} AS max,
    {r(std)} AS std, {r("arg_min(value, (ts,event_id))")} AS first, {r("arg_max(value, (ts,event_id))")} AS last FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"""


_MONDAY = "date_trunc('week', ts)"
_WEEK = f"strftime({_MONDAY}, '%Y') || '-W' || lpad(CAST((dayofyear({_MONDAY}) + 6 - dayofweek({_MONDAY})) // 7 AS VARCHAR), 2, '0')"


def _daily(spark, d):
    return _events(spark, d).groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("v")).withColumn("i", F.unix_date(F.col("day").cast("date")).cast("double"))


_DAILY = "SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS v, CAST(date_diff('day', DATE '1970-01-01', CAST(date_trunc('day', ts) AS DATE)) AS DOUBLE) AS i FROM events GROUP BY 1, 2"


def _poi(spark, d):
    return I.points(spark, d).select("fid", "x", "y", F.lpad((F.col("user_id") * 7919 % 900000 + 100000).cast("string"), 6, "0").alias("adcode"), F.concat(F.col("kind"), F.lit("_%_"), F.col("user_id").cast("string")).alias("name"), F.initcap("kind").alias("category"), F.concat(F.col("kind"), F.lit(";type"), (F.col("fid") % 17).cast("string")).alias("subtype"))


_POI = "poi AS (SELECT fid, x, y, lpad(CAST(user_id*7919 % 900000 + 100000 AS VARCHAR), 6, '0') AS adcode, kind || '_%_' || CAST(user_id AS VARCHAR) AS name, upper(kind[1]) || kind[2:] AS category, kind || ';type' || CAST(fid % 17 AS VARCHAR) AS subtype FROM points)"
_TRIANGLE = [(116.1, 39.6), (116.9, 39.7), (116.5, 40.3)]


def _panel(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy((F.col("c_nationkey") * 1101 + 5).cast("string").alias("adcode"), F.concat(F.lit("county"), F.col("c_nationkey").cast("string")).alias("county"), F.year("o_orderdate").alias("year"))
    return g.agg(F.create_map(F.lit("orders"), F.count("*").cast("double"), F.lit("total"), F.round(F.sum("o_totalprice"), 2), F.lit("max"), F.max("o_totalprice")).alias("indicators"))


def _lineage(spark, d):
    o = table(spark, d, "orders")
    edges = o.select((F.col("o_custkey") % 97).alias("src"), (F.col("o_custkey") * 31 % 97 + F.col("o_orderkey") % 3).alias("dst"), (F.col("o_custkey") % 2).alias("project")).distinct()
    roots = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_nationkey") % 2).cast("long").alias("project"))
    return R.lineage(edges, roots, 5).select("root", "node", "project", F.col("depth").cast("long").alias("depth"))


_LINEAGE = """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 97 AS src, o_custkey*31 % 97 + o_orderkey % 3 AS dst, o_custkey % 2 AS project FROM orders),
walk(root, node, project, depth) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), CAST(n_nationkey % 2 AS BIGINT), 0 FROM nation UNION SELECT w.root, e.dst, w.project, w.depth + 1 FROM walk w JOIN e ON e.src = w.node AND e.project = w.project WHERE w.depth < 5)
SELECT root, node, project, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY 1, 2, 3"""


def _asof(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return R.asof_join(left, right, "user_id", "ts", "view_ts", ["view_id", "view_value"], "view_id").select("event_id", "view_id", F.round("view_value", 4).alias("view_value"))


def _interval(spark, d):
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("part"), (F.col("p_retailprice") - 1).alias("low"), (F.col("p_retailprice") + 1).alias("high"))
    ranges = lines.groupBy("low", "high").agg(F.count("*").alias("parts"), F.min("part").alias("first"))  # equal intervals hold the same points
    pts = _events(spark, d).select("event_id", (F.col("value") * 10).alias("v"))
    return R.interval_join(pts, ranges, "v", "low", "high", 10.0).groupBy("event_id").agg(F.sum("parts").alias("n"), F.min("first").alias("first_part"))


def _rules(spark, d):
    p = table(spark, d, "part")
    rules = p.select((F.col("p_partkey") % 40).alias("rule_id"), F.lit("size").alias("key"), (F.col("p_partkey") % 40).cast("double").alias("low"), ((F.col("p_partkey") % 40) + 20).cast("double").alias("high"), F.lit(None).cast("array<string>").alias("options")).distinct()
    kinds = spark.createDataFrame([(100, "segment", None, None, ["building", "Machinery"]), (101, "missing", 5.0, None, None)], rules.schema)
    c = table(spark, d, "customer")
    contexts = c.select(F.col("c_custkey").alias("ctx_id"), F.lit("size").alias("key"), (F.col("c_custkey") % 60).cast("double").alias("num"), F.lit(None).cast("string").alias("text")).unionAll(c.select("c_custkey", F.lit("segment"), F.lit(None).cast("double"), "c_mktsegment"))
    return R.rule_applicability(rules.unionAll(kinds), contexts).groupBy("rule_id").agg(F.count("*").alias("n_contexts"))


def _trend(spark, d):
    got = T.trend(_daily(spark, d), "i", "v", ["event_type"])
    return got.select("event_type", "n", F.round("ols_slope", 5).alias("ols_slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 4).alias("r2"), F.round("sen_slope", 5).alias("sen_slope"), "direction")


_WINDOW = T.relative_window("last_7_days", dt.datetime(2024, 1, 30))
_SNAP = "SELECT year(o_orderdate) AS snapshot, o_totalprice AS v, o_orderkey AS k, o_custkey AS c FROM orders"


def _orders(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("snapshot"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


def _matches(spark, d):
    o = _orders(spark, d)
    got = T.snapshot_matches(o.where("snapshot = 1995"), o.where("snapshot = 1996"), "c", "v", "k")
    return got.select("id", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), "status")


def _windows(spark, d):
    from pyspark.sql import Window

    e = _events(spark, d)
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    return e.select("event_id", "event_type", F.rank().over(w).cast("long").alias("rank"), F.ntile(4).over(w).cast("long").alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("running"))


PLANS = {
    "temporal_bucket_day": (_bucket("day"), _bucket_sql("strftime(ts, '%Y-%m-%d')")),
    "temporal_bucket_hour": (_bucket("hour"), _bucket_sql("strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00')")),
    "temporal_bucket_week": (_bucket("week"), _bucket_sql(_WEEK)),
    "temporal_bucket_month": (_bucket("month"), _bucket_sql("strftime(ts, '%Y-%m')")),
    "queryspec_scan": (lambda s, d: R.query(I.points(s, d), SPEC), sql(f"SELECT fid, x, y, value FROM points WHERE {_BOX_SQL} AND value > 50 ORDER BY fid LIMIT 500 OFFSET 100", "points")),
    "queryspec_total": (lambda s, d: R.query_total(I.points(s, d), SPEC), sql(f"SELECT count(*) AS total, CAST(greatest(0, least(count(*) - 100, 500)) AS BIGINT) AS returned, count(*) > 600 AS truncated FROM points WHERE {_BOX_SQL} AND value > 50", "points")),
    "safe_where": (lambda s, d: table(s, d, "orders").where(safe_where("o_orderpriority LIKE '1-%'", ["o_orderpriority"])).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1-%'"),
    "attribute_filter": (lambda s, d: I.points(s, d).where(attribute_filter('value > 50 and (kind in ["view", "click"] or not user_id < 100)', ["value", "kind", "user_id"])).select("fid", "kind", "value"), sql("SELECT fid, kind, value FROM points WHERE value > 50 AND (kind IN ('view','click') OR NOT user_id < 100)", "points")),
    "layer_filter": (lambda s, d: I.points(s, d).where(layer_filter(["all", [">=", ["get", "value"], 20], ["any", ["==", ["get", "kind"], "error"], ["!", ["<", ["get", "user_id"], 50]]]])).select("fid"), sql("SELECT fid FROM points WHERE value >= 20 AND (kind = 'error' OR NOT user_id < 50)", "points")),
    "catalog_search": (
        lambda s, d: R.catalog_search(I.catalog(s, d), keyword="e", bbox=(101, 20, 103, 23), crs="4326", tags=["economy", "SMALL"], limit=200).select("id", "title", "source_type", "total"),
        sql("WITH hit AS (SELECT * FROM catalog WHERE contains(lower(crs), '4326') AND list_has_any(list_transform(tags, lambda t: lower(t)), ['economy','small']) AND (contains(lower(title),'e') OR contains(lower(CAST(id AS VARCHAR)),'e') OR len(list_filter(tags, lambda t: contains(lower(t),'e'))) > 0) AND x0 <= 103 AND x1 >= 101 AND y0 <= 23 AND y1 >= 20) SELECT id, title, source_type, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY id LIMIT 200", "catalog"),
    ),
    "poi_adcode": (lambda s, d: R.poi_filter(_poi(s, d), adcode="12", name="_%_1", category="VIEW").select("fid", "adcode", "name"), sql(f"WITH {_POI} SELECT fid, adcode, name FROM poi WHERE adcode >= '12' AND adcode < '13' AND contains(lower(name), '_%_1') AND lower(category) = 'view'", "points")),
    "poi_polygon": (
        lambda s, d: R.poi_filter(_poi(s, d), polygon=_TRIANGLE, bbox=(0, 0, 1, 1), subtype="TYPE3").select("fid", "subtype"),
        sql(f"WITH {_POI}, e(x1,y1,x2,y2) AS (VALUES (116.1::DOUBLE,39.6::DOUBLE,116.9::DOUBLE,39.7::DOUBLE),(116.9::DOUBLE,39.7::DOUBLE,116.5::DOUBLE,40.3::DOUBLE),(116.5::DOUBLE,40.3::DOUBLE,116.1::DOUBLE,39.6::DOUBLE)), s AS (SELECT fid, subtype, min((x2-x1)*(y-y1)-(y2-y1)*(x-x1)) AS side FROM poi, e GROUP BY 1, 2) SELECT fid, subtype FROM s WHERE side > 0 AND contains(lower(subtype), 'type3')", "points"),
    ),
    "poi_subtype_histogram": (lambda s, d: R.top_histogram(_poi(s, d), "subtype"), sql(f"WITH {_POI} SELECT subtype, count(*) AS n FROM poi GROUP BY 1 ORDER BY n DESC, subtype LIMIT 12", "points")),
    "hash_sample": (lambda s, d: R.hash_sample(I.points(s, d), 300).select("fid", "value"), sql("SELECT fid, value FROM points ORDER BY fid * 2654435761 % 2147483647, fid LIMIT 300", "points")),
    "even_subsample": (lambda s, d: R.even_subsample(I.points(s, d).select("fid", "value"), 512), sql("WITH n AS (SELECT fid, value, row_number() OVER (ORDER BY fid) - 1 AS pos, count(*) OVER () AS n FROM points), k AS (SELECT DISTINCT CAST(floor(j * ((SELECT max(n) FROM n) - 1) / 511) AS BIGINT) AS pos FROM range(512) r(j)) SELECT fid, value FROM n JOIN k USING (pos)", "points")),
    "county_panel": (
        lambda s, d: R.county_panel(_panel(s, d), name="COUNTY1", year_from=1993, year_to=1996, indicators=["orders", "max"]).select("adcode", "county", F.col("year").cast("long").alias("year"), F.map_keys("indicators").getItem(1).alias("second"), F.col("indicators")["orders"].alias("orders"), F.round(F.col("indicators")["max"], 2).alias("most")),
        "SELECT CAST(c_nationkey*1101+5 AS VARCHAR) AS adcode, 'county' || c_nationkey AS county, year(o_orderdate) AS year, 'max' AS second, CAST(count(*) AS DOUBLE) AS orders, round(max(o_totalprice),2) AS most FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains('county' || c_nationkey, 'county1') AND year(o_orderdate) BETWEEN 1993 AND 1996 GROUP BY 1, 2, 3 ORDER BY county, year, adcode LIMIT 100",
    ),
    "township_book": (
        lambda s, d: R.township(table(s, d, "customer").select(F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("township"), (2000 + F.col("c_custkey") % 20).alias("pub_year"), F.col("c_nationkey").cast("string").alias("district_adcode"), F.lit("p").alias("province"), "c_custkey"), name="build", district="7").select("full_name", "township", "pub_year"),
        "SELECT c_name AS full_name, c_mktsegment AS township, 2000 + c_custkey % 20 AS pub_year FROM customer WHERE (contains(lower(c_name),'build') OR contains(lower(c_mktsegment),'build')) AND c_nationkey = 7 ORDER BY pub_year DESC, full_name LIMIT 200",
    ),
    "longest_prefix": (
        lambda s, d: R.longest_prefix(table(s, d, "customer").select(F.col("c_name").alias("full_name")), table(s, d, "customer").select(F.substring("c_name", 1, 14 + 0).alias("district")).unionAll(table(s, d, "customer").where("c_custkey % 3 = 0").select(F.substring("c_name", 1, 17)))),
        "WITH ds AS (SELECT DISTINCT substr(c_name,1,14) AS district FROM customer UNION SELECT DISTINCT substr(c_name,1,17) FROM customer WHERE c_custkey % 3 = 0) SELECT c_name AS full_name, (SELECT arg_max(district, length(district)) FROM ds WHERE starts_with(c_name, district)) AS district FROM customer",
    ),
    "dataset_fingerprint": (
        lambda s, d: R.fingerprint(table(s, d, "nation")),
        "SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) % 2305843009213693951 AS BIGINT) AS fingerprint, CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) % 2305843009213693951 AS BIGINT) AS fingerprint2 FROM (SELECT md5(n_name || chr(31) || CAST(n_nationkey AS VARCHAR) || chr(31) || CAST(n_regionkey AS VARCHAR)) AS h FROM nation)",
    ),
    "chart_series": (lambda s, d: R.chart_series(table(s, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")), "day", "o_totalprice").withColumn("value", F.round("value", 2)), "SELECT strftime(o_orderdate, '%Y-%m-%d') AS key, round(sum(o_totalprice),2) AS value FROM orders GROUP BY 1 ORDER BY 1 LIMIT 500"),
    "lineage_walk": (_lineage, _LINEAGE),
    "asof_join": (_asof, "SELECT l.event_id, r.event_id AS view_id, round(r.value,4) AS view_value FROM events l LEFT JOIN events r ON r.event_id = (SELECT arg_max(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.user_id = l.user_id AND v.event_type = 'view' AND v.ts <= l.ts) WHERE l.event_type = 'purchase'"),
    "interval_join": (_interval, "SELECT event_id, count(*) AS n, min(p_partkey) AS first_part FROM events JOIN part ON value*10 BETWEEN p_retailprice - 1 AND p_retailprice + 1 GROUP BY 1"),
    "anti_join_unassigned": (lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "scenario_union": (
        lambda s, d: R.merge_layers({"a": table(s, d, "supplier").select("s_suppkey", "s_acctbal"), "b": table(s, d, "supplier").select("s_suppkey", "s_name")}),
        "SELECT s_suppkey, s_acctbal, 'a' AS scenario, NULL AS s_name FROM supplier UNION ALL SELECT s_suppkey, NULL, 'b', s_name FROM supplier",
    ),
    "row_set_operations": (
        lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey")).exceptAll(table(s, d, "nation").where("n_regionkey = 1").select("n_nationkey")),
        "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    ),
    "rule_applicability": (
        _rules,
        """WITH rules AS (SELECT DISTINCT p_partkey % 40 AS rule_id, 'size' AS key, CAST(p_partkey % 40 AS DOUBLE) AS low, CAST(p_partkey % 40 + 20 AS DOUBLE) AS high FROM part), ctx AS (SELECT c_custkey AS ctx_id, CAST(c_custkey % 60 AS DOUBLE) AS num, c_mktsegment AS seg FROM customer)
        SELECT rule_id, count(*) AS n_contexts FROM (SELECT rule_id, ctx_id FROM rules, ctx WHERE num >= low AND num <= high UNION ALL SELECT 100, ctx_id FROM ctx WHERE lower(seg) IN ('building','machinery') UNION ALL SELECT 101, ctx_id FROM ctx) GROUP BY 1""",
    ),
    "rollup_cube": (
        lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")),
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity),2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
    "rank_windows": (_windows, "SELECT event_id, event_type, rank() OVER w AS rank, ntile(4) OVER w AS quartile, round(percent_rank() OVER w, 6) AS pct, round(sum(value) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS UNBOUNDED PRECEDING), 3) AS running FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)"),
    "temporal_filter_between": (lambda s, d: T.temporal_filter(_events(s, d), "ts", "BETWEEN", start=_WINDOW[0], end=_WINDOW[1], include_end=False).select("event_id"), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30'"),
    "temporal_filter_equals": (lambda s, d: T.temporal_filter(_events(s, d), "ts", "EQUALS", instant=dt.datetime(2024, 1, 1, 0, 3, 52)).select("event_id"), "SELECT event_id FROM events WHERE abs(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:03:52')) < 1"),
    "temporal_gaps": (
        lambda s, d: T.gaps(_events(s, d), "ts", ["user_id"]).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("seconds", 3).alias("seconds"), "missing"),
        """WITH s AS (SELECT user_id, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS e FROM events), d AS (SELECT *, (epoch_us(e) - epoch_us(start)) / 1000000.0::DOUBLE AS step FROM s WHERE e IS NOT NULL),
        m AS (SELECT user_id, max(step) AS median FROM (SELECT user_id, step, row_number() OVER (PARTITION BY user_id ORDER BY step) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM d WHERE step > 0) WHERE pos = n // 2 GROUP BY 1)
        SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, round(step,3) AS seconds, CAST(round_even(step / median, 0) AS BIGINT) - 1 AS missing FROM d JOIN m USING (user_id) WHERE step > greatest(2*median, median + 1)""",
    ),
    "temporal_granularity": (
        lambda s, d: T.granularity(_events(s, d), "ts", ["event_type"]).withColumn("median", F.round("median", 3)),
        """WITH s AS (SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY event_type ORDER BY ts)) - epoch_us(ts)) / 1000000.0::DOUBLE AS step FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM s WHERE step > 0),
        g AS (SELECT event_type, max(CASE WHEN pos = n // 2 THEN step END) AS median, stddev_pop(step) / avg(step) < 0.15 AS regular FROM r GROUP BY 1)
        SELECT event_type, round(median,3) AS median, CASE WHEN median < 5 THEN 'SECOND' WHEN median BETWEEN 50 AND 70 THEN 'MINUTE' WHEN median BETWEEN 3500 AND 3700 THEN 'HOUR' WHEN median BETWEEN 80000 AND 90000 THEN 'DAY' WHEN median BETWEEN 600000 AND 620000 THEN 'WEEK' ELSE 'IRREGULAR' END AS granularity, regular FROM g""",
    ),
    "moving_average": (
        lambda s, d: T.moving_average(_events(s, d), "value", ["event_type"], ["ts", "event_id"], 5).select("event_id", F.round("moving_average", 3).alias("moving_average")),
        "SELECT event_id, round(round_even(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4), 3) AS moving_average FROM events",
    ),
    "anomalies": (
        lambda s, d: T.anomalies(_events(s, d), "value", ["event_type"]).select("event_id", "z", "kind"),
        "SELECT event_id, round_even(z,3) AS z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS kind FROM (SELECT event_id, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type)) WHERE n >= 3 AND abs(z) >= 2",
    ),
    "trend": (
        _trend,
        f"""WITH dl AS ({_DAILY}), s AS (SELECT a.event_type, (b.v - a.v) / (b.i - a.i) AS slope FROM dl a JOIN dl b ON a.event_type = b.event_type AND a.i < b.i), m AS (SELECT event_type, quantile_cont(slope, 0.5) AS sen FROM s GROUP BY 1),
        o AS (SELECT event_type, count(*) AS n, regr_slope(v, i) AS s, regr_intercept(v, i) AS b, regr_r2(v, i) AS r FROM dl GROUP BY 1)
        SELECT event_type, n, round(round(s,6),5) AS ols_slope, round(round(b,4),2) AS intercept, round(r,4) AS r2, round(round(sen,6),5) AS sen_slope, CASE WHEN coalesce(nullif(sen,0), s) > 0.001 THEN 'increasing' WHEN coalesce(nullif(sen,0), s) < -0.001 THEN 'decreasing' ELSE 'stable' END AS direction FROM o JOIN m USING (event_type)""",
    ),
    "snapshot_change": (
        lambda s, d: T.snapshot_change(_orders(s, d), "snapshot", "v"),
        f"WITH p AS (SELECT snapshot, count(*) AS n, avg(v) AS m FROM ({_SNAP}) GROUP BY 1), l AS (SELECT *, lag(n) OVER (ORDER BY snapshot) AS n0, lag(m) OVER (ORDER BY snapshot) AS m0 FROM p) SELECT snapshot, n - n0 AS count_change, round(100.0*(n-n0)/n0, 2) AS count_pct, round(m-m0,4) AS mean_change, round(100.0*(m-m0)/abs(m0),2) AS mean_pct FROM l WHERE n0 IS NOT NULL",
    ),
    "snapshot_matches": (
        _matches,
        f"WITH o AS ({_SNAP}), a AS (SELECT CAST(c AS VARCHAR) AS id, arg_max(v, k) AS before FROM o WHERE snapshot = 1995 GROUP BY 1), b AS (SELECT CAST(c AS VARCHAR) AS id, arg_max(v, k) AS after FROM o WHERE snapshot = 1996 GROUP BY 1) SELECT id, round(before,2) AS before, round(after,2) AS after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before <> after THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b USING (id)",
    ),
    "temporal_profile": (
        lambda s, d: T.temporal_profile(table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy/M/d").alias("order_date"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderkey").cast("string").alias("code")), ["order_date", "priority", "year", "code"]).select("field", "n_values", "candidate"),
        "SELECT unnest(['order_date','priority','year','code']) AS field, count(*) AS n_values, unnest([true,false,true,false]) AS candidate FROM orders",
    ),
}
