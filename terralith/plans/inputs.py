"""Layers derived from the driver's tables, for Spark and as SQL text for DuckDB: integer arithmetic, then one division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import rectangle, to_utm

ZONE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(a, b, dx: float = 116.0, dy: float = 39.5):
    return F.lit(dx) + (a % 1000) / F.lit(1000.0), F.lit(dy) + (b % 1000) / F.lit(1000.0)


def _with_metres(df: DataFrame) -> DataFrame:
    mx, my = to_utm(F.col("x"), F.col("y"), ZONE)
    return df.withColumns({"mx": mx, "my": my})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, x, y, mx, my, t, value, kind, user_id from events."""
    e = table(spark, sf_dir, "events")
    x, y = _place(F.col("user_id") * 37 + F.col("event_id") * 11, F.col("event_id") * 53)
    return _with_metres(e.select(F.col("event_id").alias("fid"), x.alias("x"), y.alias("y"), F.col("ts").alias("t"), "value", F.col("event_type").alias("kind"), "user_id"))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    x, y = _place(F.col("s_suppkey") * 61, F.col("s_suppkey") * 89)
    return _with_metres(s.select(F.col("s_suppkey").alias("fid"), x.alias("x"), y.alias("y"), (1 + F.col("s_suppkey") % 5).cast("double").alias("capacity"), F.col("s_nationkey").alias("nation")))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    x, y = _place(F.col("c_custkey") * 41, F.col("c_custkey") * 73)
    return _with_metres(c.select(F.col("c_custkey").alias("fid"), x.alias("x"), y.alias("y"), (1 + F.col("c_custkey") % 7).cast("double").alias("weight"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))


#: Multipliers and prime moduli that give each key a place of its own, evenly over a square degree.
_OWN = ((754880, 1000003), (569831, 999983))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, x, y, mx, my, balance: no two customers at one place, while `demand` has 1000 places for all."""
    (a, p), (b, q) = _OWN
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return _with_metres(c.select(k.alias("fid"), (F.lit(116.0) + k * a % p / F.lit(float(p))).alias("x"), (F.lit(39.5) + k * b % q / F.lit(float(q))).alias("y"), F.col("c_acctbal").alias("balance")))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, name, region, ring: 25 rectangles of 0.2 degrees from (116, 39.5)."""
    n = table(spark, sf_dir, "nation")
    x0 = F.lit(116.0) + (F.col("n_nationkey") % 5) * 2 / F.lit(10.0)
    y0 = F.lit(39.5) + F.floor(F.col("n_nationkey") / 5) * 2 / F.lit(10.0)
    return n.select(F.col("n_nationkey").alias("pid"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), rectangle(x0, y0, x0 + F.lit(0.2), y0 + F.lit(0.2)).alias("ring"))


def pixels(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """row, col, v: mean quantity by order and part modulo 64; of one return flag for a second epoch."""
    line = table(spark, sf_dir, "lineitem")
    line = line.where(F.col("l_returnflag") == flag) if flag else line
    return line.groupBy((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(F.avg("l_quantity").alias("v"))


def grid_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a 20 by 20 street grid whose crossings are the orders' keys modulo 400, two ways, cost in seconds at 30 + (id % 4) * 10 km/h."""
    ids = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 400).alias("id")).distinct()
    n = ids.select(F.col("id").alias("node"), (F.lit(116.0) + (F.col("id") % 20) * 5 / F.lit(100.0)).alias("x"), (F.lit(39.5) + F.floor(F.col("id") / 20) * 5 / F.lit(100.0)).alias("y"))
    right = ids.where("id % 20 < 19").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    up = ids.where("id < 380").select(F.col("id").alias("u"), (F.col("id") + 20).alias("v"))
    one = right.unionAll(up).withColumn("k", F.col("u"))
    both = one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "k"))
    a, b = n.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), n.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    sized = both.join(a, "u").join(b, "v").withColumn("length_m", geo.haversine_m(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")))
    return n, sized.select("u", "v", "length_m", (F.col("length_m") / ((30 + (F.col("k") % 4) * 10) / F.lit(3.6))).alias("cost"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x0, y0 = F.lit(100.0) + (F.col("p_partkey") % 50) / F.lit(10.0), F.lit(20.0) + (F.col("p_partkey") * 7 % 50) / F.lit(10.0)
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("source_type"), F.when(F.col("p_size") % 2 == 0, "EPSG:4326").otherwise("EPSG:3857").alias("crs"), F.split("p_type", " ").alias("tags"), x0.alias("x0"), y0.alias("y0"), (x0 + F.lit(0.5)).alias("x1"), (y0 + F.lit(0.5)).alias("y1"))


def settled(c: Column, digits: int) -> Column:
    """c rounded; what lies at a half but for the error of sums goes up, in Spark and in SQL alike."""
    return F.floor(c * 10.0**digits + F.lit(0.500001)) / F.lit(10.0**digits)


# the same in SQL


def settled_sql(expression: str, digits: int) -> str:
    return f"(floor(({expression}) * {10.0**digits}::DOUBLE + 0.500001::DOUBLE) / {10.0**digits}::DOUBLE)"


def utm_sql(x: str, y: str) -> tuple[str, str]:
    lat, lon = f"radians({y})", f"radians({x} - {6.0 * ZONE - 183.0})"
    t = f"sinh(atanh(sin({lat})) - {geo._ECC!r} * atanh({geo._ECC!r} * sin({lat})))"
    xi, eta = f"atan2({t}, cos({lon}))", f"asinh(sin({lon}) / sqrt({t} * {t} + pow(cos({lon}), 2)))"
    east = " + ".join([f"({eta})", *(f"{a!r} * cos({2 * j} * ({xi})) * sinh({2 * j} * ({eta}))" for j, a in enumerate(geo._ALPHA, 1))])
    up = " + ".join([f"({xi})", *(f"{a!r} * sin({2 * j} * ({xi})) * cosh({2 * j} * ({eta}))" for j, a in enumerate(geo._ALPHA, 1))])
    return f"(500000.0::DOUBLE + {geo._K0 * geo._RECT!r}::DOUBLE * ({east}))", f"({geo._K0 * geo._RECT!r}::DOUBLE * ({up}))"


_MX, _MY = utm_sql("x", "y")


def _metres(body: str) -> str:
    return f"SELECT *, {_MX} AS mx, {_MY} AS my FROM ({body})"


CTES = {
    "points": _metres("SELECT event_id AS fid, 116.0::DOUBLE + ((user_id*37 + event_id*11) % 1000)/1000.0::DOUBLE AS x, 39.5::DOUBLE + ((event_id*53) % 1000)/1000.0::DOUBLE AS y, ts AS t, value, event_type AS kind, user_id FROM events"),
    "facilities": _metres("SELECT s_suppkey AS fid, 116.0::DOUBLE + (s_suppkey*61 % 1000)/1000.0::DOUBLE AS x, 39.5::DOUBLE + (s_suppkey*89 % 1000)/1000.0::DOUBLE AS y, CAST(1 + s_suppkey % 5 AS DOUBLE) AS capacity, s_nationkey AS nation FROM supplier"),
    "demand": _metres("SELECT c_custkey AS fid, 116.0::DOUBLE + (c_custkey*41 % 1000)/1000.0::DOUBLE AS x, 39.5::DOUBLE + (c_custkey*73 % 1000)/1000.0::DOUBLE AS y, CAST(1 + c_custkey % 7 AS DOUBLE) AS weight, c_mktsegment AS segment, c_acctbal AS balance FROM customer"),
    "customers": _metres("SELECT c_custkey AS fid, " + ", ".join(f"{low}::DOUBLE + (c_custkey*{a} % {p})/{p}.0::DOUBLE AS {c}" for (a, p), low, c in zip(_OWN, (116.0, 39.5), "xy", strict=True)) + ", c_acctbal AS balance FROM customer"),
    "polys": "SELECT n_nationkey AS pid, n_name AS name, n_regionkey AS region, 116.0::DOUBLE + (n_nationkey % 5)*2/10.0::DOUBLE AS x0, 39.5::DOUBLE + (n_nationkey // 5)*2/10.0::DOUBLE AS y0, 116.0::DOUBLE + (n_nationkey % 5)*2/10.0::DOUBLE + 0.2::DOUBLE AS x1, 39.5::DOUBLE + (n_nationkey // 5)*2/10.0::DOUBLE + 0.2::DOUBLE AS y1 FROM nation",
    "pixels": "SELECT l_orderkey % 64 AS row, l_partkey % 64 AS col, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "pixels_a": "SELECT l_orderkey % 64 AS row, l_partkey % 64 AS col, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2",
    "catalog": "SELECT p_partkey AS id, p_name AS title, p_brand AS source_type, CASE WHEN p_size % 2 = 0 THEN 'EPSG:4326' ELSE 'EPSG:3857' END AS crs, string_split(p_type, ' ') AS tags, 100.0::DOUBLE + (p_partkey % 50)/10.0::DOUBLE AS x0, 20.0::DOUBLE + (p_partkey*7 % 50)/10.0::DOUBLE AS y0, 100.0::DOUBLE + (p_partkey % 50)/10.0::DOUBLE + 0.5::DOUBLE AS x1, 20.0::DOUBLE + (p_partkey*7 % 50)/10.0::DOUBLE + 0.5::DOUBLE AS y1 FROM part",
    "ids": "SELECT DISTINCT o_orderkey % 400 AS id FROM orders",
    "nodes": "SELECT id AS node, 116.0::DOUBLE + (id % 20)*5/100.0::DOUBLE AS x, 39.5::DOUBLE + (id // 20)*5/100.0::DOUBLE AS y FROM ids",
    "edges": """SELECT u, v, len AS length_m, len / ((30 + (k % 4)*10)/3.6::DOUBLE) AS cost FROM (
        SELECT e.u, e.v, k, 2*6371000.0::DOUBLE*asin(sqrt(least(1.0, pow(sin(radians(b.y-a.y)/2),2) + cos(radians(a.y))*cos(radians(b.y))*pow(sin(radians(b.x-a.x)/2),2)))) AS len
        FROM (SELECT id AS u, id+1 AS v, id AS k FROM ids WHERE id % 20 < 19 UNION ALL SELECT id, id+20, id FROM ids WHERE id < 380
              UNION ALL SELECT id+1, id, id FROM ids WHERE id % 20 < 19 UNION ALL SELECT id+20, id, id FROM ids WHERE id < 380) e
        JOIN nodes a ON a.node = e.u JOIN nodes b ON b.node = e.v)""",
}
_NEEDS = {"edges": ["ids", "nodes"], "nodes": ["ids"]}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """body with the named layers as common tables."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, []), n) if x not in order]
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{parts}, {body.lstrip()[5:]}" if parts else body
    return f"WITH {parts} {body}" if parts else body
