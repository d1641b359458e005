"""Audit and repair of layers, scenario decisions, text chunks and vectors, event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import rectangle
from ..operators import decision as D
from ..operators import quality as Q
from ..operators import text as X
from ..sources.store import materialize, shared_path
from ..streaming import windows as W
from . import inputs as I
from .inputs import settled, settled_sql, sql, table


def _flawed(s, d):
    """Points with missing, absurd, zero and out-of-range places."""
    p, k = I.points(s, d), F.col("fid")
    x = F.when(k % 97 == 0, F.lit(None)).when(k % 89 == 0, F.lit(1e11)).when(k % 83 == 0, F.lit(0.0)).when(k % 79 == 0, F.lit(200.0)).otherwise(F.col("x"))
    y = F.when(k % 83 == 0, F.lit(0.0)).when(k % 101 == 0, F.lit(float("nan"))).otherwise(F.col("y"))
    return p.select("fid", x.alias("x"), y.alias("y"), "value", "kind", "user_id")


_FLAWED = "flawed AS (SELECT fid, CASE WHEN fid%97=0 THEN NULL WHEN fid%89=0 THEN 1e11::DOUBLE WHEN fid%83=0 THEN 0.0::DOUBLE WHEN fid%79=0 THEN 200.0::DOUBLE ELSE x END AS x, CASE WHEN fid%83=0 THEN 0.0::DOUBLE WHEN fid%101=0 THEN 'nan'::DOUBLE ELSE y END AS y, value, kind, user_id FROM points)"
_BAD = "x IS NOT NULL AND y IS NOT NULL AND (isnan(x) OR isnan(y) OR abs(x) > 1e10 OR abs(y) > 1e10)"


def _rings(s, d):
    """Rectangles, open rings, bow ties, slivers and short rings, by supplier key modulo 5."""
    f = I.facilities(s, d)
    x, y, k = F.col("x"), F.col("y"), F.col("fid") % 5
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    closed = rectangle(x, y, x + F.lit(0.01), y + F.lit(0.01))
    bow = F.array(at(0.0, 0.0), at(0.01, 0.01), at(0.01, 0.0), at(0.0, 0.01), at(0.0, 0.0))
    sliver = rectangle(x, y, x + F.lit(1.0), y + F.lit(0.0001))
    ring = F.when(k == 1, F.slice(closed, 1, 4)).when(k == 2, bow).when(k == 3, sliver).when(k == 4, F.slice(closed, 1, 2)).otherwise(closed)
    return f.select("fid", ring.alias("ring"))


def _boxes(s, d):
    """Overlapping rectangles around facilities."""
    f = I.facilities(s, d)
    return f.select("fid", rectangle(F.col("x"), F.col("y"), F.col("x") + F.lit(0.05), F.col("y") + F.lit(0.03)).alias("ring"))


_OVERLAP = """WITH b AS (SELECT fid, x AS x0, y AS y0, x + 0.05::DOUBLE AS x1, y + 0.03::DOUBLE AS y1 FROM facilities), p AS (SELECT a.fid AS a_fid, c.fid AS b_fid, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, c.x0 AS bx0, c.y0 AS by0, c.x1 AS bx1, c.y1 AS by1 FROM b a JOIN b c ON a.fid < c.fid AND a.x0 < c.x1 AND a.x1 > c.x0 AND a.y0 < c.y1 AND a.y1 > c.y0),
v AS (SELECT *, [ax0, ax1, ax1, ax0, (ax0+ax1)/2] AS vx, [ay0, ay0, ay1, ay1, (ay0+ay1)/2] AS vy, [bx0, bx1, bx1, bx0, (bx0+bx1)/2] AS wx, [by0, by0, by1, by1, (by0+by1)/2] AS wy FROM p)
SELECT a_fid, b_fid FROM v WHERE len(list_filter(range(1,6), lambda k: vx[k] > bx0 AND vx[k] < bx1 AND vy[k] > by0 AND vy[k] < by1)) > 0 OR len(list_filter(range(1,6), lambda k: wx[k] > ax0 AND wx[k] < ax1 AND wy[k] > ay0 AND wy[k] < ay1)) > 0"""


def _ends(s, d):
    return I.demand(s, d).select("fid", "mx", "my")


def _dirty(s, d):
    p = _flawed(s, d)
    return p.withColumn("code", F.concat(F.lit(" 00"), (F.col("user_id") % 50).cast("string"), F.lit(" ")))


def _repaired(s, d):
    got = Q.repair(_dirty(s, d), tolerance=0.5, keys=["kind"], text=["code"])
    return got.select("fid", "x", "y", "kind", "code")


_REPAIR = f"""WITH {_FLAWED}, o AS (SELECT fid, round_even(x/0.5::DOUBLE,0)*0.5::DOUBLE AS x, round_even(y/0.5::DOUBLE,0)*0.5::DOUBLE AS y, kind, CAST(user_id % 50 AS VARCHAR) AS code FROM flawed WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y))
SELECT fid, x, y, kind, code FROM o WHERE fid IN (SELECT min(fid) FROM o GROUP BY x, y, kind)"""


def _options(s, d):
    """Forty scenarios: changes in percent and a confidence, in binary fractions, some missing."""
    o = table(s, d, "orders")
    by = o.groupBy((F.col("o_custkey") % 40).alias("id"))
    n, k = F.count("*"), F.col("id")
    got = by.agg(n.alias("n"), F.sum(F.col("o_orderkey") % 100).alias("c"), F.min("o_orderkey").alias("m"))
    return got.select("id", ((F.col("c") % 4000) / F.lit(64.0)).alias("cost"), F.when(k % 7 != 0, (F.col("n") % 50).cast("double")).alias("reach"), ((F.col("m") % 90) / F.lit(8.0)).alias("noise"), ((F.col("n") % 9) / F.lit(8.0)).alias("confidence"))


_OPTIONS = "opt AS (SELECT id, (c % 4000)/64.0::DOUBLE AS cost, CASE WHEN id % 7 <> 0 THEN CAST(n % 50 AS DOUBLE) END AS reach, (m % 90)/8.0::DOUBLE AS noise, (n % 9)/8.0::DOUBLE AS confidence FROM (SELECT o_custkey % 40 AS id, count(*) AS n, CAST(sum(o_orderkey % 100) AS BIGINT) AS c, min(o_orderkey) AS m FROM orders GROUP BY 1))"
_GOALS = {"cost": "minimize", "reach": "maximize", "noise": "minimize"}
_FRONT = f"""{_OPTIONS}, dominated AS (SELECT DISTINCT a.id FROM opt a JOIN opt b ON (coalesce(b.cost < a.cost, false) OR coalesce(b.reach > a.reach, false) OR coalesce(b.noise < a.noise, false)) AND NOT (coalesce(b.cost > a.cost, false) OR coalesce(b.reach < a.reach, false) OR coalesce(b.noise > a.noise, false))),
front AS (SELECT id FROM opt WHERE id NOT IN (SELECT id FROM dominated) OR (SELECT count(*) FROM dominated) = (SELECT count(*) FROM opt))"""


def _recommended(s, d):
    options = materialize(_options(s, d), "options")
    front = D.pareto_front(options, _GOALS)
    return D.recommend(options, front, _GOALS).select("id", "on_front", "score")


def _deltas(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).when(F.col("c_custkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("c_custkey") / F.lit(8.0)).alias("base"))
    rule = c.withColumns({"lo": F.lit(-0.25), "mid": (F.col("id") % 5) / F.lit(16.0), "hi": F.lit(0.5)})
    return D.metric_delta(rule, "base", "lo", "mid", "hi").select("id", "simulated", "range_min", "range_max", "delta_abs", "delta_pct")


def _confidences(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    base, mean, n, rules = (k % 11) / F.lit(10.0), (k % 7) / F.lit(8.0), k % 6, F.when(k % 3 == 0, F.lit(None)).otherwise((k % 5) / F.lit(4.0))
    distance = (k * 37 % 3000).cast("double")
    return c.select(k.alias("id"), settled(D.confidence(base, mean, n, rules), 3).alias("confidence"), settled(D.distance_decay(distance, 30.0, 800.0), 4).alias("decay"), D.step_decay(distance).alias("step"), settled(D.timeliness((k % 40).cast("double")), 4).alias("fresh"), settled(D.source_score(base, mean, base, mean, base), 3).alias("source"))


_CONFIDENCE = f"""WITH c AS (SELECT c_custkey AS id, (c_custkey % 11)/10.0::DOUBLE AS b, (c_custkey % 7)/8.0::DOUBLE AS m, c_custkey % 6 AS n, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 5)/4.0::DOUBLE END AS r, CAST(c_custkey*37 % 3000 AS DOUBLE) AS d FROM customer)
SELECT id, {settled_sql("greatest(0, least(1, round_even(0.35::DOUBLE*b + 0.35::DOUBLE*CASE WHEN n > 0 THEN least(1, m*(0.8::DOUBLE + 0.05::DOUBLE*least(n, 4))) ELSE 0.6::DOUBLE END + 0.30::DOUBLE*coalesce(r, 0.75::DOUBLE), 4)))", 3)} AS confidence, {settled_sql("30.0::DOUBLE*exp(-d/800.0::DOUBLE)", 4)} AS decay,
CASE WHEN d <= 500 THEN 20.0::DOUBLE WHEN d <= 1500 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS step, {settled_sql("exp(-0.05::DOUBLE*(id % 40))", 4)} AS fresh, {settled_sql("round_even(0.2::DOUBLE*b + 0.3::DOUBLE*m + 0.2::DOUBLE*b + 0.15::DOUBLE*m + 0.15::DOUBLE*b, 4)", 3)} AS source FROM c"""


def _thematic(s, d):
    p = table(s, d, "part")
    score = D.thematic_score("polished STEEL brass anodized", F.col("p_name"), F.col("p_type"), F.split(F.lower("p_type"), " "), F.array(F.lower("p_brand")))
    return p.select(F.col("p_partkey").alias("id"), settled(score, 3).alias("score"))


_THEMATIC = f"""WITH w AS (SELECT ['polished','steel','brass','anodized'] AS w), p AS (SELECT p_partkey AS id, list_distinct(regexp_split_to_array(lower(p_name), '\\s+')) AS a, list_distinct(regexp_split_to_array(lower(p_type), '\\s+')) AS b, [lower(p_brand)] AS f, w FROM part, w),
n AS (SELECT id, len(list_intersect(w, a))/4.0::DOUBLE AS t, len(list_intersect(w, b))/4.0::DOUBLE AS e, len(list_intersect(w, f))/4.0::DOUBLE AS f FROM p)
SELECT id, {settled_sql("round_even(least(1, least(1, t*0.7::DOUBLE + e*0.3::DOUBLE)*0.6::DOUBLE + least(1, e*0.6::DOUBLE + f*0.4::DOUBLE)*0.4::DOUBLE), 4)", 3)} AS score FROM n"""


def _marked(s, d):
    """Texts with second-level headings before every 'a'-sentence break."""
    t = table(s, d, "documents")
    return t.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(". A"), F.lit(".\n## A")).alias("text"))


def _sections(s, d):
    parts = _marked(s, d).select("doc_id", F.posexplode(X.markdown_sections(F.col("text"))).alias("at", "part"))
    return parts.select("doc_id", F.col("at").cast("long").alias("at"), F.char_length("part").cast("long").alias("chars"), F.md5("part").alias("md5"))


_SECTIONS = """WITH m AS (SELECT doc_id, replace(coalesce(text,''), '. A', '.' || chr(10) || '## A') AS text FROM documents), s AS (SELECT doc_id, string_split(replace(text, chr(10) || '## ', chr(1) || '## '), chr(1)) AS parts FROM m),
f AS (SELECT doc_id, list_filter(parts, lambda x: trim(x, ' ') <> '') AS parts FROM s)
SELECT doc_id, unnest(range(0, len(parts))) AS at, CAST(length(unnest(parts)) AS BIGINT) AS chars, md5(unnest(parts)) AS md5 FROM f"""


def _chunks(s, d):
    got = X.chunk_documents(table(s, d, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "start_char", "end_char", F.md5("content").alias("md5"))


_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


def _vectors(s, d):
    e = table(s, d, "embeddings")
    key = e.columns[0]
    vector = next(c for c, t in e.dtypes if t.startswith("array"))
    return e.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), (F.col(key) % 3).alias("tenant"), (F.col(key) % 10 == 0).alias("deleted"))


def _search(s, d):
    v = _vectors(s, d)
    n = v.select(F.size("embedding").alias("n")).head()[0]
    tenants = s.createDataFrame([(1,), (2,)], "tenant long")
    got = X.cosine_search(X.visible(v, tenants), [_QUERY[i % 64] for i in range(n)], k=20)
    return got.select("vec_id", settled(F.col("score"), 5).alias("score"))


_SEARCH = f"""WITH q AS (SELECT vec_id, embedding, list_transform(range(0, len(embedding)), lambda i: CASE WHEN (i % 64) % 3 = 0 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END) AS q FROM embeddings WHERE vec_id % 3 IN (1, 2) AND vec_id % 10 <> 0)
SELECT vec_id, {settled_sql("score", 5)} AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM q) ORDER BY score DESC, vec_id LIMIT 20"""


def _streamed(s, d, build, name):
    """A stream over what the events table holds now, run to its end into a table of the shared folder."""
    folder, _, pattern = f"{d}/events.parquet".rpartition("/")
    where = shared_path(s, name)
    W.run_to_files(build(W.read_events(s, folder, pattern)), f"{where}/rows", f"{where}/state")
    return s.read.parquet(f"{where}/rows")


def _tumbling(s, d):
    got = _streamed(s, d, lambda e: W.windowed(e, "6 hours"), "tumbling")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", settled(F.col("total"), 3).alias("total"))


def _sliding(s, d):
    got = _streamed(s, d, lambda e: W.windowed(e, "2 days", "1 day"), "sliding")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", settled(F.col("total"), 3).alias("total"))


def _sessions(s, d):
    got = _streamed(s, d, lambda e: W.sessions(e, "2 hours"), "sessions")
    return got.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def _first_events(s, d):
    got = _streamed(s, d, lambda e: W.deduplicated(e, ["user_id", "event_type"]), "first").groupBy("user_id", "event_type")
    return got.agg(F.count("*").alias("n"))


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"

PLANS = {
    "audit_points": (
        lambda s, d: Q.audit_points(_flawed(s, d)),
        sql(f"WITH {_FLAWED} SELECT fid, 'validity' AS dimension, 'EMPTY_GEOMETRY' AS code, 'error' AS level FROM flawed WHERE x IS NULL OR y IS NULL UNION ALL SELECT fid, 'validity', 'EXTREME_COORDINATES', 'error' FROM flawed WHERE {_BAD} UNION ALL SELECT fid, 'accuracy', 'NULL_ISLAND', 'warning' FROM flawed WHERE abs(x) < 1e-7 AND abs(y) < 1e-7 UNION ALL SELECT fid, 'accuracy', 'IMPOSSIBLE_LAT_LON', 'error' FROM flawed WHERE NOT ({_BAD}) AND (abs(x) > 180 OR abs(y) > 90)", "points"),
    ),
    "audit_duplicates": (
        lambda s, d: Q.audit_duplicates(I.points(s, d), "user_id", ["kind"]),
        sql("SELECT fid, 'uniqueness' AS dimension, code, 'warning' AS level FROM (SELECT fid, 'DUPLICATE_PRIMARY_KEY' AS code, min(fid) OVER (PARTITION BY user_id) AS f FROM points UNION ALL SELECT fid, 'DUPLICATE_GEOMETRY', min(fid) OVER (PARTITION BY x, y) FROM points UNION ALL SELECT fid, 'DUPLICATE_FEATURE', min(fid) OVER (PARTITION BY x, y, kind) FROM points) WHERE fid > f", "points"),
    ),
    "audit_attributes": (
        lambda s, d: Q.audit_attributes(I.points(s, d).withColumns({"steep": F.pow("value", F.lit(6.0)), "rare": F.when(F.col("fid") % 3 == 0, F.col("kind"))}), ["steep", "value"], ["rare", "kind"]),
        sql("WITH p AS (SELECT fid, value, pow(value, 6.0) AS steep FROM points), z AS (SELECT fid, abs(steep - avg(steep) OVER ()) / stddev_pop(steep) OVER () AS zs, abs(value - avg(value) OVER ()) / stddev_pop(value) OVER () AS zv FROM p) SELECT CAST(NULL AS BIGINT) AS fid, 'completeness' AS dimension, 'HIGH_NULL_RATIO:rare' AS code, 'warning' AS level FROM points HAVING avg(CASE WHEN fid % 3 = 0 THEN 0 ELSE 1 END) > 0.5 UNION ALL SELECT fid, 'consistency', 'NUMERIC_OUTLIER:steep', 'warning' FROM z WHERE zs > 3 UNION ALL SELECT fid, 'consistency', 'NUMERIC_OUTLIER:value', 'warning' FROM z WHERE zv > 3", "points"),
    ),
    "audit_types": (
        lambda s, d: Q.types_of(I.points(s, d).select(F.when(F.col("fid") % 4 == 0, "True").when(F.col("fid") % 4 == 1, F.col("value").cast("string")).when(F.col("fid") % 4 == 2, F.col("kind")).alias("v")), "v"),
        sql("SELECT CASE fid % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'number' ELSE 'text' END AS kind, count(*) AS n FROM points WHERE fid % 4 < 3 AND (fid % 4 <> 1 OR value IS NOT NULL) GROUP BY 1", "points"),
    ),
    "audit_polygons": (
        lambda s, d: Q.audit_polygons(_rings(s, d)),
        sql("SELECT fid, 'validity' AS dimension, CASE fid % 5 WHEN 1 THEN 'RING_CHECK_FAILED' WHEN 2 THEN 'SELF_INTERSECTION' WHEN 3 THEN 'SLIVER_POLYGON' ELSE 'EMPTY_GEOMETRY' END AS code, CASE WHEN fid % 5 = 3 THEN 'warning' ELSE 'error' END AS level FROM facilities WHERE fid % 5 > 0", "facilities"),
    ),
    "audit_summary": (
        lambda s, d: Q.status(Q.audit_points(_flawed(s, d))),
        sql(f"WITH {_FLAWED} SELECT dimension, code, level, count(*) AS n FROM (SELECT 'validity' AS dimension, 'EMPTY_GEOMETRY' AS code, 'error' AS level FROM flawed WHERE x IS NULL OR y IS NULL UNION ALL SELECT 'validity', 'EXTREME_COORDINATES', 'error' FROM flawed WHERE {_BAD} UNION ALL SELECT 'accuracy', 'NULL_ISLAND', 'warning' FROM flawed WHERE abs(x) < 1e-7 AND abs(y) < 1e-7 UNION ALL SELECT 'accuracy', 'IMPOSSIBLE_LAT_LON', 'error' FROM flawed WHERE NOT ({_BAD}) AND (abs(x) > 180 OR abs(y) > 90)) GROUP BY 1, 2, 3", "points"),
    ),
    "topology_overlap": (lambda s, d: Q.overlapping(_boxes(s, d)), sql(_OVERLAP, "facilities")),
    "dangling_ends": (
        lambda s, d: Q.dangling_ends(_ends(s, d), 900.0),
        sql("SELECT fid FROM demand a WHERE NOT EXISTS (SELECT 1 FROM demand b WHERE b.fid <> a.fid AND abs(a.mx-b.mx) <= 900 AND abs(a.my-b.my) <= 900 AND sqrt(pow(a.mx-b.mx,2)+pow(a.my-b.my,2)) <= 900)", "demand"),
    ),
    "repair_points": (_repaired, sql(_REPAIR, "points")),
    "spatial_profile": (
        lambda s, d: Q.spatial_profile(I.points(s, d)).withColumn("zoom", F.col("zoom").cast("long")),
        sql("SELECT count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, (min(x)+max(x))/2 AS cx, (min(y)+max(y))/2 AS cy, CAST(greatest(0, least(18, floor(log2(360.0::DOUBLE / greatest(max(x)-min(x), max(y)-min(y)))))) AS BIGINT) AS zoom FROM points", "points"),
    ),
    "metric_delta": (
        _deltas,
        "WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN 0.0::DOUBLE ELSE c_custkey/8.0::DOUBLE END AS b, (c_custkey % 5)/16.0::DOUBLE AS m FROM customer) SELECT id, round_even(b*(1+m),4) AS simulated, round_even(b*0.75::DOUBLE,4) AS range_min, round_even(b*1.5::DOUBLE,4) AS range_max, round_even(b*(1+m)-b,4) AS delta_abs, CASE WHEN b <> 0 THEN round_even(m*100.0::DOUBLE,4) END AS delta_pct FROM c",
    ),
    "confidence_decay": (_confidences, _CONFIDENCE),
    "thematic_score": (_thematic, _THEMATIC),
    "pareto_front": (lambda s, d: D.pareto_front(materialize(_options(s, d), "options"), _GOALS).select("id"), f"WITH {_FRONT} SELECT id FROM front"),
    "recommendation": (
        _recommended,
        f"WITH {_FRONT} SELECT o.id, f.id IS NOT NULL AS on_front, round_even((0.0::DOUBLE - cost + coalesce(reach, 0) - noise + CASE WHEN f.id IS NOT NULL THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END) * (0.5::DOUBLE + 0.5::DOUBLE*confidence), 2) AS score FROM opt o LEFT JOIN front f USING (id)",
    ),
    "trade_offs": (
        lambda s, d: D.trade_offs(_options(s, d), ["cost", "reach", "confidence"]),
        f"WITH {_OPTIONS}, r AS (SELECT 'cost' AS metric, min(cost) AS low, max(cost) AS high FROM opt UNION ALL SELECT 'reach', min(reach), max(reach) FROM opt UNION ALL SELECT 'confidence', min(confidence), max(confidence) FROM opt) SELECT metric, low, high, round(100.0::DOUBLE*(high-low)/greatest(abs(low),1),2) AS spread_pct FROM r WHERE 100.0::DOUBLE*(high-low)/greatest(abs(low),1) > 5",
    ),
    "markdown_sections": (_sections, _SECTIONS),
    "chunk_documents": (_chunks, None),
    "cosine_search": (_search, _SEARCH),
    "stream_tumbling": (
        _tumbling,
        f"SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, {settled_sql('sum(value)', 3)} AS total FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS w, event_type, value FROM events) GROUP BY w, event_type HAVING w + INTERVAL 6 HOURS <= {_CLOSED}",
    ),
    "stream_sliding": (
        _sliding,
        f"SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, {settled_sql('sum(value)', 3)} AS total FROM (SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS w, event_type, value FROM events, range(0, 2) r(k)) GROUP BY w, event_type HAVING w + INTERVAL 2 DAYS <= {_CLOSED}",
    ),
    "stream_sessions": (
        _sessions,
        f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 2 HOURS, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOURS <= {_CLOSED}",
    ),
    "stream_first_events": (_first_events, "SELECT user_id, event_type, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1, 2"),
}
