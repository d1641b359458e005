"""Catalog and table queries: bounded scans, catalog search, points of interest, panels, lineage, samples."""

from __future__ import annotations

import math

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bbox_intersects, in_bbox, point_in_ring, ring
from ..functions.predicates import contains_ci, safe_where

#: Multiplier and modulus of the deterministic sample (Knuth's multiplicative hash).
SAMPLE_FACTOR, SAMPLE_MODULUS = 2654435761, 2147483647

#: A prime below 2 ** 61.
FINGERPRINT_MODULUS = (1 << 61) - 1


class BoundsError(ValueError):
    """A result is larger than its caller allows."""


@dataclass
class QuerySpec:
    bbox: tuple[float, float, float, float] | None = None
    columns: list[str] = field(default_factory=list)
    where: str | None = None
    limit: int = 100
    offset: int = 0


def clamp(limit: int, cap: int) -> int:
    return max(1, min(limit, cap))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: int = 10000) -> DataFrame:
    """Rows offset .. offset + limit of the order; the order must break every tie."""
    return df.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, cap))


def query(df: DataFrame, spec: QuerySpec, fid: str = "fid", x: str = "x", y: str = "y") -> DataFrame:
    """Box, predicate, projection and page of a layer; all of them reach the scan."""
    if spec.bbox:
        df = df.where(in_bbox(F.col(x), F.col(y), spec.bbox))
    if spec.where:
        df = df.where(safe_where(spec.where, df.columns))
    out = page(df, [F.col(fid)], spec.limit, spec.offset)
    return out.select(*spec.columns) if spec.columns else out


def query_total(df: DataFrame, spec: QuerySpec, x: str = "x", y: str = "y") -> DataFrame:
    """One row: total rows before the page, rows on it, and whether there are more."""
    if spec.bbox:
        df = df.where(in_bbox(F.col(x), F.col(y), spec.bbox))
    if spec.where:
        df = df.where(safe_where(spec.where, df.columns))
    total = F.count("*")
    here = F.greatest(F.lit(0), F.least(total - max(0, spec.offset), F.lit(clamp(spec.limit, 10000)))).cast("long")
    return df.agg(total.alias("total"), here.alias("returned"), (total > spec.offset + here).alias("truncated"))


def catalog_search(catalog: DataFrame, keyword: str | None = None, bbox=None, crs: str | None = None, tags: list[str] | None = None, source_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Entries (id, title, description, name, tags, crs, source_type, x0, y0, x1, y1) that match all given conditions, with the total before paging."""
    df = catalog
    if source_type:
        df = df.where(F.col("source_type") == source_type)
    if crs:
        df = df.where(contains_ci(F.col("crs"), crs))
    if tags:
        df = df.where(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags])))
    if keyword:
        hit = F.exists("tags", lambda t: contains_ci(t, keyword))
        for c in ("title", "description", "name", "id"):
            if c in df.columns:
                hit = hit | contains_ci(F.col(c), keyword)
        df = df.where(hit)
    if bbox:
        df = df.where(bbox_intersects([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.lit(float(v)) for v in bbox]))
    totals = df.agg(F.count("*").alias("total"))
    return page(df, [F.col("id")], limit, offset).join(F.broadcast(totals))


def _convex_sides(x: Column, y: Column, polygon) -> Column | None:
    """Whether a point lies inside every side of a strictly convex polygon, by the sign of one product each; None for other polygons."""
    points = [(float(a), float(b)) for a, b in polygon]
    points = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
    ends = list(zip(points, points[1:] + points[:1], strict=True))
    turns = [(b[0] - a[0]) * (d[1] - b[1]) - (b[1] - a[1]) * (d[0] - b[0]) for (a, b), (_, d) in zip(ends, ends[1:] + ends[:1], strict=True)]
    way = 1 if min(turns) > 0 else -1 if max(turns) < 0 else 0
    around = sum(math.atan2(t, (b[0] - a[0]) * (d[0] - b[0]) + (b[1] - a[1]) * (d[1] - b[1])) for t, ((a, b), (_, d)) in zip(turns, zip(ends, ends[1:] + ends[:1], strict=True), strict=True))
    if len(points) < 3 or not way or abs(around) > 7:  # a star turns around more than once
        return None
    out = F.lit(True)
    for (x1, y1), (x2, y2) in ends:
        side = (F.lit(x2) - F.lit(x1)) * (y - F.lit(y1)) - (F.lit(y2) - F.lit(y1)) * (x - F.lit(x1))
        out &= side > 0 if way > 0 else side < 0
    return out


def poi_filter(pois: DataFrame, polygon=None, bbox=None, adcode: str | None = None, name: str | None = None, category: str | None = None, subtype: str | None = None) -> DataFrame:
    """Points of interest (fid, x, y, adcode, name, category, subtype). A polygon is used before a box, a box before an adcode.

    An adcode of 6 digits must be equal; a shorter one is a prefix, as a range that reaches the scan.
    """
    df = pois
    if polygon:
        xs, ys = zip(*polygon, strict=True)
        sides = _convex_sides(F.col("x"), F.col("y"), polygon)
        within = point_in_ring(F.col("x"), F.col("y"), ring(polygon), boundary=False) if sides is None else sides
        df = df.where(in_bbox(F.col("x"), F.col("y"), (min(xs), min(ys), max(xs), max(ys))) & within)
    elif bbox:
        df = df.where(in_bbox(F.col("x"), F.col("y"), bbox))
    elif adcode:
        df = df.where(F.col("adcode") == adcode) if len(adcode) == 6 else df.where((F.col("adcode") >= adcode) & (F.col("adcode") < adcode[:-1] + chr(ord(adcode[-1]) + 1)))
    if name:
        df = df.where(contains_ci(F.col("name"), name))
    if category:
        df = df.where(F.lower("category") == category.lower())
    if subtype:
        df = df.where(contains_ci(F.col("subtype"), subtype))
    return df


def hash_sample(df: DataFrame, limit: int, fid: str = "fid") -> DataFrame:
    """The `limit` rows with the smallest hash of fid: the same ones in every run."""
    h = F.pmod(F.col(fid), F.lit(SAMPLE_MODULUS)).cast("long") * SAMPLE_FACTOR % SAMPLE_MODULUS
    return df.orderBy(h, F.col(fid)).limit(limit)


def even_subsample(df: DataFrame, cap: int, fid: str = "fid") -> DataFrame:
    """At most `cap` rows, evenly spaced in the order of fid (first and last included); all rows if there are no more."""
    n = df.count()
    if n <= cap:
        return df
    numbered = with_position(df, [F.col(fid)], "_at")
    picks = df.sparkSession.range(cap).select(F.floor(F.col("id") * (n - 1) / (cap - 1)).alias("_at")).distinct()
    return numbered.join(F.broadcast(picks) if cap <= 1_000_000 else picks, "_at").drop("_at")


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place, from 0, in a total order, by a range partition and counts of its parts rather than in one task."""
    from ..sources.store import materialize

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    stored = materialize(dealt, "ordered")
    counts = stored.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    return stored.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_id")


def top_histogram(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def county_panel(panel: DataFrame, adcode: str | None = None, name: str | None = None, year_from: int | None = None, year_to: int | None = None, indicators: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Rows (adcode, county, year, indicators map<string,double>) by zero-padded adcode or name, in the order county, year."""
    df = panel
    if adcode:
        df = df.where(F.lpad("adcode", 6, "0") == adcode.zfill(6))
    if name:
        df = df.where(contains_ci(F.col("county"), name))
    if year_from is not None:
        df = df.where(F.col("year") >= year_from)
    if year_to is not None:
        df = df.where(F.col("year") <= year_to)
    if indicators:
        df = df.withColumn("indicators", F.map_filter("indicators", lambda k, _v: k.isin(*indicators)))
    return page(df, [F.col("county"), F.col("year"), F.col("adcode")], limit, cap=2000)


def township(book: DataFrame, name: str = "", pub_year: int | None = None, province: str = "", district: str = "", limit: int = 200) -> DataFrame:
    """Yearbook rows whose full_name or township contains the name, newest first."""
    df = book.where(contains_ci(F.col("full_name"), name) | contains_ci(F.col("township"), name)) if name else book
    if pub_year is not None:
        df = df.where(F.col("pub_year") == pub_year)
    if province:
        df = df.where(F.col("province") == province)
    if district:
        df = df.where(F.col("district_adcode") == district)
    return page(df, [F.desc("pub_year"), F.col("full_name")], limit, cap=2000)


def longest_prefix(names: DataFrame, districts: DataFrame, key: str = "full_name") -> DataFrame:
    """Each name with the district whose name is its longest prefix, by an equi-join on prefixes; without one, null."""
    lengths = districts.agg(F.collect_set(F.char_length("district")).alias("_lengths"))  # one row, no more entries than the longest name has letters
    candidates = names.join(F.broadcast(lengths)).withColumn("_n", F.explode("_lengths")).where(F.char_length(key) >= F.col("_n")).drop("_lengths")
    keyed = candidates.withColumn("district", F.substring(F.col(key), F.lit(1), F.col("_n"))).join(districts.select("district").distinct(), "district")
    best = keyed.groupBy(key).agg(F.max_by("district", "_n").alias("district"))
    return names.join(best, key, "left")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and two order-insensitive hashes of their contents, sums of row hashes (columns in the order of their names)."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    total = lambda at: (F.coalesce(F.sum(F.conv(F.substring(F.md5(row), at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)) % F.lit(FINGERPRINT_MODULUS)).cast("long")
    return df.agg(F.count("*").alias("n_rows"), total(1).alias("fingerprint"), total(16).alias("fingerprint2"))


def enforce_bounds(df: DataFrame, max_rows: int) -> DataFrame:
    """df, or BoundsError if it has more rows; at most max_rows + 1 rows are looked at."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise BoundsError(f"the result has more than {max_rows} rows")
    return df


def chart_series(df: DataFrame, key: str, value: str, how: str = "sum", limit: int = 500) -> DataFrame:
    """Finite values by key for a chart, at most `limit` points in the order of the key."""
    v = F.col(value).try_cast("double")
    finite = df.select(F.col(key).alias("key"), v.alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    agg = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}[how]
    return finite.groupBy("key").agg(agg("v").alias("value")).orderBy("key").limit(limit)


def lineage(edges: DataFrame, roots: DataFrame, max_depth: int = 5, direction: str = "down") -> DataFrame:
    """Nodes within max_depth steps of each root over (src, dst, project) edges of the root's project; their smallest depth."""
    src, dst = ("src", "dst") if direction == "down" else ("dst", "src")
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("to"), "project")
    seen = roots.select(F.col("node").alias("root"), "node", "project", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        fresh = frontier.join(step, ["node", "project"]).select("root", F.col("to").alias("node"), "project", F.lit(depth).alias("depth")).distinct()
        frontier = fresh.join(seen.select("root", "node", "project"), ["root", "node", "project"], "left_anti")
        seen = seen.unionAll(frontier)
    return seen


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, values: list[str], tie: str) -> DataFrame:
    """Each left row with the latest right row of its key at or before it (ties: the largest `tie`), by one sort of both sides."""
    got = F.struct(*values)
    lefts = left.select(by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(got.alias("s")).schema["s"].dataType).alias("_got"))
    rights = right.select(by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(lefts.schema["_left"].dataType).alias("_left"), got.alias("_got"))
    w = Window.partitionBy(by).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = rights.unionAll(lefts).withColumn("_last", F.last("_got", ignorenulls=True).over(w))
    return filled.where("_side = 1").select("_left.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points (numeric `at`) with the closed intervals they lie in: an equi-join on buckets of `width`, then the exact test."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(i, "_b").where(F.col(at).between(F.col(start), F.col(end))).drop("_b")


def merge_layers(layers: dict[str, DataFrame], tag: str = "scenario") -> DataFrame:
    """One layer out of several, tagged by name; columns that a layer lacks are null."""
    out = None
    for name, df in layers.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no layers")
    return out


def rule_applicability(rules: DataFrame, contexts: DataFrame, max_rules: int = 10_000) -> DataFrame:
    """rules (rule_id, key, low, high, options) and contexts (ctx_id, key, num, text): rule_id, ctx_id of the pairs whose conditions all hold.

    A key that the context lacks does not disqualify. The rule book is one broadcast row; more than `max_rules`
    conditions are an error. A context is one row with its facts and tests all rules where it stands.
    """
    if rules.limit(max_rules + 1).count() > max_rules:
        raise BoundsError(f"the rule book has more than {max_rules} conditions")
    book = rules.groupBy("rule_id").agg(F.collect_list(F.struct("key", "low", "high", "options")).alias("conditions")).agg(F.collect_list(F.struct("rule_id", "conditions")).alias("book"))
    facts = contexts.groupBy("ctx_id").agg(F.collect_list(F.struct("key", "num", "text")).alias("facts"))

    def fails(c: Column, f: Column) -> Column:
        low, high = c["low"].isNotNull() & (f["num"] < c["low"]), c["high"].isNotNull() & (f["num"] > c["high"])
        other = c["options"].isNotNull() & ~F.array_contains(F.transform(c["options"], F.lower), F.lower(f["text"]))
        return (c["key"] == f["key"]) & F.coalesce(low | high | other, F.lit(False))

    held = F.filter("book", lambda r: ~F.exists(r["conditions"], lambda c: F.exists("facts", lambda f: fails(c, f))))
    return facts.join(F.broadcast(book)).select(F.explode(held).alias("rule"), "ctx_id").select("rule.rule_id", "ctx_id")


#: How names of counties, districts and autonomous counties end in the official list of divisions.
DISTRICT_ENDINGS = ("县", "区", "自治县")


def district_match(names: DataFrame, districts: DataFrame) -> DataFrame:
    """names (full_name, province_hint) with the district (dt_name, dt_adcode, pr_name) whose name is the longest proper prefix of 2 letters or more.

    A district's name also counts with its last letter changed between county and district, unless a district has
    that name. Of districts with one name the one of the hinted province is taken, else the one with the smallest code.
    """
    known = districts.select("dt_name", F.lpad(F.col("dt_adcode").cast("string"), 6, "0").alias("dt_adcode"), "pr_name")
    n = F.col("dt_name")
    county, district, autonomous = map(F.lit, DISTRICT_ENDINGS)
    stem = F.substring(n, F.lit(1), F.char_length(n) - 1)
    other = F.when(F.endswith(n, county) & ~F.endswith(n, autonomous), F.concat(stem, district)).when(F.endswith(n, district) & (F.char_length(n) > 2), F.concat(stem, county))
    aliases = known.withColumn("key", other).where("key is not null").join(known.select(F.col("dt_name").alias("key")).distinct(), "key", "left_anti")
    keyed = known.withColumn("key", n).unionByName(aliases)
    lengths = keyed.agg(F.collect_set(F.char_length("key")).alias("_lengths"))  # one row, no more entries than the longest name has letters
    tried = names.select("full_name", "province_hint").distinct().join(F.broadcast(lengths)).withColumn("_n", F.explode("_lengths")).where((F.col("_n") >= 2) & (F.col("_n") < F.char_length("full_name")))
    hits = tried.withColumn("key", F.substring(F.col("full_name"), F.lit(1), F.col("_n"))).join(keyed, "key")
    order = F.struct(-F.col("_n"), F.when(F.col("pr_name") == F.col("province_hint"), 0).otherwise(1), F.col("dt_adcode"))
    best = hits.groupBy("full_name", "province_hint").agg(F.min_by(F.struct("dt_name", "dt_adcode", "pr_name"), order).alias("d"))
    same = (names["full_name"] == best["full_name"]) & names["province_hint"].eqNullSafe(best["province_hint"])
    return names.join(best.select(F.col("full_name"), F.col("province_hint"), "d"), same, "left").select(names["*"], "d.dt_name", "d.dt_adcode", "d.pr_name")


def stac_search(items: DataFrame, collections: list[str] | None = None, bbox: tuple | None = None, start=None, end=None, keep_unplaced: bool = False) -> DataFrame:
    """items (collection, x0, y0, x1, y1, at) of the collections that meet the closed box and time range; unplaced ones only if asked."""
    out = items.where(F.col("collection").isin(collections)) if collections else items
    if bbox:
        meets = (F.col("x0") <= bbox[2]) & (F.col("x1") >= bbox[0]) & (F.col("y0") <= bbox[3]) & (F.col("y1") >= bbox[1])
        out = out.where(F.coalesce(meets, F.lit(keep_unplaced)))
    if start is not None:
        out = out.where(F.col("at") >= F.lit(start))
    return out.where(F.col("at") <= F.lit(end)) if end is not None else out


def demo_source(features: DataFrame, bbox: tuple | None = None, columns: list[str] | None = None, limit: int = 100, offset: int = 0, order: str = "fid") -> DataFrame:
    """Features (geometry_type, x, y, ...) of a layer held by the session: a box only tests points, others pass; then offset, limit and columns."""
    out = features
    if bbox:
        out = out.where((F.col("geometry_type") != "Point") | (F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3])))
    out = out.orderBy(order).offset(offset).limit(limit)
    return out.select(*columns) if columns else out


def status_tally(rows: DataFrame, provider: str = "provider", found: str = "found") -> DataFrame:
    """Per provider of a fallback chain: tries, hits and their share in percent."""
    hits = F.sum(F.col(found).cast("long"))
    return rows.groupBy(provider).agg(F.count("*").alias("tries"), hits.alias("hits"), F.round(100.0 * hits / F.count("*"), 2).alias("pct"))


#: Parts of column names that tell what a column is, in the order of preference, in English and Chinese.
#: They must be these for a table to be read the same way.
FIELD_PARTS = {
    "name": ("name", "名称", "title", "标题"),
    "address": ("address", "地址", "addr", "location", "位置"),
    "lat": ("lat", "latitude", "纬度", "y"),
    "lon": ("lon", "lng", "longitude", "经度", "x"),
}


def field_roles(columns: list[str]) -> dict[str, str]:
    """Role to column: each column takes the first role that a part of its name tells; of several, the last column has it."""
    found: dict[str, str] = {}
    for c in columns:
        role = next((r for r, parts in FIELD_PARTS.items() if any(p in c.lower() for p in parts)), None)
        if role:
            found[role] = c
    return found
