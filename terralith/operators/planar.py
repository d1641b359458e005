"""Unions, differences and repairs of polygons as whole polygons with holes, by noded edges.

All rings are snapped to a grid of `unit`. Their edges are cut wherever they cross or touch another edge of the same
key; what lies left and right of each piece (how many polygons of which layer) decides whether it bounds the result; the
pieces that do, directed with the result to their left, are chained into rings, first clockwise at every vertex, so that rings
touch themselves or each other in points at most. Holes go to the smallest shell around them.

Everything is a join or an aggregation over edges: edges and boxes meet by cells of their own size (a power of two) and those
above, so one long edge among many short ones is not cut into their cells; equal edges are one before they
meet; rings are labelled by doubling jumps. Cells are dealt to both sides: a small file may have very many. Only the edges of one ring of the result come together, in its row.
Parts thinner than the grid vanish. Null and empty rings, and rings without area, count for nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RING, edges, let, signed_area
from ..sources.store import materialize

UNIT = 1e-7
_SEG = ["ax", "ay", "bx", "by"]
#: Which sides belong to the result, from whether layers 0 and 1 cover them.
_RULES = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric_difference": lambda a, b: (a & ~b) | (b & ~a),
}


def _snapped(ring: Column, unit: float) -> Column:
    """The ring in whole grid units (as doubles), open, without repeated vertices."""
    points = F.transform(F.coalesce(ring, F.array().cast(RING)), lambda p: F.struct(F.rint(p["x"] / unit).alias("x"), F.rint(p["y"] / unit).alias("y")))
    last = lambda r, k: F.element_at(r, F.when(k == 0, F.size(r)).otherwise(k).cast("int"))
    return let(points, lambda r: F.filter(r, lambda p, k: (p["x"] != last(r, k)["x"]) | (p["y"] != last(r, k)["y"])))


def _directed(polys: DataFrame, unit: float) -> DataFrame:
    """key, fid, layer, ax, ay, bx, by of every edge, the polygon on its left: shells counter-clockwise, holes clockwise."""
    shell = F.array(F.struct(_snapped(F.col("ring"), unit).alias("r"), F.lit(1.0).alias("way")))
    holes = F.transform(F.coalesce("holes", F.array().cast(f"array<{RING}>")), lambda h: F.struct(_snapped(h, unit).alias("r"), F.lit(-1.0).alias("way")))
    each = polys.select("key", "fid", "layer", F.explode(F.concat(shell, holes)).alias("x")).select("key", "fid", "layer", "x.r", (F.signum(signed_area(F.col("x.r"))) * F.col("x.way")).alias("way"))
    each = each.where("way <> 0").select("key", "fid", "layer", "way", F.explode(edges(F.col("r"))).alias("e"))
    turn = lambda a, b: F.when(F.col("way") > 0, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}")).cast("long")
    return each.select("key", "fid", "layer", turn("x1", "x2").alias("ax"), turn("y1", "y2").alias("ay"), turn("x2", "x1").alias("bx"), turn("y2", "y1").alias("by")).where("ax <> bx OR ay <> by")


def _canonical(df: DataFrame, sign: str = "sign") -> DataFrame:
    """Edges from their lower end (by x, then y); sign -1 where that turns them."""
    swap = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)
    rest = [c for c in df.columns if c not in (*_SEG, sign)]
    return df.select(*rest, pick("ax", "bx"), pick("ay", "by"), pick("bx", "ax"), pick("by", "ay"), F.when(swap, -1).otherwise(1).alias(sign))


def _level(df: DataFrame) -> DataFrame:
    """df (x0, y0, x1, y1) with the power of two that its box fits into."""
    return df.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1)).cast("double")))).cast("int"))


def _cells(df: DataFrame, level: Column) -> DataFrame:
    """df once for each cell of the level that its box meets: four at most at its own level or above."""
    size = F.pow(F.lit(2.0), level)
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return df.withColumn("at", level).withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))


def _levels(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("level").distinct().collect())  # 64 at most


def _boxed(segments: DataFrame) -> DataFrame:
    return _level(segments.withColumns({"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")}))


def _cuts(segments: DataFrame) -> DataFrame:
    """key, ax, ay, bx, by, points: where other distinct segments of the key cut each one, within half a unit."""
    boxed = _boxed(segments)
    levels = _levels(boxed)
    own = _cells(boxed, F.col("level")).select("key", "at", "cx", "cy", *(F.col(c).alias(f"o_{c}") for c in (*_SEG, "x0", "x1", "y0", "y1")))
    above = boxed.withColumn("up", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("level"))))
    above = _cells(above, F.col("up")).select("key", "at", "cx", "cy", *_SEG, "x0", "x1", "y0", "y1")
    near = own.join(above.hint("merge"), ["key", "at", "cx", "cy"]).where("x0 <= o_x1 + 1 AND o_x0 <= x1 + 1 AND y0 <= o_y1 + 1 AND o_y0 <= y1 + 1")
    near = near.where(" OR ".join(f"{c} <> o_{c}" for c in _SEG))
    both = near.select("key", *_SEG, *(f"o_{c}" for c in _SEG)).unionAll(near.select("key", *(F.col(f"o_{c}") for c in _SEG), *_SEG))
    d = lambda a, b: (F.col(a) - F.col(b)).cast("double")
    dx, dy, ox, oy = d("bx", "ax"), d("by", "ay"), d("o_bx", "o_ax"), d("o_by", "o_ay")
    length = F.sqrt(dx * dx + dy * dy)

    def touch(px: str, py: str) -> Column:
        """The end of the other one, where it lies on this one but not at its ends."""
        along = (d(px, "ax") * dx + d(py, "ay") * dy) / length
        off = F.abs(d(px, "ax") * dy - d(py, "ay") * dx) / length
        return F.when((off <= 0.5) & (along > 0) & (along < length), F.struct(F.col(px).alias("x"), F.col(py).alias("y")))

    cross = dx * oy - dy * ox
    t = (d("o_ax", "ax") * oy - d("o_ay", "ay") * ox) / F.when(cross != 0, cross)
    u = (d("o_ax", "ax") * dy - d("o_ay", "ay") * dx) / F.when(cross != 0, cross)
    meet = F.when((t > 0) & (t < 1) & (u > 0) & (u < 1), F.struct((F.col("ax") + F.rint(t * dx).cast("long")).alias("x"), (F.col("ay") + F.rint(t * dy).cast("long")).alias("y")))
    points = both.select("key", *_SEG, F.explode(F.array(touch("o_ax", "o_ay"), touch("o_bx", "o_by"), meet)).alias("p")).where("p IS NOT NULL")
    points = points.where("(p.x <> ax OR p.y <> ay) AND (p.x <> bx OR p.y <> by)").distinct()
    return points.groupBy("key", *_SEG).agg(F.collect_list("p").alias("points"))


def noded(directed: DataFrame, rounds: int = 8) -> DataFrame:
    """directed edges (key, fid, layer, ax, ay, bx, by) in pieces (canonical, with sign) that meet at their ends only."""
    now = materialize(_canonical(directed), "edges")
    for _ in range(rounds):
        cuts = materialize(_cuts(now.select("key", *_SEG).distinct()), "cuts")
        if cuts.limit(1).count() == 0:
            return now
        along = lambda p: (p["x"] - F.col("ax")).cast("double") * (F.col("bx") - F.col("ax")) + (p["y"] - F.col("ay")).cast("double") * (F.col("by") - F.col("ay"))
        end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        placed = F.array_sort(F.transform("points", lambda p: F.struct(along(p).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
        chain = F.concat(F.array(end("ax", "ay")), F.transform(placed, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array(end("bx", "by")))
        cut = now.join(cuts, ["key", *_SEG]).withColumn("chain", chain)
        steps = F.explode(F.zip_with(F.slice("chain", 1, F.size("chain") - 1), F.slice("chain", 2, F.size("chain") - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))))
        parts = _canonical(cut.select("key", "fid", "layer", F.col("sign").alias("was"), steps.alias("s")).select("key", "fid", "layer", "was", "s.*"), "turn")
        parts = parts.select("key", "fid", "layer", *_SEG, (F.col("was") * F.col("turn")).alias("sign"))
        rest = now.join(cuts.drop("points"), ["key", *_SEG], "left_anti").select("key", "fid", "layer", *_SEG, "sign")
        now = materialize(rest.unionAll(parts.where("ax <> bx OR ay <> by")), "pieces")
    return now


def _covered(middles: DataFrame, polys: DataFrame, pieces: DataFrame, unit: float) -> DataFrame:
    """key, ax, ay, bx, by, in0, in1: which layers hold the middle of each piece within a polygon that does not have it as an edge."""
    rings = F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(f"array<{RING}>")))
    sides = F.flatten(F.transform(rings, lambda r: edges(_snapped(r, unit))))
    low = lambda k: F.array_min(F.transform("sides", lambda e: F.least(e[f"{k}1"], e[f"{k}2"])))
    high = lambda k: F.array_max(F.transform("sides", lambda e: F.greatest(e[f"{k}1"], e[f"{k}2"])))
    boxed = _level(polys.select("key", "fid", "layer", sides.alias("sides")).where(F.size("sides") > 0).withColumns({"x0": low("x"), "x1": high("x"), "y0": low("y"), "y1": high("y")}))
    boxed = materialize(boxed, "boxes")
    levels = _levels(boxed)
    mx, my = (F.col("ax") + F.col("bx")) / 2.0, (F.col("ay") + F.col("by")) / 2.0
    size = F.pow(F.lit(2.0), F.col("at"))
    asked = middles.select("key", *_SEG, mx.alias("mx"), my.alias("my"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("at"))
    asked = asked.withColumns({"cx": F.floor(F.col("mx") / size), "cy": F.floor(F.col("my") / size)})
    near = asked.join(_cells(boxed, F.col("level")).drop("level").hint("merge"), ["key", "at", "cx", "cy"]).where("mx BETWEEN x0 AND x1 AND my BETWEEN y0 AND y1")
    x, y = F.col("mx"), F.col("my")
    crossed = F.filter("sides", lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    hits = near.where(F.size(crossed) % 2 == 1).select("key", *_SEG, "fid", "layer")
    hits = hits.join(pieces.select("key", *_SEG, "fid", "layer").distinct(), ["key", *_SEG, "fid", "layer"], "left_anti")
    return hits.groupBy("key", *_SEG).agg(F.bool_or(F.col("layer") == 0).alias("in0"), F.bool_or(F.col("layer") == 1).alias("in1"))


def _jumped(links: DataFrame) -> DataFrame:
    """e, ring: the smallest e on each cycle of (e, next)."""
    now = materialize(links.select("e", F.col("next").alias("to"), F.least("e", "next").alias("ring")), "jump")
    while True:  # two jumps a round
        far = now.select(F.col("e").alias("to"), F.col("to").alias("beyond"), F.col("ring").alias("other"))
        step = now.join(far, "to").select("e", F.col("beyond").alias("to"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved"))
        far = step.select(F.col("e").alias("to"), F.col("to").alias("beyond"), F.col("ring").alias("other"), F.col("moved").alias("also"))
        step = materialize(step.join(far, "to").select("e", F.col("beyond").alias("to"), F.least("ring", "other").alias("ring"), (F.col("moved") | F.col("also") | (F.col("other") < F.col("ring"))).alias("moved")), "jump")
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now.select("e", "ring")


def _chained(unit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rings, areas = [], [], []
            for key, steps in zip(batch.column("key").to_pylist(), batch.column("steps").to_pylist(), strict=True):
                after = {s["e"]: s for s in steps}
                at = min(after)
                points = []
                for _ in steps:
                    points.append((after[at]["ux"], after[at]["uy"]))
                    at = after[at]["next"]
                p = np.array(points, np.float64)
                d, b = np.roll(p, -1, axis=0) - p, p - np.roll(p, 1, axis=0)
                p = p[b[:, 0] * d[:, 1] != b[:, 1] * d[:, 0]]  # no vertices within straight lines
                near = p - p[0] if len(p) else p
                areas.append(float((near[:, 0] * np.roll(near[:, 1], -1) - np.roll(near[:, 0], -1) * near[:, 1]).sum()) / 2 * unit * unit)
                keys.append(key)
                rings.append([{"x": x * unit, "y": y * unit} for x, y in [*p.tolist(), *p[:1].tolist()]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("key").type), pa.array(rings, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), pa.array(areas, pa.float64())], ["key", "ring", "area"])

    return run


def _polygons(bounds: DataFrame, unit: float) -> DataFrame:
    """key, ring, holes, area from directed edges (key, ax, ay, bx, by) with the polygon on their left."""
    e = materialize(bounds.withColumn("e", F.monotonically_increasing_id()), "bounds")
    back = F.atan2((F.col("ay") - F.col("by")).cast("double"), (F.col("ax") - F.col("bx")).cast("double"))
    into = e.select("key", F.col("bx").alias("vx"), F.col("by").alias("vy"), "e", back.alias("back"))
    out = e.select("key", F.col("ax").alias("vx"), F.col("ay").alias("vy"), F.col("e").alias("next"), F.atan2((F.col("by") - F.col("ay")).cast("double"), (F.col("bx") - F.col("ax")).cast("double")).alias("ahead"))
    links = into.join(out, ["key", "vx", "vy"]).groupBy("e").agg(F.min_by("next", F.pmod(F.col("back") - F.col("ahead"), F.lit(2 * math.pi))).alias("next"))
    links = materialize(links, "links")
    steps = e.join(links, "e").join(_jumped(links), "e").groupBy("key", "ring").agg(F.collect_list(F.struct("e", "next", F.col("ax").alias("ux"), F.col("ay").alias("uy"))).alias("steps"))
    kind = steps.schema["key"].dataType.simpleString()
    rings = steps.select("key", "steps").mapInArrow(_chained(unit), f"key {kind}, ring {RING}, area double").where("area <> 0")
    rings = materialize(rings.withColumn("part", F.monotonically_increasing_id()), "rings")
    shells, holes = rings.where("area > 0"), rings.where("area < 0")

    box = lambda k, f: f(F.transform("ring", lambda p: p[k]))
    boxed = _level(shells.withColumns({f"{k}{i}": box(k, f) / unit for k in "xy" for i, f in ((0, F.array_min), (1, F.array_max))}))
    levels = _levels(boxed)
    first, second = F.element_at("ring", 1), F.element_at("ring", 2)
    asked = holes.select("key", F.col("ring").alias("hole"), F.col("part").alias("hole_part"), ((first["x"] + second["x"]) / 2).alias("mx"), ((first["y"] + second["y"]) / 2).alias("my"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("at"))
    size = F.pow(F.lit(2.0), F.col("at"))
    asked = asked.withColumns({"cx": F.floor(F.col("mx") / unit / size), "cy": F.floor(F.col("my") / unit / size)})
    near = asked.join(_cells(boxed, F.col("level")).select("key", "at", "cx", "cy", "ring", "part", "area").hint("merge"), ["key", "at", "cx", "cy"])
    x, y = F.col("mx"), F.col("my")
    inside = F.size(F.filter(edges(F.col("ring")), lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))) % 2 == 1
    owner = near.where(inside).groupBy("hole_part").agg(F.min_by(F.struct("part", "hole"), "area").alias("o"))
    held = owner.groupBy(F.col("o.part").alias("part")).agg(F.array_sort(F.collect_list("o.hole")).alias("holes"))
    hole_area = F.aggregate("holes", F.lit(0.0), lambda s, h: s + F.abs(signed_area(h)))
    got = shells.join(held, "part", "left").withColumn("holes", F.coalesce("holes", F.array().cast(f"array<{RING}>")))
    return got.select("key", "ring", "holes", (F.col("area") - hole_area).alias("area"))


def _prepared(polys: DataFrame) -> DataFrame:
    """key, fid, layer, ring, holes; equal polygons of one key and layer are one."""
    extra = {c: v for c, v in (("holes", F.lit(None).cast(f"array<{RING}>")), ("layer", F.lit(0))) if c not in polys.columns}
    return materialize(polys.withColumns(extra).select("key", "layer", "ring", "holes").where("size(ring) > 2").distinct().withColumn("fid", F.monotonically_increasing_id()), "polygons")


def combine(polys: DataFrame, how: str = "union", unit: float = UNIT) -> DataFrame:
    """key, ring, holes, area: what layers 0 and 1 of polys (key, ring; holes and layer where there are) make together under each key.

    Each layer counts as the union of its polygons, which may overlap. how: union, intersection, difference (0 outside
    1) or symmetric_difference. Rows of the result are polygons; those of one key touch in points at most.
    """
    if how not in _RULES:
        raise ValueError(f"unknown combination {how}; there are {', '.join(_RULES)}")
    polys = _prepared(polys)
    pieces = noded(_directed(polys, unit))
    beside = lambda layer, sign: F.bool_or((F.col("layer") == layer) & (F.col("sign") == sign))
    sides = pieces.groupBy("key", *_SEG).agg(*(beside(i, s).alias(f"{n}{i}") for i in (0, 1) for n, s in (("l", 1), ("r", -1))))
    sides = materialize(sides, "sides")
    held = _covered(sides, polys, pieces, unit)
    known = sides.join(held, ["key", *_SEG], "left")
    cover = lambda n, i: F.col(f"{n}{i}") | F.coalesce(F.col(f"in{i}"), F.lit(False))
    left, right = (_RULES[how](cover(n, 0), cover(n, 1)) for n in "lr")
    return _polygons(_ahead(known.withColumns({"left": left, "right": right}).where("left <> right")), unit)


def _ahead(bounds: DataFrame) -> DataFrame:
    """Canonical pieces turned so that what belongs to the result is on their left."""
    pick = lambda a, b: F.when(F.col("left"), F.col(a)).otherwise(F.col(b)).alias(a)
    return bounds.select("key", pick("ax", "bx"), pick("ay", "by"), pick("bx", "ax"), pick("by", "ay"))


def dissolve_union(df: DataFrame, keys: list[str], unit: float = UNIT) -> DataFrame:
    """keys, ring, holes, area: the union of the polygons (ring, holes) of each combination of keys, a row per polygon of it. Null keys are a group."""
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    named = df.withColumn("key", key)
    got = combine(named.select("key", "ring", *(["holes"] if "holes" in df.columns else [])), "union", unit)
    return got.join(named.select("key", *keys).dropDuplicates(["key"]), "key").select(*keys, "ring", "holes", "area")


def alike(df: DataFrame, fid: str, columns: list[str]) -> DataFrame:
    """fid, _one: the smallest fid whose rows hold the same columns, so that equal shapes are worked on once."""
    held = df.groupBy(fid).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_held"))
    return materialize(held.join(held.groupBy("_held").agg(F.min(fid).alias("_one")), "_held").select(fid, "_one"), "alike")


def make_valid(df: DataFrame, fid: str = "fid", unit: float = UNIT) -> DataFrame:
    """fid, ring, holes, area: each row's rings (ring, holes) as valid polygons under the even-odd rule, a row per polygon.

    Self-crossings are noded, edges that a polygon runs along twice cancel (spikes vanish), and a ring inside another is a
    hole, one inside that a polygon again. Rows of which nothing is left give no row. Equal shapes are repaired once.
    """
    same = alike(df, fid, [c for c in ("ring", "holes") if c in df.columns])
    ones = df.join(same.where(F.col(fid) == F.col("_one")).select(fid), fid, "left_semi")
    return same.join(_repaired(ones, fid, unit).withColumnRenamed(fid, "_one"), "_one").select(fid, "ring", "holes", "area")


def _repaired(df: DataFrame, fid: str, unit: float) -> DataFrame:
    held = [] if "holes" not in df.columns else [F.coalesce("holes", F.array().cast(f"array<{RING}>"))]
    rings = F.concat(F.array("ring"), *held)
    each = df.select(F.col(fid).alias("key"), F.explode(rings).alias("r")).select("key", F.explode(edges(_snapped(F.col("r"), unit))).alias("e"))
    segments = each.select("key", F.lit(0).alias("fid"), F.lit(0).alias("layer"), *(F.col(f"e.{c}").cast("long").alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), _SEG, strict=True))).where("ax <> bx OR ay <> by")
    pieces = noded(segments).groupBy("key", *_SEG).agg((F.count("*") % 2).alias("odd")).where("odd = 1").drop("odd")
    pieces = materialize(pieces, "odd")
    # A ray from the middle of a piece to its left: up from one that goes right, to the west from one that goes up.
    upright = F.col("ax") == F.col("bx")
    boxed = _boxed(pieces)
    span = boxed.agg(F.avg(F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0"))).head()[0] or 1.0
    strip = lambda c: F.floor(c / F.lit(max(span, 1.0)))
    middle = boxed.select("key", *_SEG, upright.alias("up"), ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my")).withColumn("strip", strip(F.when(F.col("up"), F.col("my")).otherwise(F.col("mx"))))
    other = [F.col(c).alias(f"o_{c}") for c in _SEG]
    flat = boxed.select("key", *other, "y0", "y1", F.lit(True).alias("up"), F.explode(F.sequence(strip(F.col("y0")), strip(F.col("y1")))).alias("strip")).where("y0 < y1")
    steep = boxed.select("key", *other, F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.lit(False).alias("up"), F.explode(F.sequence(strip(F.col("x0")), strip(F.col("x1")))).alias("strip")).where("y0 < y1")
    met = middle.join(flat.unionAll(steep).hint("merge"), ["key", "up", "strip"]).where("CASE WHEN up THEN my ELSE mx END >= y0 AND CASE WHEN up THEN my ELSE mx END < y1")
    share = lambda p, a, b: (F.col(p) - F.col(f"o_{a}")) / (F.col(f"o_{b}") - F.col(f"o_{a}"))
    west = F.col("o_ax") + share("my", "ay", "by") * (F.col("o_bx") - F.col("o_ax")) < F.col("mx")
    north = F.col("o_ay") + share("mx", "ax", "bx") * (F.col("o_by") - F.col("o_ay")) > F.col("my")
    itself = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"o_{c}") for c in _SEG))
    counted = met.where(~itself).groupBy("key", *_SEG).agg(F.count_if(F.when(F.col("up"), west).otherwise(north)).alias("n"))
    bounds = pieces.join(counted, ["key", *_SEG], "left").withColumn("left", F.coalesce("n", F.lit(0)) % 2 == 1)
    return _polygons(_ahead(bounds), unit).withColumnRenamed("key", fid)
