"""Networks as edge tables (u, v, cost): shortest-path costs by joins, and what is built on them.

A graph of bounded size is broadcast and searched from each origin in parallel. Beyond the bound, costs spread as
DataFrames: a round extends what the last round improved, keeps the smallest cost per (origin, node) and stops when
nothing improves, so many origins are searched at once and no graph needs to fit in one task.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..sources.store import materialize

DEFAULT_SPEED_KMH = 40.0
#: Edges of a graph that is broadcast: some 50 MB.
GRAPH_EDGES = 1_000_000
#: Steps that one round of a search takes before it is written.
HOPS = 4
#: Metres a minute on a network.
MODES = {"walking": 80, "cycling": 250, "driving": 667, "transit": 417}


def is_oneway(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("yes", "1", "true", "t"), F.lit(False))


def build_edges(lines: DataFrame, snap: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines (fid, points, one_way, speed_kmh): ends within the snapping grid are one node.

    Each step of a line is an edge, both ways unless one-way; of repeated directed pairs the first (by line and step) stays.
    """
    steps = lines.select("fid", "one_way", "speed_kmh", F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))).alias("k", "s"))
    node = lambda p: F.concat_ws(":", F.rint(p["x"] / snap).cast("long"), F.rint(p["y"] / snap).cast("long"))
    a, b = F.col("s.a"), F.col("s.b")
    speed = F.when(F.col("speed_kmh") > 0, F.col("speed_kmh")).otherwise(DEFAULT_SPEED_KMH)
    sized = steps.select("fid", "k", node(a).alias("u"), node(b).alias("v"), a.alias("pu"), b.alias("pv"), haversine_m(a["x"], a["y"], b["x"], b["y"]).alias("length_m"), is_oneway(F.col("one_way")).alias("one"), speed.alias("speed")).where("u <> v")
    ways = sized.select("fid", "k", F.lit(0).alias("d"), "u", "v", "length_m", "speed").unionAll(sized.where(~F.col("one")).select("fid", "k", F.lit(1).alias("d"), F.col("v").alias("u"), F.col("u").alias("v"), "length_m", "speed"))
    first = ways.groupBy("u", "v").agg(F.min(F.struct("fid", "k", "d", "length_m", "speed")).alias("e"))
    edges = first.select("u", "v", F.col("e.length_m").alias("length_m"), (F.col("e.length_m") / (F.col("e.speed") / 3.6)).alias("time_s"))
    ends = sized.select(F.col("u").alias("node"), F.col("pu").alias("p")).unionAll(sized.select("v", "pv"))
    return ends.groupBy("node").agg(F.min("p.x").alias("x"), F.min("p.y").alias("y")), edges


def edge_cost(c: Column, factor: Column | None = None) -> Column:
    """An impedance as a cost: 0 or less counts as 0.001, times a barrier's factor, 1e-4 at least."""
    base = F.when(c <= 0, 0.001).otherwise(c)
    return F.greatest(base * F.coalesce(factor, F.lit(1.0)) if factor is not None else base, F.lit(1e-4))


def apply_barriers(edges: DataFrame, barriers: DataFrame) -> DataFrame:
    """barriers (u, v, factor): a null factor closes the edge, others multiply its cost."""
    joined = edges.join(barriers.groupBy("u", "v").agg(F.max(F.col("factor").isNull()).alias("closed"), F.max("factor").alias("factor")), ["u", "v"], "left")
    return joined.where(~F.coalesce("closed", F.lit(False))).withColumn("cost", edge_cost(F.col("cost"), F.col("factor"))).select(*edges.columns)


def _searches(edges: DataFrame, origins: DataFrame, cutoff: float | None) -> DataFrame:
    """costs() over a graph of at most `GRAPH_EDGES` edges: it is broadcast as one row, and each task searches from its origins."""
    spark, kind = edges.sparkSession, edges.schema["u"].dataType.simpleString()
    graph = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("cost").cast("double").alias("c")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.collect_list("c").alias("c"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = origins.select("node").distinct().groupBy(F.pmod(F.xxhash64("node"), F.lit(4 * parts)).alias("part")).agg(F.collect_list("node").alias("nodes"))
    most = float("inf") if cutoff is None else cutoff

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).type.value_type
            for nodes, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                ways: dict = {}
                for u, v, cost in zip(a, b, c, strict=True):
                    ways.setdefault(u, []).append((v, cost))
                for origin in nodes:
                    best, via = cheapest(ways, origin, most)
                    reached = list(best)
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * len(reached), node), pa.array(reached, node), pa.array([best[x] for x in reached], pa.float64()), pa.array([via[x] for x in reached], node)], ["origin", "node", "cost", "via"])

    return dealt.join(F.broadcast(graph)).select("nodes", "a", "b", "c").mapInArrow(run, f"origin {kind}, node {kind}, cost double, via {kind}")


def cheapest(ways: dict, origin, most: float) -> tuple[dict, dict]:
    """Cost and the node before, for every node within `most` of the origin; of equal costs the smallest node before."""
    best, via, done, queue = {origin: 0.0}, {origin: None}, set(), [(0.0, origin)]
    while queue:
        cost, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        for v, step in ways.get(u, ()):
            reach = cost + step
            if reach > most or v in done:
                continue
            known = best.get(v)
            if known is None or reach < known:
                best[v], via[v] = reach, u
                heapq.heappush(queue, (reach, v))
            elif reach == known and u < via[v]:
                via[v] = u
    return best, via


def costs(edges: DataFrame, origins: DataFrame, cutoff: float | None = None) -> DataFrame:
    """origin, node, cost, via: the cheapest cost from every origin (column node) to every node within the cutoff; via is the node before.

    Of equal costs the smallest `via` stays. Costs are not negative. A graph of at most `GRAPH_EDGES` edges is
    broadcast and searched from each origin by itself; over a larger one all searches spread in rounds of joins.
    """
    ways = materialize(edges.select("u", "v", F.col("cost").cast("double").alias("cost")), "ways")
    return (_searches if ways.count() <= GRAPH_EDGES else spread_costs)(ways, origins, cutoff)


def spread_costs(edges: DataFrame, origins: DataFrame, cutoff: float | None = None) -> DataFrame:
    """costs() for graphs of any size: a round extends what the last one improved, and keeps the smallest cost."""
    best = materialize(origins.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("cost"), F.lit(None).cast(origins.schema["node"].dataType).alias("via")).distinct(), "costs")
    ways = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.col("cost").alias("step")), "ways")

    def extend(rows: DataFrame) -> DataFrame:
        steps = rows.join(ways, "node").select("origin", F.col("to").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.col("node").alias("via"))
        steps = steps.where(F.col("cost") <= cutoff) if cutoff is not None else steps
        return steps.groupBy("origin", "node").agg(F.min(F.struct("cost", "via")).alias("n")).select("origin", "node", "n.cost", "n.via")

    frontier = best
    while True:
        hops = [extend(frontier)]
        while len(hops) < HOPS:
            hops.append(extend(hops[-1]))
        found = functools.reduce(DataFrame.unionAll, hops).groupBy("origin", "node").agg(F.min(F.struct("cost", "via")).alias("n"))
        joined = best.withColumnRenamed("cost", "c0").withColumnRenamed("via", "via0").join(found, ["origin", "node"], "full")
        better = F.coalesce(F.col("n.cost") < F.col("c0"), F.col("c0").isNull())
        via = F.when(better, F.col("n.via")).when(F.col("n.cost") == F.col("c0"), F.least("n.via", "via0")).otherwise(F.col("via0"))
        via = F.when(F.col("via0").isNull() & F.col("c0").isNotNull(), F.lit(None)).otherwise(via)  # an origin has no node before
        state = materialize(joined.select("origin", "node", F.when(better, F.col("n.cost")).otherwise(F.col("c0")).alias("cost"), via.alias("via"), better.alias("fresh")), "costs")
        best, frontier = state.drop("fresh"), state.where("fresh").drop("fresh")
        if not frontier.limit(1).count():
            return best


def od_matrix(edges: DataFrame, origins: DataFrame, destinations: DataFrame, cutoff: float | None = None) -> DataFrame:
    """origins (oid, node) × destinations (did, node): pairs with a path, and its cost; origins at one node share a search."""
    reached = costs(edges, origins.select("node").distinct(), cutoff)
    out = reached.join(destinations.select("did", "node"), "node").select("origin", "did", "cost")
    return origins.select("oid", F.col("node").alias("origin")).join(out, "origin").select("oid", "did", "cost")


def closest_facility(od: DataFrame, k: int = 1) -> DataFrame:
    """The k cheapest facilities of each demand, ties by facility."""
    w = Window.partitionBy("oid").orderBy("cost", "did")
    return od.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_labels(edges: DataFrame, facilities: DataFrame, k: int, cutoff: float | None = None, slack: float = 0.0) -> DataFrame:
    """node, did, cost: the k cheapest facilities (did, node) on the way to every node, and all that cost at most `slack` more than the k-th.

    Labels spread from all facilities at once and a node passes on only what it keeps, so the work grows with k times
    the graph, not with facilities times nodes. Of facilities at one node the k smallest are told apart. A graph of at
    most `GRAPH_EDGES` edges is broadcast and searched from groups of facilities; a larger one in rounds of joins.
    """
    ways = materialize(edges.select("u", "v", F.col("cost").cast("double").alias("cost")), "ways")
    first = facilities.select("did", "node").where("node IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("did"))).where(F.col("_n") <= k).drop("_n")
    return (_label_searches if ways.count() <= GRAPH_EDGES else spread_labels)(ways, first, k, cutoff, slack)


def _label_searches(edges: DataFrame, facilities: DataFrame, k: int, cutoff: float | None, slack: float) -> DataFrame:
    spark, node, did = edges.sparkSession, facilities.schema["node"].dataType.simpleString(), facilities.schema["did"].dataType.simpleString()
    graph = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("cost").alias("c")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.collect_list("c").alias("c"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = facilities.groupBy(F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("did", "node")).alias("sources"))
    most = float("inf") if cutoff is None else cutoff

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.column(0).type.value_type.field(c).type for c in ("node", "did")]
            for sources, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                ways: dict = {}
                for u, v, cost in zip(a, b, c, strict=True):
                    ways.setdefault(u, []).append((v, cost))
                queue = [(0.0, s["did"], s["node"]) for s in sources]
                heapq.heapify(queue)
                kept: dict = {}
                while queue:
                    cost, d, u = heapq.heappop(queue)
                    mine = kept.setdefault(u, {})
                    if d in mine or len(mine) >= k and cost > sorted(mine.values())[k - 1] + slack:
                        continue
                    mine[d] = cost
                    for v, step in ways.get(u, ()):
                        if cost + step <= most and d not in kept.get(v, ()):
                            heapq.heappush(queue, (cost + step, d, v))
                rows = [(u, d, cost) for u, mine in kept.items() for d, cost in mine.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (*kinds, pa.float64()), strict=True)], ["node", "did", "cost"])

    found = dealt.join(F.broadcast(graph)).select("sources", "a", "b", "c").mapInArrow(run, f"node {node}, did {did}, cost double")
    return _k_best(found, k, slack)


def _k_best(labels: DataFrame, k: int, slack: float) -> DataFrame:
    """Of labels (node, did, cost), one per pair, those of the k best costs of the node, with the slack."""
    w = Window.partitionBy("node").orderBy("cost", "did")
    last = F.max(F.when(F.col("_n") == k, F.col("cost"))).over(Window.partitionBy("node"))
    return labels.withColumn("_n", F.row_number().over(w)).withColumn("_last", last).where(F.col("_last").isNull() | (F.col("cost") <= F.col("_last") + slack)).drop("_n", "_last")


def spread_labels(edges: DataFrame, facilities: DataFrame, k: int, cutoff: float | None = None, slack: float = 0.0) -> DataFrame:
    """nearest_labels() for graphs of any size: each round extends the labels that are new or better, and a node keeps its best."""
    best = materialize(facilities.select("node", "did", F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")), "labels")
    while True:
        steps = best.where("fresh").select("node", "did", "cost").join(edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.col("cost").alias("step")), "node").select(F.col("to").alias("node"), "did", (F.col("cost") + F.col("step")).alias("cost"))
        steps = steps.where(F.col("cost") <= cutoff) if cutoff is not None else steps
        old = best.select("node", "did", "cost", F.lit(False).alias("fresh"))
        one = old.unionAll(steps.withColumn("fresh", F.lit(True))).groupBy("node", "did").agg(F.min(F.struct("cost", "fresh")).alias("x")).select("node", "did", "x.cost", "x.fresh")
        best = materialize(_k_best(one, k, slack), "labels")
        if not best.where("fresh").limit(1).count():
            return best.drop("fresh")


def closest_on_network(edges: DataFrame, demand: DataFrame, facilities: DataFrame, k: int = 1, cutoff: float | None = None, direction: str = "from_facility", digits: int = 3) -> DataFrame:
    """oid, did, cost, rank: the k cheapest facilities (did, node) of each demand (oid, node), by costs of so many digits and then by facility.

    direction: from_facility or to_facility, which goes against the edges. Demands of one node share their answer; one
    without a facility within the cutoff has no row.
    """
    if direction not in ("from_facility", "to_facility"):
        raise ValueError(f"unknown direction {direction}")
    ways = edges if direction == "from_facility" else edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost")
    slack = 10.0**-digits
    labels = nearest_labels(ways, facilities, k, None if cutoff is None else cutoff + slack, slack).withColumn("cost", F.round("cost", digits))
    labels = labels.where(F.col("cost") <= cutoff) if cutoff is not None else labels
    ranked = closest_facility(labels.withColumnRenamed("node", "oid"), k).withColumnRenamed("oid", "node")
    return demand.select("oid", "node").join(ranked, "node").select("oid", "did", "cost", "rank")


def node_accessibility(edges: DataFrame, demand: DataFrame, facilities: DataFrame, cutoff: float, method: str = "2sfca", digits: int = 3) -> DataFrame:
    """accessibility() of demand (oid, node, weight) and facilities (did, node, capacity), by node: only pairs of nodes within the cutoff are made."""
    sites = facilities.groupBy(F.col("node").alias("did")).agg(F.sum("capacity").alias("capacity"))
    zones = demand.groupBy(F.col("node").alias("oid")).agg(F.sum("weight").alias("weight"))
    within = costs(edges, sites.select(F.col("did").alias("node")), cutoff + 10.0**-digits)
    od = within.select(F.col("node").alias("oid"), F.col("origin").alias("did"), F.round("cost", digits).alias("cost")).join(zones.select("oid"), "oid", "left_semi")
    got = accessibility(od, zones, sites, cutoff, method).select(F.col("oid").alias("node"), "score", "least", "served")
    return demand.select("oid", "node", "weight").join(got, "node").select("oid", "weight", "score", "least", "served")


def od_totals(edges: DataFrame, demand: DataFrame, facilities: DataFrame, cutoff: float | None = None) -> DataFrame:
    """oid, n, total: how many facilities reach each demand within the cutoff, and the sum of their costs; by node, so that no pair is made."""
    sites = facilities.groupBy("node").agg(F.count("*").alias("sites"))
    reached = costs(edges, sites.select("node"), cutoff).join(sites.withColumnRenamed("node", "origin"), "origin")
    by = reached.groupBy("node").agg(F.sum("sites").alias("n"), F.sum(F.col("sites") * F.col("cost")).alias("total"))
    return demand.select("oid", "node").join(by, "node").select("oid", "n", "total")


def shortest_path(edges: DataFrame, origin, destination) -> DataFrame:
    """seq, node, cost along the cheapest path, empty if there is none. The way back doubles with each join."""
    kind = edges.schema["u"].dataType.simpleString()
    tree = materialize(costs(edges, edges.sparkSession.createDataFrame([(origin,)], f"node {kind}")), "tree")
    up = tree.where("via is not null").select(F.col("node").alias("below"), F.col("via").alias("above"))
    path = tree.where(F.col("node") == F.lit(destination)).select("node")
    while True:
        further = materialize(path.join(up, path["node"] == up["below"]).select(F.col("above").alias("node")), "path")
        if not further.limit(1).count():
            break
        path = path.unionAll(further)
        up = materialize(up.join(up.select(F.col("below").alias("above"), F.col("above").alias("top")), "above").select("below", F.col("top").alias("above")), "up")
    rows = tree.join(path, "node", "left_semi").select("node", "cost")
    return rows.withColumn("seq", F.row_number().over(Window.orderBy("cost", "node")) - 1).select("seq", "node", "cost")  # one path's rows


def break_cutoff(value: float, unit: str) -> float:
    """A break in minutes, seconds, metres or kilometres as seconds of travel or metres."""
    return {"minutes": value * 60, "seconds": value, "meters": value, "m": value, "km": value * 1000, "kilometers": value * 1000}[unit]


def service_area(edges: DataFrame, facilities: DataFrame, breaks: list[float]) -> DataFrame:
    """facility, break, n_nodes, reach: nodes within each ascending break and edge cost covered, an edge past the break by what is affordable."""
    reached = costs(edges, facilities.select("node"), max(breaks))
    each = reached.withColumn("break", F.explode(F.array(*[F.lit(float(b)) for b in sorted(breaks)]))).where("cost <= break")
    out = each.join(edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.col("cost").alias("step")), "node", "left")
    return out.groupBy(F.col("origin").alias("facility"), "break").agg(F.count_distinct("node").alias("n_nodes"), F.sum(F.least(F.col("step"), F.col("break") - F.col("cost"))).alias("reach"))


def accessibility(od: DataFrame, demand: DataFrame, facilities: DataFrame, cutoff: float, method: str = "2sfca") -> DataFrame:
    """demand (oid, weight), facilities (did, capacity), od costs: score, least cost and whether served.

    2sfca: capacity over the demand within the cutoff, summed over the facilities within it; any other method: the
    nearest facility within the cutoff serves.
    """
    near = od.where(F.col("cost") <= cutoff)
    if method == "2sfca":
        ratio = near.join(demand, "oid").groupBy("did").agg(F.sum("weight").alias("w")).join(facilities, "did").select("did", F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(0.0).alias("ratio"))
        got = near.join(ratio, "did").groupBy("oid").agg(F.sum("ratio").alias("score"), F.min("cost").alias("least"))
    else:
        got = near.groupBy("oid").agg(F.lit(1.0).alias("score"), F.min("cost").alias("least"))
    out = demand.join(got, "oid", "left")
    return out.select("oid", "weight", F.coalesce("score", F.lit(0.0)).alias("score"), "least", (F.coalesce("score", F.lit(0.0)) > 0).alias("served"))


def coverage(zones: DataFrame) -> DataFrame:
    """One row: served and total demand, coverage in percent (100 without demand) and the weighted mean cost of the served."""
    served = F.sum(F.when(F.col("served"), F.col("weight")).otherwise(0))
    total = F.sum("weight")
    return zones.agg(served.alias("served"), total.alias("total"), F.when(total > 0, 100.0 * served / total).otherwise(100.0).alias("pct"), (F.sum(F.when(F.col("served"), F.col("weight") * F.col("least"))) / served).alias("mean_cost"))


def first_sites(facilities: DataFrame, p: int) -> DataFrame:
    """Of facilities (did, node) at one node the p smallest: they reach everything at the same cost, so no choice of p needs others."""
    first = Window.partitionBy("node").orderBy("did")
    return facilities.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= p).drop("_n")


def allocate(od: DataFrame, demand: DataFrame, candidates: list | None, p: int, problem: str = "p_median", cutoff: float = 900.0, exact_limit: int = 20_000) -> tuple[list, float]:
    """The p candidates of least weighted cost, or of most weight within the cutoff; unreachable demand costs 1e9 a unit.

    All combinations are scored in one job if there are at most `exact_limit`; else greedy, then swaps while they help,
    each step one pass over the costs: a demand knows its cost without each chosen site, and a candidate's gain is
    summed over the demands that it reaches. First best wins. Without candidates, all destinations of od are.
    """
    spark = od.sparkSession
    candidates = sorted(r[0] for r in od.select("did").distinct().collect()) if candidates is None else list(candidates)
    p = min(p, len(candidates))
    far, worth = (1e9, F.col("cost")) if problem == "p_median" else (1.0, F.when(F.col("cost") <= cutoff, 0.0).otherwise(1.0))
    scored = materialize(od.join(F.broadcast(spark.createDataFrame([(c,) for c in candidates], f"did {od.schema['did'].dataType.simpleString()}")), "did").join(demand, "oid").select("oid", "did", worth.alias("u"), "weight"), "scored")
    total = float(demand.agg(F.sum("weight")).head()[0] or 0.0)
    shown = (lambda s: s) if problem == "p_median" else (lambda s: s - total)

    if math.comb(len(candidates), p) <= exact_limit:
        sets = list(itertools.combinations(candidates, p))
        rows = spark.createDataFrame([(i, c) for i, s in enumerate(sets) for c in s], f"k long, did {od.schema['did'].dataType.simpleString()}")
        best = scored.join(F.broadcast(rows), "did").groupBy("k", "oid").agg(F.min("u").alias("u"), F.first("weight").alias("weight"))
        found = dict(best.groupBy("k").agg(F.sum((F.lit(far) - F.least("u", F.lit(far))) * F.col("weight"))).collect())  # a number per set of candidates
        scores = [far * total - found.get(i, 0.0) for i in range(len(sets))]
        at = min(range(len(sets)), key=lambda i: (scores[i], i))
        return list(sets[at]), shown(scores[at])

    def trials(kept: list[tuple]) -> list[tuple[float, int, object]]:
        """(score, which, candidate) of every set kept[which] with one candidate more."""
        own = scored.where(F.col("did").isin(sorted({c for s in kept for c in s}))).groupBy("oid").agg(F.map_from_entries(F.collect_list(F.struct("did", "u"))).alias("mine"))
        without = [F.least(F.lit(far), *[F.coalesce(F.col("mine")[F.lit(c)], F.lit(far)) for c in s], F.lit(far)) for s in kept]
        based = demand.join(own, "oid", "left").select("oid", "weight", *[w.alias(f"b{i}") for i, w in enumerate(without)])
        bases = based.agg(*[F.sum(F.col(f"b{i}") * F.col("weight")) for i in range(len(kept))]).head()
        gains = scored.drop("weight").join(based, "oid").groupBy("did").agg(*[F.sum(F.col("weight") * F.greatest(F.col(f"b{i}") - F.col("u"), F.lit(0.0))).alias(f"g{i}") for i in range(len(kept))])
        return [(bases[i] - r[f"g{i}"], i, r["did"]) for r in gains.collect() for i in range(len(kept)) if r["did"] not in kept[i]]  # a row per candidate

    chosen: list = []
    best = far * total
    while len(chosen) < p:
        best, _, more = min(trials([tuple(chosen)]))
        chosen.append(more)
    while True:
        found = [x for x in trials([tuple(c for c in chosen if c != out) for out in chosen]) if x[2] not in chosen]
        if not found or min(found)[0] >= best - 1e-9:
            return list(chosen), shown(best)
        best, out, more = min(found)
        chosen[out] = more


def route(matrix: list[list[float]], start: int = 0, closed: bool = True, scans: int = 100) -> tuple[list[int], float]:
    """A tour over a small directed cost matrix: nearest neighbour, then first-improvement 2-opt (gains over 1e-4)."""
    n = len(matrix)
    tour, left = [start], set(range(n)) - {start}
    while left:
        nxt = min(left, key=lambda j: (matrix[tour[-1]][j], j))
        tour.append(nxt)
        left.remove(nxt)

    def sums(t: list[int]) -> tuple[list[float], list[float]]:
        """Costs along the tour up to each place, onward and backward."""
        steps = list(itertools.pairwise(t))
        return [0.0, *itertools.accumulate(matrix[a][b] for a, b in steps)], [0.0, *itertools.accumulate(matrix[b][a] for a, b in steps)]

    def improvement() -> tuple[int, int] | None:
        onward, backward = sums(tour)
        for i, j in itertools.combinations(range(1, n), 2):
            before, first, last = tour[i - 1], tour[i], tour[j]
            after = tour[j + 1] if j + 1 < n else tour[0] if closed else None
            old = matrix[before][first] + onward[j] - onward[i] + (matrix[last][after] if after is not None else 0.0)
            new = matrix[before][last] + backward[j] - backward[i] + (matrix[first][after] if after is not None else 0.0)
            if new < old - 1e-4:
                return i, j
        return None

    for _ in range(scans):
        if (swap := improvement()) is None:
            break
        i, j = swap
        tour[i : j + 1] = tour[i : j + 1][::-1]
    return tour, sums(tour)[0][-1] + (matrix[tour[-1]][tour[0]] if closed else 0.0)


def turn_edges(nodes: DataFrame, edges: DataFrame, penalty: float, angle: float = 25.0) -> DataFrame:
    """The line graph: states are edges, and going on by a bearing change over `angle` degrees costs `penalty` more."""
    a = nodes.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    bearing = F.pmod(F.degrees(F.atan2((F.col("vx") - F.col("ux")) * F.cos(F.radians((F.col("uy") + F.col("vy")) / 2)), F.col("vy") - F.col("uy"))), F.lit(360.0))
    e = edges.join(a, "u").join(b, "v").select(F.concat_ws(">", "u", "v").alias("state"), "u", "v", "cost", bearing.alias("bearing"))
    first, second = e.select(F.col("state").alias("s1"), F.col("v").alias("mid"), F.col("bearing").alias("b1")), e.select(F.col("state").alias("s2"), F.col("u").alias("mid"), F.col("bearing").alias("b2"), "cost")
    turn = F.abs(F.pmod(F.col("b2") - F.col("b1") + 180.0, F.lit(360.0)) - 180.0)
    return first.join(second, "mid").select(F.col("s1").alias("u"), F.col("s2").alias("v"), (F.col("cost") + F.when(turn > angle, penalty).otherwise(0.0)).alias("cost"))


def split_crossings(lines: DataFrame, cell: float = 0.01, by: DataFrame | None = None) -> DataFrame:
    """lines (fid, points, ...) with a vertex more at every place where steps of two lines, or of one, cross or touch.

    Steps meet by an equi-join on grid cells; a step's cuts are sorted along it. Ends that only touch are cut too.
    by: other lines (fid, points); these alone cut, and are not cut themselves.
    """

    def steps(of: DataFrame) -> DataFrame:
        each = of.select("fid", F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))).alias("k", "s"))
        return each.select("fid", "k", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))

    flat = steps(lines)
    span = lambda p, q: F.sequence(F.floor(F.least(p, q) / cell), F.floor(F.greatest(p, q) / cell))
    in_cells = lambda df: materialize(df.withColumn("_cx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("_cy", F.explode(span(F.col("y1"), F.col("y2")))), "steps")
    celled = in_cells(flat)
    other = (celled if by is None else in_cells(steps(by))).select("_cx", "_cy", *[F.col(c).alias(f"o_{c}") for c in ("fid", "k", "x1", "y1", "x2", "y2")])
    apart = F.lit(True) if by is not None else (F.col("fid") != F.col("o_fid")) | (F.col("k") != F.col("o_k"))
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("o_x2") - F.col("o_x1"), F.col("o_y2") - F.col("o_y1")
    den = dx * ey - dy * ex
    px, py = F.col("o_x1") - F.col("x1"), F.col("o_y1") - F.col("y1")
    t, u = (px * ey - py * ex) / F.when(den != 0, den), (px * dy - py * dx) / F.when(den != 0, den)
    pairs = celled.join(other, ["_cx", "_cy"]).where(apart).select("fid", "k", "x1", "y1", "x2", "y2", t.alias("t"), u.alias("u"))
    cuts = pairs.where("t > 1e-9 and t < 1 - 1e-9 and u > -1e-9 and u < 1 + 1e-9").groupBy("fid", "k").agg(F.array_sort(F.collect_set(F.round("t", 9))).alias("cuts"))
    cut = flat.join(cuts, ["fid", "k"], "left")
    inner = F.transform(F.coalesce("cuts", F.array().cast("array<double>")), lambda t: F.struct((F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y")))
    start, end = (F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y"))) for a, b in (("x1", "y1"), ("x2", "y2")))
    last = cut.withColumn("pts", F.concat(start, inner)).withColumn("end", end)
    joined = last.groupBy("fid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "pts"))), lambda x: x["pts"])).alias("head"), F.max_by("end", "k").alias("tail"))
    return lines.drop("points").join(joined, "fid").select(*[c for c in lines.columns if c != "points"], F.concat("head", "tail").alias("points"))


def cut_streets(streets: DataFrame, lines: DataFrame, cell: float = 0.05) -> DataFrame:
    """fid, n_points of streets (fid, across, low, high along x if across, else along y) cut by lines without end (across, at).

    A line that runs the other way meets every street that has its place between low and high, wherever the street stands.
    So streets of one span have the same cuts: one of them is cut, by strokes that stand for the lines. A list of cuts for
    each street would grow with the product of streets and lines.
    """

    def drawn(of: DataFrame, a: tuple[Column, Column], b: tuple[Column, Column]) -> DataFrame:
        """From a to b, each (place along the line, place beside it)."""
        at = lambda u, v: F.struct(F.when(F.col("across"), u).otherwise(v).alias("x"), F.when(F.col("across"), v).otherwise(u).alias("y"))
        return of.select("fid", F.array(at(*a), at(*b)).alias("points"))

    shapes = materialize(streets.groupBy("across", "low", "high").agg(F.min("fid").alias("fid")), "spans")
    near, mid, far = (F.lit(cell * k / 4) for k in (1, 2, 3))
    strokes = drawn(lines.select("across", "at").distinct().withColumn("fid", F.lit(0)), (near, F.col("at")), (far, F.col("at")))
    cut = split_crossings(drawn(shapes, (F.col("low"), mid), (F.col("high"), mid)), cell, strokes)
    found = materialize(cut.select("fid", F.size("points").cast("long").alias("n_points")), "cut")
    return streets.join(shapes.join(found, "fid").drop("fid"), ["across", "low", "high"]).select("fid", "n_points")


def turn_aware_path(nodes: DataFrame, edges: DataFrame, origin, destination, penalty: float, angle: float = 25.0) -> DataFrame:
    """seq, node, cost, turn along the path that is cheapest with turns over `angle` degrees costing `penalty`; turn is the bearing's change.

    The search runs over edges: a start leads to every edge out of the origin.
    """
    line = materialize(turn_edges(nodes, edges, penalty, angle), "turns")
    begin = edges.where(F.col("u") == F.lit(origin)).select(F.lit("start").alias("u"), F.concat_ws(">", "u", "v").alias("v"), "cost")
    every = materialize(line.select("u", "v", "cost").unionByName(begin), "line")
    reached = costs(every, edges.sparkSession.createDataFrame([("start",)], "node string"))
    best = reached.where(F.get(F.split("node", ">"), 1) == F.lit(str(destination))).orderBy("cost", "node").head()
    spark = edges.sparkSession
    if best is None:
        return spark.createDataFrame([], "seq long, node string, cost double, turn string")
    path = shortest_path(every, "start", best["node"]).where("node <> 'start'")
    to = F.get(F.split("node", ">"), 1)
    w = Window.orderBy("seq")
    a, b = nodes.select(F.col("node").cast("string").alias("from"), F.col("x").alias("ax"), F.col("y").alias("ay")), nodes.select(F.col("node").cast("string").alias("to"), F.col("x").alias("bx"), F.col("y").alias("by"))
    legs = path.withColumn("from", F.get(F.split("node", ">"), 0)).withColumn("to", to).join(a, "from").join(b, "to")
    bearing = F.pmod(F.degrees(F.atan2((F.col("bx") - F.col("ax")) * F.cos(F.radians((F.col("ay") + F.col("by")) / 2)), F.col("by") - F.col("ay"))), F.lit(360.0))
    change = F.pmod(F.col("bearing") - F.lag("bearing").over(w) + 180.0, F.lit(360.0)) - 180.0
    way = F.when(F.abs("change") <= angle, "straight").when(F.col("change") > 0, "right").otherwise("left")
    return legs.withColumn("bearing", bearing).withColumn("change", change).select("seq", F.col("to").alias("node"), "cost", F.coalesce(F.when(F.col("change").isNotNull(), way), F.lit("start")).alias("turn"))  # one path's rows


def isochrones(nodes: DataFrame, edges: DataFrame, facilities: DataFrame, minutes: float, mode: str = "walking") -> DataFrame:
    """facility, n_nodes, farthest (m), ring, area: nodes within the mode's reach of each facility (node), and their convex hull."""
    from .geometry import convex_hull

    reach = MODES[mode] * minutes
    got = costs(edges.select("u", "v", F.col("length_m").alias("cost")), facilities.select("node"), reach)
    placed = got.join(nodes.select("node", "x", "y"), "node")
    counts = got.groupBy(F.col("origin").alias("facility")).agg(F.count("*").alias("n_nodes"), F.max("cost").alias("farthest"))
    return counts.join(convex_hull(placed, "origin", "x", "y").withColumnRenamed("origin", "facility"), "facility", "left")


#: Kilometres an hour of a straight-line service area.
AREA_SPEEDS = {"walking": 5.0, "cycling": 15.0, "driving": 40.0}


def travel_areas(points: DataFrame, minutes: float, mode: str = "walking") -> DataFrame:
    """Points (mx, my) with the disc that the mode's speed reaches in the time, as `ring`."""
    from .geometry import buffer_points

    return buffer_points(points, AREA_SPEEDS[mode] * 1000.0 * minutes / 60.0)
