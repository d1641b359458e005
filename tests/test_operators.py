"""Operators that SQL cannot express, and edge cases, against brute force on small fixtures."""

import itertools
import json
import random
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.operators import clustering, decision, network, quality, relational, spatial, statistics, text
from terralith.sources import store
from terralith.sources.features_api import FeatureReader
from terralith.streaming import windows


def graph(n=60, seed=3):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)): float(r.choice([1, 1, 2, 3, 7])) for _ in range(4 * n)}.items())


def test_searches_agree(spark):
    """The broadcast search and the spreading one give the same costs, and both Bellman-Ford's."""
    rows = [(u, v, c) for (u, v), c in graph()]
    edges = spark.createDataFrame(rows, "u long, v long, cost double")
    origins = spark.createDataFrame([(0,), (5,), (5,), (999,)], "node long")
    for cutoff in (None, 6.0):
        one = {tuple(r) for r in network.costs(edges, origins, cutoff).collect()}
        assert one == {tuple(r) for r in network.spread_costs(edges, origins, cutoff).collect()}
        for origin in (0, 5):
            best = {origin: 0.0}
            for _ in range(60):
                for u, v, c in rows:
                    if u in best and best[u] + c < best.get(v, 1e9):
                        best[v] = best[u] + c
            assert {r[1]: r[2] for r in one if r[0] == origin} == {k: c for k, c in best.items() if cutoff is None or c <= cutoff}


def test_shortest_path(spark):
    rows = [(u, v, c) for (u, v), c in graph()]
    edges = spark.createDataFrame(rows, "u long, v long, cost double")
    got = network.shortest_path(edges, 0, 41).orderBy("seq").collect()
    steps = {(u, v): c for u, v, c in rows}
    assert got[0]["node"] == 0 and got[-1]["node"] == 41
    assert all(abs(b["cost"] - a["cost"] - steps[a["node"], b["node"]]) < 1e-9 for a, b in itertools.pairwise(got))
    tree = {r["node"]: r["cost"] for r in network.costs(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got[-1]["cost"] == tree[41]
    assert network.shortest_path(edges, 0, 12345).count() == 0


@pytest.mark.parametrize("problem", ["p_median", "max_coverage"])
def test_allocation(spark, problem):
    """Greedy with swaps gets a score that no single swap betters, and the exact search the best of all sets."""
    r = random.Random(8)
    od = [(o, d, float(r.randrange(1, 60))) for o in range(25) for d in range(9) if r.random() < 0.6]
    weight = {o: float(1 + o % 4) for o in range(25)}
    frame, demand = spark.createDataFrame(od, "oid long, did long, cost double"), spark.createDataFrame(list(weight.items()), "oid long, weight double")

    def score(sites):
        total = 0.0
        for o, w in weight.items():
            best = min((c for a, d, c in od if a == o and d in sites), default=1e9)
            total += w * best if problem == "p_median" else (-w if best <= 20 else 0.0)
        return total

    exact, value = network.allocate(frame, demand, None, 3, problem, cutoff=20)
    assert value == pytest.approx(score(exact)) and value == pytest.approx(min(score(s) for s in itertools.combinations(range(9), 3)))
    near, found = network.allocate(frame, demand, None, 3, problem, cutoff=20, exact_limit=0)
    assert found == pytest.approx(score(near)) and len(set(near)) == 3
    assert found <= min(score([c if x == out else x for x in near]) for out in near for c in range(9) if c not in near) + 1e-6


def test_route():
    r = np.random.default_rng(4)
    matrix = r.integers(1, 50, (9, 9)).astype(float).tolist()
    for closed in (True, False):
        tour, total = network.route(matrix, closed=closed)
        way = tour + tour[:1] if closed else tour
        assert sorted(tour) == list(range(9)) and total == pytest.approx(sum(matrix[a][b] for a, b in itertools.pairwise(way)))
        for i, j in itertools.combinations(range(1, 9), 2):
            other = tour[:i] + tour[i : j + 1][::-1] + tour[j + 1 :]
            way = other + other[:1] if closed else other
            assert sum(matrix[a][b] for a, b in itertools.pairwise(way)) >= total - 1e-4


def test_jenks(spark):
    """Every row counts, however often its value repeats; the best split of all."""
    r = random.Random(6)
    values = [float(r.randrange(12)) for _ in range(300)] + [50.0] * 900 + [52.0, 90.0, 95.0]
    got = statistics.breaks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "jenks", 3)

    def spread(limits):
        groups = [[v for v in values if (v <= b and (v > a or i == 0))] for i, (a, b) in enumerate(itertools.pairwise(limits))]
        return sum(sum((v - sum(g) / len(g)) ** 2 for v in g) for g in groups if g)

    inner = sorted(set(values))
    assert spread(got) == pytest.approx(min(spread([inner[0], a, b, inner[-1]]) for a, b in itertools.combinations(inner[:-1], 2)))
    many = [float(i % 5000) for i in range(20_000)]
    limits = statistics.breaks(spark.createDataFrame([(v,) for v in many], "v double"), "v", "jenks", 4)
    assert limits[0] == 0 and limits[-1] == 4999 and max(abs(x - w) for x, w in zip(limits, [0, 1250, 2500, 3750, 4999], strict=True)) < 30


@pytest.mark.parametrize("shape", ["outlier", "skewed", "two crowds"])
def test_jenks_of_many_values(spark, shape):
    """More distinct values than classes: the sum of squares is that of the exact programme over all values."""
    r = random.Random(3)
    values = {
        "outlier": [float(1000 * c + i) for c in range(4) for i in range(300 + 4 * c)] + [1e9],
        "skewed": [r.lognormvariate(0, 2.5) for _ in range(1800)],
        "two crowds": [r.gauss(0, 1e-3) for _ in range(900)] + [r.gauss(5, 1e-3) for _ in range(900)] + [r.uniform(0, 1000) for _ in range(40)],
    }[shape]
    got = statistics.breaks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "jenks", 5)
    exact = statistics.jenks(sorted((v, v, 1, v, 0.0) for v in values), 5)

    def spread(limits):
        groups = [[v for v in values if v <= b and (v > a or i == 0)] for i, (a, b) in enumerate(itertools.pairwise(limits))]
        return sum(sum((v - sum(g) / len(g)) ** 2 for v in g) for g in groups if g)

    assert len(got) == 6 and spread(got) <= spread(exact) * 1.002 + 1e-6
    if shape == "outlier":
        assert got == exact == [0.0, *[1000.0 * c + 299 + 4 * c for c in range(4)], 1e9]


def test_few_points(spark):
    kind = "fid long, mx double, my double, x double, y double"
    none, one = spark.createDataFrame([], kind), spark.createDataFrame([(1, 2.0, 3.0, 2.0, 3.0)], kind)
    assert spatial.nearest(one, one, 8, by_self=True).count() == 0
    assert spatial.nearest(one, none, 1).count() == 0
    cells = spark.createDataFrame([(1, 2.0, 3.0)], "fid long, cx double, cy double")
    assert statistics.kde(none, cells).count() == 0
    with pytest.raises(ValueError, match="bandwidth"):
        statistics.kde(one, cells)
    assert statistics.kde(one, cells, bandwidth=2.0).count() == 1


def test_fingerprint(spark):
    rows = [spark.createDataFrame([(v,) for v in x], "v long") for x in ([1, 1, 3], [2, 2, 3], [3, 1, 1], [])]
    got = [tuple(relational.fingerprint(x).head()) for x in rows]
    assert got[0] == got[2] and len(set(got)) == 3


def test_longest_prefix(spark):
    names = spark.createDataFrame([("x" * n,) for n in (1, 5, 299, 400, 700)] + [("y",), (None,)], "full_name string")
    districts = spark.createDataFrame([("x" * n,) for n in range(2, 401)], "district string")
    got = {r["full_name"]: r["district"] for r in relational.longest_prefix(names, districts).collect()}
    assert got == {"x": None, "x" * 5: "x" * 5, "x" * 299: "x" * 299, "x" * 400: "x" * 400, "x" * 700: "x" * 400, "y": None, None: None}


def test_rules(spark):
    rules = spark.createDataFrame([(1, "a", 1.0, 5.0, None), (1, "b", None, None, ["X"]), (2, "c", 0.0, None, None)], "rule_id long, key string, low double, high double, options array<string>")
    contexts = spark.createDataFrame([(1, "a", 3.0, None), (1, "b", None, "x"), (2, "a", 9.0, None), (3, "b", None, "y"), (4, "d", 1.0, None)], "ctx_id long, key string, num double, text string")
    got = sorted(map(tuple, relational.rule_applicability(rules, contexts).collect()))
    assert got == [(1, 1), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4)]
    with pytest.raises(relational.BoundsError):
        relational.rule_applicability(rules, contexts, max_rules=2)


@pytest.mark.parametrize("total", [0, 95, 100, 250])
def test_features_are_paged_to_the_end(total):
    """No feature is lost, whatever total is expected and however small the service's own pages are."""
    every = [{"id": i, "geometry": {"type": "Point", "coordinates": [i, -i]}, "properties": {"k": i}} for i in range(237)]

    def fetch(url):
        q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(url).query).items() if k in ("limit", "offset")}
        return json.dumps({"type": "FeatureCollection", "features": every[q["offset"] : q["offset"] + min(q["limit"], 30)]}).encode()

    reader = FeatureReader({"url": "http://x/items", "total": str(total), "page": "50"}, fetch)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [int(r[0]) for r in rows] == list(range(237))


def test_chunks(spark):
    """Chunks cover the text in order; from the second on they end behind the best separator of their latter half."""
    body = "".join(f"Sentence {i} of it. " + ("\n\n" if i % 7 == 0 else "") for i in range(300))
    for tokens, overlap in ((40, 5), (64, 0), (16, 20)):
        found = text.chunk_bounds(body, tokens, overlap)
        size, at = 4 * tokens, 0
        for i, (start, end, content) in enumerate(found):
            assert start == at and content == body[start:end].strip()
            if i:
                part = body[start : start + size]
                ends = [k + len(s) for s in text.SEPARATORS if (k := part.rfind(s)) > size // 2]
                assert end == start + (ends[0] if ends else size)
            else:
                assert end == size
            at = end - 4 * overlap if end - 4 * overlap > start else start + max(1, size // 2)
        assert at >= len(body)
    assert text.chunk_documents(spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")).count() == 3


def test_running_anomalies(spark, sf, tmp_path):
    events = windows.read_events(spark, sf)
    windows.run_to_files(windows.running_anomalies(events, threshold=1.7), f"file://{tmp_path}/rows", f"file://{tmp_path}/state")
    got = {(r["event_type"], r["event_id"], r["z"]) for r in spark.read.parquet(f"file://{tmp_path}/rows").collect()}
    want, seen = set(), {}
    for r in spark.read.parquet(f"{sf}/events.parquet").where("value is not null").orderBy("ts", "event_id").collect():
        before = np.array(seen.setdefault(r["event_type"], []))
        if len(before) >= 30 and before.std() > 0 and abs(r["value"] - before.mean()) / before.std() >= 1.7:
            want.add((r["event_type"], r["event_id"], round(float((r["value"] - before.mean()) / before.std()), 3)))
        seen[r["event_type"]].append(r["value"])
    assert {x[:2] for x in got} == {x[:2] for x in want} and len(want) > 5


def test_rings_and_schemas(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(1, ring((0, 0), (0, 2), (2, 2), (2, 0))), (2, ring((0, 0), (1, 0), (1, 0), (1, 1), (0, 0))), (3, ring((0, 0), (1, 1), (0, 0)))]
    got = {r["fid"]: [(p["x"], p["y"]) for p in r["ring"]] for r in quality.repair_rings(spark.createDataFrame(rows, "fid long, ring array<struct<x:double,y:double>>")).collect()}
    assert got.keys() == {1, 2}
    for points in got.values():
        assert points[0] == points[-1] and all(a != b for a, b in itertools.pairwise(points))
        assert sum(a[0] * b[1] - b[0] * a[1] for a, b in itertools.pairwise(points)) > 0
    layers = {"a": spark.createDataFrame([(1, 2)], "x long, y long"), "b": spark.createDataFrame([(1,)], "x long")}
    assert quality.schema_drift(layers) == [("b", "y")]


def test_decay_needs_a_radius():
    with pytest.raises(ValueError, match="radius"):
        decision.distance_decay(F.lit(1.0), 1.0, 0.0)


def test_dbscan_numbers(spark):
    rows = [(i, float(10 * (i // 5) + i % 5), 0.0) for i in range(40)] + [(99, 500.0, 500.0)]
    got = {r["fid"]: r["cluster"] for r in clustering.dbscan(spark.createDataFrame(rows, "fid long, mx double, my double"), 1.5, 3).collect()}
    assert got == {i: i // 5 for i in range(40)} | {99: -1}


def test_shared_folder(spark, monkeypatch):
    """Written tables go when they are cleared; a cluster without a shared folder is an error."""
    monkeypatch.setattr(store, "_written", {})
    out = store.materialize(spark.range(5).toDF("id"), "cleared")
    assert out.count() == 5
    path = store._written[spark.sparkContext.applicationId][0]
    store.clear_shared(spark)
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path)

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(Cluster)


@pytest.mark.parametrize("direction", ["from_facility", "to_facility"])
def test_closest_on_network(spark, monkeypatch, direction):
    """k labels against all pairs, on a broadcast graph and in rounds of joins; facilities that share nodes, ties, nodes out of reach."""
    r = random.Random(7)
    ways = [(r.randrange(40), r.randrange(40), float(r.randrange(1, 6))) for _ in range(110)] + [(90, 91, 1.0)]
    fac = [(d, r.randrange(40)) for d in range(25)] + [(100 + d, 3) for d in range(6)] + [(200, 91), (201, None)]
    dem = [(o, r.randrange(40)) for o in range(60)] + [(60, 90), (61, 77)]
    graph = {}
    for u, v, c in ways:
        u, v = (u, v) if direction == "from_facility" else (v, u)
        graph.setdefault(u, []).append((v, c))
    far = {n: network.cheapest(graph, n, float("inf"))[0] for n in {n for _, n in fac if n is not None}}
    edges, facilities, demand = spark.createDataFrame(ways, "u long, v long, cost double"), spark.createDataFrame(fac, "did long, node long"), spark.createDataFrame(dem, "oid long, node long")
    for k, cutoff in ((1, None), (3, 6.0)):
        want = set()
        for o, n in dem:
            reach = sorted((far[m][n], d) for d, m in fac if m is not None and n in far[m] and (cutoff is None or far[m][n] <= cutoff))
            want |= {(o, d, c, i + 1) for i, (c, d) in enumerate(reach[:k])}
        for limit in (1_000_000, 0):
            monkeypatch.setattr(network, "GRAPH_EDGES", limit)
            got = network.closest_on_network(edges, demand, facilities, k, cutoff, direction).collect()
            assert len(got) == len(want) and {tuple(x) for x in got} == want
