"""Spatial predicates against the nine intersections, counted on a lattice of half units."""

import random
from collections import Counter

import pytest

from terralith.operators.relate import PREDICATES, shape_join

KIND = "fid long, kind string, parts array<array<struct<x:double,y:double>>>"
SIZE = 9


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def made(seed=3):
    r = random.Random(seed)
    out = []
    for _ in range(28):
        x, y = r.randrange(6), r.randrange(6)
        w, h = r.randrange(1, 4), r.randrange(1, 4)
        out.append(("polygon", [box(x, y, x + w, y + h)[:: r.choice([1, -1])]]))
    out += [("polygon", [box(0, 0, 8, 8), box(2, 2, 6, 6)]), ("polygon", [box(2, 2, 6, 6)]), ("polygon", [box(3, 3, 4, 4)]), ("polygon", [box(0, 0, 8, 8), box(3, 3, 4, 4), box(5, 5, 7, 7)])]
    for _ in range(30):
        p = [(r.randrange(8), r.randrange(8))]
        for _ in range(r.randrange(1, 5)):
            x, y = p[-1]
            p.append((r.randrange(9), y) if r.random() < 0.5 else (x, r.randrange(9)))
        p = [q for i, q in enumerate(p) if i == 0 or q != p[i - 1]]
        # a line that runs along itself has no clear interior
        steps = [tuple(sorted(s)) for a, b in zip(p, p[1:]) for s in unit_steps(a, b)]
        if len(p) > 1 and len(set(steps)) == len(steps) and simple(p):
            out.append(("line", [p]))
    out += [("line", [[(0, 0), (3, 0)], [(5, 0), (5, 4)]]), ("line", [[(0, 3), (8, 3)]]), ("line", [[(2, 3), (5, 3)]]), ("line", [[(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]])]
    out += [("point", [[(r.randrange(9), r.randrange(9))] for _ in range(r.choice([1, 1, 2, 3]))]) for _ in range(14)]
    return [(i, kind, parts) for i, (kind, parts) in enumerate(out)]


def unit_steps(a, b):
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    at = lambda k: (a[0] + (b[0] - a[0]) * k // n, a[1] + (b[1] - a[1]) * k // n)
    return [(at(k), at(k + 1)) for k in range(n)]


def simple(p):
    places = [s[0] for a, b in zip(p, p[1:]) for s in unit_steps(a, b)] + [p[-1]]
    return max(Counter(places).values()) == 1


def lattice(kind, parts):
    """I, B or E of each half-unit place, by place."""
    where = {}
    edges = {q for p in parts for a, b in zip(p, p[1:]) for (x, y), (u, v) in unit_steps(a, b) for q in ((2 * x, 2 * y), (x + u, y + v), (2 * u, 2 * v))}
    if kind == "point":
        return {(2 * p[0][0], 2 * p[0][1]): "I" for p in parts}
    if kind == "line":
        ends = Counter(q for p in parts for q in (p[0], p[-1]))
        return {q: "B" if any(n % 2 and (2 * x, 2 * y) == q for (x, y), n in ends.items()) else "I" for q in edges}
    for x in range(2 * SIZE):
        for y in range(2 * SIZE):
            if (x, y) in edges:
                where[x, y] = "B"
            elif sum(min(a[1], b[1]) * 2 <= y + 0.5 < max(a[1], b[1]) * 2 and 2 * a[0] > x for p in parts for a, b in zip(p, p[1:])) % 2:
                where[x, y] = "I"
    return where


def expected(predicate, a, b):
    (ka, x), (kb, y) = a, b
    size = {"point": 0, "line": 1, "polygon": 2}
    da, db = size[ka], size[kb]
    both = [(x.get(q, "E"), y.get(q, "E"), q) for q in x.keys() | y.keys()]
    has = {(i, j) for i, j, _ in both}
    ii, ie, ei = ("I", "I") in has, ("I", "E") in has, ("E", "I") in has
    along = any(i == j == "I" and (q[0] % 2 or q[1] % 2) for i, j, q in both)
    contact = any(i != "E" and j != "E" for i, j in has)
    match predicate:
        case "intersects":
            return contact
        case "within":
            return ii and not ie and ("B", "E") not in has
        case "contains":
            return ii and not ei and ("E", "B") not in has
        case "touches":
            return contact and not ii
        case "equals":
            return ii and not ie and not ei and ("B", "E") not in has and ("E", "B") not in has
        case "overlaps":
            return da == db and ii and ie and ei and (da != 1 or along)
        case "crosses":
            return (da == db == 1 and ii and not along) or (da < db and ii and ie) or (da > db and ii and ei)


@pytest.fixture(scope="module")
def shapes():
    return made()


def frame(spark, rows):
    return spark.createDataFrame([(i, k, None if p is None else [[{"x": float(x), "y": float(y)} for x, y in part] for part in p]) for i, k, p in rows], KIND).repartition(4)


@pytest.mark.parametrize("predicate", PREDICATES)
def test_predicates(spark, shapes, predicate):
    a = frame(spark, shapes)
    seen = {i: (k, lattice(k, p)) for i, k, p in shapes}
    want = {(i, j) for i in seen for j in seen if expected(predicate, seen[i], seen[j])}
    got = [tuple(r) for r in shape_join(a, a, predicate).collect()]
    wrong = [(i, j, (i, j) in want, shapes[i][1:], shapes[j][1:]) for i, j in set(got) ^ want]
    assert not wrong, wrong[0]
    assert len(got) == len(want) > 5


def test_outer_joins_and_sizes(spark):
    """Large and tiny shapes, null and empty ones, and those without a partner."""
    a = [(1, "polygon", [box(0, 0, 1000, 1000)]), (2, "point", [[(5, 5)]]), (3, "polygon", None), (4, "line", []), (5, "point", [[(2000, 2000)]])]
    b = [(10, "polygon", [box(4.999, 4.999, 5.001, 5.001)]), (11, "line", [[(-10, 500), (1010, 500)]]), (12, "point", [[(-1, -1)]]), (13, "point", None)]
    x, y = frame(spark, a), frame(spark, b)
    pairs = {(1, 10), (1, 11), (2, 10)}
    for how, more in (("inner", set()), ("left", {(3, None), (4, None), (5, None)}), ("right", {(None, 12), (None, 13)}), ("full", {(3, None), (4, None), (5, None), (None, 12), (None, 13)})):
        got = [tuple(r) for r in shape_join(x, y, how=how).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs | more
    assert {tuple(r) for r in shape_join(x, y, "contains").collect()} == {(1, 10)}
    assert {tuple(r) for r in shape_join(y, x, "crosses").collect()} == {(11, 1)}
    with pytest.raises(ValueError):
        shape_join(x, y, "near")
