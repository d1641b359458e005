"""Decoded tiles of lines and polygons against the shapes they come from."""

import math
import random

import numpy as np

from terralith.sources.shape_tiles import clip_line, clip_ring, shape_tiles

PARTS = "fid long, parts array<array<struct<x:double,y:double>>>, kind string"


def varints(b):
    out, n, shift = [], 0, 0
    for c in b:
        n, shift = n | (c & 127) << shift, shift + 7
        if c < 128:
            out.append(n)
            n = shift = 0
    return out


def fields(b):
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            c = b[at]
            at += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while at < len(b):
        tag = varint()
        n = varint()
        if tag & 7 == 2:
            yield tag >> 3, bytes(b[at : at + n])
            at += n
        else:
            yield tag >> 3, n


def decoded(tile):
    """(id, type, properties, parts) of each feature."""
    ((_, layer),) = fields(tile)
    keys, values, out, raw = [], [], [], []
    for k, v in fields(layer):
        {3: lambda: keys.append(v.decode()), 4: lambda: values.append(dict(fields(v))[1].decode()), 2: lambda: raw.append(dict(fields(v)))}.get(k, lambda: None)()
    for f in raw:
        tags, numbers, parts, x, y, at = varints(f.get(2, b"")), varints(f[4]), [], 0, 0, 0
        while at < len(numbers):
            command, n = numbers[at] & 7, numbers[at] >> 3
            at += 1
            if command == 7:
                continue
            for _ in range(n):
                x, y = x + (numbers[at] >> 1 ^ -(numbers[at] & 1)), y + (numbers[at + 1] >> 1 ^ -(numbers[at + 1] & 1))
                at += 2
                if command == 1:
                    parts.append([])
                parts[-1].append((x, y))
        out.append((f[1], f[3], {keys[tags[i]]: values[tags[i + 1]] for i in range(0, len(tags), 2)}, parts))
    return out


def unit(x, y, z, tx, ty):
    n = 1 << z
    v = 0.5 - math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) / (2 * math.pi)
    return ((x / 360 + 0.5) * n - tx) * 4096, (v * n - ty) * 4096


def inside(x, y, rings):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:] + r[:1])) % 2 == 1


def near(x, y, rings, least):
    def far(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy or 1)))
        return math.hypot(a[0] + t * dx - x, a[1] + t * dy - y)

    return any(far(a, b) < least for r in rings for a, b in zip(r, r[1:] + r[:1]))


def frame(spark, rows):
    return spark.createDataFrame([(i, None if parts is None else [[{"x": float(x), "y": float(y)} for x, y in p] for p in parts], k) for i, parts, k in rows], PARTS).repartition(3)


def test_polygons(spark):
    r = random.Random(6)
    star = [(10 + (8 if i % 2 else 3) * math.cos(i * math.pi / 9), 45 + (8 if i % 2 else 3) * math.sin(i * math.pi / 9)) for i in range(18)]
    hole = [(10 + 2 * math.cos(-i), 45 + 2 * math.sin(-i)) for i in range(6)]
    rows = [(1, [star, hole], "a"), (2, [[(-20, -10), (0, -10), (0, 10), (-20, 10), (-20, -10)]], "b"), (3, [[(170, 0), (-170, 0), (-170, 20), (170, 20)]], None), (4, None, "n"), (5, [], "n"), (6, [[(1, 1), (1, 1), (1, 1)]], "n"), (7, [star, hole], "copy")]
    shapes = {1: [star, hole], 2: [rows[1][1][0][:-1]], 3: [[(170, 0), (190, 0), (190, 20), (170, 20)]]}
    zooms = [0, 2, 5, 6]
    tiles = {(t["z"], t["tx"], t["ty"]): (t["n"], decoded(bytes(t["tile"]))) for t in shape_tiles(frame(spark, rows), zooms, True, properties=["kind"]).collect()}
    assert {z for z, _, _ in tiles} == set(zooms) and all(n == len(x) for n, x in tiles.values())
    assert {f[0] for _, x in tiles.values() for f in x} == {1, 2, 3} and {f[1] for _, x in tiles.values() for f in x} == {3}
    assert {(f[0], f[2].get("kind")) for _, x in tiles.values() for f in x} == {(1, "a"), (2, "b"), (3, None)}
    assert {tx for z, tx, _ in tiles if z == 5 and tx in (0, 31)} == {0, 31}  # both sides of the antimeridian
    for _ in range(1500):
        fid = r.choice([1, 1, 2, 3])
        x, y = {1: (r.uniform(0, 20), r.uniform(36, 54)), 2: (r.uniform(-22, 2), r.uniform(-12, 12)), 3: (r.uniform(165, 195), r.uniform(-3, 23))}[fid]
        z = r.choice(zooms)
        wrapped = x - 360 if x >= 180 else x
        u, v = unit(wrapped, y, z, 0, 0)
        tx, ty = int(u // 4096), int(v // 4096)
        found = [f for f in tiles.get((z, tx, ty), (0, []))[1] if f[0] == fid]
        rings = [[unit(a, b, z, 0, 0) for a, b in ring] for ring in shapes[fid]]
        at = unit(x, y, z, 0, 0)
        if not near(*at, rings, 3):
            assert inside(u - 4096 * tx, v - 4096 * ty, [p for f in found for p in f[3]]) == inside(*at, rings), (fid, x, y, z)
    for _, features in tiles.values():
        for _, _, _, parts in features:
            sizes = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) for p in parts]
            assert sizes[0] > 0 and all(s < 0 for s in sizes[1:]) and all(-64 <= c <= 4160 for p in parts for q in p for c in q)


def test_lines(spark):
    wave = [(x / 4, 30 * math.sin(x / 40)) for x in range(-200, 200)]
    rows = [(1, [wave], "w"), (2, [[(175, 10), (-175, 12)], [(0.3, 60), (0.4, 70)]], "two"), (3, [[(5, 5), (5, 5)]], "dot")]
    zooms = [1, 3, 6]
    tiles = {(t["z"], t["tx"], t["ty"]): decoded(bytes(t["tile"])) for t in shape_tiles(frame(spark, rows), zooms, False).collect()}
    whole = {1: [wave], 2: [[(175, 10), (185, 12)], [(0.3, 60), (0.4, 70)]]}
    for z in zooms:
        for fid, lines in whole.items():
            placed = [[unit(x, y, z, 0, 0) for x, y in line] for line in lines]
            total = 0.0
            for (k, tx, ty), features in tiles.items():
                for f in (f for f in features if k == z and f[0] == fid):
                    assert f[1] == 2 and f[2] == {}
                    for part in f[3]:
                        for x, y in part:
                            here = (x + 4096 * tx, y + 4096 * ty)
                            assert any(near(*here, [p, p[::-1]][:1], 1.5) or near(here[0] + 4096 * (1 << z), here[1], [p], 1.5) for p in placed)
                        for p in clip_line(np.array(part, float), np.zeros(2), np.full(2, 4096.0)):
                            total += np.hypot(*np.diff(p, axis=0).T).sum()
            want = sum(math.dist(a, b) for p in placed for a, b in zip(p, p[1:]))
            assert abs(total - want) < 0.02 * want + 3 * len(tiles)


def test_clipping():
    r = random.Random(1)
    low, high = np.array([0.0, 0.0]), np.array([1.0, 1.0])
    for _ in range(200):
        p = np.array([(r.choice([r.uniform(-1, 2), 0, 1]), r.choice([r.uniform(-1, 2), 0, 1])) for _ in range(r.randrange(2, 9))])
        for part in clip_line(p, low, high):
            assert (part >= -1e-12).all() and (part <= 1 + 1e-12).all()
        length = sum(np.hypot(*np.diff(x, axis=0).T).sum() for x in clip_line(p, low, high))
        steps = np.linspace(0, 1, 4001)
        want = sum(np.hypot(*(b - a)) * ((a + np.outer(steps, b - a) >= 0).all(axis=1) & (a + np.outer(steps, b - a) <= 1).all(axis=1)).mean() for a, b in zip(p[:-1], p[1:]))
        assert abs(length - want) < 5e-3 * len(p)
        ring = clip_ring(p, low, high)
        for _ in range(20):
            x, y = r.uniform(0.001, 0.999), r.uniform(0.001, 0.999)
            assert inside(x, y, [ring.tolist()]) == inside(x, y, [p.tolist()])
