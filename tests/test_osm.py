"""An OpenStreetMap extract written here, byte by byte, read back and cut into themes."""

import random
import struct
import zlib

import numpy as np
import pytest

from terralith.sources import osm


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def part(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def deltas(values):
    return b"".join(varint(zigzag(b - a)) for a, b in zip([0, *values], values))


def block(nodes, ways, dense=True, grain=100, south=0, west=0):
    strings = [""] + sorted({s for _, *_, tags in nodes + ways for kv in tags.items() for s in kv})
    at = {s: i for i, s in enumerate(strings)}
    unit = lambda v, off: round((v * 1e9 - off) / grain)
    group = b""
    if dense and nodes:
        pairs = b"".join(b"".join(varint(at[k]) + varint(at[v]) for k, v in t.items()) + b"\0" for *_, t in nodes)
        group += part(2, part(1, deltas([n[0] for n in nodes])) + part(8, deltas([unit(n[2], south) for n in nodes])) + part(9, deltas([unit(n[1], west) for n in nodes])) + part(10, pairs))
    packed = lambda t, i: part(2, b"".join(varint(at[k]) for k in t)) + part(3, b"".join(varint(at[v]) for v in t.values())) if i else b""
    if not dense:
        group += b"".join(part(1, varint(8) + varint(zigzag(i)) + packed(t, True) + varint(64) + varint(zigzag(unit(y, south))) + varint(72) + varint(zigzag(unit(x, west)))) for i, x, y, t in nodes)
    group += b"".join(part(3, varint(8) + varint(i) + packed(t, True) + part(8, deltas(refs))) for i, refs, t in ways)
    head = varint(17 << 3) + varint(grain) + varint(19 << 3) + varint(south) + varint(20 << 3) + varint(west)
    return part(1, b"".join(part(1, s.encode()) for s in strings)) + part(2, group) + head


def blob(kind, data, packed):
    body = (varint(16) + varint(len(data)) + part(3, zlib.compress(data))) if packed else part(1, data)
    head = part(1, kind) + varint(24) + varint(len(body))
    return struct.pack(">I", len(head)) + head + body


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    r = random.Random(4)
    nodes = [(r.randrange(-5, 2**40) if i else -7, round(r.uniform(-180, 180), 7), round(r.uniform(-90, 90), 7), {"amenity": r.choice(["cafe", "bank"]), "name": f"Café {i}"} if i % 5 == 0 else {"shop": "kiosk", "office": "x"} if i % 7 == 0 else {}) for i in range(300)]
    nodes = list({n[0]: n for n in nodes}.values())
    ways = [(10**9 + i, [r.choice(nodes)[0] for _ in range(r.randrange(1, 9))], {"highway": "primary", "name": "Weg ü"} if i % 2 else {"railway": "rail"} if i % 3 else {"building": "yes"}) for i in range(80)]
    ways += [(5, [nodes[0][0], 2**50, nodes[1][0]], {"waterway": "river"}), (6, [2**50, nodes[1][0]], {"waterway": "canal"})]
    data = blob(b"OSMHeader", b"\x22\x00", False) + blob(b"OSMData", block(nodes[:120], []), True) + blob(b"OSMData", block(nodes[120:200], [], dense=False), False)
    data += blob(b"OSMData", block(nodes[200:], ways[:30], grain=10, south=500, west=-(10**6)), True) + blob(b"OSMData", block([], ways[30:]), True)
    where = tmp_path_factory.mktemp("osm") / "some.osm.pbf"
    where.write_bytes(data)
    return str(where), nodes, ways, data


def test_reading(spark, made):
    path, nodes, ways, _ = made
    got = osm.read_osm(spark, path).collect()
    found = {x["id"]: (round(x["x"], 6), round(x["y"], 6), x["tags"]) for x in got if x["kind"] == "node"}
    assert found == {i: (round(x, 6), round(y, 6), t) for i, x, y, t in nodes}
    assert {x["id"]: (x["refs"], x["tags"]) for x in got if x["kind"] == "way"} == {i: (refs, t) for i, refs, t in ways}


def test_themes(spark, made):
    path, nodes, ways, _ = made
    objects, place = osm.read_osm(spark, path), {n[0]: n[1:3] for n in nodes}
    pois = {x["osm_id"]: x for x in osm.osm_theme(objects, "pois").collect()}
    assert pois.keys() == {n[0] for n in nodes if n[3]} and {x["category"] for x in pois.values()} == {"cafe", "bank", "kiosk"}
    for theme in ("roads", "railways", "waterways"):
        key = osm.THEMES[theme][1][0]
        want = {i: [place[n] for n in refs if n in place] for i, refs, t in ways if key in t}
        got = {x["osm_id"]: [(p["x"], p["y"]) for p in x["points"]] for x in osm.osm_theme(objects, theme).collect()}
        assert got.keys() == {i for i, p in want.items() if len(p) > 1}
        assert all(np.allclose(got[i], want[i], atol=1e-6) for i in got)
    roads = osm.osm_theme(objects, "roads")
    assert osm.scan_theme(roads, "roads", name_like="WEG", tag="highway=primary", limit=5).count() == 5
    assert osm.scan_theme(roads, "roads", tag="name=Weg ü", limit=9999).count() == roads.count()
    assert osm.scan_theme(roads, "roads", bbox=(-180, -90, 180, 90)).count() == roads.count() and osm.scan_theme(roads, "roads", tag="highway=track").count() == 0
    with pytest.raises(ValueError):
        osm.scan_theme(roads, "roads", bbox=(5, 0, 4, 1))
    with pytest.raises(ValueError):
        osm.osm_theme(objects, "parks")


def test_damaged(spark, made, tmp_path):
    data = made[3]
    for i, bad in enumerate((data[:-3], data[: len(data) // 2], b"PK\x03\x04 nothing", data[:60])):
        (tmp_path / f"{i}.pbf").write_bytes(bad)
        with pytest.raises(Exception, match="ExtractError"):
            osm.read_osm(spark, str(tmp_path / f"{i}.pbf")).count()
    values = np.array([0, 1, 127, 128, 2**63 + 5, 2**64 - 1], np.uint64)
    assert osm.numbers(b"".join(varint(int(v)) for v in values)).tolist() == values.tolist()
