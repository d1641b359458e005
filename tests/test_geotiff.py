"""GeoTIFF files written here, byte by byte, and read back."""

import struct
import zlib

import numpy as np
import pytest

from terralith.operators.warp import Grid
from terralith.sources import geotiff as G


def lzw_packed(data):
    out, bits, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)

    table, width, w = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    n = 258
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        put(table[w], width)
        table[w + bytes([b])] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            put(256, width)
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        w = bytes([b])
    put(table[w], width)
    n += 1
    put(257, 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def packbits(data):
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))


def tiff(v, order="<", tile=None, compression=1, predictor=1, apart=False, big=False, nodata=None):
    """v: rows x cols x bands."""
    rows, cols, bands = v.shape
    dtype = v.dtype.newbyteorder(order)
    th, tw = tile or (5, cols)
    blocks = []
    for group in [[b] for b in range(bands)] if apart else [list(range(bands))]:
        for r in range(0, rows, th):
            for c in range(0, cols, tw):
                part = v[r : r + th, c : c + tw][:, :, group]
                part = np.pad(part, ((0, th - part.shape[0] if tile else 0), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    u = part.view(f"u{dtype.itemsize}")
                    raw = np.diff(u, axis=1, prepend=np.zeros_like(u[:, :1])).astype(u.dtype.newbyteorder(order)).tobytes()
                elif predictor == 3:
                    n, k = part.shape[0], part.shape[1] * len(group)
                    planes = part.astype(dtype.newbyteorder(">")).reshape(n, k).view(np.uint8).reshape(n, k, dtype.itemsize).transpose(0, 2, 1).reshape(n, -1, len(group))
                    raw = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).astype(np.uint8).tobytes()
                else:
                    raw = part.astype(dtype).tobytes()
                blocks.append({1: bytes, 5: lzw_packed, 8: zlib.compress, 32773: packbits}[compression](raw))
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    at = 16 if big else 8
    places = np.cumsum([at, *map(len, blocks)])[:-1].tolist()
    entries = {256: (4, [cols]), 257: (4, [rows]), 258: (3, [8 * dtype.itemsize] * bands), 259: (3, [compression]), 277: (3, [bands]), 284: (3, [2 if apart else 1]), 317: (3, [predictor]), 339: (3, [kind] * bands), 33550: (12, [0.5, 0.25, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 100.0, 40.0, 0.0]), 34735: (3, [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326])}
    entries |= {322: (4, [tw]), 323: (4, [th]), 324: (4, places), 325: (4, list(map(len, blocks)))} if tile else {273: (4, places), 278: (4, [th]), 279: (4, list(map(len, blocks)))}
    if nodata is not None:
        entries[42113] = (2, str(nodata).encode() + b"\0")
    start = at + sum(map(len, blocks))
    n, extra, body = len(entries), b"", struct.pack(f"{order}{'Q' if big else 'H'}", len(entries))
    room, word = (8, "Q") if big else (4, "I")
    for tag, (k, value) in sorted(entries.items()):
        raw = value if k == 2 else struct.pack(f"{order}{len(value)}{G._KINDS[k]}", *value)
        if len(raw) > room:
            place = start + (8 + 20 * n + 8 if big else 2 + 12 * n + 4) + len(extra)
            extra += raw
            raw = struct.pack(f"{order}{word}", place)
        body += struct.pack(f"{order}HH{word}", tag, k, len(value)) + raw.ljust(room, b"\0")
    head = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, start) if big else struct.pack(f"{order}HI", 42, start))
    return head + b"".join(blocks) + body + bytes(8 if big else 4) + extra


r = np.random.default_rng(1)
CASES = {
    "strips": (r.integers(0, 250, (13, 9, 1)).astype("u1"), {}),
    "big endian, bands apart": (r.integers(-999, 999, (13, 9, 3)).astype("i2"), {"order": ">", "apart": True}),
    "tiles, deflate": (r.normal(size=(37, 41, 2)).astype("f4"), {"tile": (16, 16), "compression": 8}),
    "predictor 2": (r.integers(0, 60_000, (20, 33, 3)).astype("u2"), {"tile": (16, 16), "compression": 8, "predictor": 2, "order": ">"}),
    "predictor 3": (r.normal(size=(20, 33, 1)), {"tile": (16, 32), "compression": 8, "predictor": 3}),
    "predictor 3, bands": (r.normal(size=(20, 33, 2)).astype("f4"), {"compression": 8, "predictor": 3, "order": ">"}),
    "lzw": (np.tile(r.integers(0, 40, (60, 70, 1)), (1, 2, 1)).astype("i4"), {"compression": 5, "tile": (64, 64)}),
    "packbits": (r.integers(0, 9, (30, 11, 1)).astype("u1"), {"compression": 32773}),
    "big tiff": (r.integers(0, 2**40, (8, 8, 1)).astype("i8"), {"big": True, "tile": (16, 16)}),
    "no data": (r.integers(0, 5, (13, 9, 1)).astype("f4"), {"nodata": 3}),
}


def test_files(spark, tmp_path):
    for i, (v, how) in enumerate(CASES.values()):
        (tmp_path / f"f{i}.tif").write_bytes(tiff(v, **how))
    (tmp_path / "note.txt").write_text("not a raster")
    files = G.geotiff_files(spark, str(tmp_path))
    info = {x["path"].rsplit("/", 1)[1]: x for x in G.geotiff_info(files).collect()}
    pixels: dict = {}
    for x in G.geotiff_pixels(files).collect():
        pixels.setdefault(x["path"].rsplit("/", 1)[1], {})[x["row"], x["col"], x["band"]] = x["v"]
    assert len(info) == len(pixels) == len(CASES)
    for i, (name, (v, how)) in enumerate(CASES.items()):
        one, got = info[f"f{i}.tif"], pixels[f"f{i}.tif"]
        assert (one["height"], one["width"], one["bands"]) == v.shape and one["dtype"] == v.dtype.name and one["crs"] == "EPSG:4326", name
        assert (one["x0"], one["y0"], one["dx"], one["dy"], one["nodata"]) == (100.0, 40.0, 0.5, 0.25, how.get("nodata"))
        want = {(a, b, c + 1): None if how.get("nodata") == v[a, b, c] else float(v[a, b, c]) for a in range(v.shape[0]) for b in range(v.shape[1]) for c in range(v.shape[2])}
        assert got == want, name


def test_damaged(spark):
    good = tiff(CASES["tiles, deflate"][0], **CASES["tiles, deflate"][1])
    for bad in (b"", b"II*\0", b"PNG and so on", good[:200], good.replace(struct.pack("<HHI", 259, 3, 1) + struct.pack("<H", 8), struct.pack("<HHI", 259, 3, 1) + struct.pack("<H", 7))):
        with pytest.raises(Exception, match="RasterError|zlib"):
            G.geotiff_pixels(spark.createDataFrame([("x", bad)], "path string, content binary")).count()


def test_blocks(spark):
    v = np.round(np.random.default_rng(2).normal(size=(50, 70)), 3)
    rows = [(i, j, float(v[i, j])) for i in range(50) for j in range(70) if (i + j) % 7]
    grid = Grid("EPSG:32650", 4e5, 4.4e6, 30.0, 30.0, 50, 70)
    blocks = G.geotiff_blocks(spark.createDataFrame(rows, "row long, col long, v double"), grid, 32)
    got = {}
    place = {x["path"]: (round((4.4e6 - x["y0"]) / 30), round((x["x0"] - 4e5) / 30), x["crs"]) for x in G.geotiff_info(blocks).collect()}
    assert len(place) == 6 and {x[2] for x in place.values()} == {"EPSG:32650"}
    for x in G.geotiff_pixels(blocks).where("v IS NOT NULL").collect():
        got[x["row"] + place[x["path"]][0], x["col"] + place[x["path"]][1]] = x["v"]
    assert got == {(i, j): x for i, j, x in rows}
