"""OpenStreetMap extracts (PBF) as tables of nodes and ways, and themes of places and lines from them.

An extract is read as Spark's binaryFile source gives it (2 GB a file at most). Where the file is, it is only cut into its
blobs; these travel compressed and are decoded in parallel, deltas and packed numbers by array operations. Ways meet
their nodes by a join, so neither the nodes of a country nor the index of their places need to fit in one task. Relations
and the history of objects are left aside.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each theme holds, and the tags that make an object part of it and give its category, in their order of preference.
THEMES = {
    "pois": ("node", ("amenity", "shop", "tourism", "leisure", "office", "healthcare")),
    "roads": ("way", ("highway",)),
    "railways": ("way", ("railway",)),
    "waterways": ("way", ("waterway",)),
}
#: Letters of the tags' text that a theme keeps.
TAG_LETTERS = 512


class ExtractError(ValueError):
    """A file that is no readable extract; says why."""


def numbers(data: bytes | memoryview) -> np.ndarray:
    """Packed varints as unsigned 64-bit integers."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = b < 128
    if not last[-1]:
        raise ExtractError("a number is cut off")
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64)), starts)


def signed(x: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message: varints as numbers, what has a length as bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while at < n:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7
        raise ExtractError("a message is cut off")

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            if at + size > n:
                raise ExtractError("a message is cut off")
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ExtractError(f"a field of kind {kind}")


def blobs(data: memoryview) -> Iterator[tuple[bool, memoryview]]:
    """(whether it is zlib data, bytes) of the file's blobs of objects."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ExtractError("the file ends early")
        size = struct.unpack(">I", data[at : at + 4])[0]
        if size > 1 << 16:
            raise ExtractError("not an extract")
        head = dict(fields(data[at + 4 : at + 4 + size]))
        start = at + 4 + size
        at = start + int(head.get(3, 0))
        if 1 not in head or at > len(data):
            raise ExtractError("the file ends early" if at > len(data) else "not an extract")
        if bytes(head[1]) == b"OSMData":
            blob = dict(fields(data[start:at]))
            if 3 not in blob and 1 not in blob:
                raise ExtractError("a blob is neither plain nor zlib")
            yield 3 in blob, blob[3] if 3 in blob else blob[1]


def objects(data: bytes) -> Iterator[tuple[str, int, float | None, float | None, list[int] | None, list[tuple[str, str]]]]:
    """(kind, id, x, y, refs, tags) of the nodes and ways of a block."""
    strings: list[str] = []
    groups, grain, south, west = [], 100, 0, 0
    for k, v in fields(memoryview(data)):
        if k == 1:
            strings = [bytes(s).decode("utf-8", "replace") for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            south = int(np.uint64(v).view(np.int64))
        elif k == 20:
            west = int(np.uint64(v).view(np.int64))

    def tags(message: dict) -> list[tuple[str, str]]:
        return [(strings[a], strings[b]) for a, b in zip(numbers(message.get(2, b"")).tolist(), numbers(message.get(3, b"")).tolist(), strict=True)]

    place = lambda v, off: (off + grain * v) / 1e9
    zigzag = lambda v: (v >> 1) ^ -(v & 1)
    for group in groups:
        for kind, message in fields(group):
            if kind == 2:
                dense = dict(fields(message))
                ids, lat, lon = (np.cumsum(signed(numbers(dense.get(i, b"")))) for i in (1, 8, 9))
                if not len(ids) == len(lat) == len(lon):
                    raise ExtractError("dense nodes of different lengths")
                pairs = numbers(dense.get(10, b"")).tolist()
                at = 0
                for i, x, y in zip(ids.tolist(), lon.tolist(), lat.tolist(), strict=True):
                    own = []
                    while at < len(pairs) and pairs[at]:
                        own.append((strings[pairs[at]], strings[pairs[at + 1]]))
                        at += 2
                    at += 1
                    yield "node", i, place(x, west), place(y, south), None, own
            elif kind == 1:
                m = dict(fields(message))
                yield "node", zigzag(m[1]), place(zigzag(m[9]), west), place(zigzag(m[8]), south), None, tags(m)
            elif kind == 3:
                m = dict(fields(message))
                yield "way", int(np.uint64(m[1]).view(np.int64)), None, None, np.cumsum(signed(numbers(m.get(8, b"")))).tolist(), tags(m)


_OBJECT = "kind string, id long, x double, y double, refs array<long>, tags map<string,string>"


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """kind (node or way), id, x, y of nodes, refs (ids of nodes) of ways, tags."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                for i, (packed, data) in enumerate(blobs(memoryview(content.as_buffer()).cast("B"))):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([packed]), pa.array([bytes(data)], pa.binary())], ["i", "packed", "data"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = list(objects(zlib.decompress(data) if packed else data))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((*r[:5], list(dict(r[5]).items())) for r in rows), strict=True), kinds, strict=True)], [x.split()[0] for x in _OBJECT.split(", ")])

    return files.mapInArrow(cut, "i long, packed boolean, data binary").repartition("i").mapInArrow(decode, _OBJECT)


def osm_theme(objects: DataFrame, theme: str) -> DataFrame:
    """osm_id, name, category, tags (JSON text), x, y and points of the objects of a theme.

    category is the first of the theme's tags that the object has. A way's points are those of its nodes in their order; nodes
    that the extract lacks are left out, and a way with fewer than two is no line. x and y are a node's place, or
    the way's first. Of objects that repeat an id, any one stays.
    """
    if theme not in THEMES:
        raise ValueError(f"unknown theme {theme}; there are {', '.join(THEMES)}")
    kind, keys = THEMES[theme]
    category = F.coalesce(*(F.col("tags")[F.lit(k)] for k in keys))
    held = objects.where((F.col("kind") == kind) & category.isNotNull()).dropDuplicates(["id"])
    text = F.substring(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags")))), 1, TAG_LETTERS)
    named = held.select(F.col("id").alias("osm_id"), F.col("tags")["name"].alias("name"), category.alias("category"), text.alias("tags"), "x", "y", "refs")
    if kind == "node":
        return named.drop("refs").withColumn("points", F.array(F.struct("x", "y")))
    nodes = objects.where(F.col("kind") == "node").select(F.col("id").alias("ref"), "x", "y").dropDuplicates(["ref"])
    steps = named.select("osm_id", F.posexplode("refs").alias("at", "ref")).join(nodes, "ref")
    lines = steps.groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias("p")).where(F.size("p") > 1)
    lines = lines.select("osm_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))
    return named.drop("x", "y", "refs").join(lines, "osm_id").select("osm_id", "name", "category", "tags", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"), "points")


def scan_theme(rows: DataFrame, theme: str, bbox: tuple | None = None, name_like: str | None = None, tag: str | None = None, limit: int = 200) -> DataFrame:
    """Rows of a theme that meet a box (degrees, checked), whose name contains a text, and with a tag `key=value`; limit 2000 at most.

    A tag of the theme is compared with the category, any other sought in the tags' text.
    """
    if bbox:
        x0, y0, x1, y1 = map(float, bbox)
        if not (-180 <= x0 <= x1 <= 180 and -90 <= y0 <= y1 <= 90):
            raise ValueError(f"not a box in degrees: {bbox}")
        side = lambda k, f: f(F.transform("points", lambda p: p[k]))
        rows = rows.where((side("x", F.array_min) <= x1) & (side("x", F.array_max) >= x0) & (side("y", F.array_min) <= y1) & (side("y", F.array_max) >= y0))
    if name_like:
        rows = rows.where(F.contains(F.lower("name"), F.lit(name_like.lower())))
    if tag:
        key, found, value = tag.partition("=")
        if not found:
            raise ValueError("a tag is key=value")
        exact = F.col("category") == value if key in THEMES[theme][1] else F.lit(False)
        rows = rows.where(exact | F.contains("tags", F.lit(f'"{key}":"{value}"')))
    return rows.orderBy("osm_id").limit(max(1, min(int(limit), 2000)))
