"""Vector files of other formats as layers: shapefiles (also zipped), KML and GeoPackage.

Files are read by Spark as binary rows, one task per file, and parsed where they are. Every layer has file, id, kind,
x and y of points, `ring` (the outer ring of a polygon's first part), the geometry as GeoJSON text and the properties
as JSON text. Coordinates come as the file has them; a shapefile or GeoPackage layer that is not in WGS 84 or says
nothing about its frame is an error, as is a file that ends early.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import RING
from .files import SourceError

_LAYER = f"file string, id string, kind string, x double, y double, ring {RING}, geometry string, properties string"
Feature = tuple[str, dict | None, dict]


def _read(spark: SparkSession, path: str, parse: Callable[[bytes, dict[str, bytes]], Iterator[Feature]], with_others: bool = False) -> DataFrame:
    """path's files, each with the files beside it of the same stem where with_others is set."""
    ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if with_others:
        files = files.groupBy(stem.alias("path")).agg(F.map_from_entries(F.collect_list(F.struct(F.lower(F.element_at(F.split("path", r"\."), -1)).alias("k"), F.col("content")))).alias("parts"))  # the few parts of one file
    else:
        files = files.select("path", F.create_map(F.lit("file"), "content").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                parts = dict(parts)
                for name, geometry, properties in parse(parts.get("file", parts.get("shp", b"")), parts):
                    kind = geometry["type"] if geometry else None
                    places = geometry["coordinates"] if geometry else None
                    outer = {"Polygon": lambda c: c[0], "MultiPolygon": lambda c: c[0][0]}.get(kind, lambda c: None)(places)
                    x, y = (float(places[0]), float(places[1])) if kind == "Point" else (None, None)
                    rows.append((file, name, kind, x, y, [{"x": float(p[0]), "y": float(p[1])} for p in outer] if outer else None, json.dumps(geometry) if geometry else None, json.dumps(properties, ensure_ascii=False, sort_keys=True)))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), ring, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ("file", "id", "kind", "x", "y", "ring", "geometry", "properties")])

    return files.mapInArrow(run, _LAYER)


def _area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _grouped(rings: list[list]) -> dict:
    """Shapefile rings as polygons: clockwise ones are outer, the others holes of the outer ring before them."""
    polygons: list[list] = []
    for r in rings:
        if _area(r) <= 0 or not polygons:
            polygons.append([r])
        else:
            polygons[-1].append(r)
    return {"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {"type": "MultiPolygon", "coordinates": polygons}


def _shape(content: bytes) -> dict | None:
    kind = struct.unpack_from("<i", content)[0] % 10
    if kind == 0:
        return None
    if kind == 1:
        return {"type": "Point", "coordinates": list(struct.unpack_from("<2d", content, 4))}
    if kind == 8:
        n = struct.unpack_from("<i", content, 36)[0]
        return {"type": "MultiPoint", "coordinates": [list(struct.unpack_from("<2d", content, 40 + 16 * i)) for i in range(n)]}
    if kind not in (3, 5):
        raise SourceError(f"shape type {kind}")
    n_parts, n = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", content, 44 + 4 * n_parts)
    parts = [[[flat[2 * i], flat[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
    if kind == 5:
        return _grouped(parts)
    return {"type": "LineString", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiLineString", "coordinates": parts}


def _records(dbf: bytes) -> Iterator[dict]:
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at, offset = [], 32, 1
    while dbf[at] != 0x0D:
        width = dbf[at + 16]
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), chr(dbf[at + 11]), offset, width))
        at, offset = at + 32, offset + width
    for i in range(n):
        row = dbf[head + i * size : head + (i + 1) * size]
        out: dict = {}
        for name, kind, a, width in fields:
            text = row[a : a + width].decode("utf-8", "replace").strip("\0 ")
            if kind in "NF":
                out[name] = (float(text) if "." in text or "e" in text.lower() else int(text)) if text.strip("*") else None
            else:
                out[name] = text or None
        yield out


def _is_wgs84(text: str) -> bool:
    flat = text.upper().replace(" ", "_")
    return "PROJCS" not in flat and ("WGS_1984" in flat or "WGS84" in flat or "4326" in flat)


def _shapefile(_: bytes, parts: dict[str, bytes]) -> Iterator[Feature]:
    shp, prj = parts.get("shp"), parts.get("prj")
    if not shp:
        return
    if prj is None or not _is_wgs84(prj.decode("utf-8", "replace")):
        raise SourceError("a shapefile needs a .prj of WGS 84")
    rows = _records(parts["dbf"]) if "dbf" in parts else iter(())
    at, size = 100, 2 * struct.unpack_from(">i", shp, 24)[0]
    if len(shp) < size:
        raise SourceError("the shapefile ends early")
    while at < size:
        number, words = struct.unpack_from(">2i", shp, at)
        yield str(number), _shape(shp[at + 8 : at + 8 + 2 * words]), next(rows, {})
        at += 8 + 2 * words


def _zipped(content: bytes, _: dict[str, bytes]) -> Iterator[Feature]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        stems: dict[str, dict[str, bytes]] = {}
        for name in sorted(z.namelist()):
            stem, _, kind = name.rpartition(".")
            if kind.lower() in ("shp", "dbf", "prj"):
                stems.setdefault(stem, {})[kind.lower()] = z.read(name)
    for parts in stems.values():
        yield from _shapefile(b"", parts)


def _kml(content: bytes, _: dict[str, bytes]) -> Iterator[Feature]:
    root = ElementTree.fromstring(content)
    tag = lambda e: e.tag.rpartition("}")[2]
    places = lambda e: [[float(v) for v in p.split(",")[:2]] for p in (e.text or "").split()]

    def geometry(e: ElementTree.Element) -> dict | None:
        inner = {tag(x): x for x in e.iter()}
        if tag(e) == "Point":
            return {"type": "Point", "coordinates": places(inner["coordinates"])[0]}
        if tag(e) == "LineString":
            return {"type": "LineString", "coordinates": places(inner["coordinates"])}
        if tag(e) == "Polygon":
            rings = [places(c) for kind in ("outerBoundaryIs", "innerBoundaryIs") for b in e.iter() if tag(b) == kind for c in b.iter() if tag(c) == "coordinates"]
            return {"type": "Polygon", "coordinates": rings}
        return None

    for i, mark in enumerate(e for e in root.iter() if tag(e) == "Placemark"):
        shapes = [g for e in mark.iter() if (g := geometry(e))]
        properties = {tag(e): (e.text or "").strip() for e in mark if tag(e) in ("name", "description")}
        for e in mark.iter():
            if tag(e) == "Data":
                properties[e.get("name")] = next(((v.text or "").strip() for v in e if tag(v) == "value"), "")
            if tag(e) == "SimpleData":
                properties[e.get("name")] = (e.text or "").strip()
        yield mark.get("id") or str(i), shapes[0] if shapes else None, properties


def _wkb(b: bytes, at: int = 0) -> tuple[dict, int]:
    """Geometry at a place of well-known binary, and where it ends; a third coordinate is dropped."""
    order = "<" if b[at] else ">"
    code = struct.unpack_from(order + "I", b, at + 1)[0]
    kind, width = code % 1000, 3 if code // 1000 in (1, 2) else 4 if code // 1000 == 3 else 2
    at += 5

    def line(at: int) -> tuple[list, int]:
        n = struct.unpack_from(order + "I", b, at)[0]
        flat = struct.unpack_from(f"{order}{n * width}d", b, at + 4)
        return [list(flat[i : i + 2]) for i in range(0, len(flat), width)], at + 4 + 8 * n * width

    if kind == 1:
        return {"type": "Point", "coordinates": list(struct.unpack_from(order + "2d", b, at))}, at + 8 * width
    if kind == 2:
        got, at = line(at)
        return {"type": "LineString", "coordinates": got}, at
    n, at, out = struct.unpack_from(order + "I", b, at)[0], at + 4, []
    for _ in range(n):
        got, at = line(at) if kind == 3 else (lambda g: (g[0]["coordinates"], g[1]))(_wkb(b, at))
        out.append(got)
    names = {3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
    if kind not in names:
        raise SourceError(f"geometry type {kind}")
    return {"type": names[kind], "coordinates": out}, at


def _geopackage(content: bytes, _: dict[str, bytes]) -> Iterator[Feature]:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    for table, column, srs in db.execute("SELECT c.table_name, column_name, organization_coordsys_id FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) LEFT JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id ORDER BY 1").fetchall():
        if srs != 4326:
            raise SourceError(f"{table} is not in WGS 84")
        rows = db.execute(f"SELECT rowid, * FROM {quoted(table)} ORDER BY 1")
        names = [d[0] for d in rows.description]
        for row in rows:
            values = dict(zip(names[1:], row[1:], strict=True))
            blob = values.pop(column)
            box = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] if blob else 0
            empty = not blob or bool(blob[3] >> 4 & 1)
            yield str(row[0]), None if empty else _wkb(blob, 8 + box)[0], {k: v for k, v in values.items() if not isinstance(v, bytes)}
    db.close()


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Shapefiles (path covers their .shp, .dbf and .prj)."""
    return _read(spark, path, _shapefile, with_others=True)


def read_zipped_shapefile(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _zipped)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _kml)


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _geopackage)


def ingest_places(spark: SparkSession, path: str, target: str) -> None:
    """CSV files of places (name, category, "lng,lat" as `location`, adcode) in GCJ-02 as Parquet in WGS 84, by the first two digits of the code.

    Header lines within the files and rows without a valid place are dropped; rows that repeat name and place are one.
    """
    from ..functions.geo import gcj_to_wgs

    raw = spark.read.csv(path, header=True)
    at = F.split("location", ",")
    placed = raw.where("location <> 'location'").withColumns({"gx": F.trim(F.get(at, 0)).try_cast("double"), "gy": F.trim(F.get(at, 1)).try_cast("double")})
    x, y = gcj_to_wgs(F.col("gx"), F.col("gy"))
    good = placed.where(F.col("gx").between(-180, 180) & F.col("gy").between(-90, 90)).withColumns({"x": x, "y": y, "adcode": F.lpad("adcode", 6, "0")})
    out = good.drop("location", "gx", "gy").dropDuplicates(["name", "x", "y"]).withColumn("part", F.substring("adcode", 1, 2))
    out.write.mode("overwrite").partitionBy("part").parquet(target)


def sync_catalog(known: DataFrame, described: DataFrame) -> DataFrame:
    """The catalog (id, ..., updated_at) after a refresh: of each id the row that was updated last, new ones added."""
    both = known.unionByName(described, allowMissingColumns=True)
    rest = [c for c in both.columns if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*rest), "updated_at").alias("row")).select("id", "row.*")
