"""Readers of vector formats over files written here, byte by byte."""

import json
import sqlite3
import struct
import zipfile

import pytest

from terralith.sources import vector_formats as V

WGS84 = 'GEOGCS["WGS 84",DATUM["WGS_1984"]]'
SQUARE = [[0.0, 0.0], [0.0, 2.0], [2.0, 2.0], [2.0, 0.0], [0.0, 0.0]]  # clockwise
HOLE = [[0.5, 0.5], [1.0, 0.5], [1.0, 1.0], [0.5, 0.5]]


def shp(shapes):
    body = b"".join(struct.pack(">2i", i + 1, len(s) // 2) + s for i, s in enumerate(shapes))
    return struct.pack(">i5i", 9994, 0, 0, 0, 0, 0) + struct.pack(">i", (100 + len(body)) // 2) + struct.pack("<2i", 1000, 1) + bytes(64) + body


def polygon(*rings):
    points = [p for r in rings for p in r]
    starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
    return struct.pack("<i4d2i", 5, 0, 0, 2, 2, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def dbf(rows):
    fields = b"".join(n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w]) + bytes(15) for n, k, w in (("NAME", "C", 8), ("POP", "N", 6)))
    head = struct.pack("<4BIHH", 3, 24, 1, 1, len(rows), 32 + len(fields) + 1, 15) + bytes(20) + fields + b"\r"
    return head + b"".join(b" " + n.encode().ljust(8) + p.encode().rjust(6) for n, p in rows)


POINT = struct.pack("<i2d", 1, 116.5, 39.75)
SHAPES = shp([POINT, polygon(SQUARE, HOLE), polygon(SQUARE, SQUARE), struct.pack("<i", 0)])
TABLE = dbf([("a", "12"), ("café"[:3], "1.5"), ("", ""), ("d", "7")])


def rows(df):
    return [(r["id"], r["kind"], r["x"], len(r["ring"] or []), json.loads(r["properties"])) for r in df.orderBy("id").collect()]


WANT = [("1", "Point", 116.5, 0, {"NAME": "a", "POP": 12}), ("2", "Polygon", None, 5, {"NAME": "caf", "POP": 1.5}), ("3", "MultiPolygon", None, 5, {"NAME": None, "POP": None}), ("4", None, None, 0, {"NAME": "d", "POP": 7})]


def test_shapefile(spark, tmp_path):
    for kind, data in (("shp", SHAPES), ("dbf", TABLE), ("prj", WGS84.encode())):
        (tmp_path / f"layer.{kind}").write_bytes(data)
    got = V.read_shapefile(spark, f"{tmp_path}/layer.*")
    assert rows(got) == WANT
    assert json.loads(got.where("id = '2'").head()["geometry"])["coordinates"] == [SQUARE, HOLE]
    with zipfile.ZipFile(tmp_path / "layer.zip", "w") as z:
        for kind in ("shp", "dbf", "prj"):
            z.write(tmp_path / f"layer.{kind}", f"inner/layer.{kind}")
    assert rows(V.read_zipped_shapefile(spark, f"{tmp_path}/layer.zip")) == WANT
    (tmp_path / "layer.prj").write_text('PROJCS["UTM"]')
    with pytest.raises(Exception, match="WGS 84"):
        V.read_shapefile(spark, f"{tmp_path}/layer.*").collect()


def test_kml(spark, tmp_path):
    line = "<LineString><coordinates>1,2 3,4,9</coordinates></LineString>"
    area = "<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 2,0 2,2 0,0</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>1,0.5 1.5,0.5 1.5,1 1,0.5</coordinates></LinearRing></innerBoundaryIs></Polygon>"
    marks = ['<Placemark id="p"><name> one </name><Point><coordinates>116.1,39.9,5</coordinates></Point><ExtendedData><Data name="k"><value>v</value></Data></ExtendedData></Placemark>', f"<Placemark>{line}</Placemark>", f"<Placemark>{area}</Placemark>", "<Placemark><name>none</name></Placemark>"]
    (tmp_path / "a.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>' + "".join(marks) + "</Folder></Document></kml>")
    got = {r["id"]: r for r in V.read_kml(spark, f"{tmp_path}/*.kml").collect()}
    assert got["p"]["x"] == 116.1 and got["p"]["y"] == 39.9 and json.loads(got["p"]["properties"]) == {"name": "one", "k": "v"}
    assert json.loads(got["1"]["geometry"]) == {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}
    assert len(json.loads(got["2"]["geometry"])["coordinates"]) == 2 and len(got["2"]["ring"]) == 4
    assert got["3"]["kind"] is None


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.executescript(
        "CREATE TABLE gpkg_contents(table_name TEXT); CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT, srs_id INT); CREATE TABLE gpkg_spatial_ref_sys(srs_id INT, organization_coordsys_id INT);"
        "INSERT INTO gpkg_contents VALUES ('towns'); INSERT INTO gpkg_geometry_columns VALUES ('towns', 'geom', 7); INSERT INTO gpkg_spatial_ref_sys VALUES (7, 4326); CREATE TABLE towns(fid INTEGER PRIMARY KEY, geom BLOB, name TEXT);"
    )
    head = b"GP\0\x01" + struct.pack("<i", 7)
    ring = struct.pack("<I", 5) + b"".join(struct.pack("<2d", *p) for p in SQUARE)
    area = struct.pack("<BII", 1, 3, 1) + ring
    shapes = [head + struct.pack("<BI2d", 1, 1, 3.0, 4.0), head + area, head + struct.pack("<BII", 1, 6, 2) + area + area, None, b"GP\0\x03" + struct.pack("<i4d", 7, 0, 1, 0, 1) + struct.pack(">BI2d", 0, 1, 5.0, 6.0)]
    db.executemany("INSERT INTO towns(geom, name) VALUES (?, ?)", [(g, f"t{i}") for i, g in enumerate(shapes)])
    db.commit()
    db.close()
    got = rows(V.read_geopackage(spark, f"{tmp_path}/a.gpkg"))
    assert [x[:4] for x in got] == [("1", "Point", 3.0, 0), ("2", "Polygon", None, 5), ("3", "MultiPolygon", None, 5), ("4", None, None, 0), ("5", "Point", 5.0, 0)]
    assert got[0][4] == {"fid": 1, "name": "t0"}


def test_ingest_places(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('name,category,location,adcode\nA,food,"116.40,39.90",110101\nA,food,"116.40,39.90",110101\nname,category,location,adcode\nB,food,"x,y",110101\nC,bank,"121.47, 31.23",3101\n')
    V.ingest_places(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    got = {r["name"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.keys() == {"A", "C"} and got["C"]["adcode"] == "003101"
    assert 100 < abs(got["A"]["x"] - 116.40) * 85_000 < 1000


def test_sync_catalog(spark):
    kind = "id long, title string, updated_at long"
    known, new = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], kind), spark.createDataFrame([(2, "c", 6), (3, "d", 6)], kind)
    assert sorted(map(tuple, V.sync_catalog(known, new).select("id", "title").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_field_roles_and_readers(spark, tmp_path):
    from terralith.operators.relational import field_roles
    from terralith.sources import files

    assert field_roles(["店铺名称", "详细地址", "纬度", "经度", "phone"]) == {"name": "店铺名称", "address": "详细地址", "lat": "纬度", "lon": "经度"}
    assert field_roles(["Title", "LOCATION", "lat_wgs", "lng_wgs"]) == {"name": "Title", "address": "LOCATION", "lat": "lat_wgs", "lon": "lng_wgs"}
    (tmp_path / "a.csv").write_text("经度,纬度,note\n116.5,39.9,one\n,39,none\nabc,1,bad\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["x"], r["y"], r["note"]) for r in got] == [(116.5, 39.9, "one")]
