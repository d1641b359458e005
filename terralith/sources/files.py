"""Vector files as layers: GeoJSON, CSV with coordinates, Parquet with places; and GeoJSON as a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names that hold coordinates. The usual spellings, lower case.
X_NAMES = ("lon", "lng", "long", "longitude", "x", "经度")
Y_NAMES = ("lat", "latitude", "y", "纬度")

_FEATURE = "type string, id string, geometry struct<type:string,coordinates:string>, properties string"


class SourceError(ValueError):
    pass


def coordinate_columns(columns: list[str]) -> tuple[str, str]:
    low = {c.strip().lower(): c for c in reversed(columns)}
    x, y = (next((low[n] for n in names if n in low), None) for names in (X_NAMES, Y_NAMES))
    if x is None or y is None:
        raise SourceError(f"no coordinate columns among {columns}")
    return x, y


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header as points (x, y and the text columns); rows without valid coordinates are dropped."""
    df = spark.read.csv(path, header=True)
    xc, yc = coordinate_columns(df.columns)
    out = df.withColumns({"x": F.col(f"`{xc}`").try_cast("double"), "y": F.col(f"`{yc}`").try_cast("double")})
    return out.where(F.col("x").between(-180, 180) & F.col("y").between(-90, 90))


def _ring(json: Column) -> Column:
    return F.transform(F.from_json(json, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features, one per line or in collections: id, geometry type, x and y of points, ring of polygons (the outer one), properties as JSON."""
    raw = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"struct<features:array<struct<{_colons(_FEATURE)}>>>", {"allowUnquotedFieldNames": "false"})
    one = F.from_json("line", f"struct<{_colons(_FEATURE)}>")
    collections = raw.select(F.explode(whole["features"]).alias("f"))
    lines = raw.where(~F.col("value").rlike(r'"FeatureCollection"')).select(F.explode(F.split("value", "\n")).alias("line")).where(F.trim("line") != "").select(one.alias("f"))
    f = collections.unionAll(lines).where("f.geometry is not null")
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.when(kind == "Point", F.from_json(text, "array<double>"))
    return f.select(F.col("f.id").alias("id"), kind.alias("kind"), point[0].alias("x"), point[1].alias("y"), F.when(kind == "Polygon", _ring(F.get_json_object(text, "$[0]"))).alias("ring"), F.col("f.properties").alias("properties"))


def _colons(ddl: str) -> str:
    return ", ".join(f"{a}:{b}" for a, b in (x.split(" ", 1) for x in ddl.split(", ")))


def feature_json(df: DataFrame, fid: str = "fid") -> DataFrame:
    """One GeoJSON feature per row as text: a Point of x, y, or a Polygon of ring."""
    rest = [c for c in df.columns if c not in ("x", "y", "ring", fid)]
    if "ring" in df.columns:
        geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    else:
        geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    properties = F.struct(*rest) if rest else F.create_map()
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(fid).cast("string").alias("id"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def write_geojson(df: DataFrame, path: str, fid: str = "fid") -> None:
    """Features as lines, in as many files as df has partitions."""
    feature_json(df, fid).write.mode("overwrite").text(path)


def read_places(spark: SparkSession, path: str, bbox=None, columns: list[str] | None = None) -> DataFrame:
    """Parquet with x and y: box and columns reach the scan."""
    df = spark.read.parquet(path)
    if bbox:
        df = df.where(F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3]))
    return df.select(*columns) if columns else df


def read_jdbc_layer(spark: SparkSession, url: str, table: str, bbox=None, x: str = "x", y: str = "y", **options: str) -> DataFrame:
    """A database layer; Catalyst sends box, projection and limit to it."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.where(F.col(x).between(bbox[0], bbox[2]) & F.col(y).between(bbox[1], bbox[3])) if bbox else df
