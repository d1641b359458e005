"""A feature service as a Spark data source: pages are partitions, box and limit go to the service.

The transport is a function url -> bytes, so services of one style (OGC API Features, ArcGIS FeatureServer, WFS with
JSON) differ in how a page is asked for and where the features stand in the answer. The option `total` is how many
features to expect, for pages in parallel; whatever it says, the last partition reads on to the end.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

SCHEMA = "id string, x double, y double, properties string"


@dataclass
class Style:
    """Parameter names of a service: limit, offset, bbox, and fixed ones."""

    limit: str
    offset: str
    bbox: str
    fixed: dict[str, str]


STYLES = {
    "ogc": Style("limit", "offset", "bbox", {"f": "json"}),
    "arcgis": Style("resultRecordCount", "resultOffset", "geometry", {"f": "geojson", "where": "1=1", "geometryType": "esriGeometryEnvelope", "inSR": "4326", "outSR": "4326"}),
    "wfs": Style("count", "startIndex", "bbox", {"service": "WFS", "version": "2.0.0", "request": "GetFeature", "outputFormat": "application/json", "srsName": "EPSG:4326"}),
}


def page_url(base: str, style: Style, offset: int, limit: int, bbox: tuple | None) -> str:
    values = style.fixed | {style.limit: str(limit), style.offset: str(offset)}
    if bbox:
        values[style.bbox] = ",".join(f"{v:.12g}" for v in bbox)
    return f"{base}?{urllib.parse.urlencode(values)}"


def features(raw: bytes) -> list[dict]:
    """Features of an answer; one that is no JSON collection is a failure even if its status was 200."""
    try:
        data = json.loads(raw)
        found = data["features"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the service did not answer with features") from e
    crs = (data.get("crs") or {}).get("properties", {}).get("name", "")
    if crs and not crs.endswith((":4326", "CRS84")):
        raise ValueError(f"features in {crs}; WGS 84 was asked for")
    return found


def http(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=30) as r:
        return r.read()


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str], bytes] = http):
        self.base, self.style = options["url"], STYLES[options.get("style", "ogc")]
        self.total, self.page = int(options.get("total", 0)), int(options.get("page", 1000))
        self.box: list[float | None] = [None] * 4
        self.fetch = fetch

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of x and y become the box; Spark keeps testing them, as a service may answer with more."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in ("x", "y") and isinstance(f, GreaterThanOrEqual):
                self.box["xy".index(name)] = float(f.value)
            elif name in ("x", "y") and isinstance(f, LessThanOrEqual):
                self.box[2 + "xy".index(name)] = float(f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        """A page of the expected total each; the last one goes on to the end of what the service has."""
        return [InputPartition((i, i + self.page)) for i in range(0, self.total - self.page, self.page)] + [InputPartition((max(self.total - 1, 0) // self.page * self.page, None))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        box = tuple(self.box) if None not in self.box else None
        at, end = partition.value
        while end is None or at < end:
            n = self.page if end is None else min(self.page, end - at)
            page = features(self.fetch(page_url(self.base, self.style, at, n, box)))
            for f in page[:n]:
                point = (f.get("geometry") or {}).get("coordinates") or [None, None]
                x, y = (point[0], point[1]) if isinstance(point[0], int | float) else (None, None)
                yield (str(f.get("id", "")), x, y, json.dumps(f.get("properties") or {}, sort_keys=True, ensure_ascii=False))
            if not page:  # a service may give less than a page although it has more
                return
            at += len(page[:n])


class FeatureSource(DataSource):
    """spark.read.format("features").option("url", ...).option("style", "ogc | arcgis | wfs")"""

    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(dict(self.options))
