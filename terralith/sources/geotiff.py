"""GeoTIFF rasters as pixel tables, and pixel tables as blocks of GeoTIFF.

Files are rows (path, content), as Spark's binaryFile source gives them from any store (2 GB a file at most). The
directory of each is read where the file is; its tiles or strips then travel by themselves, as they are compressed, and
are decoded in parallel, so a task holds one tile. Read are TIFF and BigTIFF of either byte order, tiles and strips, bands beside or
after each other, integers and floats of 8 to 64 bits, no compression, LZW, Deflate and PackBits, and predictors 2 and 3.
What else a file holds (other compressions, further directories, rotation) raises or is left aside, as stated below.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.warp import Grid

# TIFF 6.0 and GeoTIFF tags and codes.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_SIZES = 256, 257, 258, 259, 273, 277, 278, 279
_PLANAR, _PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_SIZES, _FORMAT = 284, 317, 322, 323, 324, 325, 339
_SCALE, _TIEPOINT, _MATRIX, _GEO_KEYS, _NODATA = 33550, 33922, 34264, 34735, 42113
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


class RasterError(ValueError):
    """A file that is no readable GeoTIFF; says why."""


@dataclass
class Directory:
    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default=None):
        found = self.tags.get(tag)
        if found is None and default is None:
            raise RasterError(f"the file has no tag {tag}")
        return found[0] if found else default

    @property
    def dtype(self) -> np.dtype:
        bits, kind = self.one(_BITS, 1), {1: "u", 2: "i", 3: "f"}.get(self.one(_FORMAT, 1))
        if kind is None or bits not in (8, 16, 32, 64) or len(set(self.tags.get(_BITS, (bits,)))) > 1 or (kind == "f" and bits < 32):
            raise RasterError(f"samples of {self.tags.get(_BITS)} bits and format {self.one(_FORMAT, 1)} are not read")
        return np.dtype(f"{self.order}{kind}{bits // 8}")

    @property
    def nodata(self) -> float | None:
        text = self.tags.get(_NODATA)
        try:
            return float(text[0].split(b"\0")[0]) if text else None
        except ValueError:
            return None

    @property
    def crs(self) -> str | None:
        keys = self.tags.get(_GEO_KEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = codes.get(3072) or codes.get(2048)
        return f"EPSG:{code}" if code and code != 32767 else None

    def corner(self) -> tuple[float, float, float, float] | None:
        """x and y of the upper left corner, and the size of a pixel; none without a place, or with one that is turned."""
        if _SCALE in self.tags and _TIEPOINT in self.tags:
            (i, j, _, x, y, _), (dx, dy, *_) = self.tags[_TIEPOINT][:6], self.tags[_SCALE]
            return x - i * dx, y + j * dy, dx, dy
        m = self.tags.get(_MATRIX)
        return (m[3], m[7], m[0], -m[5]) if m and not m[1] and not m[4] else None


def directory(data: bytes) -> Directory:
    """The first directory of a file."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    magic = struct.unpack_from(f"{order}H", data, 2)[0] if order and len(data) >= 8 else 0
    if magic not in (42, 43):
        raise RasterError("not a TIFF file")
    try:
        big = magic == 43
        at = struct.unpack_from(f"{order}{'Q' if big else 'I'}", data, 8 if big else 4)[0]
        n = struct.unpack_from(f"{order}{'Q' if big else 'H'}", data, at)[0]
        tags = {}
        for i in range(n):
            entry = at + (8 + 20 * i if big else 2 + 12 * i)
            tag, kind = struct.unpack_from(f"{order}HH", data, entry)
            count = struct.unpack_from(f"{order}{'Q' if big else 'I'}", data, entry + 4)[0]
            if kind not in _KINDS:
                continue
            form = f"{order}{count}s" if kind == 2 else f"{order}{count * len(_KINDS[kind])}{_KINDS[kind][0]}"
            here, room = (entry + 12, 8) if big else (entry + 8, 4)
            if struct.calcsize(form) > room:
                here = struct.unpack_from(f"{order}{'Q' if big else 'I'}", data, here)[0]
            tags[tag] = struct.unpack_from(form, data, here)
    except struct.error as e:
        raise RasterError(f"the directory is cut off: {e}") from e
    return Directory(order, tags)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bits, one bit wider a code early."""
    out, table, width, previous, bits, held = bytearray(), [], 9, b"", 0, 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not previous:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out += entry
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


_UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits}


def decode(data: bytes, compression: int, predictor: int, dtype: np.dtype, rows: int, cols: int, samples: int) -> np.ndarray:
    """rows x cols x samples of one tile or strip."""
    if compression not in _UNPACK:
        raise RasterError(f"compression {compression} is not read")
    raw = np.frombuffer(_UNPACK[compression](data), np.uint8)
    need = rows * cols * samples * dtype.itemsize
    if len(raw) < need:
        raise RasterError(f"a tile holds {len(raw)} of {need} bytes")
    raw = raw[:need]
    if predictor == 3:
        planes = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, cols, samples)
    values = raw.view(dtype).reshape(rows, cols, samples)
    if predictor == 2:
        unsigned = np.dtype(f"u{dtype.itemsize}")
        values = np.cumsum(values.astype(dtype.newbyteorder("=")).view(unsigned), axis=1, dtype=unsigned).view(dtype.newbyteorder("="))
    elif predictor != 1:
        raise RasterError(f"predictor {predictor} is not read")
    return values


def geotiff_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the TIFF files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path).select("path", "content")


_INFO = "path string, width long, height long, bands int, dtype string, crs string, x0 double, y0 double, dx double, dy double, nodata double"


def geotiff_info(files: DataFrame) -> DataFrame:
    """A row per file (path, content): size, bands, type of samples, system, upper left corner, pixel size and the value for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d = directory(data.as_buffer().to_pybytes())
                rows.append((path, d.one(_WIDTH), d.one(_HEIGHT), d.one(_SAMPLES, 1), d.dtype.newbyteorder("=").name, d.crs, *(d.corner() or (None,) * 4), d.nodata))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _INFO.split(", ")])

    return files.select("path", "content").mapInArrow(run, _INFO)


_TILE = "path string, row long, col long, rows int, cols int, height int, width int, band int, samples int, compression int, predictor int, dtype string, nodata double, data binary"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to their tiles or strips, still compressed."""
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 8, pa.string(), pa.float64(), pa.binary()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_buffer()
            d = directory(data.to_pybytes())
            width, height, samples = d.one(_WIDTH), d.one(_HEIGHT), d.one(_SAMPLES, 1)
            tiled = _TILES in d.tags
            tw, th = (d.one(_TILE_WIDTH), d.one(_TILE_HEIGHT)) if tiled else (width, min(d.one(_STRIP_ROWS, height), height))
            offsets, sizes = (d.tags.get(_TILES), d.tags.get(_TILE_SIZES)) if tiled else (d.tags.get(_STRIPS), d.tags.get(_STRIP_SIZES))
            if not offsets or not sizes or len(offsets) != len(sizes):
                raise RasterError(f"{path}: places and sizes of tiles do not match")
            across, down, apart = -(-width // tw), -(-height // th), d.one(_PLANAR, 1) == 2
            for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
                band, at = divmod(i, across * down) if apart else (0, i)
                row, col = at // across * th, at % across * tw
                if size == 0:
                    continue  # nothing was ever written there
                high = th if tiled else min(th, height - row)
                one = (path, row, col, high, tw, height - row, width - col, band, 1 if apart else samples, d.one(_COMPRESSION, 1), d.one(_PREDICTOR, 1), d.dtype.str, d.nodata, data.slice(offset, size).to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one, kinds, strict=True)], [x.split()[0] for x in _TILE.split(", ")])


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch.to_pylist():
            values = decode(t["data"], t["compression"], t["predictor"], np.dtype(t["dtype"]), t["rows"], t["cols"], t["samples"])[: t["height"], : t["width"]]
            rows, cols, n = values.shape
            for band in range(n):
                v = values[:, :, band].astype(np.float64).ravel()
                gone = np.isnan(v) if t["nodata"] is None else np.isnan(v) | (v == np.float64(np.dtype(t["dtype"]).type(t["nodata"]) if np.dtype(t["dtype"]).kind == "f" else t["nodata"]))
                at = [np.repeat(np.arange(rows) + t["row"], cols), np.tile(np.arange(cols) + t["col"], rows)]
                yield pa.RecordBatch.from_arrays([pa.array([t["path"]] * len(v)), pa.array([t["band"] + band + 1] * len(v), pa.int32()), *map(pa.array, at), pa.array(v, mask=gone)], ["path", "band", "row", "col", "v"])


def geotiff_pixels(files: DataFrame) -> DataFrame:
    """path, band (from 1), row, col, v of files (path, content); no data and not-a-number are null. A file that cannot be read raises."""
    tiles = files.select("path", "content").mapInArrow(_tiles, _TILE)
    return tiles.repartition("path", "band", "row", "col").mapInArrow(_pixels, "path string, band int, row long, col long, v double")


# the sink


def encode_block(values: np.ndarray, grid: Grid, row: int, col: int, nodata: float = -9999.0) -> bytes:
    """A GeoTIFF of one tile of doubles (nan: nothing), Deflate with predictor 3, at its place in the grid."""
    rows, cols = values.shape
    v = np.where(np.isnan(values), nodata, values).astype(">f8")
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(rows, cols, 8).transpose(0, 2, 1)).reshape(rows, -1)
    data = zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes(), 6)
    code = int(grid.crs.upper().removeprefix("EPSG:"))
    projected = code not in range(4000, 5000)
    keys = (1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, 3072 if projected else 2048, 0, 1, code)
    text = f"{nodata}\0".encode()
    entries = [
        (_WIDTH, 4, (cols,)), (_HEIGHT, 4, (rows,)), (_BITS, 3, (64,)), (_COMPRESSION, 3, (8,)), (262, 3, (1,)), (_SAMPLES, 3, (1,)), (_PREDICTOR, 3, (3,)),
        (_TILE_WIDTH, 4, (cols,)), (_TILE_HEIGHT, 4, (rows,)), (_TILES, 4, (8,)), (_TILE_SIZES, 4, (len(data),)), (_FORMAT, 3, (3,)),
        (_SCALE, 12, (grid.dx, grid.dy, 0.0)), (_TIEPOINT, 12, (0.0, 0.0, 0.0, grid.x0 + col * grid.dx, grid.y0 - row * grid.dy, 0.0)), (_GEO_KEYS, 3, keys), (_NODATA, 2, text),
    ]
    start = 8 + len(data) + len(data) % 2
    extra, body = b"", struct.pack("<H", len(entries))
    for tag, kind, value in entries:
        raw = value if kind == 2 else struct.pack(f"<{len(value)}{_KINDS[kind]}", *value)
        count = len(value)
        if len(raw) > 4:
            place = start + 2 + 12 * len(entries) + 4 + len(extra)
            extra += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", place)
        body += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, start) + data + b"\0" * (len(data) % 2) + body + struct.pack("<I", 0) + extra


def geotiff_blocks(pixels: DataFrame, grid: Grid, size: int = 256) -> DataFrame:
    """path, content: pixels (row, col, v) as GeoTIFF blocks of size x size, named by the block's place; a block without a value is left out."""
    held = pixels.where("v IS NOT NULL").groupBy(F.floor(F.col("row") / size).alias("r"), F.floor(F.col("col") / size).alias("c")).agg(F.collect_list(F.struct((F.col("row") % size).alias("i"), (F.col("col") % size).alias("j"), F.col("v").cast("double").alias("v"))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, c, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = np.full((min(size, grid.rows - r * size), min(size, grid.cols - c * size)), np.nan)
                i, j, v = (held.values.field(k).to_numpy() for k in range(3))
                values[i, j] = v
                yield pa.RecordBatch.from_arrays([pa.array([f"block_{r}_{c}.tif"]), pa.array([encode_block(values, grid, r * size, c * size)], pa.binary())], ["path", "content"])

    return held.mapInArrow(run, "path string, content binary")
