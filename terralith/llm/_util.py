"""Helpers that several operators share: the shared folder, Arrow text buffers, vectorised hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..sources.store import materialize, shared_path

__all__ = ["materialize", "shared_path"]

#: Text bytes that one vectorised step works on; temporary arrays take about 60 times this.
CHUNK_BYTES = 1 << 20

_R1 = 0x9E3779B97F4A7C15
_R2 = 0xC2B2AE3D27D4EB4F | 1


def input_bytes(df: DataFrame, column: str) -> int:
    """Catalyst's estimate of a DataFrame's size, or the bytes of its main column where the source has no statistics."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else int(df.agg(F.sum(F.octet_length(column))).head()[0] or 0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, end to end, and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts take about `limit` bytes; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_array(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs with `text` (not null) as zstd frames, for a shuffle of whole texts; `unpacked` gives the texts back."""
    at = docs.columns.index("text")
    kind = StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in chunks(batches, "text", 8 * CHUNK_BYTES):
            texts = pa.array([pack(x) for x in batch.column(at).cast(pa.large_binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, kind)


def unpacked(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches of `packed_texts` with texts of about `limit` bytes, as large binary; one longer text is a slice of its own."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        frames = batch.column(at).to_pylist()
        sizes = [max(zstandard.get_frame_parameters(x).content_size, 1) for x in frames]
        start = 0
        while start < len(frames):
            end, size = start + 1, sizes[start]
            while end < len(frames) and size + sizes[end] <= limit:
                size += sizes[end]
                end += 1
            part = batch.slice(start, end - start)
            yield part.set_column(at, "text", pa.array([unpack.decompress(x) for x in frames[start:end]], pa.large_binary()))
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp prefix sums: the hash of values[i:j] is (out[j] - out[i]) / base ** i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * powers(base, len(values)), out=out[1:])
    return out


def window_hash(values: np.ndarray, width: int, base: int = _R1) -> np.ndarray:
    """Rabin-Karp hash of every window of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = prefix_hash(values, base)
    return mix((p[width:] - p[:n]) * powers(pow(base, -1, 1 << 64), n))


def spans_of(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses the offsets of a row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[cut[:n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cut[1:]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


#: White space of the word patterns `[^\x20\x09-\x0D]+`, as a table over bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def words_in(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words are the runs of `inside`: (each word's place among the distinct ones, those as binary, offsets of the rows in words)."""
    starts, ends = spans_of(inside, offs)
    stops = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=stops[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(stops), pa.py_buffer(data[inside])]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, np.searchsorted(starts, offs)


def digests(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the XXH3-128 of each value."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.to_pylist())), np.uint64)
    return both[0::2].copy(), both[1::2].copy()


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the half-open spans."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def task_count(df: DataFrame, column: str, per_task: int = 32 << 20) -> int:
    """Partitions for a shuffle of this DataFrame: the session's setting, and more where the input asks for it."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(input_bytes(df, column) / per_task))
