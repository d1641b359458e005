"""Texts in chunks of about a megabyte: the rows of a table that travel, are compressed and are answered together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import CHUNK_BYTES, chunks, materialize, text_array

_CHUNK = "chunk long, n_bytes long, ids array<long>, sizes array<long>, texts binary"


def pack(data: bytes | np.ndarray, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(data: bytes, kind: np.dtype | type = np.uint8) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_ascending(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers in ascending order, as byte planes of their differences."""
    steps = np.diff(values.astype("<u4"), prepend=np.uint32(0))
    return pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T), 1)


def unpack_ascending(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(unpack(data).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def chunk_table(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """chunk, n_bytes, ids, sizes, texts: doc_id and text of docs, written. Texts are zstd frames, end to end; null texts are empty.

    A text longer than `limit` is a chunk of its own. Numbers of chunks follow from the partitions read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in chunks(batches, "text", limit):
            data, offs = text_array(batch.column("text"))
            sizes = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.array(np.diff(offs), pa.int64()))
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column("doc_id")]))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(data)], pa.int64()), ids, sizes, pa.array([pack(data)], pa.binary())], [x.split()[0] for x in _CHUNK.split(", ")])
            number += 1

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _CHUNK), "chunks")


def opened(ids: list[int | None], sizes: list[int], texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the texts end to end, offsets of the rows, whether each row has a doc_id)."""
    return unpack(texts), np.append(0, np.cumsum(np.array(sizes, np.int64))), np.array([i is not None for i in ids], bool)
