"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

Files hold little-endian ids and nothing else. Each is cut into blocks of `block` ids; a task reads one block at a
time and searches it for the separator with vectorised comparisons. A block reports how many separators it has,
the ids before its first and after its last one, and the document sizes between them. A prefix scan over the
blocks of a file (a window over one small row per block) tells each block how many documents ended before it and
how many ids the open document has so far; so documents across any number of blocks come out whole.

`tokenize_to_files` writes such files from documents: one file per task, named by a number of its own, so a task
that runs twice leaves an orphan that no manifest names. Null and empty texts are a separator alone; repeated rows
are documents of their own; extra columns are not read; an empty table gives no files and an empty result. Ids
behind the last separator of a file are an unfinished document and not counted. The separator's string within a
text is ordinary text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import materialize, read_table, shared_path
from .tokens import default_tokenizer, token_batches

END = 49407
BLOCK = 1 << 20
FILE_DOCS = 1 << 16


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI that all executors share."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def _one_list(parts: list[pa.Array]) -> pa.Array:
    values = pa.concat_arrays(parts)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


_ORDER = "file string, n_ids long, docs array<long>"


def tokenize_to_files(docs: DataFrame, folder: str, tokenizer: str, end: int = END, dtype: str = "<u2") -> DataFrame:
    """Writes the files; returns the manifest: file, n_ids and the doc_ids in their order, which no scan reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name, out, n, order = "", None, 0, []
        for batch, ids, _ in token_batches(batches, tokenizer, end, literal=True):
            if out is None:
                name = f"{uuid.uuid4().hex}.tokens"
                out = store.open_output_stream(f"{path}/{name}")
            if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                raise ValueError(f"id {int(ids.max())} does not fit {dtype}")
            out.write(ids.astype(dtype).tobytes())
            n += len(ids)
            order.append(batch.column("doc_id"))
            if sum(map(len, order)) >= FILE_DOCS:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), _one_list(order)], ["file", "n_ids", "docs"])
                out, n, order = None, 0, []
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), _one_list(order)], ["file", "n_ids", "docs"])

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ORDER), "manifest")


_SCAN = "file string, block long, n_ends long, head long, tail long, sizes array<long>"


def scan_blocks(spark: SparkSession, files: DataFrame, folder: str, end: int = END, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """A row per block of `files` (file, n_ids): separators, ids up to the first and behind the last one, sizes between."""
    width = np.dtype(dtype).itemsize
    blocks = files.where("n_ids > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block))).alias("block"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as f:
                    ids = np.frombuffer(f.read_at(block * width, k * block * width), dtype)
                at = np.flatnonzero(ids == end)
                head, tail = (int(at[0]) + 1, len(ids) - int(at[-1]) - 1) if len(at) else (len(ids), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (k, len(at), head, tail)), pa.array([np.diff(at)], pa.list_(pa.int64()))], ["file", "block", "n_ends", "head", "tail", "sizes"])

    return blocks.repartition(parts, "file", "block").mapInArrow(run, _SCAN)


def token_counts(scanned: DataFrame) -> DataFrame:
    """file, ordinal (from 0), n_tokens (the separator included) of every document that ends in a scanned file."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # blocks between two that have a separator share the number of the first
    stitched = (
        scanned.withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .withColumn("seen", F.coalesce(F.sum(F.when(F.col("n_ends") > 0, 1).otherwise(0)).over(before), F.lit(0)))
        .withColumn("open", F.coalesce(F.sum("tail").over(Window.partitionBy("file", "seen").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # the tail of the block whose separator came last belongs to the number before
        .withColumn("carried", F.coalesce(F.last(F.when(F.col("n_ends") > 0, F.col("tail")), ignorenulls=True).over(before), F.lit(0)))
    )
    sizes = F.concat(F.array(F.col("open") + F.col("carried") + F.col("head")), F.col("sizes"))
    return stitched.where("n_ends > 0").select("file", "ends_before", F.posexplode(sizes).alias("k", "n_tokens")).select("file", (F.col("ends_before") + F.col("k")).alias("ordinal"), "n_tokens")


def op6(spark, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    manifest = tokenize_to_files(read_table(spark, sf_dir, "documents"), folder, default_tokenizer())
    counts = token_counts(scan_blocks(spark, manifest.select("file", "n_ids"), folder))
    order = manifest.select("file", F.posexplode("docs").alias("at", "doc_id")).select("file", F.col("at").cast("long").alias("ordinal"), "doc_id")
    return order.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
