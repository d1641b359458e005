"""Where documents may repeat each other: windows dealt by their smallest inner hash.

A window is `width` consecutive units (words or bytes) of one document. Its anchor is the smallest hash of the
`inner`-unit pieces in it, so equal windows have equal anchors wherever they stand. Consecutive windows with one
anchor are a run; there are about 2 / (width - inner + 2) runs per unit. A window can only stand in two documents
if its anchor does, so runs whose anchor occurs in one document alone are done with. This is exact: nothing that
repeats is lost.

Runs travel by anchor, as packed blocks of one chunk of documents and one bucket of anchors. A chunk sends an
anchor that several of its documents share once; the other documents' runs are known to be shared and are dealt
by document. So an anchor has at most as many entries as there are chunks, whatever part of all rows it fills.

A document goes by (doc_id, tag), tag being Spark's xxhash64 of its text; rows that repeat both are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import chunks, input_bytes, mix, packed_texts, text_array, window_hash

#: Entries of one bucket, about; a bucket is one group of a grouped map.
BUCKET_ENTRIES = 1_000_000

_RUN = np.dtype([("anchor", "<u8"), ("start", "<i4"), ("count", "<i4")])
#: (values to hash, offsets of the rows in them) of one slice of documents.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text, tag of the rows that have a doc_id; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def tag_of(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64))


def runs_in(values: np.ndarray, offs: np.ndarray, width: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor) of the runs, as (rows, runs of _RUN, starts in `values`)."""
    none = np.zeros(0, np.int64)
    n = len(values) - width + 1
    if n <= 0:
        return none, np.zeros(0, _RUN), none
    low, have, need = window_hash(values, inner), 1, width - inner + 1
    while have < need:  # smallest of the next `have` hashes, doubling
        step = min(have, need - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    low = low[:n]
    left = np.zeros(n, bool)  # windows that stay within their row
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a >= width:
            left[a : b - width + 1] = True
    fresh = np.ones(n, bool)
    fresh[1:] = (low[1:] != low[:-1]) | ~left[:-1]
    cut = offs[offs < n]
    fresh[cut] = True
    at = np.flatnonzero(fresh & left)
    if not len(at):
        return none, np.zeros(0, _RUN), none
    stop = np.flatnonzero(np.append(fresh[1:] | ~left[1:], True) & left) + 1
    rows = np.searchsorted(offs, at, side="right") - 1
    runs = np.zeros(len(at), _RUN)
    runs["anchor"], runs["start"], runs["count"] = low[at], at - offs[rows], stop - at
    return rows, runs, at


def _deflate(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _inflate(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


_BLOCK = "bucket long, doc_id long, tag long, many binary, anchors binary, docs binary, tags binary, starts binary, counts binary, runs binary"


def _blocks(docs: DataFrame, units: Units, width: int, inner: int, buckets: int) -> DataFrame:
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offs = text_array(batch.column("text"))
            values, rows_at = units(data, offs)
            row, runs, _ = runs_in(values, rows_at, width, inner)
            if not len(row):
                continue
            ids, tags = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
            order = np.argsort(runs["anchor"], kind="stable")
            row, runs = row[order], runs[order]
            first = np.ones(len(row), bool)
            first[1:] = runs["anchor"][1:] != runs["anchor"][:-1]
            group = np.cumsum(first) - 1
            head = np.flatnonzero(first)
            doc = ids[row]
            several = (np.maximum.reduceat(doc, head) != np.minimum.reduceat(doc, head))[group]
            # an anchor of several documents is sent by the first of its runs alone
            sent = ~several | first
            out = []
            own, local = row[sent], runs[sent]
            bucket = (mix(local["anchor"]) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((local["start"], own, bucket))
            own, local, bucket, many = own[by], local[by], bucket[by], several[sent][by]
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x = local[a:b]
                out.append((int(bucket[a]), None, None, np.packbits(many[a:b]).tobytes(), x["anchor"].tobytes(), _deflate(np.diff(ids[own[a:b]], prepend=0)), _deflate(tags[own[a:b]]), _deflate(np.diff(x["start"], prepend=np.int32(0))), _deflate(x["count"].astype(np.int32)), None))
            rest = np.flatnonzero(~sent)
            rest = rest[np.argsort(row[rest], kind="stable")]
            edges = np.append(np.flatnonzero(np.append(True, row[rest][1:] != row[rest][:-1])), len(rest)) if len(rest) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                r = int(row[rest[a]])
                out.append((int(mix(np.array([ids[r]], np.int64).view(np.uint64))[0] % np.uint64(buckets)), int(ids[r]), int(tags[r]), None, None, None, None, None, None, runs[rest[a:b]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, _BLOCK)


def _shared(table: pa.Table) -> pa.Table:
    """The runs of one bucket whose anchors stand in several documents, a row per document."""
    ready = table.filter(pa.compute.is_valid(table["runs"])).select(["doc_id", "tag", "runs"])
    blocks = table.filter(pa.compute.is_valid(table["anchors"]))
    ids, tags, runs, many = [], [], [], []
    for m, a, d, t, s, c in zip(*(blocks[x].to_pylist() for x in ("many", "anchors", "docs", "tags", "starts", "counts")), strict=True):
        x = np.zeros(len(a) // 8, _RUN)
        x["anchor"], x["start"], x["count"] = np.frombuffer(a, np.uint64), np.cumsum(_inflate(s, np.int32)), _inflate(c, np.int32)
        ids.append(np.cumsum(_inflate(d, np.int64)))
        tags.append(_inflate(t, np.int64))
        runs.append(x)
        many.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)).astype(bool))
    if not ids:
        return ready
    ids, tags, runs, many = (np.concatenate(x) for x in (ids, tags, runs, many))
    order = np.argsort(runs["anchor"], kind="stable")
    anchors = runs["anchor"][order]
    first = np.append(True, anchors[1:] != anchors[:-1])
    head, group = np.flatnonzero(first), np.cumsum(first) - 1
    shared = (np.maximum.reduceat(ids[order], head) != np.minimum.reduceat(ids[order], head)) | np.logical_or.reduceat(many[order], head)
    kept = order[shared[group]]
    kept = kept[np.lexsort((runs["start"][kept], tags[kept], ids[kept]))]
    if not len(kept):
        return ready
    i, t, r = ids[kept], tags[kept], runs[kept]
    edges = np.append(np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]))), len(i))
    found = pa.table({"doc_id": i[edges[:-1]], "tag": t[edges[:-1]], "runs": pa.array([r[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())})
    return pa.concat_tables([ready, found.cast(ready.schema)])


def _found(docs: DataFrame, units: Units, width: int, inner: int, per_entry: int) -> DataFrame:
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs, "text") // (per_entry * BUCKET_ENTRIES))
    return _blocks(docs, units, width, inner, buckets).groupBy("bucket").applyInArrow(_shared, "doc_id long, tag long, runs binary")


def _with_runs(docs: DataFrame, found: DataFrame) -> DataFrame:
    return packed_texts(docs).join(found.groupBy("doc_id", "tag").agg(F.collect_list("runs").alias("runs")), ["doc_id", "tag"])


def shared_runs(docs: DataFrame, units: Units, width: int, inner: int, per_entry: int) -> DataFrame:
    """docs (from `tagged`, texts packed) that have runs with anchors of other documents too, with `runs` (array<binary>).

    per_entry: bytes of stored text to one run, about; sets the number of buckets.
    """
    return _with_runs(docs, _found(docs, units, width, inner, per_entry))


def runs_of(parts: list[bytes]) -> np.ndarray:
    """The runs of one document, by start; rows that repeat give theirs once."""
    x = np.concatenate([np.frombuffer(p, _RUN) for p in parts])
    _, at = np.unique(x["start"], return_index=True)
    return x[at]
