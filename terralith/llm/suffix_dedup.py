"""Suffix-array dedup over bytes with a run-length compressed Burrows-Wheeler index.

Texts are UTF-8 bytes; matches never cross documents. A byte is removed if a string of `width` bytes over it also
starts in a document with a smaller doc_id, judged on the input. Overlapping strings merge into maximal spans.

1. Texts are written in chunks (`chunked`). The anchor of a string is the smallest hash of the `inner`-byte pieces
   in it, so equal strings have equal anchors; consecutive strings with one anchor are a run. Each chunk sends the
   distinct anchors of its runs, 32 bits each, to buckets, with the page of its first occurrence.
2. A bucket answers each chunk, for every anchor that several documents have, with the anchor's page: its first
   occurrence in the order of chunks. Anchors of one document alone are done with; nothing that repeats is lost.
3. Consecutive runs with one page travel as one stretch of text, so a repeated passage travels once and not by its
   anchors. Stretches are dealt by page; equal strings have equal anchors and so meet on a page. Equal stretches of
   one chunk travel once, by the smallest doc_id (the others are marked there and then).
4. A shard indexes, for every page, the stretches of its smallest doc_id only (`run_index`: the transform's runs,
   suffix positions at the runs' ends, thresholds, and the smallest doc_id by runs of rows). All stretches stream
   through the index, which gives their matching statistics. A match of `width` bytes or more says that the string
   starts in the page's smallest document. What does not match, but has a hash that repeats in the shard, is indexed
   and streamed by itself.
5. An anchor of over `HOT_RUNS` runs is salted by chunk in step 4, so that no shard has an unbounded group. There,
   runs with strings that are not marked go on to a second round of shards, by longer anchors of their own.

The marks come from the index, but for equal stretches within one chunk. Null and empty texts have no bytes; rows
that repeat a doc_id do not remove each other's bytes; rows without a doc_id are left whole and remove nothing;
extra columns are not read; an empty table gives an empty result. Removal may cut a multi-byte character, so the
kept text is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import covered, materialize, mix, read_table, spans_of, window_hash
from .chunked import chunk_table, opened, pack, pack_ascending, unpack, unpack_ascending
from .repeats import runs_in
from .run_index import NONE, RunIndex

WIDTH = 50
INNER = 24
#: Text bytes to an anchor entry, about, and entries of a bucket.
PER_ENTRY = 14
BUCKET_ENTRIES = 1_000_000
#: Bytes of a chunk to a page, and text of the corpus to a shard.
PAGE = 4096
SHARD_BYTES = 4 << 20
#: Runs of one anchor that meet in one shard.
HOT_RUNS = 2048
#: Strings of a piece that streams through an index.
STREAM = 512

_HOME_BITS = 27


def _hashed(x: np.ndarray) -> np.ndarray:
    return mix(np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class _Anchors:
    """The runs of one chunk and its distinct anchors by bucket, found anew alike in each step."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, known: np.ndarray, width: int, inner: int, buckets: int):
        row, runs, at = runs_in(data.astype(np.uint64) + np.uint64(1), offs, width, inner)
        keep = known[row]
        self.row, self.count, self.at = row[keep], runs["count"][keep].astype(np.int64), at[keep]
        anchors = mix(runs["anchor"][keep])
        bucket = (anchors >> np.uint64(32)) % np.uint64(buckets)
        key = (bucket << np.uint64(32)) | (anchors & np.uint64(0xFFFFFFFF))
        self.keys, self.first, self.of = np.unique(key, return_index=True, return_inverse=True)
        self.bucket = (self.keys >> np.uint64(32)).astype(np.int64)
        self.edges = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(self.keys) else np.zeros(0, np.int64)


_ENTRY = "bucket long, chunk long, n int, anchors binary, notes binary"


def _entries(chunks: DataFrame, width: int, inner: int, buckets: int) -> DataFrame:
    names = [x.split()[0] for x in _ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, ids, sizes, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _Anchors(*opened(ids, sizes, texts), width, inner, buckets)
                if not len(found.keys):
                    continue
                # of each anchor: whether several documents of the chunk have it, its runs (up to 255), its page
                doc = np.array([0 if i is None else i for i in ids], np.int64)[found.row]
                by = np.argsort(found.of, kind="stable")
                head = np.searchsorted(found.of[by], np.arange(len(found.keys)))
                several = np.maximum.reduceat(doc[by], head) != np.minimum.reduceat(doc[by], head)
                runs = np.minimum(np.bincount(found.of), 255).astype(np.uint8)
                page = np.minimum(found.at[found.first] // PAGE, 0xFFFF).astype("<u2")
                out = []
                for a, b in zip(found.edges.tolist(), np.append(found.edges[1:], len(found.keys)).tolist(), strict=True):
                    notes = pack(np.packbits(several[a:b]).tobytes() + runs[a:b].tobytes() + page[a:b].tobytes(), 1)
                    out.append((int(found.bucket[a]), chunk, b - a, pack_ascending((found.keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), notes))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    return chunks.mapInArrow(run, _ENTRY)


def _answers(hot_runs: int):
    """For one bucket: each chunk's codes, one per anchor in order; 0: one document alone has it; else salt bits and home."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"].to_numpy()
        sizes = table["n"].to_numpy().astype(np.int64)
        anchors = np.concatenate([unpack_ascending(x) for x in table["anchors"].to_pylist()])
        several, runs, page = [], [], []
        for notes, n in zip(table["notes"].to_pylist(), sizes.tolist(), strict=True):
            x, bits = unpack(notes), -(-n // 8)
            several.append(np.unpackbits(x[:bits], count=n).astype(bool))
            runs.append(x[bits : bits + n])
            page.append(x[bits + n :].view("<u2"))
        several, runs, page = (np.concatenate(x) for x in (several, runs, page))
        of = np.repeat(np.arange(len(chunk)), sizes)
        order = np.lexsort((chunk[of], anchors))
        head = np.flatnonzero(np.append(True, anchors[order][1:] != anchors[order][:-1]))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        shared = np.logical_or.reduceat(several[order], head) | (np.diff(np.append(head, len(order))) > 1)
        total = np.add.reduceat(runs[order].astype(np.int64), head)
        salts = np.ceil(np.log2(np.maximum(total / hot_runs, 1))).astype(np.uint32)
        leader = order[head]
        home = (_hashed(_hashed(chunk[of[leader]]) ^ page[leader].astype(np.uint64)) & np.uint64((1 << _HOME_BITS) - 1)).astype(np.uint32)
        code = np.where(shared, np.maximum((np.minimum(salts, 31) << np.uint32(_HOME_BITS)) | home, 1), 0).astype("<u4")
        codes = np.empty(len(anchors), "<u4")
        codes[order] = code[group]
        stops = np.cumsum(sizes)
        out = [(c, b, pack(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T), 1)) for c, b, x in zip(chunk.tolist(), table["bucket"].to_pylist(), np.split(codes, stops[:-1]), strict=True) if x.any()]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["chunk", "bucket", "codes"])

    return run


#: A stretch of text, or without `piece` its marks: triples (row, first string, strings) of the chunk, packed.
_STRETCH = "shard long, home long, hot boolean, chunk long, doc_id long, row int, start int, piece binary, marks binary"
_STRETCHES = pa.schema([("shard", pa.int64()), ("home", pa.int64()), ("hot", pa.bool_()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int32()), ("start", pa.int32()), ("piece", pa.binary()), ("marks", pa.binary())])


def _marks(row: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    return pack(np.stack([row, start, count]).astype("<u4").tobytes(), 1)


def _stretches(answered: DataFrame, width: int, inner: int, buckets: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, sizes, texts, answers in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "sizes", "texts", "answers")), strict=True):
                data, offs, known = opened(ids, sizes, texts)
                found = _Anchors(data, offs, known, width, inner, buckets)
                code = np.zeros(len(found.keys), np.uint32)
                first_of = dict(zip(found.bucket[found.edges].tolist(), found.edges.tolist(), strict=True))
                for x in answers:
                    codes = np.ascontiguousarray(unpack(x["codes"]).reshape(4, -1).T).view("<u4").ravel()
                    a = first_of[x["bucket"]]
                    code[a : a + len(codes)] = codes
                code = code[found.of]
                order = np.argsort(found.at)
                row, at, count, code = found.row[order], found.at[order], found.count[order], code[order]
                new = np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + count[:-1]))
                head = np.flatnonzero(new & (code > 0))
                number = np.cumsum(new) - 1
                total = np.bincount(number, count).astype(np.int64)[number[head]]
                row, at, code = row[head], at[head], code[head]
                salt, home = (code >> np.uint32(_HOME_BITS)).astype(np.int64), (code & np.uint32((1 << _HOME_BITS) - 1)).astype(np.int64)
                sub = np.where(salt > 0, int(_hashed(np.array([chunk]))[0] >> np.uint64(1)) & ((1 << np.minimum(salt, 31)) - 1), 0)
                shard = (_hashed(home * 65536 + sub) % np.uint64(shards)).astype(np.int64)
                raw, seen, out = data.tobytes(), {}, []
                again: list[tuple[int, int, int]] = []
                docs = np.array([0 if i is None else i for i in ids], np.int64)[row]
                for k in np.argsort(docs, kind="stable").tolist():
                    piece = raw[at[k] : at[k] + total[k] + width - 1]
                    r, start = int(row[k]), int(at[k] - offs[row[k]])
                    if seen.setdefault((int(code[k]), piece), int(docs[k])) < int(docs[k]):
                        again.append((r, start, int(total[k])))
                    else:
                        out.append((int(shard[k]), int(home[k]) * 65536 + int(sub[k]), bool(salt[k]), chunk, int(docs[k]), r, start, piece, None))
                if again:
                    out.append((chunk % shards, None, None, chunk, None, None, None, None, _marks(*np.array(again, np.int64).T)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _STRETCHES.types, strict=True)], schema=_STRETCHES)

    return answered.mapInArrow(run, _STRETCH)


def _matches(index: RunIndex, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of each string of the texts, end to end, `NONE` where no owner has one, and the texts' offsets."""
    parts, at = [], []
    sizes = np.fromiter((len(t) - width + 1 for t in texts), np.int64, len(texts))
    offs = np.append(0, np.cumsum(sizes))
    for text, base in zip(texts, offs.tolist(), strict=False):
        for a in range(0, len(text) - width + 1, STREAM):
            part = text[a : a + STREAM + width - 1]
            parts.append(part)
            at.append(base + a + len(part))
    out, ends = np.full(int(offs[-1]), NONE), np.array(at, np.int64)
    for back, long, least in index.stream(parts):
        out[ends[long] - back] = least
    return out, offs


def _again(wanted: np.ndarray, offs: np.ndarray, texts: list[bytes], width: int) -> np.ndarray:
    """Of the wanted strings, those whose hash another wanted string has too."""
    at = np.flatnonzero(wanted)
    hashes = window_hash(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1), width)
    text = np.repeat(np.arange(len(texts)), np.diff(offs))[at]
    hashes = hashes[at + text * (width - 1)]
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    out = np.zeros_like(wanted)
    out[at[twice]] = True
    return out


def _decide(width: int, shards: int, again: int):
    """One shard's marks, by chunk, and the runs of hot anchors, by anchors of `again` bytes, that go on to another shard."""

    def run(table: pa.Table) -> pa.Table:
        done = table.filter(table["piece"].is_null())
        table = table.filter(table["piece"].is_valid())
        home, hot, chunk, doc, row, start = (table[c].to_numpy(zero_copy_only=False) for c in ("home", "hot", "chunk", "doc_id", "row", "start"))
        kinds = table["piece"].combine_chunks().dictionary_encode()
        texts, of = kinds.dictionary.to_pylist(), kinds.indices.to_numpy()
        if not texts:
            return done
        # the smallest document of each page, and of each text
        _, page = np.unique(home, return_inverse=True)
        smallest = np.full(int(page.max()) + 1, NONE)
        np.minimum.at(smallest, page, doc)
        owner = np.full(len(texts), NONE)
        np.minimum.at(owner, of, doc)
        chosen = np.unique(of[doc == smallest[page]])
        least, offs = _matches(RunIndex([texts[k] for k in chosen.tolist()], owner[chosen], width), texts, width)
        # what the pages' smallest documents don't have, as far as its hashes repeat
        a, b = spans_of(_again(least == NONE, offs, texts, width), offs)
        if len(a):
            whose = np.searchsorted(offs, a, side="right") - 1
            rest = [texts[k][i:j] for k, i, j in zip(whose.tolist(), (a - offs[whose]).tolist(), (b - offs[whose] + width - 1).tolist(), strict=True)]
            found, inner = _matches(RunIndex(rest, owner[whose], width), rest, width)
            least[np.repeat(a - inner[:-1], np.diff(inner)) + np.arange(len(found))] = found
        # a string that no other text has is its text's own
        alone = np.flatnonzero(least == NONE)
        least[alone] = owner[np.searchsorted(offs, alone, side="right") - 1]
        # back to the rows that have the texts
        sizes = np.diff(offs)[of]
        stops = np.append(0, np.cumsum(sizes))
        mine = least[np.repeat(offs[of] - stops[:-1], sizes) + np.arange(stops[-1])]
        later = mine < np.repeat(doc, sizes)
        a, b = spans_of(later, stops)
        whose = np.searchsorted(stops, a, side="right") - 1
        order = np.argsort(chunk[whose], kind="stable")
        a, b, whose = a[order], b[order], whose[order]
        first, out = start[whose] + a - stops[whose], []
        edges = np.flatnonzero(np.append(True, chunk[whose][1:] != chunk[whose][:-1])) if len(whose) else whose
        for i, j in zip(edges.tolist(), np.append(edges[1:], len(whose)).tolist(), strict=False):
            out.append((None, None, None, int(chunk[whose[i]]), None, None, None, None, _marks(row[whose[i:j]], first[i:j], (b - a)[i:j])))
        for k in np.flatnonzero(hot & (doc == owner[of])).tolist():
            piece, open_ = texts[of[k]], np.append(0, np.cumsum(~later[stops[k] : stops[k + 1]]))
            _, runs, _ = runs_in(np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1), np.array([0, len(piece)]), width, again)
            for h, i, n in zip(_hashed(runs["anchor"]).tolist(), runs["start"].tolist(), runs["count"].tolist(), strict=True):
                if open_[i + n] > open_[i]:
                    out.append((h % shards, h >> 1, False, int(chunk[k]), int(doc[k]), int(row[k]), int(start[k]) + i, piece[i : i + n + width - 1], None))
        made = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(_STRETCHES), _STRETCHES.types, strict=True)], schema=_STRETCHES)
        return pa.concat_tables([done.cast(_STRETCHES), made])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, inner: int = INNER, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, spans (maximal, in bytes), a row per document."""
    chunks = chunk_table(docs)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = chunks.agg(F.sum("n_bytes")).head()[0] or 0
    buckets = max(least, n_bytes // (PER_ENTRY * BUCKET_ENTRIES))
    shards = max(2 * least, n_bytes // SHARD_BYTES)
    answers = _entries(chunks, width, inner, buckets).groupBy("bucket").applyInArrow(_answers(hot_runs), "chunk long, bucket long, codes binary")
    answered = chunks.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes")).alias("answers")), "chunk")
    decide = _decide(width, shards, inner + 2 * (width - inner) // 3)
    decided = _stretches(answered, width, inner, buckets, shards).groupBy("shard").applyInArrow(decide, _STRETCH)
    first = materialize(decided, "marks")
    second = first.where("piece is not null").groupBy("shard").applyInArrow(decide, _STRETCH)
    marks = first.where("marks is not null").select("chunk", "marks").unionAll(second.select("chunk", "marks").where("marks is not null"))
    every = chunks.join(marks.groupBy("chunk").agg(F.collect_list("marks").alias("marks")), "chunk", "left").select("ids", "sizes", "texts", "marks")
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, texts, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, offs, _ = opened(ids, sizes, texts)
                row, start, count = np.concatenate([unpack(x, "<u4").reshape(3, -1) for x in marks], axis=1).astype(np.int64) if marks else np.zeros((3, 0), np.int64)
                gone = covered(offs[row] + start, offs[row] + start + count + width - 1, len(data))
                a, b = spans_of(gone, offs)
                of = np.searchsorted(offs, a, side="right") - 1
                spans: list[list[dict]] = [[] for _ in ids]
                for r, i, j in zip(of.tolist(), (a - offs[of]).tolist(), (b - offs[of]).tolist(), strict=True):
                    spans[r].append({"start": i, "end": j})
                removed = np.append(0, np.cumsum(gone))[offs]
                kept_offs = offs - removed
                kept = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(kept_offs), pa.py_buffer(data[~gone])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), kept, pa.array(sizes, pa.int64()), pa.array(np.diff(removed)), pa.array(spans, pair)], ["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    return every.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>")


def op8(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
