"""Substring dedup over words: Rabin-Karp hashes of every fixed-length window, counted in Spark.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a window is `width` consecutive words of one document. A word is
removed if a window over it has a word sequence that also starts in a document with a smaller doc_id, judged on
the input. Overlapping windows merge into maximal intervals.

Every window is hashed. Windows whose anchor stands in one document alone cannot repeat and are counted as such
without travelling (see `repeats`); all others go, by two 64-bit hashes, to a window function that finds the
smallest doc_id of each. The two are polynomials of different bases over different halves of each word's XXH3-128.
Within a chunk of documents a window is sent once, by its first document, and the later documents' windows are
removed there and then; so a window has at most as many rows as chunks, however often a document repeats it.

Null, empty and short texts have no windows; rows that repeat a doc_id do not remove each other's words; rows
without a doc_id are left whole; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import NOT_SPACE, _R1, _R2, covered, digests, packed_texts, read_table, spans_of, text_array, unpacked, window_hash, words_in
from .repeats import runs_of, shared_runs, tagged

WIDTH = 50


def word_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, words, rows_at = words_in(data, offs, NOT_SPACE[data])
    return digests(words)[0][codes], rows_at


_WINDOW = "h1 long, h2 long, doc_id long, tag long, start int, count int, more binary, done boolean"


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """One row per distinct window of a chunk (its first document), and the intervals that this already decides (done)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            data, offs = text_array(batch.column("text"))
            codes, words, rows_at = words_in(data, offs, NOT_SPACE[data])
            one, two = (window_hash(half[codes], width, base) for half, base in zip(digests(words), (_R1, _R2), strict=True))
            at, row = [], []
            for r, parts in enumerate(batch.column("runs").to_pylist()):
                runs = runs_of(parts)
                n = runs["count"].astype(np.int64)
                at.append(np.repeat(runs["start"] - (np.cumsum(n) - n), n) + np.arange(n.sum()) + rows_at[r])
                row.append(np.full(int(n.sum()), r))
            at, row = np.concatenate(at), np.concatenate(row)
            ids, tags = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
            h1, h2, doc = one[at], two[at], ids[row]
            order = np.lexsort((at, doc, h2, h1))
            h1, h2, doc, row, at = h1[order], h2[order], doc[order], row[order], at[order]
            first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            least = doc[first][np.cumsum(first) - 1]
            sent, done = np.flatnonzero(doc == least), doc > least
            start = (at - rows_at[row]).astype(np.int32)
            # a window that its first document repeats is one row, with the other places packed
            tag = tags[row[sent]]
            new = np.flatnonzero(np.append(True, (h1[sent][1:] != h1[sent][:-1]) | (h2[sent][1:] != h2[sent][:-1]) | (tag[1:] != tag[:-1]))) if len(sent) else sent
            times = np.diff(np.append(new, len(sent)))
            more = [None if n == 1 else start[sent[a + 1 : a + n]].astype("<i4").tobytes() for a, n in zip(new.tolist(), times.tolist(), strict=True)]
            own = sent[new]
            yield _rows(h1[own], h2[own], doc[own], tags[row[own]], start[own], np.ones(len(own), np.int32), more, False)
            if done.any():
                row, start = row[done], start[done]
                by = np.lexsort((start, row))
                row, start = row[by], start[by]
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
                count = np.diff(np.append(new, len(row))).astype(np.int32)
                row, start = row[new], start[new]
                yield _rows(ids[row].view(np.uint64), start.astype(np.uint64), ids[row], tags[row], start, count, [None] * len(row), True)

    def _rows(h1, h2, doc, tag, start, count, more, done) -> pa.RecordBatch:
        columns = [*map(pa.array, (h1.view(np.int64), h2.view(np.int64), doc, tag, start, count)), pa.array(more, pa.binary()), pa.array(np.full(len(doc), done))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _WINDOW.split(", ")])

    return docs.select("doc_id", "tag", "text", "runs").mapInArrow(run, _WINDOW)


def repeated_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, tag, starts, counts, more: windows (as runs, and single ones packed) that a document with a smaller doc_id has too. docs from `tagged`."""
    rows = _windows(shared_runs(docs, word_units, width, width // 2, 40), width)
    least = F.min("doc_id").over(Window.partitionBy("done", "h1", "h2"))
    found = rows.withColumn("least", least).where(F.col("done") | (F.col("doc_id") > F.col("least")))
    return found.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"), F.collect_list("more").alias("more"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, intervals (maximal, in words)."""
    own = tagged(docs)
    without = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).transform(packed_texts).select("*", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("counts"), F.lit(None).cast("array<binary>").alias("more"))
    every = packed_texts(own).join(repeated_intervals(own, width), ["doc_id", "tag"], "left").select("doc_id", "text", "starts", "counts", "more").unionAll(without)
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            out = []
            for text, starts, counts, more in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "counts", "more")), strict=True):
                words, spans, removed = text.split(), [], 0
                n = len(words)
                if starts:
                    s, e = np.array(starts, np.int64), np.array(starts, np.int64) + np.array(counts, np.int64)
                    for x in more:
                        others = np.frombuffer(x, "<i4").astype(np.int64)
                        s, e = np.append(s, others), np.append(e, others + 1)
                    gone = covered(s, np.minimum(e + width - 1, n), n)
                    removed = int(gone.sum())
                    spans = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in spans_of(gone, np.array([0, n]))), strict=True)]
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((b" ".join(words).decode(), n, removed, spans))
            kept, n, removed, spans = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pair)], ["doc_id", "text", "n_words", "n_removed", "intervals"])

    return every.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, intervals array<struct<start:long,end:long>>")


def op3(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
