"""Benchmark decontamination with an FM-index per shard of the training documents.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A benchmark item gives every window of
`width` consecutive words, or its whole word sequence if it has fewer; an item without words (null, empty) gives
none. A document word is hit if it lies in any occurrence of a window. Items with equal texts are all reported; the
windows of an item without an item_id count as hits, but it has no name to report.
Documents without words (null, empty) have no hits; repeated doc_ids are judged row by row; extra columns of
either table are not read. An empty benchmark hits nothing, an empty documents table gives an empty result.

A shard is a slice of about a megabyte of documents within a Spark task. Its words become numbers of the
benchmark's vocabulary, by their bytes; a window can only lie in a run of such words, so the shard's sequence consists of these
runs, each ended by a separator. The windows are searched backwards through the ranks of a wavelet matrix over
its Burrows-Wheeler transform, found rows are located by steps to sampled suffixes, and the spans are merged.
No document is shuffled. The windows of a block of items travel in the task closure; a block holds at most
`block_bytes` of item texts, and a larger benchmark takes several passes whose spans are merged per document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._util import chunks, covered, materialize, read_table, spans_of, text_array, words_in
from .suffixes import FMIndex

WIDTH = 13
BLOCK_BYTES = 16 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


@dataclass
class Windows:
    """Distinct windows of a block of items, as vocabulary numbers from 1."""

    vocabulary: dict[bytes, int]
    by_width: list[tuple[np.ndarray, np.ndarray]]  # phrases of one width, and the number of each in `items`
    items: list[list[int]]

    @property
    def shortest(self) -> int:
        return min((p.shape[1] for p, _ in self.by_width), default=0)


def windows_of(items: list[tuple[int, str | None]], width: int) -> Windows:
    phrases: dict[tuple[bytes, ...], set[int]] = {}
    for item, text in items:
        words = _WORD.findall((text or "").encode().lower())
        for i in range(max(len(words) - width, 0) + 1 if words else 0):
            phrases.setdefault(tuple(words[i : i + width]), set()).update(() if item is None else (item,))
    number = {w: i + 1 for i, w in enumerate(sorted({w for p in phrases for w in p}))}
    by_width: dict[int, list[tuple[list[int], int]]] = {}
    for i, p in enumerate(phrases):
        by_width.setdefault(len(p), []).append(([number[w] for w in p], i))
    return Windows(number, [(np.array([p for p, _ in x], np.int64), np.array([i for _, i in x], np.int64)) for _, x in sorted(by_width.items())], [sorted(x) for x in phrases.values()])


def _occurrences(numbers: np.ndarray, word_offs: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first word, width) of every occurrence in one shard."""
    none = np.zeros(0, np.int64)
    starts, ends = spans_of(numbers > 0, word_offs)
    long = ends - starts >= windows.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none, none
    sizes = ends - starts + 1
    stops = np.cumsum(sizes)
    place = np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1])  # the word at each place of the sequence
    symbols = np.where(np.isin(np.arange(stops[-1]), stops - 1), 0, numbers[np.minimum(place, len(numbers) - 1)])
    index = FMIndex(symbols)
    found, at, wide = [], [], []
    for phrases, which in windows.by_width:
        low, high = index.search(phrases)
        n = high - low
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append(np.repeat(which, n))
        at.append(place[index.locate(rows)])
        wide.append(np.full(len(rows), phrases.shape[1]))
    return np.concatenate(found), np.concatenate(at), np.concatenate(wide)


def _scan(docs: DataFrame, windows: Windows) -> DataFrame:
    """docs with n_words, spans and items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offs = text_array(batch.column("text"))
            data = _LOWER[data]
            codes, words, word_offs = words_in(data, offs, _IS_WORD[data])
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            items: list[set[int]] = [set() for _ in range(batch.num_rows)]
            if windows.shortest and len(codes):
                numbers = np.fromiter((windows.vocabulary.get(w, 0) for w in words.to_pylist()), np.int64, len(words))[codes]
                found, at, wide = _occurrences(numbers, word_offs, windows)
                if len(at):
                    for a, b in zip(*(x.tolist() for x in spans_of(covered(at, at + wide, len(codes)), word_offs)), strict=True):
                        d = int(np.searchsorted(word_offs, a, side="right")) - 1
                        spans[d].append({"start": a - int(word_offs[d]), "end": b - int(word_offs[d])})
                    pairs = np.unique(np.stack([np.searchsorted(word_offs, at, side="right") - 1, found]), axis=1)
                    for d, w in pairs.T.tolist():
                        items[d].update(windows.items[w])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.diff(word_offs)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))],
                [*docs_columns, "n_words", "spans", "items"],
            )

    docs_columns = docs.columns
    kind = StructType([*docs.schema.fields, *StructType.fromDDL("n_words long, spans array<struct<start:long,end:long>>, items array<long>").fields])
    return docs.mapInArrow(run, kind)


def _merge_spans(spans):
    """Union of spans from several passes, in SQL functions."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (merged, in words), items (ascending), n_hit and `contaminated`, a row per document."""
    added = ["n_words", "spans", "items", "n_hit", "contaminated"]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in added])
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, math.ceil(2 * total / block_bytes))

    def scan(rows: DataFrame, b: int) -> DataFrame:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return _scan(rows, windows_of([tuple(r) for r in part.collect()], width))

    if blocks == 1:
        found = scan(docs, 0)
    else:  # each row goes by a number of its own meanwhile, as doc_ids may repeat
        row = "_row"
        numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        every = scan(numbered.select(row, "text"), 0).drop("text")
        for b in range(1, blocks):
            every = every.unionAll(scan(numbered.select(row, "text"), b).drop("text"))
        merged = every.groupBy(row).agg(F.max("n_words").alias("n_words"), _merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = numbered.join(merged, row).drop(row)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op2(spark, sf_dir: str) -> DataFrame:
    got = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


