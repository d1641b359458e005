"""Ranked lexical search, score at a time over impact-ordered postings.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` in the whole text, A-Z lower-cased. N
documents have a term, L is the number of all their terms, df documents hold a term, a document has n terms and
tf of one. A term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))), a document m = 25 + (75 n N) div L, and the
impact of a posting is w * ((10^9 tf) div (1000 tf + 8 m)), all in exact 64-bit integers. A document's score for an
item is the sum of the impacts of the item's terms, repeats included.

Null and empty texts have no terms: such documents count for nothing, such items find nothing. Every item row gets its
own ranking, repeated item_ids and a null item_id too. Repeated doc_ids are documents of their own; a document
without a doc_id counts and comes last among equal scores. Extra columns of either table are not read. An empty table
on either side gives an empty result.

Documents become shards of about `SHARD_BYTES` of text within Spark tasks, written as an index of the items'
terms; the statistics are sums over the shards' own. In a shard, each term's postings lie in descending order of
impact. An item takes them level by level, every group of equal impact whole, from the highest down, over all its
terms at once; a document not yet complete can gain no more than what the next group of each term brings. The item stops
only when at most k documents can still reach the k-th score, its own or that of the shards read before it by this task,
and the scores of those are completed from the documents' own postings. A task hands on k documents an item; they are
merged by salted windows, so no group grows beyond the square root of the number of tasks. The terms of a block of items
travel in the task closure; a block holds at most `block_bytes` of item texts, and more items take several passes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import chunks, materialize, read_table, text_array, words_in
from .chunked import pack, unpack

K = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xFF]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_TERM = np.zeros(256, bool)
_IS_TERM[48:58] = _IS_TERM[97:123] = _IS_TERM[128:] = True

_INDEX = "n_docs long, n_terms long, ids array<long>, sizes binary, docs binary, terms binary, tfs binary, held array<int>, dfs array<int>"


@dataclass
class Queries:
    """A block of items: a query per distinct bag of terms, and the item rows that ask it."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    rows: list[list[tuple[int, int | None]]]


def queries_of(items: list[tuple[int | None, str | None]]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    bags: dict[tuple, list] = {}
    for row, (item, text) in enumerate(items):
        bag = Counter(vocabulary.setdefault(w, len(vocabulary)) for w in _TERM.findall((text or "").encode().lower()))
        if bag:
            bags.setdefault(tuple(sorted(bag.items())), []).append((row, item))
    pairs = [np.array(b, np.int64) for b in bags]
    return Queries(vocabulary, [p[:, 0] for p in pairs], [p[:, 1] for p in pairs], list(bags.values()))


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per shard: its documents' ids and sizes, the postings of the vocabulary by document, and how many documents hold a term."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            data, offs = text_array(batch.column("text"))
            data = _LOWER[data]
            codes, words, word_offs = words_in(data, offs, _IS_TERM[data])
            sizes = np.diff(word_offs)
            number = np.fromiter((vocabulary.get(w, -1) for w in words.to_pylist()), np.int64, len(words))[codes] if len(codes) else np.zeros(0, np.int64)
            at = np.flatnonzero(number >= 0)
            doc = np.searchsorted(word_offs, at, side="right") - 1
            keys, tfs = np.unique(doc * size + number[at], return_counts=True)
            terms = keys % size
            held, dfs = np.unique(terms, return_counts=True)
            columns = [
                pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column("doc_id")])),
                *(pa.array([pack(x.astype("<i4"))], pa.binary()) for x in (sizes, keys // size, terms, tfs)),
                pa.array([held], pa.list_(pa.int32())), pa.array([dfs], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _INDEX.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _INDEX)


def impacts(sizes: np.ndarray, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The exact impact of each posting."""
    if 75 * int(sizes.max(initial=0)) * n_docs < 1 << 63:
        m = 25 + (75 * sizes * n_docs) // n_terms
    else:
        m = np.array([25 + 75 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)
    return weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]))


class Shard:
    """Postings twice: by document, and by term in descending order of impact."""

    def __init__(self, n_docs: int, docs: np.ndarray, terms: np.ndarray, impact: np.ndarray, size: int):
        self.n_docs, self.terms, self.impact = n_docs, terms, impact
        self.first = np.searchsorted(docs, np.arange(n_docs + 1))
        order = np.lexsort((-impact, terms))
        self.by_docs, self.falling = docs[order], -impact[order]
        self.start = np.searchsorted(terms[order], np.arange(size + 1))

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that can be among the k best of this shard with a score of `least` or more, k or a few more where equal."""
        here = [[int(self.start[t]), int(self.start[t + 1]), int(n), int(t)] for t, n in zip(terms, times, strict=True) if self.start[t] < self.start[t + 1]]
        top = [-int(self.falling[a]) * n for a, _, n, _ in here]
        found = np.zeros(self.n_docs, np.int64)
        while True:
            rest = sum(top)  # what a document can still gain
            reach = max(int(np.partition(found, -k)[-k]) if self.n_docs > k else 0, least)
            open_ = np.flatnonzero(found + rest >= reach)
            if len(open_) <= k or not rest:
                break
            level = max(max(top) // 2, 1)
            for i, (a, end, n, _) in enumerate(here):
                if top[i] < level:
                    continue
                stop = a + int(np.searchsorted(self.falling[a:end], -level // n, side="right"))
                found[self.by_docs[a:stop]] -= n * self.falling[a:stop]
                here[i][0] = stop
                top[i] = -int(self.falling[stop]) * n if stop < end else 0
        if rest:
            times_of = dict(zip(terms.tolist(), times.tolist(), strict=True))
            for d in open_.tolist():
                a, b = self.first[d], self.first[d + 1]
                found[d] = sum(times_of.get(t, 0) * i for t, i in zip(self.terms[a:b].tolist(), self.impact[a:b].tolist(), strict=True))
        scores = found[open_]
        return open_[scores >= least], scores[scores >= least]


def _answers(shards: DataFrame, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int, block: int) -> DataFrame:
    """q, item_id, doc_id, score: the k best of each task for each item row."""
    size = len(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none, none) for _ in queries.terms]  # scores, whether the id is null, ids
        for batch in batches:
            for row in batch.to_pylist():
                sizes, docs, terms, tfs = (unpack(row[x], np.dtype("<i4")).astype(np.int64) for x in ("sizes", "docs", "terms", "tfs"))
                if not len(docs):
                    continue
                shard = Shard(len(sizes), docs, terms, impacts(sizes, docs, terms, tfs, weights, n_docs, n_terms), size)
                ids = np.array([x or 0 for x in row["ids"]], np.int64)
                null = np.array([x is None for x in row["ids"]], np.int64)
                for q, (t, n) in enumerate(zip(queries.terms, queries.times, strict=True)):
                    scores, nulls, known = best[q]
                    found, got = shard.best(t, n, k, int(scores[k - 1]) if len(scores) == k else 1)
                    if len(found):
                        scores, nulls, known = np.concatenate([scores, got]), np.concatenate([nulls, null[found]]), np.concatenate([known, ids[found]])
                        order = np.lexsort((known, nulls, -scores))[:k]
                        best[q] = scores[order], nulls[order], known[order]
        out = [(block + row, item, None if null else i, s) for (scores, nulls, ids), rows in zip(best, queries.rows, strict=True) for row, item in rows for s, null, i in zip(scores.tolist(), nulls.tolist(), ids.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["q", "item_id", "doc_id", "score"])

    return shards.select("ids", "sizes", "docs", "terms", "tfs").mapInArrow(run, "q long, item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the k highest-scoring documents of each row of items (item_id, text), scores above 0."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, math.ceil(2 * total / block_bytes))
    found, tasks = None, 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        queries = queries_of([tuple(r) for r in part.collect()])
        shards = materialize(index(docs, queries.vocabulary), "postings")
        tasks += shards.rdd.getNumPartitions()
        n_docs, n_terms = (int(x or 0) for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).head())
        pairs = shards.select(F.explode(F.arrays_zip("held", "dfs")).alias("x")).groupBy(F.col("x.held").alias("t")).agg(F.sum("x.dfs").alias("df"))
        weights = np.zeros(len(queries.vocabulary), np.int64)
        for t, df in pairs.collect():  # a row per term of the block
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        got = _answers(shards, queries, weights, n_docs, n_terms, k, b << 40)
        found = got if found is None else found.unionAll(got)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.spark_partition_id(), F.lit(math.ceil(math.sqrt(tasks))))
    some = found.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("place") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS t FROM documents)
), asked AS (
  SELECT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark)
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), stats AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), postings AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, stats GROUP BY term
), impacts AS (
  SELECT p.doc_id, p.term, w * ((1000000000::BIGINT * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS impact
  FROM postings p JOIN weights USING (term) JOIN sizes s ON p.doc_id = s.doc_id, stats
), scores AS (
  SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term) JOIN impacts USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
