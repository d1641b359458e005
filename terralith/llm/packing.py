"""Shortest-pack-first packing of documents into sequences, planned over the histogram of lengths.

A document is cut into whole sequences of `size` tokens and a rest. The rests' lengths (at most `size` different
ones, whatever the corpus) are counted in Spark; only this histogram reaches the driver. The plan opens the least
number of packs that can hold all rests and places lengths, longest first, each into the packs with the fewest
tokens so far. Packs with the same fill are one class with a range of sequence numbers and a count; placing a
length moves a count from one class to another, so the plan works on counts and not on documents. Where even the
shortest pack has no room for a whole rest, the rest is cut: its head fills the pack, its tail waits for its turn
as a shorter length. So all packs but the last few are full.

Each placement says: the rests of one length with ranks [rank, rank + count) put tokens [start, start + length) at
`offset` of sequences [sequence, sequence + count). A rest's rank among those of its length comes from two levels
of counting (length and bucket, then place within the bucket), so that a length of a third of all documents is no
hot group, and placements meet rests by an equi-join on length and blocks of `RANK_BLOCK` ranks.

Null and empty texts have the end token alone. Repeated doc_ids are documents of their own: they get their own
pieces and a row number `doc_row` tells them apart. Extra columns are not read; an empty table gives an empty
result. Sequences have no gaps; padding stands only behind the last token of a sequence.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize, read_table
from .tokens import default_tokenizer, documents_with_tokens, unpack

SIZE = 4096
END = 2
RANK_BLOCK = 4096
#: Buckets at least, and documents of one bucket, about.
BUCKETS = 1024
BUCKET_DOCS = 200_000

Placement = tuple[int, int, int, int, int, int, int]


def plan(histogram: dict[int, int], size: int = SIZE, first_sequence: int = 0) -> list[Placement]:
    """Rows (length, rank, count, start, piece, sequence, offset) that place every rest exactly once."""
    total = sum(n * c for n, c in histogram.items())
    packs = -(-total // size)
    # classes of packs by fill: lists of [first sequence, count]
    classes: dict[int, list[list[int]]] = {0: [[first_sequence, packs]]} if packs else {}
    fills = list(classes)
    # what waits: by remaining length (longest first), groups of [length, rank, count, start]
    waiting: dict[int, list[list[int]]] = {}
    for n, c in histogram.items():
        waiting.setdefault(n, []).append([n, 0, c, 0])
    queue = [-n for n in waiting]
    heapq.heapify(queue)
    rows: list[Placement] = []

    def move(fill: int, sequence: int, count: int, by: int) -> None:
        new = fill + by
        if new not in classes:
            classes[new] = []
            heapq.heappush(fills, new)
        last = classes[new][-1] if classes[new] else None
        if last and last[0] + last[1] == sequence:
            last[1] += count
        else:
            classes[new].append([sequence, count])

    while queue:
        left = -heapq.heappop(queue)
        for length, rank, count, start in waiting.pop(left):
            while count:
                while not classes.get(fills[0]):
                    classes.pop(heapq.heappop(fills), None)
                fill = fills[0]
                piece = min(left, size - fill)
                if piece <= 0:
                    raise AssertionError("no room left")
                group = classes[fill][-1]
                n = min(count, group[1])
                group[1] -= n
                sequence = group[0] + group[1]
                if not group[1]:
                    classes[fill].pop()
                rows.append((length, rank, n, start, piece, sequence, fill))
                move(fill, sequence, n, piece)
                if piece < left:
                    rest = left - piece
                    if rest not in waiting:
                        waiting[rest] = []
                        heapq.heappush(queue, -rest)
                    waiting[rest].append([length, rank, n, start + piece])
                rank += n
                count -= n
    return rows


_PLAN = "length long, rank long, count long, start long, piece long, sequence long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, doc_row, start, length, sequence_id, offset, doc_tokens, ids (binary, little-endian unsigned 32-bit), a row per piece."""
    spark = docs.sparkSession
    tokens = materialize(documents_with_tokens(docs, tokenizer or default_tokenizer(), end).withColumn("doc_row", F.monotonically_increasing_id()), "tokens")
    lengths = tokens.select("doc_id", "doc_row", "n_tokens", (F.col("n_tokens") % size).alias("rest"), F.floor(F.col("n_tokens") / size).alias("whole"))

    # whole sequences: numbered within a bucket, after those of the buckets before
    bucket = F.pmod(F.xxhash64("doc_row"), F.lit(max(BUCKETS, tokens.count() // BUCKET_DOCS)))
    rests = lengths.where("rest > 0").withColumn("bucket", bucket)
    counts = rests.groupBy("rest", "bucket").agg(F.count("*").alias("n"))
    histogram = {int(k): int(n) for k, n in counts.groupBy("rest").agg(F.sum("n")).collect()}  # at most `size` rows
    wholes = lengths.where("whole > 0").withColumn("bucket", bucket)
    whole_counts = {int(b): int(n) for b, n in wholes.groupBy("bucket").agg(F.sum("whole")).collect()}  # a row per bucket

    earlier = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("rest", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = spark.createDataFrame(plan(histogram, size), _PLAN)

    local = F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("doc_row")) - 1
    ranked = rests.withColumn("local", local).join(before, ["rest", "bucket"]).withColumn("at", F.col("local") + F.col("before"))
    blocks = placed.withColumn("part", F.explode(F.sequence(F.floor(F.col("rank") / RANK_BLOCK), F.floor((F.col("rank") + F.col("count") - 1) / RANK_BLOCK))))
    pieces = (
        ranked.withColumn("block", F.floor(F.col("at") / RANK_BLOCK))
        .join(blocks, (F.col("rest") == F.col("length")) & (F.col("block") == F.col("part")) & (F.col("at") >= F.col("rank")) & (F.col("at") < F.col("rank") + F.col("count")))
        .select("doc_row", (F.col("whole") * size + F.col("start")).alias("start"), F.col("piece").alias("length"), (F.col("sequence") + F.col("at") - F.col("rank")).alias("sequence_id"), "offset")
    )
    opened = -(-sum(n * c for n, c in histogram.items()) // size)
    bases, at = [], opened
    for b in sorted(whole_counts):
        bases.append((b, at))
        at += whole_counts[b]
    so_far = F.sum("whole").over(Window.partitionBy("bucket").orderBy("doc_row").rowsBetween(Window.unboundedPreceding, -1))
    full = (
        wholes.withColumn("so_far", F.coalesce(so_far, F.lit(0)))
        .join(spark.createDataFrame(bases, "bucket long, base long"), "bucket")
        .select("doc_row", F.col("base"), "so_far", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("k"))
        .select("doc_row", (F.col("k") * size).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), (F.col("base") + F.col("so_far") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    by_doc = pieces.unionAll(full).groupBy("doc_row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, row, n, packed, parts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = unpack(packed)
                rows += [(doc, row, p["start"], p["length"], p["sequence_id"], p["offset"], n, ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in parts]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())], ["doc_id", "doc_row", "start", "length", "sequence_id", "offset", "doc_tokens", "ids"])

    joined = tokens.join(by_doc, "doc_row").select("doc_id", "doc_row", "n_tokens", "ids", "pieces")
    return joined.mapInArrow(cut, "doc_id long, doc_row long, start long, length long, sequence_id long, offset long, doc_tokens long, ids binary")


def op5(spark, sf_dir: str) -> DataFrame:
    got = pack_documents(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
