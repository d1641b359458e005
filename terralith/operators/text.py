"""Document chunks and vector search."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a chunk prefers to end, best first.
SEPARATORS = ("\n\n", "\n", ". ", "。")


def chunk_bounds(text: str, max_tokens: int = 512, overlap: int = 50) -> list[tuple[int, int, str]]:
    """(start, end, content) of sliding chunks of 4 characters a token; from the second on, one ends at a separator in its latter half.

    A chunk starts `overlap` tokens before the end of the one before it, or half a chunk on where that would not be
    ahead; so a text shorter than the overlap gives several.
    """
    size = min(4 * max_tokens, len(text))
    places = [(len(s), [m.start() for m in re.finditer(f"(?={re.escape(s)})", text)]) for s in SEPARATORS]

    def end_of(start: int) -> int:
        for n, at in places:
            k = bisect.bisect_right(at, start + size - n) - 1
            if k >= 0 and at[k] > start + size // 2:
                return at[k] + n
        return start + size

    bounds = [(0, size)] if size else []
    while bounds:
        start, end = bounds[-1]
        start = max(end - 4 * overlap, start + 1) if end - 4 * overlap > start else start + max(1, size // 2)
        if start >= len(text):
            break
        bounds.append((start, end_of(start)))
    return [(a, b, text[a:b].strip()) for a, b in bounds]


def chunk_documents(docs: DataFrame, max_tokens: int = 512, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, start_char, end_char, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, a, b, c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (a, b, c) in enumerate(chunk_bounds(t or "", max_tokens, overlap))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "chunk_index", "start_char", "end_char", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_index int, start_char long, end_char long, content string")


def markdown_sections(text: Column) -> Column:
    """Parts of a text, each second-level heading starting a new one; blank parts are left out."""
    return F.filter(F.split(text, r"\n(?=## )"), lambda s: F.trim(s) != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_search(vectors: DataFrame, query: list[float], k: int = 5, keep: Column | None = None, overfetch: int = 4) -> DataFrame:
    """The k vectors (vec_id, embedding) with the largest cosine to the query; a filter applies to the first overfetch * k, so fewer may come back."""
    q = F.array(*[F.lit(float(v)) for v in query])
    score = dot(F.col("embedding"), q) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(q, q)))
    best = vectors.withColumn("score", score).orderBy(F.desc("score"), "vec_id").limit(overfetch * k)
    return (best.where(keep) if keep is not None else best).orderBy(F.desc("score"), "vec_id").limit(k)


def visible(vectors: DataFrame, tenants: DataFrame) -> DataFrame:
    """Vectors of the given tenants that are not deleted."""
    return vectors.where(~F.coalesce("deleted", F.lit(False))).join(tenants, "tenant", "left_semi")


def compact(vectors: DataFrame) -> DataFrame:
    """The latest version (column version) of every vec_id, without those whose latest one is deleted."""
    last = vectors.groupBy("vec_id").agg(F.max_by(F.struct(*[c for c in vectors.columns if c != "vec_id"]), "version").alias("v"))
    return last.select("vec_id", "v.*").where(~F.coalesce("deleted", F.lit(False)))
