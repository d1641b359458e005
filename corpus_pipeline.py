"""From raw documents to packed training sequences: five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, untouched but where the
stage's task is to change them, whatever extra columns there are and however they are called. Null texts count as
empty, an empty table gives an empty one, and a text of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm._util import materialize, read_table
from terralith.llm.decontaminate import contamination
from terralith.llm.near_copies import drop_near_duplicates
from terralith.llm.packing import pack_documents
from terralith.llm.pii import redact_pii
from terralith.llm.quality_rules import quality_cascade
from terralith.sources.store import clear_shared, shared_count


def _kept(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], kept: Column) -> DataFrame:
    """The rows of docs, untouched, that are kept; all columns but doc_id and text go by names that no operator adds."""
    aside = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return operator(docs.withColumnsRenamed(aside)).where(kept).select([F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by itself, repeated ones alike; null, empty and blank texts go."""
    return _kept(docs, lambda x: quality_cascade(x, metrics=False), F.col("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest doc_id, of each group of near copies (five-word shingles, similarity 0.8 or more).

    Null, empty and blank texts are copies of each other. Repeated rows are one; rows of one doc_id with texts that
    are no near copies all stay, and so do rows without a doc_id.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words come from benchmark windows; texts without words stay."""
    return _kept(docs, lambda x: contamination(x, read_table(spark, sf_dir, "benchmark")), ~F.col("contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind and n_chars counted anew (null for a null text)."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, with their token ids, in sequences of at most 4096; a text without words is its end token."""
    return pack_documents(docs).drop("doc_row")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", pii),
    ("packing", packing),
]

#: Token ids and fingerprints are beyond SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has put into the shared folder goes once its result is written."""
    docs, since = read_table(spark, sf_dir, "documents"), shared_count(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clear_shared(spark, since, keep_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
