"""The stages over small tables, each on its predecessor's rows; the pipeline against the brute-force rules."""

import corpus_pipeline

from . import brute
from .conftest import rows_of
from .test_near_copies import components


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = rows_of(tables, "benchmark", "item_id", "text")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = (before, {r["doc_id"]: r["text"] for r in docs.collect()})
    before, after = seen["quality rules"]
    failed = {x[0] for x in brute.quality(before.items()) if x[-1]}
    assert not failed & after.keys() and len(after) > 0.5 * (len(before) - len(failed))
    before, after = seen["SimHash near-dedup"]
    assert after.keys() == set(components(before.items()).values())
    before, after = seen["benchmark decontamination"]
    assert after.keys() == {x[0] for x in brute.contamination(before.items(), items) if not x[-1]}
    before, after = seen["PII"]
    assert after.keys() == before.keys()
    assert all(sum(x[1:5]) == 0 for x in brute.pii(after.items()))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == after.keys()


def test_stages_keep_the_documents_columns(spark, tables):
    """Columns named like those that an operator adds come out with the document's own values and types."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = {tuple(r) for r in docs.collect()}
    for stage in (corpus_pipeline.quality, corpus_pipeline.decontaminate):
        out = stage(spark, docs, tables)
        assert out.dtypes == docs.dtypes
        after = [tuple(r) for r in out.collect()]
        assert after and set(after) <= before


def odd(spark):
    """Nulls in every column, empty and blank texts, one very long text, repeated rows and ids, and clashing column names."""
    several = lambda p, n: " ".join(p + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(n))
    words = several("wo", 80)
    rows = [(None, None, None, None, None), (None, words, "en", "s", 3), (1, None, "en", None, 0), (2, "", None, "s", None), (3, " \n\t", "en", "s", 3), (4, words, "en", "s", 5), (4, words, "en", "s", 5), (4, words + " " + several("ve", 99), "de", "t", 6), (5, several("ex", 300_000), "en", "s", 7), (6, words, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(*r, f"k{i}", i, "v", 1) for i, r in enumerate(rows)], kind + ", kept string, n_words int, _tag string, root int").repartition(3)


def test_stages_take_odd_rows(spark, tables):
    docs = odd(spark)
    before = sorted(map(str, docs.collect()))
    quality, near, decontaminated, private, packed = (f(spark, docs, tables) for _, f in corpus_pipeline.STAGES)
    for out in (quality, near, decontaminated, private):
        assert out.dtypes == docs.dtypes
    kept = sorted(str(r) for r in quality.collect())
    assert set(kept) <= set(before) and [r["n_words"] for r in quality.orderBy("n_words").collect()] == [1, 5, 6, 7, 8, 9]
    rows = near.collect()
    # one of the null, empty and blank texts; one of the copies of 4; its other text; the long one; all rows without doc_id
    assert sorted(map(str, ((r["doc_id"], r["n_words"]) for r in rows))) == sorted(map(str, [(None, 0), (None, 1), (1, 2), (4, 5), (4, 7), (5, 8)]))
    assert sorted(map(str, decontaminated.collect())) == before
    assert sorted(map(str, private.drop("n_chars").collect())) == sorted(map(str, docs.drop("n_chars").collect()))
    pieces = packed.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in pieces} == {None, 1, 2, 3, 4, 5, 6}


def test_stages_take_empty_tables(spark, nothing):
    docs = spark.read.parquet(f"{nothing}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, nothing).count() == 0
