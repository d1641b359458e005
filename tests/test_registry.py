"""Operators by name in SQL."""

import pytest
from pyspark.sql import functions as F

from terralith.functions import geo, registry
from terralith.operators.raster import change_class
from terralith.operators.text import chunk_documents


def test_scalars_are_expressions(spark):
    registry.register(spark)
    p = spark.createDataFrame([(116.4, 39.9, 2.35, 48.85), (0.0, 0.0, 0.0, 0.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    p.createOrReplaceTempView("pairs")
    mx, my = geo.to_mercator(F.col("a"), F.col("b"))
    want = p.select(geo.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")), mx, my, change_class(F.col("a") - F.col("c"), 3.0)).collect()
    got = spark.sql("SELECT great_circle_m(a, b, c, d), mercator_x(a), mercator_y(b), change_class(a - c, 3) FROM pairs")
    assert "Python" not in got._jdf.queryExecution().toString()
    for g, w in zip(got.collect(), want, strict=True):
        assert all((x is None) == (y is None) and (x is None or x == y or abs(x - y) < 1e-6) for x, y in zip(g, w, strict=True))
    assert spark.sql("SELECT boxes_meet(0, 0, 1, 1, 1, 1, 2, 2) AND NOT boxes_meet(0, 0, 1, 1, 2, 0, 3, 1) AS x").head()["x"]


def test_table_functions(spark):
    registry.register(spark)
    docs = spark.createDataFrame([(1, "one. two. three. " * 40), (2, None), (3, "")], "doc_id long, text string")
    docs.createOrReplaceTempView("texts")
    got = spark.sql("SELECT doc_id, c.* FROM texts, LATERAL text_chunks(text, 20, 4) c").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chunk_documents(docs, 20, 4).collect())) and len(got) > 5
    assert [tuple(r) for r in spark.sql("SELECT * FROM tile_cover(0.0D, 0.0D, 100.0D, 10.0D, 2)").collect()] == [(2, 2, 1), (2, 3, 1), (2, 2, 2), (2, 3, 2)]
    assert spark.sql("SELECT * FROM tile_cover(1.0D, 0.0D, NULL, 10.0D, 2)").count() == 0
    spark.createDataFrame([("a", 1.0), ("a", 2.5), ("a", 9.0), ("a", None), ("b", 0.0), ("b", 100.0), ("a", 3.0), (None, 5.0)], "k string, at double").createOrReplaceTempView("ticks")
    got = spark.sql("SELECT * FROM sessions(TABLE(ticks) PARTITION BY k ORDER BY (at), 2.0D)").collect()
    assert {tuple(r) for r in got} == {("a", 0, 1.0, 3.0, 3), ("a", 1, 9.0, 9.0, 1), ("b", 0, 0.0, 0.0, 1), ("b", 1, 100.0, 100.0, 1), (None, 0, 5.0, 5.0, 1)}


def test_catalog_and_errors(spark):
    rows = {r["name"]: r for r in registry.catalog(spark).collect()}
    assert rows.keys() == registry.OPERATORS.keys() and rows["sessions"]["kind"] == "table" and rows["mercator_x"]["parameters"] == "x DOUBLE"
    with pytest.raises(ValueError):
        registry.register(spark, ["nothing"])
    registry.register(spark, ["sessions"])
    with pytest.raises(Exception, match="columns k and at"):
        spark.sql("SELECT * FROM sessions(TABLE(SELECT 1 AS z) PARTITION BY (z), 2.0D)").collect()
