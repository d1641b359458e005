"""Operators by name, with typed parameters, for SQL: scalar functions as SQL expressions, table functions over rows or partitions.

Scalar functions are Spark's own SQL functions, so Catalyst inlines them and no Python runs. Table functions take the columns of a
row (`LATERAL text_chunks(text)`) or a table whose partitions are each seen in order
(`sessions(TABLE(t) PARTITION BY k ORDER BY (ts), gap)`); of a partition they hold one row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SelectedColumn, udtf
from pyspark.sql.types import LongType, StringType, StructType

from ..operators.text import chunk_bounds

_DEG = "acos(-1.0D) / 180"


@dataclass(frozen=True)
class Operator:
    name: str
    parameters: tuple[tuple[str, str], ...]
    returns: str
    what: str
    #: A SQL expression over the parameters, or a class of a table function.
    body: str | type

    @property
    def kind(self) -> str:
        return "scalar" if isinstance(self.body, str) else "table"


class TextChunks:
    """A text's chunks; a null text has none."""

    def eval(self, text: str | None, max_tokens: int = 512, overlap: int = 50) -> Iterator[tuple]:
        if max_tokens is None or overlap is None or max_tokens < 1 or overlap < 0:
            raise ValueError("max_tokens is 1 or more and overlap 0 or more")
        for i, (start, end, content) in enumerate(chunk_bounds(text or "", max_tokens, overlap)):
            yield i, start, end, content


class TileCover:
    """The web tiles of a zoom that a box in degrees meets, row by row; a box without places has none."""

    def eval(self, x0: float | None, y0: float | None, x1: float | None, y1: float | None, zoom: int) -> Iterator[tuple]:
        import math

        if None in (x0, y0, x1, y1) or x0 > x1 or y0 > y1:
            return
        n = 1 << zoom
        column = lambda x: min(n - 1, max(0, math.floor((x / 360 + 0.5) * n)))
        line = lambda y: min(n - 1, max(0, math.floor((0.5 - math.asinh(math.tan(math.radians(max(-85.0511287798066, min(85.0511287798066, y))))) / (2 * math.pi)) * n)))
        for ty in range(line(y1), line(y0) + 1):
            for tx in range(column(x0), column(x1) + 1):
                yield zoom, tx, ty


class Sessions:
    """Sessions of a partition's rows in their order: a new one where `gap` is passed. The table has the columns k and at (a number); rows without `at` belong to none."""

    def __init__(self) -> None:
        self.state: tuple | None = None  # key, number, first, last, rows
        self.gap = 0.0

    @staticmethod
    def analyze(rows: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or {"k", "at"} - {f.name for f in rows.dataType.fields}:
            raise ValueError("sessions takes a table with the columns k and at")
        kind = next(f.dataType for f in rows.dataType.fields if f.name == "k")
        schema = StructType().add("k", kind).add("session", LongType()).add("first", "double").add("last", "double").add("n", LongType())
        return AnalyzeResult(schema=schema, select=[SelectedColumn("k"), SelectedColumn("at")])

    def eval(self, rows: Row, gap: float) -> Iterator[tuple]:
        at = rows["at"]
        if at is None:
            return
        at = float(at)
        if self.state and at - self.state[3] <= float(gap):
            self.state = (*self.state[:3], at, self.state[4] + 1)
            return
        if self.state:
            yield self.state
        self.state = (rows["k"], self.state[1] + 1 if self.state else 0, at, at, 1)

    def terminate(self) -> Iterator[tuple]:
        if self.state:
            yield self.state


OPERATORS = {
    o.name: o
    for o in (
        Operator("great_circle_m", (("x1", "DOUBLE"), ("y1", "DOUBLE"), ("x2", "DOUBLE"), ("y2", "DOUBLE")), "DOUBLE", "metres between two places in degrees", f"2 * 6371000.0D * asin(sqrt(least(1.0D, pow(sin((y2 - y1) * {_DEG} / 2), 2) + cos(y1 * {_DEG}) * cos(y2 * {_DEG}) * pow(sin((x2 - x1) * {_DEG} / 2), 2))))"),
        Operator("boxes_meet", tuple((f"{s}{k}", "DOUBLE") for s in "ab" for k in ("x0", "y0", "x1", "y1")), "BOOLEAN", "whether two closed boxes share a place", "ax0 <= bx1 AND ax1 >= bx0 AND ay0 <= by1 AND ay1 >= by0"),
        Operator("mercator_x", (("x", "DOUBLE"),), "DOUBLE", "Web Mercator metres of a longitude", f"x * {_DEG} * 6378137.0D"),
        Operator("mercator_y", (("y", "DOUBLE"),), "DOUBLE", "Web Mercator metres of a latitude", f"ln(tan(acos(-1.0D) / 4 + greatest(-85.0511287798066D, least(85.0511287798066D, y)) * {_DEG} / 2)) * 6378137.0D"),
        Operator("change_class", (("delta", "DOUBLE"), ("threshold", "DOUBLE")), "STRING", "five classes of a change by a threshold", "CASE WHEN delta >= 2 * threshold THEN 'significant_improvement' WHEN delta >= threshold THEN 'slight_improvement' WHEN delta > -threshold THEN 'no_change' WHEN delta > -2 * threshold THEN 'slight_degradation' WHEN delta IS NOT NULL THEN 'significant_degradation' END"),
        Operator("text_chunks", (("text", "STRING"), ("max_tokens", "INT"), ("overlap", "INT")), "chunk_index INT, start_char BIGINT, end_char BIGINT, content STRING", "a text's overlapping chunks", TextChunks),
        Operator("tile_cover", (("x0", "DOUBLE"), ("y0", "DOUBLE"), ("x1", "DOUBLE"), ("y1", "DOUBLE"), ("zoom", "INT")), "z INT, tx BIGINT, ty BIGINT", "web tiles that a box meets", TileCover),
        Operator("sessions", (("rows", "TABLE"), ("gap", "DOUBLE")), "", "sessions of the rows of each partition", Sessions),
    )
}


def register(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Make operators known to the session's SQL, all or those named; their names."""
    wanted = list(names or OPERATORS)
    if unknown := [n for n in wanted if n not in OPERATORS]:
        raise ValueError(f"unknown operators {unknown}; there are {', '.join(OPERATORS)}")
    for n in wanted:
        o = OPERATORS[n]
        if isinstance(o.body, str):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {n}({', '.join(f'{p} {t}' for p, t in o.parameters)}) RETURNS {o.returns} RETURN {o.body}")
        else:
            spark.udtf.register(n, udtf(o.body, returnType=o.returns) if o.returns else udtf(o.body))
    return wanted


def catalog(spark: SparkSession) -> DataFrame:
    """name, kind, parameters, returns, what of every operator."""
    rows = [(o.name, o.kind, ", ".join(f"{p} {t}" for p, t in o.parameters), o.returns or "by the table", o.what) for o in OPERATORS.values()]
    return spark.createDataFrame(rows, StructType().add("name", StringType()).add("kind", StringType()).add("parameters", StringType()).add("returns", StringType()).add("what", StringType()))
