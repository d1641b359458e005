"""python -m tests.compare [NAME...]: queries against their SQL in DuckDB, over $TEST_SF_DIR."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import datetime

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, (str, int, bool)):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    return str(x)


def ordered(columns: list[str], rows) -> list[tuple]:
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in by) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if the rows are equal."""
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    kinds = dict(df.dtypes)
    names = dict(zip(want.columns, map(str, want.types), strict=True))
    alike = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}: {kinds[c]} and {names[c]}" for c in df.columns if kinds[c] in alike and alike[kinds[c]] != names[c]]
    got, want = ordered(df.columns, df.collect()), ordered(want.columns, want.fetchall())
    if got != want:
        only, other = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; {only} | {other} {odd}"
    return f"types {odd}" if odd else ""


def main(names: list[str]) -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names or not names and (name.startswith("op") or name == "pipeline"):
            continue
        began = time.time()
        try:
            df = query(spark, sf)
            said = (differences(df, con, sqls[name]) or "ok") if name in sqls else f"{df.count()} rows, no SQL"
        except Exception as e:
            said = f"ERROR {type(e).__name__} {str(e)[:400]}"
        print(f"{name}: {said[:700]} [{time.time() - began:.1f}]", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
