"""Materialised layers in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own in a local session and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="terralith-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: What this application has written to the shared folder.
_written: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `clear_shared` removes it."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{app}-{name}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def shared_count(spark: SparkSession) -> int:
    """How many tables and files this application has put into the shared folder and not removed."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def clear_shared(spark: SparkSession, since: int = 0, keep_last: int = 0) -> None:
    """Remove what this application has put into the shared folder, from number `since` on and but for the last ones; results that still read it must be written before."""
    held = _written.get(spark.sparkContext.applicationId, [])
    gone = held[since : len(held) - keep_last]
    held[since : len(held) - keep_last] = []
    for path in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_layer(df: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    """Materialise a layer and give it a name (and an alias) for later queries of the session; a name is overwritten."""
    out = materialize(df, name)
    for n in filter(None, (name, alias)):
        out.createOrReplaceTempView(n)
    return out


def describe_layer(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: rows, bounding box, columns."""
    from pyspark.sql import functions as F

    return df.agg(F.count("*").alias("n_rows"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1")).withColumn("n_columns", F.lit(len(df.columns)))
