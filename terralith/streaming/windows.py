"""Event streams: the same semantics as the batch operators, with watermarks for late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """A stream over the event files of a folder, with `ts` as an instant."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Tumbling or sliding windows: rows, sum and mean of value."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "mean")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_anomalies(events: DataFrame, by: str = "event_type", threshold: float = 2.0, least: int = 30) -> DataFrame:
    """Events whose value lies `threshold` population σ or more from the mean of their key's values so far (at least `least`)."""
    kind = events.schema[by].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        for frame in frames:
            for event, v in frame.sort_values(["ts", "event_id"])[["event_id", "value"]].itertuples(index=False):
                if n >= least and m2 > 0 and abs(v - mean) / (m2 / n) ** 0.5 >= threshold:
                    out.append((key[0], int(event), float(v), round((v - mean) / (m2 / n) ** 0.5, 3)))
                n += 1
                d = v - mean
                mean += d / n
                m2 += d * (v - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame(out, columns=[by, "event_id", "value", "z"])

    return events.where("value is not null").groupBy(by).applyInPandasWithState(step, f"{by} {kind}, event_id long, value double, z double", "n long, mean double, m2 double", "append", "NoTimeout")


def run_to_files(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream over what is there now and append its rows to a folder of Parquet files; windows that the watermark has not closed stay in the state."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
