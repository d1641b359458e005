"""Time: filters, buckets, gaps, trends, anomalies and snapshots, per series and without a sort of whole tables."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# instants


def parse_instant(c: Column) -> Column:
    """Text to a timestamp: ISO forms, `YYYY-MM`, `YYYY` of 1800 to 2100, `Y/M/D [h:m[:s]]`, epoch seconds or milliseconds; else null."""
    s = F.trim(c.cast("string"))
    n = s.try_cast("double")
    year = s.rlike(r"^\d{4}$") & s.try_cast("int").between(1800, 2100)
    slash = F.regexp_extract(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})", 0) != ""
    clock = F.regexp_extract(s, r" (\d{1,2}:\d{1,2}(:\d{1,2})?)$", 1)
    day = F.regexp_replace(F.regexp_extract(s, r"^[\d/]+", 0), "/", "-")
    return (
        F.when(year, F.make_timestamp(s.try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
        .when(s.rlike(r"^\d{4}-\d{1,2}$"), F.concat(s, F.lit("-01")).try_cast("timestamp"))
        .when(slash, F.when(clock == "", day).otherwise(F.concat(day, F.lit(" "), clock)).try_cast("timestamp"))
        .when(n.between(3.0e8, 3.0e9), F.timestamp_micros((n * 1e6).cast("long")))
        .when(n.between(3.0e11, 3.0e12), F.timestamp_micros((n * 1e3).cast("long")))
        .when(n.isNotNull(), F.lit(None).cast("timestamp"))
        .otherwise(s.try_cast("timestamp"))
    )


_UNIT_HOURS = {"hour": 1, "day": 24, "week": 168, "month": 720, "year": 8760}


def relative_window(text: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """`last_N_unit` or `past_N_unit` up to now; a month has 30 days, a year 365."""
    m = re.fullmatch(r"(?:last|past)_(\d+)_+(hour|day|week|month|year)s?", text.strip().lower().replace("-", "_"))
    if not m:
        raise ValueError(f"not a relative window: {text}")
    return now - dt.timedelta(hours=int(m[1]) * _UNIT_HOURS[m[2]]), now


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1000000.0)


def temporal_filter(df: DataFrame, time: str, operator: str, instant=None, start=None, end=None, include_start: bool = True, include_end: bool = True) -> DataFrame:
    """EQUALS (under a second apart), BEFORE, AFTER, BETWEEN / IN_INTERVAL (one bound open if None), IS_NULL, IS_NOT_NULL."""
    t = F.col(time)

    def lit(v) -> Column:
        return F.lit(v).cast(df.schema[time].dataType)

    if operator == "IS_NULL":
        return df.where(t.isNull())
    if operator == "IS_NOT_NULL":
        return df.where(t.isNotNull())
    if operator == "EQUALS":
        return df.where(F.abs(seconds(t) - seconds(lit(instant))) < 1)
    if operator == "BEFORE":
        return df.where(t < lit(instant))
    if operator == "AFTER":
        return df.where(t > lit(instant))
    if operator not in ("BETWEEN", "IN_INTERVAL"):
        raise ValueError(f"unknown operator {operator}")
    if start is not None:
        df = df.where(t >= lit(start) if include_start else t > lit(start))
    if end is not None:
        df = df.where(t <= lit(end) if include_end else t < lit(end))
    return df.where(t.isNotNull())


# buckets


def bucket_key(t: Column, unit: str) -> Column:
    """The bucket's key string; weeks start on Monday and are numbered by the Sunday rule of that Monday."""
    formats = {"second": "yyyy-MM-dd HH:mm:ss", "minute": "yyyy-MM-dd HH:mm:00", "hour": "yyyy-MM-dd HH:00:00", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
    if unit == "week":
        monday = F.date_trunc("week", t)
        number = F.floor((F.dayofyear(monday) + 6 - (F.dayofweek(monday) - 1)) / 7)
        return F.concat(F.date_format(monday, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))
    return F.date_format(F.date_trunc(unit, t), formats[unit])


def finite(c: Column) -> Column:
    """The value as a double, null if it is not a finite number."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def exact_sum(v: Column, places: int) -> Column:
    """The sum of values of at most `places` decimals, as a double, the same in whatever order the rows come."""
    return F.sum(v.cast(f"decimal(28,{places})")).cast("double")


def temporal_aggregate(df: DataFrame, time: str, unit: str, value: str, by: list[str] | None = None, order: str | None = None, places: int | None = None) -> DataFrame:
    """Per bucket (and key columns): all rows with a time, and count, mean, sum, min, max, sample std (0 for one), first and last of the finite values.

    first and last follow time and then `order`. places: the values have at most so many decimals, so sum, mean and
    std come from exact sums.
    """
    v = finite(F.col(value))
    rows = df.where(F.col(time).isNotNull()).select(*(by or []), bucket_key(F.col(time), unit).alias("bucket"), v.alias("v"), F.struct(F.col(time), F.col(order or time)).alias("o"))
    at = F.when(F.col("v").isNotNull(), F.col("o"))
    n, total, mean, std = F.count("v"), F.sum("v"), F.avg("v"), F.stddev_samp("v")
    if places is not None:
        total, squares = exact_sum(F.col("v"), places), exact_sum(F.col("v").cast(f"decimal(14,{places})") * F.col("v").cast(f"decimal(14,{places})"), 2 * places)
        mean = total / n
        std = F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))))
    std = F.coalesce(std, F.when(n == 1, 0.0))
    return rows.groupBy(*(by or []), "bucket").agg(
        F.count("*").alias("n_rows"), n.alias("n_values"), mean.alias("mean"), total.alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), std.alias("std"), F.min_by("v", at).alias("first"), F.max_by("v", at).alias("last")
    )


# gaps

#: Upper median of the positive steps, in seconds, and the granularity that it means.
GRANULARITY = (("SECOND", 0, 5), ("MINUTE", 50, 70), ("HOUR", 3500, 3700), ("DAY", 80000, 90000), ("WEEK", 600000, 620000), ("MONTH", 2.4e6, 2.7e6), ("QUARTER", 7.5e6, 8.0e6), ("YEAR", 3.1e7, 3.2e7))


def _steps(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(time)
    return df.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("start"), F.lead(time).over(w).alias("end")).where("end is not null").withColumn("step", seconds(F.col("end")) - seconds(F.col("start")))


def granularity(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """Per series: upper median of the positive steps, granularity, and whether they are regular (σ under 0.15 of the mean)."""
    steps = _steps(df, time, by).where("step > 0")
    at = F.row_number().over(Window.partitionBy(*by).orderBy("step")) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = steps.withColumn("at", at).withColumn("n", n)
    got = ranked.groupBy(*by).agg(F.max(F.when(F.col("at") == F.floor(F.col("n") / 2), F.col("step"))).alias("median"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("std"))
    name = F.lit("IRREGULAR")
    for g, low, high in reversed(GRANULARITY):
        name = F.when((F.col("median") >= low) & ((F.col("median") < high) if g == "SECOND" else (F.col("median") <= high)), g).otherwise(name)
    return got.select(*by, F.round("median", 6).alias("median"), name.alias("granularity"), (F.col("std") / F.col("mean") < 0.15).alias("regular"))


def gaps(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """Steps longer than max(2 m, m + 1) for the upper median m, with round(step / m) - 1 missing instants."""
    medians = granularity(df, time, by)
    far = _steps(df, time, by).join(medians, by).where(F.col("step") > F.greatest(2 * F.col("median"), F.col("median") + 1))
    return far.select(*by, "start", "end", F.round("step", 6).alias("seconds"), (F.bround(F.col("step") / F.col("median")) - 1).cast("long").alias("missing"))


# trends


def moving_average(df: DataFrame, value: str, by: list[str], order: list[str], window: int = 3) -> DataFrame:
    """Trailing mean of `window` rows, partial at the head, rounded to 4 places."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - window, 0)
    return df.withColumn("moving_average", F.bround(F.avg(value).over(w), 4))


def anomalies(df: DataFrame, value: str, by: list[str], threshold: float = 2.0) -> DataFrame:
    """Rows whose population z-score reaches the threshold, in series of 3 values or more with a spread."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n")).where("_n >= 3 and _s > 0")
    z = (F.col(value) - F.col("_m")) / F.col("_s")
    return df.join(stats, by).withColumn("z", z).where(F.abs("z") >= threshold).withColumn("z", F.bround("z", 3)).withColumn("kind", F.when(F.col("z") > 0, "high").otherwise("low")).drop("_m", "_s", "_n")


def regression(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least squares per series: slope (6 places), intercept and r² (4 places); no spread in x: slope 0; none in y: r² 1."""
    d = df.where(f"{x} is not null and {y} is not null")
    got = d.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    slope = F.coalesce("s", F.lit(0.0))
    r2 = F.when(F.col("v") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r", F.lit(0.0)))))
    return got.select(*by, "n", F.round(slope, 6).alias("slope"), F.round(F.coalesce("i", "m"), 4).alias("intercept"), F.round(r2, 4).alias("r2"))


def sens_slope(df: DataFrame, x: str, y: str, by: list[str], cap: int = 1024) -> DataFrame:
    """Median of the pairwise slopes of each series; a series of more than `cap` points is thinned evenly to that many, as the method states."""
    w = Window.partitionBy(*by).orderBy(x, y)
    d = df.select(*by, F.col(x).cast("double").alias("x"), finite(F.col(y)).alias("y")).where("x is not null and y is not null")
    w = Window.partitionBy(*by).orderBy("x", "y")
    placed = d.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    # row i is picked if it is floor(j (n - 1) / (cap - 1)) for some j
    j = F.ceil(F.col("at") * (cap - 1) / (F.col("n") - 1))
    thin = placed.where((F.col("n") <= cap) | (F.floor(j * (F.col("n") - 1) / (cap - 1)) == F.col("at")))
    series = thin.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias("p"))  # at most cap points each
    pairs = series.select(*by, "p", F.posexplode("p").alias("i", "a")).select(*by, F.explode(F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda b: F.when(b["x"] != F.col("a.x"), (b["y"] - F.col("a.y")) / (b["x"] - F.col("a.x"))))).alias("slope"))
    return pairs.where("slope is not null").groupBy(*by).agg(F.percentile("slope", 0.5).alias("slope"))


def year_axis(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """Adds `years` since the first instant of the series, of 365.25 days."""
    first = F.min(seconds(F.col(time))).over(Window.partitionBy(*by))
    return df.withColumn("years", (seconds(F.col(time)) - first) / (365.25 * 86400))


def trend(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Slope (Sen's unless it is 0), regression and direction: beyond ±0.001 increasing or decreasing, else stable."""
    both = regression(df, x, y, by).withColumnRenamed("slope", "ols_slope").join(sens_slope(df, x, y, by).withColumnRenamed("slope", "sen_slope"), by, "left")
    slope = F.when(F.coalesce("sen_slope", F.lit(0.0)) != 0, F.col("sen_slope")).otherwise(F.col("ols_slope"))
    return both.withColumn("sen_slope", F.round(F.coalesce("sen_slope", F.lit(0.0)), 6)).withColumn("direction", F.when(slope > 0.001, "increasing").when(slope < -0.001, "decreasing").otherwise("stable"))


# snapshots


def snapshot_change(df: DataFrame, snapshot: str, value: str) -> DataFrame:
    """Consecutive snapshots: change of count (% of a zero base: 100 or 0) and of mean (% of a zero base: 0)."""
    per = df.groupBy(snapshot).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    w = Window.orderBy(snapshot)  # a row per snapshot
    c = per.withColumns({"n_before": F.lag("n").over(w), "mean_before": F.lag("mean").over(w)}).where("n_before is not null")
    dn, dm = F.col("n") - F.col("n_before"), F.col("mean") - F.col("mean_before")
    return c.select(
        snapshot, dn.alias("count_change"), F.round(F.when(F.col("n_before") == 0, F.when(F.col("n") > 0, 100.0).otherwise(0.0)).otherwise(100.0 * dn / F.col("n_before")), 2).alias("count_pct"), F.round(dm, 4).alias("mean_change"), F.round(F.when(F.col("mean_before") == 0, 0.0).otherwise(100.0 * dm / F.abs("mean_before")), 2).alias("mean_pct")
    )


def snapshot_matches(first: DataFrame, last: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Features of both snapshots by id as text; of repeated ids the last row of each counts. Status added, removed, changed, same."""

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col(key).cast("string").alias("id")).agg(F.max_by(value, order).alias(name))

    both = one(first, "before").join(one(last, "after"), "id", "full")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return both.withColumn("status", status)


def temporal_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share of values that are instants, name bonus, confidence (0.7 share + 0.3 name) and candidacy (0.4 or more)."""
    hints = ("time", "date", "year", "day", "month", "created", "updated", "ts")
    stats = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), F.when(parse_instant(F.col(c)).isNotNull(), 1.0).otherwise(0.0))).alias(f"s{i}") for i, c in enumerate(columns)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"s{i}"), F.lit(0.0)).alias("share"), F.col(f"n{i}").alias("n_values"), F.lit(1.0 if any(h in c.lower() for h in hints) else 0.0).alias("bonus")) for i, c in enumerate(columns)])
    got = stats.select(F.explode(rows).alias("r")).select("r.*")
    confidence = F.when(F.col("n_values") == 0, 0.0).otherwise(0.7 * F.col("share") + 0.3 * F.col("bonus") * F.signum("share"))
    return got.select("field", "n_values", F.round("share", 4).alias("share"), F.round(confidence, 4).alias("confidence"), (confidence >= 0.4).alias("candidate"))
