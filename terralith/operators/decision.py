"""Scenarios and scores: metric changes, confidence, decay, Pareto fronts, source quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_delta(df: DataFrame, baseline: str, low: str, expected: str, high: str, interval: str = "pct") -> DataFrame:
    """Adds simulated, its range, delta_abs and delta_pct of a rule's (min, expected, max); all null without a baseline, delta_pct null for a baseline of 0."""
    b = F.col(baseline)
    of = (lambda c: b * (1 + F.col(c))) if interval == "pct" else (lambda c: b + F.col(c))
    delta = of(expected) - b
    pct = F.col(expected) * 100.0 if interval == "pct" else delta / b * 100.0
    return df.withColumns({"simulated": F.bround(of(expected), 4), "range_min": F.bround(of(low), 4), "range_max": F.bround(of(high), 4), "delta_abs": F.bround(delta, 4), "delta_pct": F.when(b != 0, F.bround(pct, 4))})


def confidence(baseline: Column, evidence_mean: Column, evidence_n: Column, rules_mean: Column) -> Column:
    """0.35 baseline + 0.35 evidence + 0.30 rules, within [0, 1]; evidence grows by 0.05 a piece up to four, 0.6 without any; rules 0.75 without any."""
    evidence = F.when(evidence_n > 0, F.least(F.lit(1.0), evidence_mean * (0.8 + 0.05 * F.least(evidence_n, F.lit(4))))).otherwise(0.6)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(0.35 * baseline + 0.35 * evidence + 0.30 * F.coalesce(rules_mean, F.lit(0.75)), 4)))


def distance_decay(distance: Column, most: float, radius: float) -> Column:
    if radius <= 0:
        raise ValueError("the decay radius must be positive")
    return most * F.exp(-distance / radius)


def step_decay(distance: Column, direct: float = 500.0, indirect: float = 1500.0, direct_delta: float = 20.0, indirect_delta: float = 10.0) -> Column:
    return F.when(distance <= direct, direct_delta).when(distance <= indirect, indirect_delta).otherwise(0.0)


def pareto_front(options: DataFrame, goals: dict[str, str], key: str = "id") -> DataFrame:
    """Options that no other dominates over maximize/minimize columns; a null carries no comparison; if all are dominated, all.

    Meant for scenario tables: options with equal values are compared once, by their distinct values.
    """
    values = options.select(*goals).distinct()
    a, b = values.select(*[F.col(c).alias(f"a_{c}") for c in goals]), values.select(*[F.col(c).alias(f"b_{c}") for c in goals])
    better, worse = F.lit(False), F.lit(False)
    for c, goal in goals.items():
        up = F.coalesce(F.col(f"b_{c}") > F.col(f"a_{c}"), F.lit(False))
        down = F.coalesce(F.col(f"b_{c}") < F.col(f"a_{c}"), F.lit(False))
        better, worse = better | (up if goal == "maximize" else down), worse | (down if goal == "maximize" else up)
    kept = a.join(b, better & ~worse, "left_anti").select(*[F.col(f"a_{c}").alias(c) for c in goals])
    same = None
    for c in goals:
        t = options[c].eqNullSafe(kept[c])
        same = t if same is None else same & t
    front = options.join(kept, same, "left_semi")
    return front if front.limit(1).count() else options


def recommend(options: DataFrame, front: DataFrame, goals: dict[str, str], key: str = "id", confidence: str = "confidence") -> DataFrame:
    """Options by score: Σ ±delta_pct (null skipped), + 10 on the front, times 0.5 + 0.5 confidence, 2 places; ties by key."""
    score = F.lit(0.0)
    for c, goal in goals.items():
        score = score + F.coalesce(F.col(c) if goal == "maximize" else -F.col(c), F.lit(0.0))
    marked = options.join(front.select(key).withColumn("on_front", F.lit(True)), key, "left").withColumn("on_front", F.coalesce("on_front", F.lit(False)))
    out = marked.withColumn("score", F.bround((score + F.when(F.col("on_front"), 10.0).otherwise(0.0)) * (0.5 + 0.5 * F.col(confidence)), 2))
    return out.select(key, "on_front", "score").orderBy(F.desc("score"), key)


def trade_offs(options: DataFrame, metrics: list[str], least: float = 5.0) -> DataFrame:
    """Metrics whose spread (max - min) / max(|min|, 1) is over `least` percent."""
    agg = options.agg(*[F.min(m).alias(f"lo_{m}") for m in metrics], *[F.max(m).alias(f"hi_{m}") for m in metrics])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"lo_{m}").cast("double").alias("low"), F.col(f"hi_{m}").cast("double").alias("high")) for m in metrics])
    spread = 100.0 * (F.col("high") - F.col("low")) / F.greatest(F.abs("low"), F.lit(1.0))
    return agg.select(F.explode(rows).alias("r")).select("r.*").withColumn("spread_pct", F.round(spread, 2)).where(spread > least)


def thematic_score(intent: str, title: Column, description: Column, tags: Column, fields: Column) -> Column:
    """Share of the intent's words in title (0.7) and description (0.3), weighed 0.6, and in tags (0.6) and fields (0.4), weighed 0.4."""
    words = F.array_distinct(F.split(F.lower(F.trim(F.lit(intent))), r"\s+"))
    n = F.greatest(F.size(words), F.lit(1))
    share = lambda other: F.size(F.array_intersect(words, other)) / n
    of = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")
    meaning = F.least(F.lit(1.0), share(of(title)) * 0.7 + share(of(description)) * 0.3)
    keys = F.least(F.lit(1.0), share(tags) * 0.6 + share(fields) * 0.4)
    return F.bround(F.least(F.lit(1.0), meaning * 0.6 + keys * 0.4), 4)


def timeliness(months: Column, rate: float = 0.05) -> Column:
    return F.exp(-rate * F.greatest(months, F.lit(0.0)))


def source_score(temporal: Column, thematic: Column, spatial: Column, field: Column, precision: Column) -> Column:
    return F.bround(0.20 * temporal + 0.30 * thematic + 0.20 * spatial + 0.15 * field + 0.15 * precision, 4)


def impact_midpoints(rules: DataFrame, scale: float = 1.0) -> DataFrame:
    """rules (scenario, metric, zone, low, high): the interval's middle times the scale, as `impact`."""
    return rules.select("scenario", "metric", "zone", (((F.col("low") + F.col("high")) / 2) * scale).alias("impact"))
