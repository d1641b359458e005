"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words and fail. Repeated rows are judged
alike, each row by itself. Extra columns are kept; the columns that this module adds replace columns of
the same names. An empty table gives an empty result.

The cascade first measures, on a random sample of the whole table (about `SAMPLE_ROWS` rows, drawn and measured where they
are read, so that no text is moved), what share of rows each rule rejects and how much work it is for a row (`rule_work`), and then tests the rules in the order of rejection per cost, the base
rules among them; a row that a rule rejects is not tested by the later ones (CASE WHEN is lazy). The order never
changes a verdict, only the work and which rule is named. With `metrics`, the base metrics are columns of the result and computed for every row; without, a
rule's metrics are only computed where the row gets that far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import read_table

MIN_WORDS = 50
#: Rows of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 1000

#: White space between words, for regular expressions.
SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, although body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def count_of(text: Column, others: str) -> Column:
    """Characters of text that are not of the class `others`: what is left is one string, not one for each match as in regexp_count."""
    return F.char_length(F.regexp_replace(text, f"{others}+", ""))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, the first included. Only the windows of a text that has such ones are sorted."""
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def positions(hashed: Column) -> Column:
        pairs = F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        twice = _let(F.sort_array(pairs), lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.when(b.isNull(), F.lit(3)).otherwise(F.least(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def counted(hashed: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0)).otherwise(_let(positions(hashed), total))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, lambda w: _let(hashes(w), counted))).cast("long")


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metric_columns() -> dict[str, Column]:
    """The base metrics of the column `text`, as long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    words = words_of(F.col("text"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))).cast("long"),
        "n_symbols": count_of(text, "[^#*$%&|<>]").cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def base_metrics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in METRICS])
    return docs.select("*", *[c.alias(name) for name, c in metric_columns().items()])


Rules = Callable[[dict[str, Column]], dict[str, Column]]


def base_rules(m: dict[str, Column]) -> dict[str, Column]:
    return {"few_words": m["n_words"] < MIN_WORDS, "repeated_windows": 100 * m["n_repeat_words"] > 50 * m["n_words"]}


def default_rules(m: dict[str, Column]) -> dict[str, Column]:
    """Rules over the base metrics and the text; true rejects. None of them concerns the language of a text."""
    letters = count_of(F.col("text"), r"\P{L}")
    return {
        "symbols_per_word": 10 * m["n_symbols"] > 3 * m["n_words"],
        "mean_word_short": m["word_chars"] < 2 * m["n_words"],
        "mean_word_long": m["word_chars"] > 14 * m["n_words"],
        "duplicate_lines": 2 * m["n_dup_lines"] > F.size(F.split("text", "\n")),
        "few_letters": 2 * letters < m["word_chars"],
        "capitals": 2 * count_of(F.col("text"), r"\P{Lu}") > letters,
    }


def rule_work(m: dict[str, Column]) -> dict[str, Column]:
    """What a rule takes for a row, besides counting the words, in units of splitting one character into words (factors measured once, over 68 million characters)."""
    chars = F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("double")
    return {
        "few_words": chars,
        "repeated_windows": chars + 40 * m["n_words"],
        "symbols_per_word": chars,
        "mean_word_short": 1.6 * chars,
        "mean_word_long": 1.6 * chars,
        "duplicate_lines": 0.5 * chars,
        "few_letters": 3 * chars,
        "capitals": 2.1 * chars,
    }


def rule_order(docs: DataFrame, rules: Rules, sample_rows: int = SAMPLE_ROWS, work: Rules = rule_work) -> list[str]:
    """Names of the rules by rejection per cost on a random sample of about `sample_rows` of docs, the highest first; rules that reject nothing there by cost alone, then by name.

    The cost of a rule is the mean of its `work` over the sample's rows; one that has none there is taken for a regular expression. Costs and
    selectivities come from one aggregation, so the order is the same each time.
    """
    rows = docs.count()
    sample = docs.select("text").where(F.rand(17) < sample_rows / rows) if rows > sample_rows else docs.select("text")
    metrics = metric_columns()
    every, costs = rules(metrics), work(metrics)
    usual = 2 * F.char_length(F.coalesce(F.col("text"), F.lit("")))
    found = sample.agg(*(F.avg(F.coalesce(rule, F.lit(False)).cast("double")).alias(f"share_{i}") for i, rule in enumerate(every.values())), *(F.avg(costs.get(name, usual)).alias(f"cost_{i}") for i, name in enumerate(every))).head()
    scores = {name: ((found[f"share_{i}"] or 0.0) / (cost := max(found[f"cost_{i}"] or 0.0, 1.0)), -cost) for i, name in enumerate(every)}
    return sorted(every, key=lambda n: (-scores[n][0], -scores[n][1], n))


def quality_cascade(docs: DataFrame, rules: Rules | None = None, sample_rows: int = SAMPLE_ROWS, metrics: bool = True) -> DataFrame:
    """docs with `kept` and `rejected_by` (the rule that fired, else null), and with metrics the base metrics and `base_failed`."""
    own = ["base_failed", "kept", "rejected_by"]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in own])
    every = lambda m: base_rules(m) | (rules or default_rules)(m)
    order = rule_order(docs, every, sample_rows)
    if metrics:
        measured, values = base_metrics(docs), {name: F.col(name) for name in METRICS}
    else:
        measured, values = docs, metric_columns()

    def verdict(n_words: Column) -> Column:
        out, tested = F.lit(None).cast("string"), every(values | {"n_words": n_words})
        for name in reversed(order):
            out = F.when(F.coalesce(tested[name], F.lit(False)), F.lit(name)).otherwise(out)
        return out

    # most rules ask for the words' number: it is counted once
    out = measured.withColumn("rejected_by", verdict(values["n_words"]) if metrics else _let(values["n_words"], verdict))
    if metrics:
        failed = list(base_rules(values).values())
        out = out.withColumn("base_failed", failed[0] | failed[1])
    return out.withColumn("kept", F.col("rejected_by").isNull())


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
