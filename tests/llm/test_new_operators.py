"""Search, repair and language identification: hot terms, ties, long conversations, few labels."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from terralith.llm import language_id, lexical_search, quality_rules, structure_repair
from terralith.sources.store import shared_count

from . import brute


@pytest.mark.parametrize("shard_bytes, block_bytes", [(200, 1 << 24), (1 << 22, 400)])
def test_search_shards_and_blocks(spark, monkeypatch, shard_bytes, block_bytes):
    """Small shards, several blocks of items, ties, copies, repeated and null ids."""
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard_bytes)
    r = random.Random(3)
    word = lambda: f"W{min(int(r.expovariate(0.3)), 40)}"
    docs = [(i, " ".join(word() for _ in range(r.randrange(0, 30)))) for i in range(150)]
    docs += [(500 - i, "W9 same W9 text") for i in range(40)] + [(None, "W9 same W9 text"), (None, None), (7, "W9 w9 W9"), (7, "")]
    items = [(i, " ".join(word() for _ in range(r.randrange(0, 9)))) for i in range(25)] + [(3, "same W9"), (3, "same W9"), (None, "text"), (40, None), (41, "W9 W9 W9 same nowhere")]
    got = lexical_search.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute.search(docs, items), key=repr)


def test_search_stops_early_and_is_exact():
    r = np.random.default_rng(5)
    n_docs, size = 4000, 30
    keys = np.unique(r.integers(0, n_docs * size, 60_000))
    docs, terms = keys // size, keys % size
    tfs = r.geometric(0.5, len(keys))
    impact = lexical_search.impacts(r.integers(5, 400, n_docs), docs, terms, tfs, r.integers(1, 9000, size), n_docs, n_docs * 200)
    shard = lexical_search.Shard(n_docs, docs, terms, impact, size)
    for _ in range(40):
        asked = np.sort(r.choice(size, r.integers(1, 8), replace=False))
        times = r.integers(1, 4, len(asked))
        weight = np.zeros(size, np.int64)
        weight[asked] = times
        full = np.zeros(n_docs, np.int64)
        np.add.at(full, docs, weight[terms] * impact)
        least = int(np.sort(full)[-10])
        found, scores = shard.best(asked, times, 10, 1)
        assert (scores == full[found]).all() and set(np.flatnonzero(full >= max(least, 1))) <= set(found.tolist())
        above, _ = shard.best(asked, times, 10, int(full.max()))
        assert set(np.flatnonzero(full == full.max())) <= set(above.tolist())


def test_impacts_do_not_wrap():
    got = lexical_search.impacts(np.array([10**9, 3]), np.array([0, 1]), np.array([0, 0]), np.array([5, 1]), np.array([7]), 10**10, 10**13)
    assert got.tolist() == [7 * (5 * 10**9 // (5000 + 8 * (25 + 75 * 10**9 * 10**10 // 10**13))), 7 * (10**9 // (1000 + 8 * 25))]


def test_repair_of_random_and_long_conversations(spark):
    r = random.Random(9)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "up"], ["", " \n", "Yes.", "No", "what?", "end! ", None, "x", "yes.\t", "中文。", "ok!"]
    rows = [(c, r.choice([None, t, t, t, t // 2]), r.choice(roles[: 2 + c % 6]), r.choice(texts) if c % 3 else f"{c} {t}.") for c in range(300) for t in range(r.randrange(1, 12))]
    rows += [(None, t, "user", f"{t}?") for t in range(4)]
    rows += [(1000, t, r.choice(roles[:3]), r.choice([f"{t}.", f"{t}", "Yes."])) for t in range(5000)]
    rows += [(1001, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(2600)] + [(1002, 1, "user", "same.")] * 2500
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    conversations, repaired = structure_repair.repair_conversations(structure_repair.damaged(frame))
    digests = {x["conv_id"]: x["repaired_sha256"] for x in structure_repair.repaired_digests(repaired).collect()}
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    got = [(*x, digests.get(x[0], brute.sha(""))) for x in map(tuple, conversations.select(*columns).collect())]
    want = [x for x in brute.repair(rows) if x[7] or x[0] in {g[0] for g in got}]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(next(x for x in got if x[0] == 1000)[7]) > 3 * 1024
    kept = {x["edit"] for x in repaired.select("edit").distinct().collect()}
    assert kept == {"I", "K", "R"} or kept == {"K", "R"}


def test_repair_inserts():
    """Cases in which an empty turn is the cheapest edit are cheaper than any deletion only between truncated-free rows."""
    costs, orders, labels = structure_repair.segment_paths([bytes([4 * 1, 4 * 1]), bytes([4 * 2]), bytes([4 * 0 + 3])])
    assert costs.shape == (3, 4, 4) and labels[0][4 * 0 + 2] == "DK" and labels[1][4 * 0 + 3] == "IK" and costs[1, 0, 3] == 5
    assert labels[2][4 * 0 + 0] == "D" and costs[2, 0, 1] == 5


@pytest.mark.parametrize("langs", [[], ["en"], ["en", "fr"], ["en", "de", "xx"], ["en", "de", "fr", "es", "ru"]])
def test_language_with_few_labels(spark, langs):
    said = {"en": "the house and the river were quiet that evening", "de": "das haus und der fluss waren an diesem abend still", "fr": "la maison et la rivière étaient calmes ce soir", "es": "la casa y el río estaban tranquilos esa noche", "ru": "дом и река были тихими в тот вечер", "xx": "qq zzk wwq kkz vvq"}
    r = random.Random(1)
    text = lambda x: " ".join(r.choices(said[x].split(), k=12))
    labelled = spark.createDataFrame([(text(x), x) for x in langs for _ in range(30)] + [("123", "en" if langs else None), (None, None), ("", None), ("loose words", None)], "text string, lang string")
    models = language_id.learn(language_id.training_rows(labelled, 20), 20)
    asked = [(text(x), x, "p") for x in langs for _ in range(10)] + [(None, "und", "p"), ("", "und", "p"), ("12 !? \U0001f600", "und", "p"), ("a", None, "p")]
    got = language_id.predict_language(spark.createDataFrame(asked, "text string, want string, lang_pred string"), models).collect()
    assert got[0].asDict().keys() == {"text", "want", "lang_pred", "score"}
    for row in got:
        assert 0 <= row["score"] <= 1
        if row["want"]:
            assert row["lang_pred"] == row["want"]
        else:
            assert row["lang_pred"] in (langs or ["und"])


def test_families():
    assert language_id.family_of("pt-BR") == "romance" and language_id.family_of("EN_us") == "germanic" and language_id.family_of("tlh") == "tlh"


def test_quality_moves_no_text(spark, tmp_path):
    """The rules' order is measured where the rows are read, and no rule makes a string of each letter of a text."""
    spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("Ab \U00010400 \u00c4\u00df#"), F.col("id"), F.uuid()).alias("text")).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    before = shared_count(spark)
    out = quality_rules.quality_cascade(docs, metrics=False)
    assert shared_count(spark) == before and not re.search("(?i)regexp_extract_all|regexp_count|TakeOrdered", str(out._jdf.queryExecution().executedPlan()))
    for others, kind in ((r"\P{L}", r"\p{L}"), (r"\P{Lu}", r"\p{Lu}"), ("[^#*$%&|<>]", "[#*$%&|<>]")):
        assert not docs.where(~quality_rules.count_of(F.col("text"), others).eqNullSafe(F.regexp_count("text", F.lit(kind)))).head(1)


def test_repeated_windows_twice(spark):
    texts = ["a b c d", "a b c a b c", "x x x x x", "a b c", "", None, "a b c d a b c", "p q r s p q r s t q r s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_repeat_words"] for r in quality_rules.base_metrics(docs).orderBy("doc_id").collect()] == [0, 6, 5, 0, 0, 0, 6, 11]


def test_rule_order(spark):
    """Rejections per cost decide, then cost, then name; the same each time, and no verdict depends on it."""
    words = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, words + " ###" * 40 if i % 2 else words) for i in range(80)] + [(100 + i, "\n".join(["same line of some words here"] * 30)) for i in range(8)] + [(200, None), (201, "")], "doc_id long, text string").repartition(3)
    every = lambda m: quality_rules.base_rules(m) | quality_rules.default_rules(m)
    order = quality_rules.rule_order(docs, every)
    assert order == quality_rules.rule_order(docs, every)
    assert order.index("symbols_per_word") < order.index("repeated_windows") and order.index("few_words") < order.index("few_letters")
    assert order.index("mean_word_long") < order.index("mean_word_short") < order.index("capitals")  # nothing rejected: by cost, then by name
    cheap = quality_rules.rule_order(docs, lambda m: {"b": F.lit(True), "a": F.lit(True), "c": F.col("text").isNull()}, work=lambda m: {"a": F.lit(5.0), "b": F.lit(5.0), "c": F.lit(1.0)})
    assert cheap == ["a", "b", "c"]
    kept = {r["doc_id"]: (r["kept"], r["rejected_by"]) for r in quality_rules.quality_cascade(docs).collect()}
    assert [kept[0], kept[1][0], kept[100][0], kept[200][0]] == [(True, None), False, False, False]
