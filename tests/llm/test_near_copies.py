"""Near copies against brute-force Jaccard of five-word shingles."""

import random

import pyarrow as pa

from terralith.llm import near_copies
from terralith.llm.near_copies import drop_near_duplicates, near_components

from . import brute


def shingles(text, n=5):
    words = brute.SPACE.findall((text or "").translate(brute.LOWER))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)} if words else set()


def components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, x) in enumerate(sets):
        for e, y in sets[i + 1 :]:
            if 5 * len(x & y) >= 4 * len(x | y) and (a := find(d)) != (b := find(e)):
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in docs}


def texts():
    """Copies of similarities from 0.6 to 1, chains of them, one large group, and a passage in all texts."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    out, passage = [None, "", " \n", "one", "One", "one two", " ".join(text(5)) * 2], text(60)
    for _ in range(120):
        base = text(300)
        out.append(" ".join(base))
        for edits in (2, 4, 6, 7, 8, 10, 14):
            base = base if r.random() < 0.7 else text(300)
            copy = list(base)
            for at in r.sample(range(300), edits):
                copy[at] = "new" + str(r.random())
            out.append(" ".join(copy))
    base = text(200)
    for _ in range(150):
        copy = list(base)
        for at in r.sample(range(200), 4):
            copy[at] = "new" + str(r.random())
        out.append(" ".join(copy))
    out += [" ".join(passage + text(n)) for n in range(5, 45)]
    r.shuffle(out)
    return [(7 * i % 2003, t) for i, t in enumerate(out)]


def test_components(spark):
    docs = texts()
    got = dict(near_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect())
    want = components(docs)
    assert len(got) == len(docs) and got == want
    assert 200 < len(set(want.values())) < len(docs) - 200


def test_drop(spark):
    """Near copies beyond 7 bits go; texts below the similarity stay."""
    docs = texts()
    kept = drop_near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in docs] + [(None, "one", "x")] * 2, "doc_id long, text string, kind string"))
    assert kept.columns == ["doc_id", "text", "kind"]
    assert sorted(r[0] for r in kept.where("doc_id is not null").collect()) == sorted(set(components(docs).values()))
    assert kept.where("doc_id is null").count() == 2


def test_short_texts_in_large_blocks(spark):
    """One text of eight words, and forty that add a word to it: each is a near copy of the first."""
    r = random.Random(5)
    docs = [(0, "a b c d e f g h")] + [(i, f"a b c d e f g h x{i}") for i in range(1, 41)]
    assert set(dict(near_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()).values()) == {0}
    # a common start, and sets of 1 to 100 shingles with few or many of them changed
    for size in (1, 2, 5, 9, 16, 24, 40, 70, 100):
        start = [f"s{size}w{i}" for i in range(size + 4)]
        for k in range(24):
            copy = list(start) + [f"e{r.random()}" for _ in range(r.choice([0, 1, 1, max(size // 4, 1), size // 5]))]
            docs.append((1000 * size + k + 100, " ".join(copy[: max(len(copy) - r.choice([0, 0, 1, size // 8]), 1)])))
    got = dict(near_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect())
    assert got == components(docs)


def test_map_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", {"k": 2}, [{"m": 1}]), (1, "a b c", {"k": 1}, None), (2, "a b c", {}, None), (None, "x", {"k": 3}, None)], "doc_id long, text string, extra map<string,int>, more array<map<string,int>>")
    kept = drop_near_duplicates(docs).collect()
    assert sorted((x["doc_id"] or 0, x["text"], x["extra"]) for x in kept) == [(0, "x", {"k": 3}), (1, "a b c", {"k": 1})]


def test_passage_that_no_partition_has_often(spark, monkeypatch):
    """Twelve texts share a passage, at most two in a partition: it comes last in the order, so no large block is left open."""

    def none(*_):
        raise AssertionError("a block was left open")

    monkeypatch.setattr(near_copies, "_wide_prints", none)
    r = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join([f"d{r.random()}" for _ in range(200)] + (passage if i % 10 == 0 else []))) for i in range(120)]
    docs.append((200, docs[50][1] + " more"))
    got = dict(near_components(spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(12, "doc_id")).collect())
    assert got == {i: i for i in range(120)} | {200: 50}


def test_blocks_within_others():
    """Of blocks that begin with one member, one within another goes, and none that has a pair of its own."""
    blocks = [[1, 2, 3], [1, 2], [1, 3, 4], [1, 4], [1, 2, 3, 5]]
    rows = [[{"sid": s, "fp": 0, "n": 9, "root": s} for s in x] for x in blocks]
    got = near_copies._largest(pa.table({"members": pa.array(rows, near_copies._FOUND.field("members").type)}))
    assert sorted([m["sid"] for m in x] for x in got["members"].to_pylist()) == [[1, 2, 3, 5], [1, 3, 4]]
