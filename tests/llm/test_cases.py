"""Cases that the small tables do not hold: colliding hashes, hot groups, small blocks, long texts, damaged input."""

import io
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import chat, decontaminate, pii, quality_rules, simhash, substring_dedup, suffix_dedup, token_counts, warc
from terralith.llm.run_index import RunIndex
from terralith.llm.tokens import default_tokenizer

from . import brute
from .conftest import rows_of


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind).repartition(3)


def thue_morse(n):
    """Words of 2 ** n letters that collide under any polynomial hash modulo 2 ** 64 with an odd base."""
    x = "ab"
    for _ in range(n - 1):
        x += x.translate({97: 98, 98: 97})
    return x, x.translate({97: 98, 98: 97})


def test_words_that_collide(spark):
    one, other = thue_morse(11)
    text = lambda w: " ".join([f"w{i}" for i in range(30)] + [w] + [f"v{i}" for i in range(30)])
    docs = [(1, text(one)), (2, text(other)), (3, text(one))]
    got = substring_dedup.remove_repeats(frame(spark, docs)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    assert sorted(map(tuple, got.collect())) == sorted(brute.substring(docs))
    items = [(7, " ".join([one] * 13))]
    got = decontaminate.contamination(frame(spark, [(1, " ".join([other] * 13)), (2, " ".join([one] * 13))]), frame(spark, items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in got.collect()) == [(1, 0, []), (2, 13, [7])]


def test_items_without_id_and_several_passes(spark, tables):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(30)]
    items = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[3] + " w1"), (77, texts[3])]
    docs = [(i, " ".join(r.choice(words) for _ in range(20)) + " " + texts[i % 30] + " x " + texts[(7 * i) % 30]) for i in range(40)] + [(50, None), (51, texts[0]), (51, texts[1])]
    want = sorted((x[0], x[1], x[2], x[3]) for x in brute.contamination(docs, [x for x in items if x[0] is not None]))
    one = decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    many = decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"), block_bytes=900)
    columns = ("doc_id", "text", "n_words", "spans", "items", "n_hit", "contaminated")
    rows = [sorted(map(str, x.select(*columns).collect())) for x in (one, many)]
    assert rows[0] == rows[1]
    assert sorted((x["doc_id"], x["n_words"], x["n_hit"], len(x["items"])) for x in one.collect()) == want


@pytest.mark.parametrize("hot_runs", [1, 4, 2048])
def test_suffix_hot_anchors(spark, hot_runs):
    """Salted anchors give the same marks; one line in most texts, copies and near copies."""
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, base = text(60), text(900)
    docs = [(i, text(70) + line + text(70)) for i in range(60)] + [(100 + i, base) for i in range(20)] + [(200 + i, base[: 30 * i] + "#" + base[30 * i :]) for i in range(1, 25)]
    docs += [(300, "ab" * 500), (301, "ab" * 400), (302, ""), (303, None), (304, base), (304, line), (304, "x" + base)]
    r.shuffle(docs)
    got = suffix_dedup.remove_repeats(frame(spark, docs), hot_runs=hot_runs)
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == sorted(brute.suffix(docs))


def test_run_index():
    r = random.Random(2)
    for t in range(60):
        width, letters = r.choice([2, 3, 5, 8]), b"ab" if t % 2 else b"abcd"
        pieces = [bytes(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(1, 8))]
        owners = np.array([r.randrange(100) for _ in pieces])
        asked = [bytes(r.choice(letters + b"z" * (t % 5 == 0)) for _ in range(r.randrange(1, 60))) for _ in range(6)] + [pieces[0] + pieces[-1]]
        got = {(int(w), len(asked[w]) - back): int(o) for back, which, least in RunIndex(pieces, owners, width).stream(asked) for w, o in zip(which, least, strict=True)}
        want = {}
        for w, x in enumerate(asked):
            for i in range(len(x) - width + 1):
                if found := [int(o) for o, p in zip(owners, pieces, strict=True) if x[i : i + width] in p]:
                    want[w, i] = min(found)
        assert got == want


@pytest.mark.parametrize("part", ["token", "token=", "://", "a://", "@", "a@", "+", "+1", "1", "1.", "1-", "a://u:p@h", "%"])
def test_pii_is_linear(part):
    """A megabyte of anchors takes seconds."""
    text = part * (1_000_000 // len(part))
    began = time.perf_counter()
    pii.spans_in(text)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_token_blocks(spark, tmp_path, block):
    """Documents across any number of blocks, and files that begin or end with a separator."""
    docs = [(i, " ".join(["word"] * n)) for i, n in enumerate([0, 1, 5, 130, 2, 0, 0, 64, 7])] + [(20, None)]
    folder = f"file://{tmp_path}/tokens"
    manifest = token_counts.tokenize_to_files(frame(spark, docs), folder, default_tokenizer())
    got = token_counts.token_counts(token_counts.scan_blocks(spark, manifest.select("file", "n_ids"), folder, block=block))
    order = manifest.select("file", F.posexplode("docs").alias("ordinal", "doc_id"))
    rows = {r["doc_id"]: r["n_tokens"] for r in order.join(got, ["file", "ordinal"]).collect()}
    assert rows == {d: len((t or "").split()) + 1 for d, t in docs}


def test_simhash_small_groups(spark, monkeypatch):
    """Groups that are dealt anew link the same fingerprints."""
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 3)
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 1, 2, 3, 4) for _ in range(6)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.link_forest(spark.createDataFrame([(v,) for v in signed], "fp long"), 2).collect()

    def classes(pairs):
        root = {v: v for v in signed}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for v in signed:
            groups.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    assert classes([(x["src"], x["dst"]) for x in links]) == classes(near)
    assert all(((x["src"] ^ x["dst"]) & ((1 << 64) - 1)).bit_count() <= 2 * len(signed) for x in links)


def test_ring_close():
    r = np.random.default_rng(3)
    one = np.uint64(r.integers(0, 1 << 63))
    for most in (0, 2, 7, 24):
        fps = np.array([one ^ np.uint64(sum(1 << int(k) for k in r.choice(64, n, replace=False))) for n in range(65) for _ in range(40)], np.uint64)
        assert simhash.ring_close(fps, one, most).tolist() == np.flatnonzero(np.bitwise_count(fps ^ one) <= most).tolist()


def test_quality_verdict(spark, tables):
    """kept is the verdict of all rules, in whatever order the cascade takes them."""
    docs = rows_of(tables, "documents", "doc_id", "text")
    base = {x[0]: x for x in brute.quality(docs)}
    letters = lambda t: sum(c.isalpha() for c in t)

    def kept(doc, text):
        text = text or ""
        _, n, chars, symbols, dup, _, failed = base[doc]
        upper = sum(c.isupper() for c in text)
        return not (failed or 10 * symbols > 3 * n or chars < 2 * n or chars > 14 * n or 2 * dup > len(text.split("\n")) or 2 * letters(text) < chars or 2 * upper > letters(text))

    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_cascade(spark.read.parquet(f"{tables}/documents.parquet")).select("doc_id", "kept").collect()}
    assert got == {d: kept(d, t) for d, t in docs}


def test_chat_intervals(spark, tables):
    """Each conversation attends, before its own stretch, exactly to the tokens of its turns that others emit."""
    turns = [(1, 0, "user", "hello there"), (1, 1, "assistant", "hi"), (1, 2, "user", "more")]
    turns += [(2, *t[1:]) for t in turns[:2]] + [(2, 2, "user", "other")] + [(3, 0, "user", "hello there")] + [(4, 0, "user", "alone")]
    turns += [(5, *t[1:]) for t in turns[:3]] + [(5, 3, "assistant", "deep")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(table)
    coder = chat.byte_coder(chat.default_tokenizer())
    tokens = {}
    for r in got.turns.collect():
        for k, token in enumerate(r["ids"]):
            assert tokens.setdefault((r["tree1"], r["tree2"], r["start"] + k), token) == token
    by = {}
    for t in turns:
        by.setdefault(t[0], []).append(t)
    rows = {r["conv_id"]: r for r in chat.attention(got).collect()}
    assert rows.keys() == by.keys()
    for conv, r in rows.items():
        read = [tokens[r["tree1"], r["tree2"], k] for x in r["intervals"] for k in range(x["start"], x["end"])]
        assert coder.decode(read) == "".join("".join(chat.formatted(role, text)) for _, _, role, text in by[conv])
        ends = [x["end"] for x in r["intervals"]]
        assert all(a < x["start"] for a, x in zip(ends, r["intervals"][1:], strict=False))
    assert len(tokens) == sum(len(r["ids"]) for r in got.turns.collect())  # every shared turn once


def test_warc_damage(spark):
    one = warc.record(1, "http://a/", b"<p>one</p>", warc.sha1(b"<p>one</p>"), None)
    two = warc.record(2, "http://b/", b"<p>one</p>", warc.sha1(b"<p>one</p>"), 1)
    assert [f["warc-type"] for f, _ in warc.records(io.BytesIO(one + two))] == ["response", "revisit"]
    raw = zlib.decompress(one, 31)
    packed = lambda x: (lambda z: z.compress(x) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for bad in (one[:-9], one + two[:20], packed(raw[:-6]), packed(raw.replace(b"<p>one", b"<p>two")), packed(b"no header\r\n\r\n")):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.records(io.BytesIO(bad)))


def test_warc_short_payloads_and_many_archives(spark, tmp_path):
    pages = [(i, f"http://x/{i}", ["<p>" + "a" * 40, "short", None][i % 3]) for i in range(60)]
    folder = f"file://{tmp_path}/warc"
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write_archives(table, folder, dedup_bytes=10, archive_bytes=500)
    assert manifest.count() > 10
    got = warc.read_archives(spark, manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect())) == sorted(brute.warc([(p, h) for p, _, h in pages], 10))
