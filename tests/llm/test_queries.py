"""The numbered queries against their contracts in plain Python, over small tables with odd rows."""

import unicodedata
import zlib

import numpy as np
import pytest

from terralith.llm import chat
from terralith.llm.registry import QUERIES
from terralith.llm.tokens import default_tokenizer

from . import brute
from .conftest import rows_of


def query(name, spark, where, *columns):
    return sorted(map(tuple, QUERIES[name](spark, where).select(*columns).collect()), key=repr)


def same(got, want):
    want = sorted(want, key=repr)
    assert [x for x in got if x not in set(want)][:3] == [] and len(got) == len(want)
    assert got == want


def test_chat(spark, tables):
    said = "</s>[INST] ok [/INST]"
    rows = rows_of(tables, "conversations", "conv_id", "turn", "role", "text") + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = query("op1_chat", spark, tables, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    same(got, brute.chat(rows, chat.formatted).values())


def test_decontaminate(spark, tables):
    want = brute.contamination(rows_of(tables, "documents", "doc_id", "text"), rows_of(tables, "benchmark", "item_id", "text"))
    assert sum(x[-1] for x in want) > 3
    same(query("op2_decontaminate", spark, tables, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), want)


def test_substring(spark, tables):
    want = brute.substring(rows_of(tables, "documents", "doc_id", "text"))
    assert sum(x[2] > 0 for x in want) > 10
    same(query("op3_substring_dedup", spark, tables, "doc_id", "n_words", "n_removed", "kept_sha256"), want)


def test_warc(spark, tables):
    want = brute.warc(rows_of(tables, "pages", "page_id", "html"))
    same(query("op4_warc", spark, tables, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), want)


def test_packing(spark, tables):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(default_tokenizer())
    ids = {d: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in rows_of(tables, "documents", "doc_id", "text")}
    got = query("op5_packing", spark, tables, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    at = {}
    for doc, start, length, crc, n, _, _ in sorted(got):
        assert start == at.get(doc, 0) and length > 0 and n == len(ids[doc])
        assert crc == zlib.crc32(ids[doc][start : start + length].tobytes())
        at[doc] = start + length
    assert at == {d: len(x) for d, x in ids.items()}
    fill = {}
    for *_, length, _, _, sequence, offset in sorted((x[5], x[6], x[2], 0, 0, x[5], x[6]) for x in got):
        assert offset == fill.get(sequence, 0)
        fill[sequence] = offset + length
    assert max(fill.values()) <= 4096
    assert len(fill) == -(-sum(map(len, ids.values())) // 4096)


def test_token_counts(spark, tables):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(default_tokenizer())
    coder.encode_special_tokens = True
    want = [(d, len(coder.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows_of(tables, "documents", "doc_id", "text")]
    same(query("op6_token_counts", spark, tables, "doc_id", "n_tokens"), want)


def test_simhash(spark, tables):
    same(query("op7_simhash", spark, tables, "doc_id", "fingerprint", "component_id"), brute.simhash(rows_of(tables, "documents", "doc_id", "text")))


def test_suffix(spark, tables):
    docs = rows_of(tables, "documents", "doc_id", "text")
    same(query("op8_suffix_dedup", spark, tables, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.suffix(docs))


def test_pii(spark, tables):
    got = query("op9_pii", spark, tables, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    same([x[:-1] for x in got], brute.pii(rows_of(tables, "documents", "doc_id", "text")))
    for x in got:
        kinds = [s.split(":")[0] for s in x[-1].split(",") if s]
        assert [kinds.count(k) for k in brute.PII] == list(x[1:5])
        base = ",".join(s for s in x[-1].split(",") if s and s.split(":")[0] in brute.PII)
        assert brute.sha(base) == x[5]


def test_quality(spark, tables):
    got = query("op10_quality_rules", spark, tables, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same([x[:-1] for x in got], brute.quality(rows_of(tables, "documents", "doc_id", "text")))
    assert not any(kept for *_, failed, kept in got if failed)
    assert 0.5 < sum(x[-1] for x in got) / sum(not x[-2] for x in got) <= 1


def test_search(spark, tables):
    want = brute.search(rows_of(tables, "documents", "doc_id", "text"), rows_of(tables, "benchmark", "item_id", "text"))
    assert len(want) > 300
    same(query("op11_lexical_search", spark, tables, "item_id", "rank", "doc_id", "score"), want)


def test_repair(spark, tables):
    want = brute.repair(rows_of(tables, "conversations", "conv_id", "turn", "role", "text"))
    assert {c for r in want for c in r[7]} == set("DKR")
    same(query("op12_structure_repair", spark, tables, "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), want)


def test_language(spark, tables):
    lang = {d: (x, t) for d, x, t in rows_of(tables, "documents", "doc_id", "lang", "text") if d >= 10_000}
    got = query("op13_language_id", spark, tables, "doc_id", "held_out", "lang_pred", "score")
    assert all(0 <= s <= 1 and out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, out, _, s in got)
    right = [p == lang[d][0] for d, out, p, _ in got if out and d in lang]
    assert len(right) > 30 and sum(right) / len(right) > 0.95
    text = dict(rows_of(tables, "documents", "doc_id", "text"))
    assert all((p == "und") == (not any(unicodedata.category(c)[0] == "L" for c in text[d] or "")) for d, _, p, _ in got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == (1 if name == "op1_chat" else 0)


@pytest.fixture(scope="session")
def repeated(spark, tables, tmp_path_factory):
    """Folders of some rows once, and of the same rows twice with a row of nulls."""
    once, twice = (str(tmp_path_factory.mktemp(x)) for x in ("once", "twice"))
    for table, key in (("documents", "doc_id"), ("benchmark", "item_id"), ("pages", "page_id"), ("conversations", "conv_id")):
        rows = spark.read.parquet(f"{tables}/{table}.parquet").orderBy(key).limit(60).collect()
        one = spark.createDataFrame(rows, spark.read.parquet(f"{tables}/{table}.parquet").schema)
        empty = spark.createDataFrame([tuple(None for _ in one.columns)], one.schema)
        one.write.parquet(f"{once}/{table}.parquet")
        one.unionAll(one).unionAll(empty).write.parquet(f"{twice}/{table}.parquet")
    return once, twice


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_repeated_rows_and_null_ids(spark, repeated, name):
    """Rows twice, and a row of nulls: each row keeps its result where rows are judged by themselves; pages and turns have rules of their own."""
    one, two = ([tuple(r) for r in QUERIES[name](spark, where).collect()] for where in repeated)
    known = [r for r in two if r[0] is not None]
    if name == "op4_warc":
        assert sorted(known, key=repr) == sorted(brute_repeated_pages(repeated[1]), key=repr)
    elif name == "op1_chat":
        assert sorted(r[0] for r in known) == sorted(r[0] for r in one) and sum(r[1] for r in known) == 2 * sum(r[1] for r in one) - 2
    elif name == "op11_lexical_search":
        want = brute.search(rows_of(repeated[1], "documents", "doc_id", "text"), rows_of(repeated[1], "benchmark", "item_id", "text"))
        assert sorted(two, key=repr) == sorted(want, key=repr)
    elif name == "op12_structure_repair":
        assert sorted(two, key=repr) == sorted(brute.repair(rows_of(repeated[1], "conversations", "conv_id", "turn", "role", "text")), key=repr)
    elif name == "op5_packing":
        total = lambda rows: sorted((r[0], r[4]) for r in rows if r[1] == 0)
        assert total(known) == sorted(total(one) * 2) and sum(r[2] for r in known) == 2 * sum(r[2] for r in one)
    else:
        assert sorted(known, key=repr) == sorted(one * 2, key=repr)
        assert len(two) == len(known) + 1


def brute_repeated_pages(where):
    """Of rows that repeat page and payload the first is the response and the others revisit it."""
    pages = [(p, h) for p, h in rows_of(where, "pages", "page_id", "html") if p is not None]
    seen, out = set(), []
    for r in brute.warc(pages):
        if r[3] == "response" and (r[0], r[2]) in seen:
            r = (*r[:3], "revisit", r[0])
        seen.add((r[0], r[2]))
        out.append(r)
    return out


def test_quality_blank_lines(spark, tmp_path):
    """Equal lines without a word are not duplicate lines and do not reject a text."""
    part = lambda i: " ".join(f"word{i}x{j}" for j in range(12))
    blank = ["\n\n\n", "\n \n \n", "\n\t\n\t\n", "\n \x0b\f\r\n \x0b\f\r\n"]
    docs = [(i, b.join(part(k) for k in range(8))) for i, b in enumerate(blank)] + [(9, "\n\n\n".join([part(0), part(1)] * 3))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = query("op10_quality_rules", spark, tmp_path, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same([x[:-1] for x in got], brute.quality(docs))
    assert [x[-1] for x in got] == [True] * 4 + [False]
