"""SimHash near-duplicates: pigeonring candidates, then the Hamming check, then components.

A fingerprint has 64 bits over word shingles (lower-cased A-Z, words `[^\\x20\\x09-\\x0D]+`, shingles joined by
one space, repeats counted, XXH64 with seed 42); a bit is 1 if it is set in over half the hashes. A text of
fewer words than a shingle is one shingle; null, empty and blank texts have fingerprint zero, which links like
any other. Rows with the same doc_id count as one document and each get its class. Extra columns of the input
are not read. An empty table gives an empty result.

Pigeonring: cut the bits into `SEGMENTS` on a ring. If two fingerprints differ in at most `max_bits` bits, then
from some segment on, the differences of the first 1, 2, ... segments stay within proportional budgets
`l * max_bits // SEGMENTS`. The leading segments with budget 0 must be equal, which gives an exact join key for
each starting segment; where that is too short, the segments with budget 1 follow with one bit masked. Within a
group of one key, each further segment prunes the pairs by its budget; the last one is the full Hamming check.
Only distinct fingerprints are compared, and each group gives a spanning forest of its links, never all pairs.
Groups over `GROUP_LIMIT` fingerprints are dealt anew by equal parts of permuted bits (of `max_bits + 1` parts
of the bits at least one is equal), so that no group needs to fit in one task; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize, mix, read_table
from .graph import connected_components

SEGMENTS = 8
WIDTH = 64 // SEGMENTS
GROUP_LIMIT = 4096
#: How often a group that is too large is dealt anew before it is compared in blocks as it is.
MAX_LEVEL = 4


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.zeros(n, np.int64)
    starts[1:] = ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)), np.uint64, n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x or b"", shingle) for x in batch.column(1).cast(pa.large_binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _budgets(max_bits: int) -> list[int]:
    return [n * max_bits // SEGMENTS for n in range(1, SEGMENTS + 1)]


def _turned(fps: np.ndarray, r: int) -> np.ndarray:
    """Segment r first, in the lowest bits."""
    s = np.uint64(r * WIDTH)
    return fps if r == 0 else (fps >> s) | (fps << np.uint64(64 - r * WIDTH))


def _tagged(values: np.ndarray, *tags: int) -> np.ndarray:
    t = np.uint64(0)
    for x in tags:
        t = mix(np.array([t + np.uint64(x + 1)], np.uint64))[0]
    return mix(values ^ t)


def ring_keys(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(starting segment, key of each fingerprint); linked fingerprints share a key for some start."""
    budgets = _budgets(max_bits)
    equal, once = sum(b == 0 for b in budgets), sum(b <= 1 for b in budgets)
    for r in range(SEGMENTS):
        ring = _turned(fps, r)
        if equal >= 3 or max_bits >= SEGMENTS:
            yield r, _tagged(ring & np.uint64((1 << (equal * WIDTH)) - 1), r)
            continue
        whole = (1 << (once * WIDTH)) - 1
        for bit in range(equal * WIDTH, once * WIDTH):
            yield r, _tagged(ring & np.uint64(whole & ~(1 << bit)), r, bit)


def _finer_keys(keys: np.ndarray, fps: np.ndarray, max_bits: int, level: int) -> Iterator[np.ndarray]:
    order = np.random.default_rng(level).permutation(64)
    for part in np.array_split(order, max_bits + 1):
        mask = sum(1 << int(b) for b in part)
        yield mix(keys ^ _tagged(fps & np.uint64(mask), level, int(part[0])))


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining the classes of each a[i] and b[i]; a label is the smallest member."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(labels, high, low)
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def ring_close(fps: np.ndarray, one: np.uint64, max_bits: int) -> np.ndarray:
    """Places of the fingerprints that differ from `one` in at most `max_bits` bits.

    Pigeonring first: from some segment on, the first 1, 2, ... differences stay within proportional budgets. The
    chains of half the ring prune what cannot, then the full check follows.
    """
    apart = np.ascontiguousarray(fps ^ one)
    bits = np.bitwise_count(apart.view(np.uint8).reshape(-1, SEGMENTS)).astype(np.int16)
    budgets, total = _budgets(max_bits), np.zeros_like(bits)
    chain = np.ones(bits.shape, bool)
    for k in range(SEGMENTS // 2):
        total += np.roll(bits, -k, axis=1)
        chain &= total <= budgets[k]
    at = np.flatnonzero(chain.any(axis=1))
    return at[np.bitwise_count(apart[at]) <= max_bits]


def links_within(fps: np.ndarray, start: int, max_bits: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (members, roots) of the links in one group, in blocks of pairs."""
    budgets, n = _budgets(max_bits), len(fps)
    ring = _turned(fps, max(start, 0))
    segments = ring.view(np.uint8).reshape(n, 8)
    labels = np.arange(n)
    for i in range(0, n, block):
        for j in range(i, n, block):
            close = ring[i : i + block, None] ^ ring[None, j : j + block]
            a, b = np.nonzero(close & np.uint64(0xFF) == 0) if budgets[0] == 0 and WIDTH == 8 and start >= 0 else np.nonzero(np.ones(close.shape, bool))
            keep = a + i < b + j
            a, b = a[keep] + i, b[keep] + j
            total = np.zeros(len(a), np.int64)
            for k in range(SEGMENTS) if start >= 0 else ():
                total += np.bitwise_count(segments[a, k] ^ segments[b, k])
                keep = total <= budgets[k]
                a, b, total = a[keep], b[keep], total[keep]
            if start < 0:
                keep = np.bitwise_count(ring[a] ^ ring[b]) <= max_bits
                a, b = a[keep], b[keep]
            labels = _roots(labels, a, b)
    others = np.flatnonzero(labels != np.arange(n))
    return fps[others], fps[labels[others]]


def link_forest(distinct: DataFrame, max_bits: int) -> DataFrame:
    """src, dst: links between distinct fingerprints (column fp), as many as span their components."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint64)
            for r, keys in ring_keys(fps, max_bits):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(fps), r, np.int32)), batch.column(0)], ["key", "start", "fp"])

    def finer(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, fps = (np.ascontiguousarray(batch.column(i).to_numpy()).view(np.uint64) for i in (0, 2))
                for got in _finer_keys(keys, fps, max_bits, level):
                    yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), batch.column(1), batch.column(2)], ["key", "start", "fp"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for start, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                members = np.unique(group.values.to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
                a, b = links_within(members, start, max_bits)
                src.append(a)
                dst.append(b)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], ["src", "dst"])

    kind = "key long, start int, fp long"
    keyed, forests = distinct.select("fp").mapInArrow(first, kind), []
    for level in range(MAX_LEVEL + 1):
        counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        counted = keyed.join(counts, "key")
        if level < MAX_LEVEL:
            last = not counts.where(F.col("n") > GROUP_LIMIT).limit(1).count()
            here = counted if last else counted.where(F.col("n") <= GROUP_LIMIT)
        else:
            last, here = True, counted
        groups = here.groupBy("key").agg(F.first("start").alias("start"), F.collect_list("fp").alias("fps"))
        forests.append(groups.select("start", "fps").mapInArrow(compare, "src long, dst long"))
        if last:
            break
        keyed = materialize(counted.where(F.col("n") > GROUP_LIMIT).select("key", "start", "fp").mapInArrow(finer(level), kind), "finer")
    out = forests[0]
    for x in forests[1:]:
        out = out.unionAll(x)
    return out


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id that links lead to, the document's own included."""
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError(f"max_bits must be under {SEGMENTS}: the first segment of a chain is a join key")
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    owners = prints.groupBy("fp").agg(F.min("doc_id").alias("owner"))
    roots = connected_components(link_forest(owners, max_bits))
    classes = owners.join(roots, owners["fp"] == roots["v"], "left").select("fp", "owner", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("owner").alias("component_id"))
    labelled = classes.join(smallest, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def op7(spark, sf_dir: str) -> DataFrame:
    got = simhash_components(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
