"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, and chains of them.

Shingles are runs of five words (lower-cased A-Z, `[^\\x20\\x09-\\x0D]+`), as 64-bit hashes; a text of fewer words
is one shingle, and a set counts each once. Equal sets are one member of what follows.

Candidates come from blocks: in one order of all shingles, two sets of a similarity t share a shingle among the first
n - ceil(t * n) + 1 of each, so every pair meets in the block of that shingle. Shingles that many documents have come
last in the order, which keeps blocks small and never loses a pair. First shingles are those of the lowest hashes but for
the frequent ones, so the lowest `COUNTED` of all hashes are counted exactly, over all documents, and what more than
`SMALL` documents have is frequent; of the others those that a partition often has. These first
shingles travel as packed lists, one per slice of documents and bucket, and a bucket gives its blocks. Within a
block, pairs whose sizes rule the similarity out are left; of the others the SimHash fingerprints (of the sets) go
through the pigeonring filter of `simhash` and the full Hamming check, at most `MAX_BITS` of 64; 0.8 is 10 bits on
average with a deviation of 3; sets of fewer than `FEW` shingles skip both. Each other pair is confirmed by its exact sets, found anew from the two texts.

A block is compared in rounds: first each member with one pivot, then with the next 16, 256, ... of them, and only
members that no confirmed pair has joined yet. From the second round on, a wide SimHash fingerprint (`WIDE_BITS` of 4096)
prunes pairs besides, which tells similarities of 0.7 from 0.8, so that a large group of loosely similar texts gives
few pairs to confirm. A group of near copies takes about as many pairs as members, and after the last round every
pair is either joined or was compared.

Null, empty and blank texts have the empty set and are copies of each other. Rows of one doc_id and different texts
are documents of their own; rows without a doc_id take no part. Extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import NOT_SPACE, _R1, chunks, digests, input_bytes, materialize, mix, packed_texts, powers, prefix_hash, text_array, unpacked, words_in
from .chunked import pack, pack_ascending, unpack, unpack_ascending
from .graph import connected_components
from .simhash import majority, ring_close

#: The least similarity, as a fraction.
LEAST = (4, 5)
MAX_BITS = 24
#: 64-bit words of the wide fingerprint, and in how many bits near copies differ at most: 0.8 is 620 of 4096 on average with a deviation of 23.
WIDE_WORDS = 64
WIDE_BITS = 724
#: A set of fewer shingles is compared without bounds on bits: those of so few shingles scatter too widely.
FEW = 24
#: A block of at most so many members is compared in whole in the first round.
SMALL = 8
#: Text bytes of one slice of documents.
SLICE_BYTES = 2 << 20
#: The share of all hashes that is counted exactly: more than a set's first shingles take (a fifth), for sets with some frequent ones.
COUNTED = 0.3
#: Of the others a shingle is frequent if over one in `FREQUENT` documents of a partition has it; the order knows the `ORDERED` most frequent ones.
FREQUENT = 2000
ORDERED = 200_000
#: Hashes to count that a task holds before they are dealt to buckets, and bytes of documents to a bucket, about.
HELD = 500_000
COUNTED_BYTES = 1 << 20
#: Entries of a bucket of first shingles, about.
BUCKET_ENTRIES = 300_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MEMBER = np.dtype([("sid", "<i8"), ("fp", "<u8"), ("n", "<i4")])


def shingle_sets(data: np.ndarray, offs: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The shingles of each text, ascending."""
    data = _LOWER[data]
    codes, words, rows = words_in(data, offs, NOT_SPACE[data])
    if not len(codes):
        return [np.zeros(0, np.uint64)] * (len(offs) - 1)
    so_far = prefix_hash(digests(words)[0][codes], _R1)
    first = rows[:-1]
    count = np.maximum(np.diff(rows) - shingle, 0) + (np.diff(rows) > 0)
    stops = np.cumsum(count)
    at = np.repeat(first - (stops - count), count) + np.arange(stops[-1])
    size = np.minimum(np.repeat(np.diff(rows), count), shingle)
    hashes = mix((so_far[at + size] - so_far[at]) * powers(pow(_R1, -1, 1 << 64), len(so_far))[at] + size.astype(np.uint64))
    return [np.unique(x) for x in np.split(hashes, stops[:-1])]


def set_hash(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64))


def wide_print(values: np.ndarray) -> bytes:
    """A SimHash fingerprint of `WIDE_WORDS` * 64 bits of a set."""
    return np.array([majority(mix(values + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) % (1 << 64)))) for j in range(WIDE_WORDS)], np.uint64).tobytes()


def _tagged(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


_PRINT = "doc_id long, tag long, sid long, n int, fp long, often binary, bucket long, low binary"
_LOW = np.uint64(int(COUNTED * 2**64))
_COUNT = np.dtype([("h", "<u8"), ("c", "<i8")])


def _counted(parts: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(parts)
    x = x[np.argsort(x["h"])]
    head = np.flatnonzero(np.append(True, x["h"][1:] != x["h"][:-1])) if len(x) else np.zeros(0, np.int64)
    out = x[head]
    if len(x):
        out["c"] = np.add.reduceat(x["c"], head)
    return out


def _low_rows(low: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Hashes to count by bucket, their first `bits` bits; the next 32 bits stand for each."""
    h = np.sort(np.concatenate(low)) >> np.uint64(32 - bits)
    bucket = (h >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    packed = [pack_ascending(x.astype(np.uint32)) for x in np.split(h & np.uint64(0xFFFFFFFF), edges[1:])]
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("often", pa.binary()), ("bucket", pa.int64()), ("low", pa.binary())])
    return pa.RecordBatch.from_arrays([*(pa.nulls(len(edges), f.type) for f in list(schema)[:6]), pa.array(bucket[edges]), pa.array(packed, pa.binary())], schema=schema)


def _prints(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """A row per document (doc_id, tag, a hash of its set, the set's size and fingerprint), one per partition with its frequent shingles, and the low hashes by bucket."""
    names = [x.split()[0] for x in _PRINT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, n_docs, low, held = [np.zeros(0, _COUNT)], 0, [], 0
        for batch in chunks(batches, "text", SLICE_BYTES):
            sets = shingle_sets(*text_array(batch.column("text")), shingle)
            every = np.concatenate(sets)
            low.append(every[every < _LOW])
            held += len(low[-1])
            if held > HELD:
                yield _low_rows(low, bits)
                low, held = [], 0
            h, c = np.unique(every[every >= _LOW], return_counts=True)
            here = np.zeros(int((c > 1).sum()), _COUNT)
            here["h"], here["c"] = h[c > 1], c[c > 1]
            often, n_docs = [_counted([*often, here])], n_docs + len(sets)
            sid, n = pa.array([set_hash(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32())
            fp = pa.array(np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), sid, n, fp, *(pa.nulls(len(sets), k) for k in (pa.binary(), pa.int64(), pa.binary()))], names)
        if held:
            yield _low_rows(low, bits)
        kept = often[0][often[0]["c"] > max(n_docs // FREQUENT, 2)]
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array([None], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())] + [pa.array([kept.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names)

    return docs.select("doc_id", "tag", "text").mapInArrow(run, _PRINT)


def _frequent(prints: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent shingles (their first 32 + bits bits, ascending, at most `ORDERED`), in how many documents they were seen, and how many bits their hashes have besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                x = np.frombuffer(packed, _COUNT)
                yield pa.RecordBatch.from_arrays([pa.array((x["h"] >> np.uint64(32 - bits)).view(np.int64)), pa.array(x["c"])], ["h", "c"])

    def count(table: pa.Table) -> pa.Table:
        h, c = np.unique(np.concatenate([unpack_ascending(x) for x in table["low"].to_pylist()]), return_counts=True)
        many = c > SMALL
        return pa.table({"h": (h[many].astype(np.int64) | table["bucket"][0].as_py() << 32), "c": c[many].astype(np.int64)})

    often = prints.where("often is not null").select("often").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    low = prints.where("low is not null").select("bucket", "low").groupBy("bucket").applyInArrow(count, "h long, c long")
    got = often.unionAll(low).orderBy(F.desc("c"), "h").limit(ORDERED).toArrow()
    h, c = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], 32 - bits


def first_shingles(values: np.ndarray, known: np.ndarray, counts: np.ndarray, rest: int = 0) -> np.ndarray:
    """Of a set, the shingles of which every near copy has one among its own; `known` holds hashes without their last `rest` bits."""
    a, b = LEAST
    if not len(values):
        return values
    if len(known):
        short = values >> np.uint64(rest)
        place = np.minimum(np.searchsorted(known, short), len(known) - 1)
        values = values[np.lexsort((values, np.where(known[place] == short, counts[place], 0)))]
    return values[: len(values) + 1 + (-a * len(values)) // b]


_LISTS = "bucket long, members binary, keys binary, which binary"


def _lists(docs: DataFrame, shingle: int, frequent: tuple[np.ndarray, np.ndarray, int], buckets: int) -> DataFrame:
    """The first shingles of all sets by bucket, packed by slices of documents."""
    names = [x.split()[0] for x in _LISTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE_BYTES):
            sets = list({set_hash(x): x for x in shingle_sets(*text_array(batch.column("text")), shingle)}.items())
            firsts = [first_shingles(x, *frequent) for _, x in sets]
            keys = mix(np.concatenate(firsts)) if firsts else np.zeros(0, np.uint64)
            if not len(keys):
                continue
            member = np.zeros(len(sets), _MEMBER)
            member["sid"], member["n"] = [s for s, _ in sets], [len(x) for _, x in sets]
            member["fp"] = np.fromiter((majority(x) for _, x in sets), np.uint64, len(sets))
            which = np.repeat(np.arange(len(sets)), [len(x) for x in firsts])
            keys = ((keys >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
            order = np.argsort(keys)
            keys, which = keys[order], which[order]
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out = []
            for a, b in zip(edges.tolist(), np.append(edges[1:], len(keys)).tolist(), strict=True):
                own, local = np.unique(which[a:b], return_inverse=True)
                out.append((int(bucket[a]), member[own].tobytes(), pack_ascending((keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), pack(local.astype("<u4").tobytes(), 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    return docs.select("text").mapInArrow(run, _LISTS)


#: A pair to confirm, or a block with more pairs (a and b null).
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("members", pa.list_(pa.struct([("sid", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("root", pa.int64())])))])
_FOUND_DDL = "a long, b long, members array<struct<sid:long,fp:long,n:int,root:long>>"


def _close(sid: np.ndarray, fp: np.ndarray, n: np.ndarray, root: np.ndarray, low: int, high: int, wide: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the pivots low, ..., high - 1 of a block with later members of other roots that may be near copies."""
    num, den = LEAST
    n = n.astype(np.int64)
    for p in range(low, (len(sid) if len(sid) <= SMALL else min(high, len(sid))) - 1 + (len(sid) > high)):
        ok = np.flatnonzero((root[p + 1 :] != root[p]) & (den * n[p + 1 :] >= num * n[p]) & (den * n[p] >= num * n[p + 1 :])) + p + 1
        near = np.minimum(n[ok], n[p]) < FEW
        near[ring_close(fp[ok], fp[p], MAX_BITS)] = True
        ok = ok[near]
        if wide is not None:
            few = np.minimum(n[ok], n[p]) < FEW
            ok = ok[few | (np.bitwise_count(wide[ok] ^ wide[p]).sum(axis=1, dtype=np.int64) <= WIDE_BITS)]
        if len(ok):
            yield np.minimum(sid[ok], sid[p]), np.maximum(sid[ok], sid[p])


def _found(table: pa.Table) -> pa.Table:
    """The blocks of one bucket: the first round's pairs, and those blocks that need more."""
    members = [np.frombuffer(x, _MEMBER) for x in table["members"].to_pylist()]
    keys = np.concatenate([unpack_ascending(x) for x in table["keys"].to_pylist()])
    base = np.cumsum([len(m) for m in members]) - [len(m) for m in members]
    which = np.concatenate([unpack(x, "<u4").astype(np.int64) + b for x, b in zip(table["which"].to_pylist(), base.tolist(), strict=True)])
    members = np.concatenate(members)
    _, same, of = np.unique(members["sid"], return_index=True, return_inverse=True)
    which = of[which]
    members = members[same]
    order = np.lexsort((which, keys))
    keys, which = keys[order], which[order]
    kept = np.append(True, (keys[1:] != keys[:-1]) | (which[1:] != which[:-1]))
    keys, which = keys[kept], which[kept]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(head, len(keys)))
    a, b, blocks, seen = [], [], [], set()
    two = np.unique(np.stack([which[head[size == 2]], which[head[size == 2] + 1]]), axis=1)
    x, y = members[two[0]], members[two[1]]
    low, high = np.minimum(x["n"], y["n"]).astype(np.int64), np.maximum(x["n"], y["n"])
    near = low < FEW
    near[ring_close(x["fp"] ^ y["fp"], np.uint64(0), MAX_BITS)] = True
    near &= LEAST[1] * low >= LEAST[0] * high
    a.append(np.minimum(x["sid"], y["sid"])[near])
    b.append(np.maximum(x["sid"], y["sid"])[near])
    for at, n in zip(head[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        block = which[at : at + n]
        if (key := block.tobytes()) in seen:
            continue
        seen.add(key)
        m = members[block]
        m = m[np.argsort(mix(m["sid"].view(np.uint64)))]
        for x, y in _close(m["sid"], m["fp"], m["n"], m["sid"], 0, 1):
            a.append(x)
            b.append(y)
        if n > SMALL:
            blocks.append(m)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    none = [None] * len(blocks)
    every = np.concatenate([np.zeros(0, _MEMBER), *blocks])
    fields = [pa.array(x) for x in (every["sid"], every["fp"].view(np.int64), every["n"], every["sid"])]
    ends = np.cumsum([0, *map(len, blocks)]).tolist()
    lists = pa.ListArray.from_arrays(pa.array([None] * pairs.shape[1] + ends, pa.int32()), pa.StructArray.from_arrays(fields, ["sid", "fp", "n", "root"]))
    return pa.Table.from_arrays([pa.array(pairs[0].tolist() + none, pa.int64()), pa.array(pairs[1].tolist() + none, pa.int64()), lists.cast(_FOUND.field("members").type)], schema=_FOUND)


def _largest(table: pa.Table) -> pa.Table:
    """Of the blocks that begin with one member, those that lie in no other: the others' pairs meet in that one too."""
    members = table["members"].combine_chunks()
    kept, sets = [], []
    for i in np.argsort(-members.value_lengths().to_numpy(), kind="stable").tolist():
        here = frozenset(members[i].values.field("sid").to_pylist())
        if not any(here <= x for x in sets):
            kept.append(i)
            sets.append(here)
    return table.select(["members"]).take(pa.array(kept))


def _pairs(blocks: DataFrame, low: int, high: int) -> DataFrame:
    """a, b: pairs of the pivots low, ..., high - 1 of each block (members: sid, fp, n, root, wide, keys) with later members of other roots.

    Of the blocks that two members share, `keys` tells the smallest; only that one gives their pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, group in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                x = group.values
                before = {s: {k for k in keys if k < key} for s, keys in zip(x.field("sid").to_pylist(), x.field("keys").to_pylist(), strict=True)}
                sid, fp, n, root = (x.field(c).to_numpy(zero_copy_only=False) for c in ("sid", "fp", "n", "root"))
                wide = np.frombuffer(b"".join(x.field("wide").to_pylist()), np.uint64).reshape(len(sid), -1)
                order = np.argsort(mix(sid.view(np.uint64)))
                for a, b in _close(sid[order], fp[order].view(np.uint64), n[order], root[order], low, high, wide[order]):
                    own = np.array([before[i].isdisjoint(before[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
                    if own.any():
                        yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own])], ["a", "b"])

    return blocks.select("members", "key").mapInArrow(run, "a long, b long")


def _wide_prints(texts: DataFrame, shingle: int) -> DataFrame:
    """sid, wide: the wide fingerprint of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches, SLICE_BYTES):
            sets = shingle_sets(*text_array(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(map(wide_print, sets), pa.binary())], ["sid", "wide"])

    return texts.select("sid", "text").mapInArrow(run, "sid long, wide binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """src, dst: the pairs whose sets have the least similarity."""
    num, den = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches, SLICE_BYTES):
            other: dict[bytes, np.ndarray] = {}
            keep = []
            for x, y in zip(shingle_sets(*text_array(batch.column("text")), shingle), batch.column("x").to_pylist(), strict=True):
                if y not in other:
                    if len(other) > 256:
                        other.clear()
                    raw = unpack(y)
                    other[y] = shingle_sets(raw, np.array([0, len(raw)]), shingle)[0]
                y = other[y]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("sid").alias("b"), "text")
    other = texts.select(F.col("sid").alias("a"), F.col("text").alias("x"))
    got = pairs.join(one, "b").join(other, "a").select(F.col("a").alias("src"), F.col("b").alias("dst"), "text", "x")
    return got.mapInArrow(run, "src long, dst long")


def near_classes(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, tag (a hash of the text), keeper (doc_id, tag): the smallest document that pairs of near copies lead to, for each document."""
    spark = docs.sparkSession
    known = _tagged(docs)
    bits = min(max((input_bytes(docs, "text") // COUNTED_BYTES).bit_length(), 4), 16)
    prints = materialize(_prints(known, shingle, bits), "prints")
    every = prints.where("sid is not null").select("doc_id", "tag", "sid", "n")
    first = F.expr(f"n + 1 - ceil(n * {LEAST[0]} / {LEAST[1]})")
    entries = every.agg(F.sum(first)).head()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries) // BUCKET_ENTRIES)
    found = materialize(_lists(known, shingle, _frequent(prints, bits), buckets).groupBy("bucket").applyInArrow(_found, _FOUND_DDL), "found")
    largest = found.where("members is not null").select("members").distinct().groupBy(F.col("members")[0]["sid"]).applyInArrow(_largest, _FOUND_DDL.split(", ")[2])
    blocks = materialize(largest.select(F.xxhash64("members").alias("key"), "members"), "blocks")
    pairs = found.where("a is not null").select("a", "b").distinct()

    # texts of the sets that a pair may need, each once, by the smallest document that has it
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionAll(blocks.select(F.explode("members.sid").alias("sid"))).distinct()
    owners = every.groupBy("sid").agg(F.min(F.struct("doc_id", "tag")).alias("owner"))
    asked = owners.join(wanted, "sid", "left_semi").select("owner.doc_id", "owner.tag", "sid")
    texts = materialize(packed_texts(known).join(asked, ["doc_id", "tag"]).select("sid", "text").dropDuplicates(["sid"]), "texts")
    member = blocks.select("key", F.explode("members").alias("m")).select("key", "m.sid", "m.fp", "m.n", "m.root")
    labels, wides, low, high = None, None, 0, 1
    while True:
        links = materialize(_confirmed(pairs, texts, shingle), "links")
        if links.limit(1).count():
            links = links if labels is None else links.unionAll(labels.select(F.col("v").alias("src"), F.col("root").alias("dst")))
            labels = connected_components(links)
            known_root = labels.select(F.col("v").alias("sid"), F.col("root").alias("now"))
            member = member.join(known_root, "sid", "left").select("key", "sid", "fp", "n", F.coalesce("now", "root").alias("root"))
        low, high = high, 16 * high + 1
        # blocks that are larger than what has been compared, and not yet of one root
        member = materialize(member, "members")
        open_ = member.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).where((F.col("size") > max(SMALL, low + 1)) & (F.col("least") < F.col("most")))
        member = materialize(member.join(open_.select("key"), "key", "left_semi"), "members")
        if not member.limit(1).count():
            break
        if wides is None:  # once, for the blocks that the first round leaves
            wides = materialize(_wide_prints(texts.join(member.select("sid").distinct(), "sid", "left_semi"), shingle), "wide")
        shared = member.groupBy("sid").agg(F.collect_list("key").alias("keys"))  # no more than a set has first shingles
        full = member.join(wides.join(shared, "sid"), "sid").groupBy("key").agg(F.collect_list(F.struct("sid", "fp", "n", "root", "wide", "keys")).alias("members"))
        pairs = _pairs(full, low, high).distinct()
    own = every.groupBy("sid").agg(F.min(F.struct("doc_id", "tag")).alias("owner"))
    if labels is None:
        classes = own.select("sid", "owner", F.col("sid").alias("root"))
    else:
        classes = own.join(labels, own["sid"] == labels["v"], "left").select("sid", "owner", F.coalesce("root", "sid").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("owner").alias("keeper"))
    keepers = classes.join(smallest, "root").select("sid", "keeper")
    return every.select("doc_id", "tag", "sid").join(keepers, "sid").select("doc_id", "tag", "keeper").distinct()


def near_components(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that pairs of near copies lead to, for the rows with a doc_id."""
    return near_classes(docs, shingle).select("doc_id", F.col("keeper.doc_id").alias("component_id")).distinct()


def drop_near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with one row, that of the smallest doc_id, of each group of near copies.

    Rows of one doc_id and different texts are documents of their own; rows that repeat both are one document, of
    which the smallest row stays (by its JSON where it holds a map). Rows without a doc_id belong to no group and stay.
    """
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    kept = near_classes(docs, shingle).where((F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("tag") == F.col("keeper.tag"))).select(F.col("doc_id").alias("_kept_id"), F.col("tag").alias("_kept_tag"))
    known = docs.where("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), tag.alias("_tag"))
    smallest = F.min_by("row", F.to_json("row")) if "map<" in known.schema["row"].dataType.simpleString() else F.min("row")  # maps have no order
    one = known.join(kept, (known["_id"] == kept["_kept_id"]) & (known["_tag"] == kept["_kept_tag"]), "left_semi").groupBy("_id", "_tag").agg(smallest.alias("row"))
    return one.select("row.*").unionAll(docs.where("doc_id is null"))
