"""Language identification by hierarchical discrimination: the family first, then the language within it.

A text's features are the byte n-grams (1 to 4) of its lower-cased letter runs, a space after each, hashed to
`DIMENSIONS` places; a feature's value is the square root of its share, so vectors have length 1. Families come from
`FAMILIES`, a language that is not there is a family of its own. Each node (the families; the languages of one family) holds one
linear support vector machine for each pair of its children (squared hinge loss, dual coordinate descent); the child
with most pairs won is taken, ties by the sum of margins, then by name. The score is the product over the two nodes of
the mean logistic of four times the winner's margins, between 0 and 1; a node with one child counts as 1.

Machines learn from a sample of at most `SAMPLE_ROWS` distinct labelled texts a language, those with the smallest hash of
all labelled texts (for pairs of families, an equal share of each language, as many in all). Each pair is trained in a
task of its own from these rows. Only weights come to the driver, `DIMENSIONS` numbers a pair, and travel in the closure
of the prediction, which reads every text whole in slices of bounded size and shuffles nothing.

Null and empty texts, and texts without a letter (Unicode category L), are `und` with score 0, and so is every text if
nothing could be learned. Rows with a null lang are not learned from; repeated rows are predicted alike and learned from once; extra
columns are kept, and those that this module adds replace columns of the same names. An empty table gives an
empty result. doc_id decides which rows are held out (crc32 of its text mod 4 is 2; a null doc_id is neither held out
nor learned from) and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._util import chunks, materialize, read_table, text_array
from .chunked import pack, unpack

DIMENSIONS = 4096
LONGEST = 4
#: Distinct texts of a language that its machines learn from, at most.
SAMPLE_ROWS = 600
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 20
EPOCHS, COST = 30, 10.0

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0].split("_")[0] in codes.split()), lang)


def counts(texts: pa.Array) -> np.ndarray:
    """A row of n-gram counts per text."""
    data, offs = text_array(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[offs[:-1][offs[:-1] < len(data)]] &= letter[offs[:-1][offs[:-1] < len(data)]]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    offs = before[offs]
    symbols = np.where(letter, data, 32)[keep].astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(offs))
    ends = np.repeat(offs[1:], np.diff(offs))
    out = np.zeros(len(texts) * DIMENSIONS, np.int64)
    gram = np.zeros(len(symbols), np.uint64)
    for n in range(1, LONGEST + 1):
        size = len(symbols) - n + 1
        if size <= 0:
            break
        gram = (gram[:size] << np.uint64(8)) | symbols[n - 1 :]
        whole = np.arange(size) + n <= ends[:size]
        place = ((gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)
        out += np.bincount(row[:size][whole] * DIMENSIONS + place[whole].astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def vectors(found: np.ndarray) -> np.ndarray:
    return np.sqrt(found / np.maximum(found.sum(axis=1, keepdims=True), 1))


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the bias last, of the support vector machine that tells y = 1 from y = -1 (dual coordinate descent, fixed order of steps)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    norms = (x * x).sum(axis=1) + 0.5 / COST
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ weights) - 1 + alpha[i] * 0.5 / COST
            new = max(alpha[i] - slope / norms[i], 0.0)
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", SLICE_BYTES):
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_rows(labelled: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """lang, place (from 1), x (packed counts) of the sample of labelled (text, lang), written."""
    rows = labelled.where(F.col("lang").isNotNull() & _has_letter(F.col("text"))).select("text", "lang", F.xxhash64("text").alias("h"))
    # Only hashes below a share that leaves some four times as many are ranked, so that no task reads a language whole.
    sizes = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * most) / F.approx_count_distinct("h")).alias("share"))
    low = rows.join(F.broadcast(materialize(sizes, "languages")), "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40))
    chosen = low.select("lang", "h").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))).where(F.col("place") <= most)
    chosen = materialize(chosen, "chosen")  # at most `most` rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            packed = [pack(r.astype("<u4")) for r in counts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(packed, pa.binary())], ["lang", "place", "x"])

    seen = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "place", "text").mapInArrow(run, "lang string, place int, x binary")
    return materialize(seen.groupBy("lang", "place").agg(F.min("x").alias("x")), "sample")


def learn(sample: DataFrame, most: int = SAMPLE_ROWS) -> dict[str, dict[tuple[str, str], np.ndarray]]:
    """Per node ("" for the families, else a family) the weights of each pair of children; a node with one child has it alone, without weights."""
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    within: dict[str, list[str]] = {}
    for lang in langs:
        within.setdefault(family_of(lang), []).append(lang)
    jobs = [("", a, b, lang, 1 if lang in within[a] else -1, most // len(within[a if lang in within[a] else b])) for a, b in combinations(sorted(within), 2) for lang in within[a] + within[b]]
    jobs += [(f, a, b, lang, 1 if lang == a else -1, most) for f, own in within.items() for a, b in combinations(own, 2) for lang in (a, b)]
    only = lambda x: {(x[0], x[0]): np.zeros(0)} if len(x) == 1 else {}
    found: dict[str, dict] = {"": only(list(within))} | {f: only(own) for f, own in within.items()}
    if not jobs:
        return found if langs else {}
    spark = sample.sparkSession
    plan = spark.createDataFrame(jobs, "node string, a string, b string, lang string, y int, share int")

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lang", "ascending"), ("place", "ascending")])
        x = vectors(np.stack([unpack(r, np.dtype("<u4")).astype(np.float64) for r in rows["x"].to_pylist()]))
        weights = train(x, rows["y"].to_numpy().astype(np.float64))
        return pa.table({"node": rows["node"][:1], "a": rows["a"][:1], "b": rows["b"][:1], "w": pa.array([weights.tobytes()], pa.binary())})

    # A pair's group is at most 2 * most rows of the sample.
    pairs = sample.join(F.broadcast(plan), "lang").where("place <= greatest(share, 1)").groupBy("node", "a", "b").applyInArrow(fit, "node string, a string, b string, w binary")
    for r in pairs.collect():
        found[r["node"]][r["a"], r["b"]] = np.frombuffer(r["w"], np.float64)
    return found


def decide(node: dict[tuple[str, str], np.ndarray], x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(child, score) of each row of x."""
    names = sorted({n for pair in node for n in pair})
    if len(names) == 1:
        return names * len(x), np.ones(len(x))
    votes, margins, sure = (np.zeros((len(x), len(names))) for _ in range(3))
    pairs = list(node)
    out = x @ np.stack([node[p][:-1] for p in pairs]).T + np.array([node[p][-1] for p in pairs])
    for (a, b), m in zip(pairs, out.T, strict=True):
        for name, margin in ((a, m), (b, -m)):
            i = names.index(name)
            votes[:, i] += (margin > 0) | ((margin == 0) & (name == a))
            margins[:, i] += margin
            sure[:, i] += 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
    top = votes == votes.max(axis=1, keepdims=True)
    best = np.argmax(np.where(top, margins, -np.inf), axis=1)
    return [names[i] for i in best], sure[np.arange(len(x)), best] / (len(names) - 1)


def predict_language(docs: DataFrame, models: dict[str, dict[tuple[str, str], np.ndarray]]) -> DataFrame:
    """docs (text) with lang_pred and score."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "_letter")]
    docs = docs.select(*(F.col(f"`{c}`") for c in own), _has_letter(F.col("text")).alias("_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            names: list[str] = ["und"] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            rows = np.flatnonzero(batch.column("_letter").to_numpy(zero_copy_only=False))
            if models and len(rows):
                x = vectors(counts(batch.column("text").take(pa.array(rows))))
                families, sure = decide(models[""], x)
                for f in sorted(set(families)):
                    mine = np.flatnonzero(np.array(families) == f)
                    langs, within = decide(models[f], x[mine])
                    scores[rows[mine]] = sure[mine] * within
                    for i, lang in zip(rows[mine].tolist(), langs, strict=True):
                        names[i] = lang
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores.round(9), pa.float64())], [*own, "lang_pred", "score"])

    kind = StructType([*docs.schema.fields[:-1], *StructType.fromDDL("lang_pred string, score double").fields])
    return docs.mapInArrow(run, kind)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    models = learn(training_rows(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang")))
    return predict_language(docs.select("doc_id", held_out().alias("held_out"), "text"), models).drop("text")
