"""Chat formatting as prefix trees: conversations that share initial turns share their tokens.

Template: `<|turn|>role\\ntext<|end|>\\n`, each of header, text and footer encoded by itself by a byte-level BPE, so a
turn's tokens do not depend on its neighbours. Within roles and texts a backslash is doubled, and a backslash goes
behind the first character of every control string (`CONTROLS`); a role's line breaks become `\\n`. So no text can
act as a control, and reading back gives every text unchanged. The loss mask of a turn is its text if the role is
`assistant`, else nothing.

A node is a turn together with all turns before it; its key is the place and two exclusive-or chains of 64-bit
hashes of (place, role, text). Conversations are sorted by the hashes of their turns, a prefix before what extends
it, which is a depth-first order of the trees; the first conversation of that order to hold a node emits it, so
each shared turn is emitted once. A tree (conversations with an equal first turn) is one layout of tokens: `start`
counts the tokens emitted before in the tree, `position` those of the turns before in the same conversation. What
a conversation emits is one stretch of the layout; it attends to the stretches of its ancestors, as intervals
[start, end), and causally to itself.

Order and layout use range partitions and sums over partitions, not one task per tree, and joins on nodes and on who
emits them salt frequent keys, so a first turn of a third of all conversations is no hot group; a conversation's sort key takes 8 bytes a turn, and texts never are gathered
by conversation: reading back streams sorted turns.

Null roles and texts are empty. Turns are in the order of turn (null first), then role and text; rows that repeat
are turns of their own. Rows without a conv_id are left out. Extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize, read_table

TURN, END = "<|turn|>", "<|end|>"
#: A key of more than one in so many rows is salted in joins.
HOT_KEYS = 1000
#: Strings that steer this template or common other ones; escaped within texts.
CONTROLS = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """Header, text and footer of one turn."""
    return f"{TURN}{escape_role(role)}\n", escape(text), f"{END}\n"


def parsed(turn: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    if not turn.startswith(TURN) or not turn.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    role, _, text = turn[len(TURN) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(text)


_coders: dict[str, object] = {}


def byte_coder(path: str):
    """A byte-level BPE without special tokens."""
    if path not in _coders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _coders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _coders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass
class Formatted:
    #: tree1, tree2, owner, idx, start, position, n_tokens, loss_start, loss_end, ids: an emitted turn; loss within its ids
    turns: DataFrame
    #: conv_id, tree1, tree2, owner, start, end, position: the stretches a conversation consists of, its own the last
    stretches: DataFrame


_EMITTED = "idx int, x1 long, x2 long, owner long, ids array<int>, n_tokens long, loss_start long, loss_end long"


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, idx (from 1), role, text, h, x1, x2: each turn's hash and its node's key."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("idx", F.row_number().over(turns))
    hashed = placed.withColumns({"h": F.xxhash64("role", "text"), "e1": F.xxhash64("idx", "role", "text"), "e2": F.xxhash64(F.lit("second"), "text", "role", "idx")})
    return hashed.withColumns({"x1": F.bit_xor("e1").over(so_far), "x2": F.bit_xor("e2").over(so_far)}).select("conv_id", "idx", "role", "text", "h", "x1", "x2")


def _spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """left joined with right, which has few rows to a key; keys of over a thousandth of left's rows are salted.

    There are at most a thousand such keys; their rows go to as many places as there are shuffle partitions, by the
    hash of `by`, and right's rows for them go to each of these.
    """
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(left.count() // HOT_KEYS, 100)
    hot = F.broadcast(left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*keys, F.lit(True).alias("_hot")))
    one = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return one.join(right.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot"), [*keys, "_salt"]).drop("_salt")


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> Formatted:
    spark, path = conversations.sparkSession, tokenizer or default_tokenizer()
    turns = materialize(_numbered(conversations), "turns")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    # depth-first order: the rank has the partition in its upper bits and the place within it in the lower ones
    paths = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"]).alias("path"))
    ranked = materialize(paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", F.monotonically_increasing_id().alias("rank")), "ranks")
    keyed = materialize(turns.select("conv_id", "idx", "x1", "x2").join(ranked, "conv_id"), "keyed")
    owners = keyed.groupBy("idx", "x1", "x2").agg(F.min("rank").alias("owner"))

    first = keyed.where("idx = 1").select("conv_id", F.col("x1").alias("tree1"), F.col("x2").alias("tree2"))
    emitting = owners.join(ranked.withColumnRenamed("rank", "owner"), "owner").join(turns.select("conv_id", "idx", "role", "text"), ["conv_id", "idx"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        for batch in batches:
            ids, sizes, low, high = [], [], [], []
            for role, text in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                head, body, foot = (coder.encode_ordinary(x) for x in formatted(role, text))
                ids.append(np.array(head + body + foot, np.int32))
                sizes.append(len(ids[-1]))
                low.append(len(head))
                high.append(len(head) + (len(body) if role == "assistant" else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32())), *(pa.array(x, pa.int64()) for x in (sizes, low, high))], [x.split()[0] for x in _EMITTED.split(", ")])

    emitted = materialize(emitting.select("idx", "x1", "x2", "owner", "role", "text").mapInArrow(encode, _EMITTED), "emitted")

    # where each conversation's own stretch begins: the tokens of earlier ranks in its tree
    trees = materialize(first.join(ranked, "conv_id").select("tree1", "tree2", "conv_id", "rank"), "trees")
    sizes = emitted.groupBy(F.col("owner").alias("rank")).agg(F.sum("n_tokens").alias("tokens"))
    sized = trees.join(sizes, "rank").withColumn("part", F.shiftright("rank", 33))
    by_part = sized.groupBy("tree1", "tree2", "part").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("tree1", "tree2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("tree1", "tree2", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("tree1", "tree2", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.withColumn("local", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(bases, ["tree1", "tree2", "part"]).select("tree1", "tree2", F.col("rank").alias("owner"), (F.col("base") + F.col("local")).alias("offset"))

    own = Window.partitionBy("owner").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    laid = emitted.withColumn("start", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(offsets, "owner").withColumn("start", F.col("start") + F.col("offset")).drop("offset")

    # the stretches of a conversation: its nodes by who emits them
    nodes = laid.select("idx", "x1", "x2", "owner", "start", "n_tokens", "tree1", "tree2")
    stretches = _spread_join(keyed, nodes, ["idx", "x1", "x2"], "conv_id").groupBy("conv_id", "tree1", "tree2", "owner").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.min("idx").alias("first_idx"))
    path_so_far = Window.partitionBy("conv_id").orderBy("first_idx").rowsBetween(Window.unboundedPreceding, -1)
    stretches = materialize(stretches.withColumn("position", F.coalesce(F.sum(F.col("end") - F.col("start")).over(path_so_far), F.lit(0))).drop("first_idx"), "stretches")
    # an emitted turn's position: that of its owner's own stretch, and the way within it
    base = stretches.join(ranked, "conv_id").where("rank = owner").select("owner", F.col("start").alias("own_start"), F.col("position").alias("own_position"))
    out = laid.join(base, "owner").withColumn("position", F.col("own_position") + F.col("start") - F.col("own_start"))
    return Formatted(out.select("tree1", "tree2", "owner", "idx", "start", "position", "n_tokens", "loss_start", "loss_end", "ids"), stretches)


def attention(result: Formatted) -> DataFrame:
    """conv_id, tree1, tree2, owner, intervals: per conversation, what its last stretch attends to: the ancestors' [start, end), neighbours merged."""
    pairs = F.array_sort(F.collect_list(F.struct("position", "start", "end")))
    merged = F.aggregate(
        pairs,
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] == x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), x["end"].alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    return result.stretches.groupBy("conv_id", "tree1", "tree2").agg(merged.alias("intervals"))


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def read_back(result: Formatted, tokenizer: str | None = None) -> DataFrame:
    """Every conversation read from the emitted tokens, by its stretches; digests of its turns and of its loss text."""
    path = tokenizer or default_tokenizer()
    turns = result.turns.select("owner", F.col("start").alias("at"), "n_tokens", "loss_start", "loss_end", "ids")
    rows = _spread_join(result.stretches, turns, ["owner"], "conv_id").where("at >= start and at < end").select("conv_id", (F.col("position") + F.col("at") - F.col("start")).alias("place"), "n_tokens", "loss_start", "loss_end", "ids")
    parts = max(int(result.stretches.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place")
    names, kinds = [x.split()[0] for x in _READ.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        conv, n, chars, loss_chars, place = None, 0, 0, 0, 0
        all_turns = loss = hashlib.sha256()
        out: list[tuple] = []

        def close() -> None:
            if conv is not None:
                out.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, place))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for c, at, size, low, high, ids in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if c != conv:
                    close()
                    conv, n, chars, loss_chars, place, all_turns, loss = c, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                if at != place:
                    raise ValueError(f"conversation {c}: tokens are missing at {place}")
                place += size
                text = coder.decode_bytes(ids).decode()
                role, said = parsed(text)
                all_turns.update(f"{role}\n{said}\n".encode())
                learnt = unescape(coder.decode_bytes(ids[low:high]).decode())
                loss.update(learnt.encode())
                n, chars, loss_chars = n + 1, chars + len(text), loss_chars + len(learnt)
            if out:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, _READ)


def op1(spark, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], table.schema)
    return read_back(format_conversations(table.unionAll(extra))).drop("n_tokens")


_PATTERN = "|".join(re.sub(r"([\\[\]|/])", r"\\\1", c) for c in CONTROLS)

ORACLE = rf"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '{_PATTERN}'))
          + length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, chr(10), '')) + len(regexp_extract_all(role, '{_PATTERN}'))
          + {len(TURN) + 1 + len(END) + 1} AS chars
  FROM rows
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS loss, sum(chars) AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM joined
"""
