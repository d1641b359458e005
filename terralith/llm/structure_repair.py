"""Conversation structure repair by weighted finite-state composition.

A conversation is the acceptor of its rows in order; composed with an edit transducer and the acceptor of the role
grammar `(s?(ua)+)?` over role initials it gives a weighted automaton whose cheapest path is the repair. Edits: Keep 0,
Rerole to user or assistant 1, Delete 2 (required where a row is blank or a duplicate), Insert an empty user or
assistant turn 5; a truncated row that stays adds 5. Weights are pairs (cost, labels), compared by cost and then by the
labels D, I, K, R as ASCII strings, so one path is best.

A row's first fault counts: blank (no `[^\\x20\\x09-\\x0D]`), duplicate (role and text seen earlier in the conversation),
truncated (its last such character is none of `.!?`). Rows go by turn, nulls first; rows of one turn by role, then by
the SHA-256 of their text, so that equal rows lie side by side. A null role or text is one space. A role whose first
letter is not s, u or a (an empty one too) can only be reroled or deleted. Rows without a conv_id are one
conversation. Repeated rows are duplicates; extra columns are not read; an empty table gives empty results.

Composition is lazy: a state is (row, grammar state), and a row's arcs, the 4 x 4 best weights between grammar states
with the inserts before it, are made once for each kind of row. Paths over equal rows between the same two states
never have labels of which one begins the other (both end in the letter of the last row, and a cycle of inserts only
costs), so weights distribute and a segment of at most 1024 rows becomes one 4 x 4 matrix, in topological order,
for thousands of segments at a time in NumPy. A conversation is then a chain of such matrices (costs, and the order of the
labels that start in one state: labels themselves stay behind), so that a very long one is spread over tasks; only
its chain, and the audit string of the result, are one row. Texts travel apart from all this and meet the edits by row
number. The digest of a repaired conversation is made from its sorted rows as they stream by; by its nature it is one task's
work for one conversation, in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize, read_table, task_count

SEGMENT_BITS = 10
_FAR = 1 << 30

#: Grammar states: 0 start (may end), 1 after s, 2 after u, 3 after a (may end).
_STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, role: s u a other) to state
_WANTED = [1, 1, 2, 1]  # the role, u or a, that Insert and Rerole write in each state
_NEXT = [2, 2, 3, 2]
_ENDS = [(0, ""), (10, "II"), (5, "I"), (0, "")]
_NAMES = {1: "user", 2: "assistant"}
#: Inserts before a row, then what happens to it; none of these strings begins another.
_PIECES = sorted("I" * n + x for n, x in product(range(3), "DKR"))

_SPACES = " \t\n\x0b\f\r"


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """(costs, pieces) by kind of row (4 * role + fault: none, blank, duplicate, truncated), state before and state after."""
    costs, pieces = np.full((16, 4, 4), _FAR, np.int64), np.zeros((16, 4, 4), np.int64)
    for role, fault, state in product(range(4), range(4), range(4)):
        at = state
        for n in range(3):
            found = [(2, "D", at)]
            if fault not in (1, 2):
                stays = 5 * (fault == 3)
                found.append((1 + stays, "R", _NEXT[at]))
                if (at, role) in _STEP:
                    found.append((stays, "K", _STEP[at, role]))
            for cost, label, to in found:
                new, old = (5 * n + cost, _PIECES.index("I" * n + label)), (costs[4 * role + fault, state, to], pieces[4 * role + fault, state, to])
                if new < old:
                    costs[4 * role + fault, state, to], pieces[4 * role + fault, state, to] = new
            at = _NEXT[at]
    return costs, pieces


_COSTS, _PIECE = _arcs()


def segment_paths(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[str | None]]]:
    """Of each segment (a byte per row: its kind) the best costs, the order of the labels from each first state, and the labels, by first state and last."""
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    longest = len(codes[order[0]])
    kinds = np.zeros((len(codes), longest), np.int64)
    for place, i in enumerate(order):
        kinds[place, : len(codes[i])] = np.frombuffer(codes[i], np.uint8)
    lengths = np.array([len(codes[i]) for i in order])
    cost = np.full((len(codes), 4, 4), _FAR, np.int64)
    cost[:, range(4), range(4)] = 0
    rank = np.zeros_like(cost)
    came = np.zeros((longest, len(codes), 4, 4), np.int8)
    said = np.zeros_like(came)
    for t in range(longest):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # segments of more than t rows
        arcs, pieces = _COSTS[kinds[:n, t]], _PIECE[kinds[:n, t]]
        total = np.minimum(cost[:n, :, :, None] + arcs[:, None], _FAR)
        labels = rank[:n, :, :, None] * 16 + pieces[:, None]
        best = np.argmin(total * 256 + labels, axis=2)
        pick = best[:, :, None, :]
        cost[:n] = np.take_along_axis(total, pick, 2)[:, :, 0]
        chosen = np.take_along_axis(labels, pick, 2)[:, :, 0]
        rank[:n] = np.argsort(np.argsort(chosen, axis=2, kind="stable"), axis=2, kind="stable")
        came[t, :n] = best
        said[t, :n] = np.take_along_axis(np.broadcast_to(pieces[:, None], labels.shape), pick, 2)[:, :, 0]
    rows = np.arange(len(codes))[:, None, None]
    firsts = np.arange(4)[None, :, None]
    at = np.broadcast_to(np.arange(4), cost.shape).copy()
    path = np.zeros((longest, len(codes), 4, 4), np.int8)
    for t in range(longest - 1, -1, -1):
        on = (lengths > t)[:, None, None]
        path[t] = said[t][rows, firsts, at]
        at = np.where(on, came[t][rows, firsts, at], at)
    text: list[list[str | None]] = [[]] * len(codes)
    for place, i in enumerate(order):
        n = len(codes[i])
        text[i] = [None if cost[place, a, b] >= _FAR else "".join([_PIECES[p] for p in path[:n, place, a, b].tolist()]) for a in range(4) for b in range(4)]
    back = np.argsort(order)
    return cost[back], rank[back], text


_SEGMENT = "conv_id long, at long, rows array<long>, costs array<int>, orders array<int>, labels array<string>, faults array<long>, illegal long, first int, last int"


def _legal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return ((before == 0) & (after == 1)) | ((before == 1) & (after == 2)) | ((before == 2) & (after == 1))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, at, rows, codes to the columns of `_SEGMENT`."""
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        start = 0
        while start < len(codes):
            end, longest = start, 0
            while end < len(codes) and (end == start or (end - start + 1) * max(longest, len(codes[end])) <= 1 << 16):
                longest = max(longest, len(codes[end]))
                end += 1
            raw = [bytes(b - 65 for b in c.encode()) for c in codes[start:end]]
            costs, orders, labels = segment_paths(raw)
            kinds = [np.frombuffer(c, np.uint8) for c in raw]
            part = batch.slice(start, end - start)
            columns = [
                part.column("conv_id"), part.column("at"), part.column("rows"),
                pa.array(costs.reshape(-1, 16).tolist(), pa.list_(pa.int32())), pa.array(orders.reshape(-1, 16).tolist(), pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.string())),
                pa.array([[int((k % 4 == f).sum()) for f in (1, 2, 3)] for k in kinds], pa.list_(pa.int64())),
                pa.array([int((~_legal(k[:-1] // 4, k[1:] // 4)).sum()) for k in kinds], pa.int64()),
                pa.array([int(k[0]) // 4 for k in kinds], pa.int32()), pa.array([int(k[-1]) // 4 for k in kinds], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SEGMENT.split(", ")])
            start = end


_CHAIN = "conv_id long, cost long, illegal long, blank long, duplicate long, truncated long, chain array<struct<at:long,first:int,last:int,tail:string>>"


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest path over each conversation's segments, from the last back to the first."""
    for batch in batches:
        out = []
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            ahead = [cost for cost, _ in _ENDS]
            choices = []
            for part in reversed(parts):
                costs, orders = part["costs"], part["orders"]
                choice = [min(range(4), key=lambda b: (costs[4 * a + b] + ahead[b], orders[4 * a + b])) for a in range(4)]  # noqa: B023
                ahead = [min(costs[4 * a + b] + ahead[b], _FAR) for a, b in enumerate(choice)]
                choices.append(choice)
            state, chain = 0, []
            for part, choice in zip(parts, reversed(choices), strict=True):
                chain.append({"at": part["at"], "first": state, "last": choice[state], "tail": ""})
                state = choice[state]
            chain[-1]["tail"] = _ENDS[state][1]
            between = sum(not _legal(np.int64(a["last"]), np.int64(b["first"])) for a, b in zip(parts, parts[1:]))
            faults = [sum(p["faults"][f] for p in parts) for f in range(3)]
            out.append((conv, ahead[0], sum(p["illegal"] for p in parts) + between, *faults, chain))
        if out:
            kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([("at", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("tail", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _CHAIN.split(", ")[:6]] + ["chain"])


_EDIT = "conv_id long, at long, idx int, edit string, row long, role string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, at, rows, first, labels to a row per edit: the row it is about (null: Insert) and the role it writes (null: the row's own)."""
    for batch in batches:
        for conv, at, rows, state, labels, roles in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "rows", "first", "labels", "roles")), strict=True):
            out, row = [], 0
            for idx, label in enumerate(labels):
                if label == "I":
                    out.append((idx, label, None, _NAMES[_WANTED[state]]))
                    state = _NEXT[state]
                    continue
                out.append((idx, label, rows[row], _NAMES[_WANTED[state]] if label == "R" else None))
                if label == "R":
                    state = _NEXT[state]
                elif label == "K":
                    state = _STEP[state, ord(roles[row]) - 48]
                row += 1
            for start in range(0, len(out), 8192):
                part = list(zip(*out[start : start + 8192], strict=True))
                n = len(part[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * n, pa.int64()), pa.array([at] * n, pa.int64()), pa.array(part[0], pa.int32()), pa.array(part[1], pa.string()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.string())],
                    [x.split()[0] for x in _EDIT.split(", ")],
                )


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired) of turns (conv_id, turn, role, text).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, of every conversation with a row. repaired: conv_id,
    at, idx (their order within a conversation), edit (K, R or I), role, text.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    seen = F.rtrim("text", F.lit(_SPACES))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(~F.substring(seen, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    key = ["conv_id", "turn", "role", "digest", "row"]
    light = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "row", fault.alias("fault"), role.alias("r"))
    light = light.repartitionByRange(task_count(rows, "text"), *key).sortWithinPartitions(*key)
    light = materialize(light.select("conv_id", "role", "digest", "row", "fault", "r", F.monotonically_increasing_id().alias("pos")), "turn-order")

    first = light.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = F.when(F.col("fault") == 1, 1).when(F.col("is_first").isNull(), 2).otherwise(F.col("fault"))
    marked = light.join(first, "pos", "left").select("conv_id", "pos", "row", F.char(65 + 4 * F.col("r") + fault).alias("code"), "r")
    parts = marked.groupBy("conv_id", F.shiftright("pos", SEGMENT_BITS).alias("segment")).agg(F.min("pos").alias("at"), F.sort_array(F.collect_list(F.struct("pos", "row", "code", "r"))).alias("x"))
    parts = parts.select("conv_id", "at", F.col("x.row").alias("rows"), F.array_join("x.code", "").alias("codes"), F.array_join(F.col("x.r").cast("array<string>"), "").alias("roles"))
    coded = materialize(parts, "segments")
    paths = materialize(coded.select("conv_id", "at", "rows", "codes").mapInArrow(_segments, _SEGMENT), "paths")

    links = F.sort_array(F.collect_list(F.struct("at", "costs", "orders", "faults", "illegal", "first", "last"))).alias("parts")
    chains = materialize(paths.groupBy("conv_id").agg(links).mapInArrow(_chains, _CHAIN), "chains")
    taken = chains.select(F.explode("chain").alias("x")).select("x.*")
    labels = F.concat(F.element_at("labels", 4 * F.col("first") + F.col("last") + 1), F.col("tail")).alias("labels")
    taken = paths.select("conv_id", "at", "rows", "labels").join(taken, "at").select("conv_id", "at", "rows", "first", labels).join(coded.select("at", "roles"), "at")
    taken = materialize(taken, "labels")

    audits = taken.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "labels"))), lambda x: x["labels"]), "").alias("audit"))
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    conversations = _together(gaps, chains.drop("chain"), audits)

    edits = taken.mapInArrow(_edits, _EDIT)
    added = edits.where("row IS NULL").select("conv_id", "at", "idx", "edit", "role", F.lit("").alias("text"))
    kept = edits.where("edit IN ('K', 'R')").withColumnRenamed("role", "new").drop("conv_id")
    kept = kept.join(rows, "row").select("conv_id", "at", "idx", "edit", F.coalesce("new", "role").alias("role"), "text")
    return conversations, kept.unionAll(added)


def _together(*tables: DataFrame) -> DataFrame:
    """Tables of at most one row per conv_id side by side, a null conv_id too."""
    columns = [c for t in tables for c in t.columns if c != "conv_id"]
    every = None
    for t in tables:
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    return every.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in columns))


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the hex digest of each conversation's `role:text` lines, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, state = None, None
        done: list[tuple] = []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pack(done)
                done = []
        if state is not None:
            yield pack([(now, state.hexdigest())])

    ordered = repaired.select("conv_id", "at", "idx", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "at", "idx")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns, damaged by crc32(`conv_id:turn`) % 20 (a null is one space): 0 drops a row, 1 empties its text, 2 removes `[.!?]`, 3 repeats it, 4 makes its role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op12(spark, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    conversations, repaired = repair_conversations(damaged(turns))
    known = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = _together(known, conversations, repaired_digests(repaired))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
