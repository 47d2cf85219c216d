"""Repair of conversations at least cost, with the least audit.

An edit list keeps (K), reroles (R) or deletes (D) each row and inserts (I) rows,
so that the role initials become `(s?(ua)+)?`. Nodes are places between rows times
the four states of that pattern. A backward dynamic program gives each node its
cost to the end; what keeps to that cost are the optimal arcs. Nodes are then
ranked by the least labels of their next 1, 2, 4, ... arcs: a rank of twice the
length is the rank of a node together with the one its doubled pointer leads to.
The path from the start is read off the doubled pointers, all its arcs at once.

Rows are ordered by ranges of (conversation, turn, role, beginning of the text), so
a large conversation lies in several partitions. Its part in one partition is a
segment; a segment acts on costs as a (min, +) matrix and on states as a map from
first to last. At most two segments of a partition belong to conversations that
cross its borders, so chains of segments have a few rows for each partition,
whatever the conversations' sizes. Rows that agree in all columns are one row with
a count. The digest of a repaired conversation is a chain by its definition; the
rows of those that cross a border stream through it in order, batch by batch.

Defined results: in role and text a null is one space; conversations without an id
are one conversation, with a null id. Rows of one turn are ordered by role, then
text. Null turns come first and don't count for gaps. Empty and very long texts
are rows like others. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import cut, join_hot

#: Costs of the edits and of an undeleted truncated row, and the space characters.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text in a partition, on average, and rows at most on average.
PART_BYTES, PART_ROWS = 64 << 20, 500_000
#: Rows that one step of the dynamic program goes back through, in each piece of a segment.
PIECE = 256
#: Characters of a text by which rows of one turn and role are dealt to partitions.
HEAD = 64

START, AFTER_S, AFTER_U, AFTER_A = range(4)
FAR = 1 << 40
#: Where a row of each role leads from each state, kept: columns are s, u, a, other. -1: nowhere.
KEPT = np.array([[AFTER_S, AFTER_U, -1, -1], [-1, AFTER_U, -1, -1], [-1, -1, AFTER_A, -1], [-1, AFTER_U, -1, -1]])
#: The only state that a user or assistant row leads to.
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
#: From behind the last row: cost to the end, and the rows to insert.
END = np.array([0, 2 * INSERT, INSERT, 0])
#: Labels in the order of their letters; the place of an arc to the next row's node comes with it.
D, I, K, R = range(4)
LETTERS = np.frombuffer(b"DIKR", np.uint8)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, n): the rows that are left, equal ones as one with their number; conv is a key without nulls."""
    none = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    word = F.concat(F.coalesce(F.col("conv_id").cast("string"), none), F.lit(":"), F.coalesce(F.col("turn").cast("string"), none))
    rows = rows.withColumn("_how", F.crc32(word) % 20).where("_how != 0")
    rows = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "conv_id", "turn",
        F.when(F.col("_how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_how") == 3, 2).otherwise(1).alias("n"),
    )
    return rows.groupBy("conv", "conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _said() -> Column:
    """Role and text of a row in its conversation, as a digest."""
    return F.sha2(F.concat(F.col("conv"), F.lit("\0"), F.length("role").cast("string"), F.lit("\0"), F.col("role"), F.col("text")), 256)


def faulty(rows: DataFrame) -> DataFrame:
    """Adds `kind` (s, u, a or other, as a number), `fault` (0 none, 1 truncated, 2 duplicate, 3 blank) and `more`: equal rows that follow, of the worse fault."""
    end = F.rtrim("text", F.lit(SPACES))
    marked = rows.withColumn("said", _said())
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = marked.groupBy("said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    joined = join_hot(marked, first, "said", "times", marked.count(), F.col("turn"))
    fault = F.when(end == "", 3).when(place > F.col("first"), 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return joined.select("conv", "conv_id", "turn", "role", "text", kind.cast("byte").alias("kind"), fault.cast("byte").alias("fault"), (F.col("n") - 1).alias("more"))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows in ranges, with their partition's number."""
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, size // PART_BYTES + 1, n // PART_ROWS + 1)
    turn = F.col("turn").asc_nulls_first()
    ranged = rows.withColumn("head", F.left("text", F.lit(HEAD))).repartitionByRange(parts, "conv", turn, "role", "head")
    return cut(ranged.sortWithinPartitions("conv", turn, "role", "text").withColumn("part", F.spark_partition_id()).drop("head"))


@dataclass
class Paths:
    """Over several segments laid end to end: `first` is each one's first row, with a last one behind all.

    Node 4 * (row + segment) + state is before the row; each segment has four more
    behind its last row. Labels are -1 where no arc leaves.
    """

    first: np.ndarray
    cost: np.ndarray
    label: np.ndarray
    target: np.ndarray


def _row_costs(kind: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keep, rerole) for rows by state: costs of those arcs; FAR where there is none."""
    stays = np.where(fault == 1, TRUNCATED, 0)[:, None]
    lost = (fault >= 2)[:, None]
    keep = np.where((KEPT.T[kind] >= 0) & ~lost, stays, FAR)
    rerole = np.where(lost, FAR, stays + REROLE) + np.zeros((1, 4), np.int64)
    return keep, rerole


def _stepped(first: np.ndarray, kind: np.ndarray, fault: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The nodes' costs, all segments in step from their ends; `behind` has those behind each segment, by state and any further axes."""
    sizes = np.diff(first)
    keep, rerole = _row_costs(kind, fault)
    cost = np.full((int(first[-1]) + len(sizes), *behind.shape[1:]), FAR, np.int64)
    at = first[1:] + np.arange(len(sizes))
    cost[at] = behind
    more = (1,) * (behind.ndim - 2)
    for back in range(1, int(sizes.max(initial=0)) + 1):
        some = np.flatnonzero(sizes >= back)
        row, node = first[1:][some] - back, at[some] - back
        after = cost[node + 1]
        to = np.maximum(KEPT.T[kind[row]], 0).reshape(len(some), 4, *more)
        kept = np.take_along_axis(after, np.broadcast_to(to, after.shape), axis=1)
        best = np.minimum(after + DELETE, kept + keep[row].reshape(to.shape))
        best = np.minimum(best, after[:, NEXT] + rerole[row].reshape(to.shape))
        # Rows inserted before the row: two reach every state that any number reaches.
        for _ in range(2):
            best = np.minimum(best, best[:, NEXT] + INSERT)
        cost[node] = np.minimum(best, FAR)
    return cost


def _acts(first: np.ndarray, kind: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Each segment as a (min, +) matrix: the cost from each state before it to each state behind it."""
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    cost = _stepped(first, kind, fault, np.repeat(unit[None], len(first) - 1, axis=0))
    return cost[first[:-1] + np.arange(len(first) - 1)]


def segment_acts(first: np.ndarray, kind: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """As `_acts`, long segments by their pieces."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        starts = np.append(np.arange(a, b, PIECE), b) - a
        acts = _acts(starts, kind[a:b], fault[a:b])
        whole = acts[-1]
        for act in acts[-2::-1]:
            whole = np.minimum((act[:, :, None] + whole[None]).min(axis=1), FAR)
        out.append(whole)
    return np.array(out)


def backward(first: np.ndarray, kind: np.ndarray, fault: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The nodes' costs by state. Long segments go in pieces, so that many rows are handled in a step."""
    sizes = np.diff(first)
    pieces = -(-sizes // PIECE)
    if pieces.max(initial=0) <= 1:
        return _stepped(first, kind, fault, behind)
    of = np.repeat(np.arange(len(sizes)), pieces)
    place = np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of]
    starts = np.append(first[of] + place * PIECE, first[-1])
    acts, ends = _acts(starts, kind, fault), np.empty((len(of), 4), np.int64)
    for i in reversed(range(len(of))):
        last = i + 1 == len(of) or of[i + 1] != of[i]
        ends[i] = behind[of[i]] if last else np.minimum((acts[i + 1] + ends[i + 1]).min(axis=1), FAR)
    cost = _stepped(starts, kind, fault, ends)
    # The nodes behind a piece are those before the next one.
    inner = np.flatnonzero(of[1:] == of[:-1])
    return np.delete(cost, starts[1:][inner] + inner, axis=0)


def paths(first: np.ndarray, kind: np.ndarray, fault: np.ndarray, behind: np.ndarray) -> Paths:
    """The optimal arc of the least label from each node; no node has two of one label, as a state has one successor for user and assistant."""
    sizes = np.diff(first)
    cost = backward(first, kind, fault, behind)
    keep, rerole = _row_costs(kind, fault)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    node = np.arange(len(kind)) + segment
    label = np.full(cost.shape, -1, np.int8)
    target = np.arange(cost.size).reshape(cost.shape)
    here, after = cost[node], cost[node + 1]
    base = (node + 1)[:, None] * 4
    kept = KEPT.T[kind]
    arcs = (
        (R, rerole + after[:, NEXT], base + NEXT),
        (K, keep + np.take_along_axis(after, np.maximum(kept, 0), 1), base + np.maximum(kept, 0)),
        (I, here[:, NEXT] + INSERT, node[:, None] * 4 + NEXT),
        (D, after + DELETE, base + np.arange(4)),
    )
    for letter, total, to in arcs:
        optimal = (total == here) & (here < FAR)
        label[node] = np.where(optimal, letter, label[node])
        target[node] = np.where(optimal, to, target[node])
    return Paths(first, cost, label.ravel(), target.ravel())


def doubled(found: Paths) -> tuple[list[np.ndarray], np.ndarray]:
    """(pointers, rank): where each node's least path is after 1, 2, 4, ... arcs, and the rank of its whole audit; the empty one has rank 0.

    A node's rank by twice the length is that of its own rank with the rank of the
    node its pointer leads to. Least paths are compared label by label, and no two
    arcs of a node share a label, so the first ranks decide which arc is the least.
    """
    pointers, rank = [found.target], found.label.astype(np.int64) + 1
    while True:
        p = pointers[-1]
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[p], return_inverse=True)[1].astype(np.int64)
        if (found.label[p] < 0).all():
            return pointers, rank
        pointers.append(p[p])


def walked(found: Paths, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, node of each step, end of each path): the least paths from the starts, in order.

    Doubled pointers are followed while a rest is left (a rank over 0), which counts
    a path's arcs; then each step's node is found from the bits of its place.
    """
    pointers, rank = doubled(found)
    length, at = np.zeros(len(starts), np.int64), starts.copy()
    for k in reversed(range(len(pointers))):
        to = pointers[k][at]
        at = np.where(rank[to] > 0, to, at)
        length += (rank[to] > 0).astype(np.int64) << k
    length += rank[at] > 0
    path = np.repeat(np.arange(len(starts)), length)
    place = np.arange(len(path)) - np.repeat(np.cumsum(length) - length, length)
    nodes = starts[path]
    for k, p in enumerate(pointers):
        nodes = np.where(place >> k & 1, p[nodes], nodes)
    return path, nodes, found.target[at]


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _segments(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole segments, some at once: the rows and each segment's first one, with a last one behind all."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy(zero_copy_only=False)
        start = np.flatnonzero(conv[1:] != conv[:-1]) + 1
        if held and conv[0] != held[-1].column("conv")[held[-1].num_rows - 1].as_py():
            start = np.concatenate([[0], start])
        if len(start):
            held.append(batch.slice(0, int(start[-1])))
            yield _whole(held, columns)
            held = [batch.slice(int(start[-1]))]
        else:
            held.append(batch)
    if held:
        yield _whole(held, columns)


def _whole(held: list[pa.RecordBatch], columns: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches([b for b in held if b.num_rows]).select(columns)
    conv = table.column("conv").to_numpy()
    first = np.flatnonzero(conv[1:] != conv[:-1]) + 1
    return table, np.concatenate([[0], first, [len(conv)]]).astype(np.int64)


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _counts(kind: np.ndarray, fault: np.ndarray, more: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Per segment: faulty rows, and neighbours within it that may not follow each other."""
    fits = np.zeros((4, 4), bool)
    fits[0, 1] = fits[1, 2] = fits[2, 1] = True
    pairs = np.zeros(len(kind), np.int64)
    pairs[1:] = ~fits[kind[:-1], kind[1:]]
    pairs[first[:-1]] = 0
    each = {
        "blank": (fault == 3) * (more + 1),
        "duplicate": np.where(fault == 2, more + 1, np.where(fault < 2, more, 0)),
        "truncated": (fault == 1).astype(np.int64),
        "illegal": pairs + more,
    }
    return {name: np.add.reduceat(x, first[:-1]) for name, x in each.items()}


SEGMENT = "conv string, part int, matrix array<long>, kinds array<int>"


def _matrices(rows: DataFrame) -> DataFrame:
    """The segments of conversations that have several: what they do to costs, and their first and last rows' kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _segments(batches, ["conv", "kind", "fault", "part"]):
            kind, fault = _ints(table, "kind"), _ints(table, "fault")
            acts = segment_acts(first, kind, fault)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("conv").take(first[:-1]).combine_chunks(), table.column("part").take(first[:-1]).combine_chunks(),
                    pa.array(acts.reshape(-1, 16).tolist(), pa.list_(pa.int64())), pa.array(np.stack([kind[first[:-1]], kind[first[1:] - 1]], 1).astype(np.int32).tolist(), pa.list_(pa.int32())),
                ],
                ["conv", "part", "matrix", "kinds"],
            )

    return rows.mapInArrow(run, SEGMENT)


def _chained_costs(segments: pd.DataFrame) -> pd.DataFrame:
    """What is behind each of a conversation's segments, by state, and whether a neighbour before it does not fit."""
    segments = segments.sort_values("part", ignore_index=True)
    behind, out = END.copy(), []
    for matrix in segments["matrix"][::-1]:
        out.append(behind)
        behind = (np.array(matrix).reshape(4, 4) + behind[None]).min(axis=1)
    kinds = segments["kinds"].tolist()
    wrong = [0] + [int((a[1], b[0]) not in {(0, 1), (1, 2), (2, 1)}) for a, b in zip(kinds, kinds[1:], strict=False)]
    return pd.DataFrame({"conv": segments["conv"], "part": segments["part"], "behind": out[::-1], "wrong": wrong, "last": [False] * (len(out) - 1) + [True]})


def _chained_states(segments: pd.DataFrame) -> pd.DataFrame:
    """The state in which the least path enters each of a conversation's segments."""
    segments = segments.sort_values("part", ignore_index=True)
    state, out = START, []
    for ends in segments["ends"]:
        out.append(state)
        state = int(ends[state])
    return pd.DataFrame({"conv": segments["conv"], "part": segments["part"], "state": out})


def _mapped(rows: DataFrame) -> DataFrame:
    """(conv, part, ends): in which state the least path leaves a segment, for each state in which it may enter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _segments(batches, ["conv", "kind", "fault", "part", "behind"]):
            behind = np.array(table.column("behind").take(first[:-1]).to_pylist(), np.int64)
            found = paths(first, _ints(table, "kind"), _ints(table, "fault"), behind)
            at = (first[:-1] + np.arange(len(first) - 1)) * 4
            ends = walked(found, (at[:, None] + np.arange(4)).ravel())[2] % 4
            yield pa.RecordBatch.from_arrays(
                [table.column("conv").take(first[:-1]).combine_chunks(), table.column("part").take(first[:-1]).combine_chunks(), pa.array(ends.reshape(-1, 4).tolist(), pa.list_(pa.int32()))],
                ["conv", "part", "ends"],
            )

    return rows.mapInArrow(run, "conv string, part int, ends array<int>")


REPAIRED = "conv string, part int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha256 string, lines array<string>"


def _lines(nodes: np.ndarray, labels: np.ndarray, rows: np.ndarray, role: list[str], text: list[str]) -> list[str]:
    """The repaired rows of one path: `nodes` and `labels` of its steps, and the row that each step edits or comes before."""
    out, names = [], {AFTER_U: "user", AFTER_A: "assistant"}
    for node, label, row in zip(nodes.tolist(), labels.tolist(), rows.tolist(), strict=True):
        if label == I:
            out.append(names[int(NEXT[node % 4])] + ":")
        elif label == K:
            out.append(f"{role[row]}:{text[row]}")
        elif label == R:
            out.append(f"{names[int(NEXT[node % 4])]}:{text[row]}")
    return out


def _repaired(rows: DataFrame) -> DataFrame:
    """A row for each segment. A conversation of one segment has its digest, the others' lines go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["conv", "role", "text", "kind", "fault", "more", "part", "behind", "wrong", "last", "state", "single"]
        for table, first in _segments(batches, columns):
            n = len(first) - 1
            kind, fault, more = _ints(table, "kind"), _ints(table, "fault"), _ints(table, "more")
            one = {c: table.column(c).take(first[:-1]).to_pylist() for c in ("conv", "part", "behind", "wrong", "last", "state", "single")}
            found = paths(first, kind, fault, np.array(one["behind"], np.int64))
            start = (first[:-1] + np.arange(n)) * 4 + np.array(one["state"])
            path, nodes, ends = walked(found, start)
            counts = _counts(kind, fault, more, first)
            counts["illegal"] = counts["illegal"] + np.array(one["wrong"])
            cost = found.cost.ravel()[start] - np.where(one["last"], 0, found.cost.ravel()[ends])
            cost = cost + DELETE * np.add.reduceat(more, first[:-1])
            labels = found.label[nodes]
            row = nodes // 4 - path
            # An edited row is followed by the deletions of the rows that equal it.
            again = np.where(labels != I, more[row], 0)
            letters = LETTERS[np.repeat(np.where(np.arange(2 * len(labels)) % 2 == 0, np.repeat(labels, 2), D), np.stack([np.ones_like(again), again], 1).ravel())]
            steps = np.searchsorted(path, np.arange(n + 1))
            ink = np.concatenate([[0], np.cumsum(1 + again)])[steps]
            audits, digests, lines, role, text = [], [], [], table.column("role").to_pylist(), table.column("text").to_pylist()
            for i in range(n):
                some = slice(steps[i], steps[i + 1])
                said, audit = _lines(nodes[some], labels[some], row[some], role, text), letters[ink[i] : ink[i + 1]].tobytes().decode()
                if one["last"][i]:
                    tail = {AFTER_S: ["user:", "assistant:"], AFTER_U: ["assistant:"]}.get(int(ends[i]) % 4, [])
                    said, audit = said + tail, audit + "I" * len(tail)
                audits.append(audit)
                digests.append(hashlib.sha256("\n".join(said).encode("utf-8", "replace")).hexdigest() if one["single"][i] else None)
                lines.append(None if one["single"][i] else said)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(one["conv"], pa.string()), pa.array(one["part"], pa.int32()), *(pa.array(counts[c]) for c in COUNTS), pa.array(cost),
                    pa.array(audits, pa.string()), pa.array(digests, pa.string()), pa.array(lines, pa.list_(pa.string())),
                ],
                ["conv", "part", *COUNTS, "cost", "audit", "sha256", "lines"],
            )

    return rows.mapInArrow(run, REPAIRED)


def _digests(segments: DataFrame) -> DataFrame:
    """(conv, sha256) of conversations of several segments, whose lines stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, empty, done = None, hashlib.sha256(), True, []
        for batch in batches:
            for name, line in zip(batch.column("conv").to_pylist(), batch.column("line"), strict=True):
                if name != conv:
                    done += [] if conv is None else [(conv, digest.hexdigest())]
                    conv, digest, empty = name, hashlib.sha256(), True
                if (said := line.as_py()) is not None:
                    digest.update(b"" if empty else b"\n")
                    digest.update(said.encode("utf-8", "replace"))
                    empty = False
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["conv", "sha256"])
                done = []
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], ["conv", "sha256"])

    lines = segments.select("conv", "part", F.posexplode_outer("lines").alias("place", "line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "part", "place").select("conv", "line").mapInArrow(run, "conv string, sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of `ordered` rows."""
    few = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    # A partition has two segments at most whose conversations cross its borders, so what is broadcast has a few rows for each partition.
    # Joins by broadcast keep the rows' order within a partition.
    several = cut(few.groupBy("conv").agg(F.count(F.lit(1)).alias("segments")).where("segments > 1").select("conv"))
    crossing = cut(rows.join(F.broadcast(several), "conv", "left_semi"))
    chain = "conv string, part int, behind array<long>, wrong int, last boolean"
    costs = cut(_matrices(crossing).groupBy("conv").applyInPandas(_chained_costs, chain))
    ends = _mapped(crossing.join(F.broadcast(costs), ["conv", "part"]))
    states = ends.groupBy("conv").applyInPandas(_chained_states, "conv string, part int, state int")
    known = cut(costs.join(states, ["conv", "part"]))
    end = F.array(*[F.lit(int(x)).cast("long") for x in END])
    whole = rows.join(F.broadcast(known), ["conv", "part"], "left").select(
        "conv", "role", "text", "kind", "fault", "more", "part", F.coalesce("behind", end).alias("behind"), F.coalesce("wrong", F.lit(0)).alias("wrong"),
        F.coalesce("last", F.lit(True)).alias("last"), F.coalesce("state", F.lit(START)).alias("state"), F.col("behind").isNull().alias("single"),
    )
    segments = cut(_repaired(whole))
    sums = [F.sum(c).alias(c) for c in (*COUNTS, "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda s: s["audit"]), "")
    per = segments.groupBy("conv").agg(*sums, audit.alias("audit"), F.max("sha256").alias("sha256"))
    chained = _digests(segments.where("sha256 is null"))
    return per.join(chained.withColumnRenamed("sha256", "chained"), "conv", "left").select("conv", *COUNTS, "cost", "audit", F.coalesce("sha256", "chained").alias("repaired_sha256"))


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, after the damage."""
    left = cut(damaged(conversations))
    rows = ordered(faulty(left))
    turns = left.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.max("turn").alias("b"), F.min("turn").alias("a"), F.count("turn").alias("n"))
    gaps = turns.select("conv", F.coalesce(F.col("b") - F.col("a") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    every = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    found = every.join(repaired(rows), "conv", "left").join(gaps, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
