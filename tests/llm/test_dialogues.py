"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from terrapulse.llm import dialogues, queries

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, part int, kind string, n int"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def edited(rows, faults):
    """(cost, audit, lines) by a search ordered by cost, then audit."""
    leads = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        steps = [(5, "I", i, c, (names[c] + ":",)) for c in leads[state] if c != "s"]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((2, "D", i + 1, state, ()))
            if faults[i] < 2:
                stays = 5 * (faults[i] == 1)
                if role[:1] and role[:1] in leads[state]:
                    steps.append((stays, "K", i + 1, role[:1], (f"{role}:{text}",)))
                steps += [(stays + 1, "R", i + 1, c, (f"{names[c]}:{text}",)) for c in leads[state] if c != "s"]
        for more, letter, at, to, said in steps:
            heapq.heappush(heap, (cost + more, audit + letter, at, to, lines + said))
    raise AssertionError


def plain(table):
    convs: dict = {c: [] for c, *_ in table}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        convs[conv] += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, seen, faults = {r[0] for r in rows if r[0] is not None}, set(), []
        for _, role, text in rows:
            said = text.rstrip(SPACES)
            faults.append(3 if not said else 2 if (role, text) in seen else 1 if said[-1] not in ".!?" else 0)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = edited(rows, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in (3, 2, 1)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 5) for r in rows], SCHEMA)


def repaired(df):
    return sorted((tuple(r) for r in dialogues.repair(df).select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User", None]
    ends = [".", "!", "?", ".", "", " ", "\n", ".\t"]
    rows = []
    for conv in [*range(60), None]:
        turn = rng.randint(0, 3)
        for _ in range(rng.randint(1, 14)):
            said = rng.choice(["hello there", "yes", "no", "ça va", "x" * 300, ""])
            text = None if rng.random() < 0.04 else said + rng.choice(ends)
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(roles[: 5 if rng.random() < 0.8 else 9]), text))
            turn += rng.choice([1, 1, 1, 0, 3])
    return rows + rows[5:9] + [rows[20]] * 3


@pytest.mark.parametrize("part_rows", [500_000, 7])
def test_repairs(spark, talk, monkeypatch, part_rows):
    """Whole conversations, and conversations cut at the borders of small partitions."""
    monkeypatch.setattr(dialogues, "PART_ROWS", part_rows)
    assert repaired(table(spark, talk)) == plain(talk)


def test_one_long_conversation(spark, monkeypatch):
    """It goes over many partitions and pieces; a third of its rows are equal."""
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", "word %d." % t, "open %d" % t, " "])) for t in range(900)]
    rows += [(1, 400, "user", "same.")] * 300 + [(2, 0, "user", "a."), (2, 1, "assistant", "b."), (3, 7, "assistant", "only.")]
    monkeypatch.setattr(dialogues, "PART_ROWS", 60)
    monkeypatch.setattr(dialogues, "PIECE", 8)
    assert repaired(table(spark, rows)) == plain(rows)


def test_nothing_left_and_empty_tables(spark):
    """A conversation of which every row is dropped keeps its id, with zeros."""
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a.")]
    assert repaired(table(spark, rows)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] == plain(rows)
    assert repaired(table(spark, [])) == []


def test_pieces_and_doubled_pointers():
    """The same costs in pieces as in one, and each least path's labels in order of its nodes."""
    rng = np.random.default_rng(1)
    first = np.array([0, 700, 703, 1500])
    kind, fault = rng.integers(0, 4, 1500), rng.choice([0, 0, 0, 1, 2, 3], 1500)
    behind = np.repeat(dialogues.END[None], 3, axis=0)
    assert (dialogues.backward(first, kind, fault, behind) == dialogues._stepped(first, kind, fault, behind)).all()
    acts = dialogues.segment_acts(first, kind, fault)
    found = dialogues.paths(first, kind, fault, behind)
    at = first[:-1] + np.arange(3)
    assert (np.minimum((acts + dialogues.END).min(axis=2), dialogues.FAR) == found.cost[at]).all()
    path, nodes, ends = dialogues.walked(found, at * 4)
    for i in range(3):
        node, steps = at[i] * 4, nodes[path == i].tolist()
        for step in steps:
            assert step == node
            node = found.target[node]
        assert node == ends[i] and found.label[node] < 0


def test_registered(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    want = plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert sorted((tuple(r) for r in queries.op12_conversation_structure_repair(spark, SF).select(*COLUMNS).collect()), key=str) == want
