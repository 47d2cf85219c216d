"""Exact dedup and sharding against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

from terrapulse.llm import exact, shards


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain(rows):
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(normalised(t), []).append(d)
    out = []
    for text, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        at = ids.index(keep)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, keep, len(ids), i == at, digest) for i, d in enumerate(ids)]
    return sorted(out, key=str)


def test_equals_grouping(documents, corpus):
    for rows in (corpus, corpus + corpus[5:9], [(None, "x"), (None, "x"), (None, "y")], [(3, "a")] * 4):
        got = [tuple(r)[:5] for r in exact.deduplicate(documents(rows)).collect()]
        assert sorted(got, key=str) == plain(rows)
    assert exact.deduplicate(documents([])).count() == 0


def test_members_and_others_are_told_apart(documents, corpus):
    """Arrivals against an index of a history: repeats join its winners, the rest groups apart."""
    old, new = corpus[:25], corpus[25:]
    index = exact.build_index(exact.digested(documents(old)), 3)
    rows = exact.resolve(index, exact.digested(documents(new)), 3).collect()
    known = {hashlib.sha256(normalised(t).encode()).digest() for _, t in old}
    found = {bytes(r["digest"]): r["seen_before"] for r in rows}
    assert {d for d, seen in found.items() if seen} == known
    assert len(found) == len(known | {hashlib.sha256(normalised(t).encode()).digest() for _, t in new})


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 4000):
        words = rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64)
        sizes, bits, slots = exact.perfect_hash(words)
        assert sorted(slots.tolist()) == list(range(n))
        assert (exact.slots_of(words, sizes, bits) == slots).all()
        strange = exact.slots_of(rng.integers(0, 1 << 63, (500, 4)).astype(np.uint64), sizes, bits)
        assert strange.min() >= -1 and strange.max() < max(n, 1)


def test_sharding(documents, corpus):
    rows, slot_map = shards.sharded(documents(corpus), shards=4, slots=64)
    got = rows.collect()
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in corpus if d is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(corpus) and slot_map.version == 2
    for s in range(4):
        assert sorted(r["place"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    empty, even = shards.sharded(documents([]), shards=4, slots=64)
    assert empty.count() == 0 and sorted(even.home.values()) == sorted(list(range(4)) * 16)


def test_a_hot_key_is_split(documents):
    rows, slot_map = shards.sharded(documents([(7, "same text")] * 600 + [(i, "text") for i in range(100, 700)]), shards=4, slots=32)
    load: dict = {}
    for r in rows.collect():
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) < 1.1 * min(load.values()) and max(slot_map.parts.values()) > 8


def test_rebalancing_moves_little_and_levels(spark, tmp_path):
    first = shards.SlotMap.even(512, 8)
    weight = {(s, 0): 100 + s % 7 for s in range(512)}
    level = first.rebalanced(weight)
    weight |= {(s, 0): 300 for s in range(0, 512, 8)}
    after = level.rebalanced(weight)
    load = [sum(weight[u] for u, h in after.home.items() if h == k) for k in range(8)]
    # Closer than the lightest slot.
    assert max(load) - min(load) < 100 and after.version == 3 and level.moved(after) < 256
    grown = after.rebalanced(weight, shards=9)
    assert {h for h in grown.home.values()} == set(range(9))
    after.save(spark, str(tmp_path))
    assert shards.SlotMap.load(spark, str(tmp_path), 3) == after
