"""Best-fit packing: ids of the tokenizer library, an exact round trip, and the fill of best-fit decreasing piece by piece."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapulse.llm import packing
from terrapulse.llm.queries import tokenizer_file

PATH = tokenizer_file()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "a", "The quick brown fox's 12 don't  \n\n stop\t\r\n", "Größe ñandú É 東京 🙂🙃 é", "   x   ", "   y\u0085",
        "a<|endoftext|>b", "x" * 5000, " " * 3000 + "z", "١٢٣ Ⅷ ½", "we'LL I'd 'S",
    ],
)
def test_ids_are_those_of_the_library(plain, text):
    assert packing.encoder(PATH)(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts(plain):
    rng = random.Random(1)
    marks = "aeßÉ 0١\t\n'’ -_#🙂​　lst"
    for _ in range(300):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 60)))
        assert packing.encoder(PATH)(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_round_trip(documents, corpus, plain):
    capacity = 64
    pieces = packing.tokenized(documents(corpus), PATH, capacity, with_ids=True).cache()
    rows = packing.packed(pieces, capacity).collect()
    want = sorted(((d, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (packing.END,)) for d, t in corpus), key=str)
    texts: dict = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] <= capacity
        assert r["length"] == capacity or r["piece"] == 0
        texts.setdefault((r["doc_id"], r["piece"]), []).append(r)
    ids = {}
    for (d, k), same in sorted(texts.items(), key=str):
        ids.setdefault(d, {})[k] = same
    for d, parts in ids.items():
        whole = [parts[k][0]["ids"] for k in sorted(parts)]
        if d is not None and all(len(p) == 1 for p in parts.values()):
            assert (d, tuple(x for p in whole for x in p)) in want
            assert [parts[k][0]["start"] for k in sorted(parts)] == [sum(map(len, whole[:k])) for k in range(len(whole))]
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in want)
    gapless(rows, capacity)
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.packed(pieces, capacity)).collect()}
    assert sum(map(len, made.values())) == sum(r["length"] for r in rows) and max(map(len, made.values())) <= capacity


def gapless(rows, capacity):
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def best_fit(lengths, capacity):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_fills_like_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randint(3, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        segments = packing.plan(histogram, capacity)
        rows = []
        for length, first, last, per, at, base in segments:
            rows += [{"sequence_id": at + i // per, "offset": base + i % per * length, "length": length} for i in range(last - first)]
        assert sorted(r["length"] for r in rows) == sorted(lengths)
        assert gapless(rows, capacity) == best_fit(lengths, capacity)
        for length in histogram:
            ranks = sorted((a, b) for n, a, b, *_ in segments if n == length)
            assert ranks[0][0] == 0 and ranks[-1][1] == histogram[length] and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:], strict=False))


def test_empty_table_and_too_long_pieces(documents):
    assert packing.pack_documents(documents([]), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_wide_plans_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_SEGMENTS", 0)
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 17 + 1).alias("length"), F.lit(0).alias("ids_crc32"))
    assert gapless(packing.packed(pieces, 20).collect(), 20) == best_fit([i % 17 + 1 for i in range(500)], 20)
