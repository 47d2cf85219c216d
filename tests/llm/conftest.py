from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (doc_id, text) pairs to a table, with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    def make(rows, source="s"):
        df = spark.createDataFrame([(d, t, source) for d, t in rows], "doc_id long, text string, source string")
        clashing = ("length", "piece", "print", "shard", "bucket", "digest", "anchor", "row", "n", "kept", "tokens", "block", "key", "id")
        return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clashing)])

    return make


@pytest.fixture(scope="session")
def corpus():
    """Odd and ordinary rows: nulls, empty texts, ties, repeated rows, copies, near copies, shared passages, one very long text."""
    rng = random.Random(5)
    syllables = ["the", "an", "er", "ion", "ße", "ña", "ou", "re", "st", "al", "É", "x9"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(90)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "a b c d"), (7, "A  b\tC d")]
    rows += [(10 + i, prose(rng.randint(20, 150))) for i in range(25)]
    rows += [(40 + i, rows[10 + i][1]) for i in range(5)]
    rows += [(50 + i, rows[12 + i][1].replace(" ", "  ", 1) + " tail") for i in range(5)]
    rows += [(60 + i, prose(30) + "\n" + shared + "\n" + prose(20)) for i in range(6)]
    rows += [(70, "ab " * 900), (71, "z" * 3000), (72, prose(40) + "🙂 " + prose(5)), (73, prose(12000))]
    rows += [(80, shared), (80, shared), (None, shared), (None, "no id, no copy " + prose(60)), (-5, prose(70))]
    return rows
