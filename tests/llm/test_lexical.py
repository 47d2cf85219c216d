"""Ranked search against a plain ranking of all documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from terrapulse.llm import lexical, queries, sql

SF = "/root/testdata/sf0.001"


def plain(docs, items, top=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def terms(text):
        return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))

    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c, n in held:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def asked(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, score string")


ITEMS = [(1, "The an ER x9 ßeße"), (2, None), (3, ""), (None, "one ñaña ab"), (5, "zzzz unheard"), (1, "one ionst"), (7, "a B c"), (8, "the " * 200 + "Éan st")]


def rows(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("size", "top"), [(4096, 50), (3, 4)])
def test_ranks(spark, documents, corpus, size, top):
    """Also with slices of three documents and few places, so that bounds leave most documents behind."""
    words = [t for _, t in corpus if t and len(t) < 2000]
    items = ITEMS + [(100 + i, t[:300]) for i, t in enumerate(words[10:16])]
    assert rows(lexical.search(documents(corpus), asked(spark, items), top, size, 2 if top == 4 else 256)) == plain(corpus, items, top)


def test_several_loads(spark, documents, corpus):
    assert rows(lexical.search(documents(corpus), asked(spark, ITEMS), vocabulary=4)) == plain(corpus, ITEMS)


def test_copies_and_empty_tables(spark, documents):
    """Copies are ranked one by one, by id; a document repeated very often takes all places."""
    many = [(i % 40, "alpha beta") for i in range(90)] + [(None, "alpha beta"), (99, "gamma")]
    got = rows(lexical.search(documents(many), asked(spark, [(1, "beta"), (2, "gamma")])))
    assert [r[2:] for r in sorted(got, key=lambda r: (r[0], r[1]))] == [r[2:] for r in sorted(plain(many, [(1, "beta"), (2, "gamma")]), key=lambda r: (r[0], r[1]))]
    assert rows(lexical.search(documents([]), asked(spark, ITEMS))) == []
    assert rows(lexical.search(documents([(1, None)]), asked(spark, ITEMS))) == []
    assert rows(lexical.search(documents(many), asked(spark, []))) == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "alpha"), ("a", "alpha"), (None, "alpha"), ("c", "other")], "doc_id string, text string")
    got = lexical.search(docs, asked(spark, [(1, "alpha")])).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["a", "b", None]


def test_registered_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = connection.execute(f"select item_id, rank, doc_id, score from ({sql.LEXICAL})").fetchall()
    assert rows(queries.op13_ranked_lexical_search(spark, SF)) == sorted(want, key=str)
