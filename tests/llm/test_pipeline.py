"""Every stage on what the one before kept, held against plain versions; the registered names."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrapulse.llm import mixing, near, quality, queries, simhash

SF = "/root/testdata/sf0.001"


def identity(rows):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in rows), key=str)


def test_stages(spark, documents, corpus):
    given = documents(corpus)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    accept, exact, near, mix, pack = [f for _, f in corpus_pipeline.STAGES]

    def step(stage, docs):
        rows = stage(spark, docs, SF)
        assert rows.columns == given.columns
        return spark.createDataFrame(rows.collect(), given.schema)

    kept = step(accept, given)
    verdicts = quality.judged(given, quality.train(given, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept").count()
    assert 0 < kept.count() == verdicts < len(corpus)

    single = step(exact, kept)
    groups: dict = {}
    for r in kept.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r)
    want = [min(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for rows in groups.values()]
    assert [x[0] for x in identity(single.collect())] == [x[0] for x in identity(want)]

    apart = step(near, single)
    left = {r["text"] for r in apart.collect()}
    assert left <= {r["text"] for r in single.collect()} and len(left) == apart.count()
    assert {r["doc_id"] for r in near(spark, apart, SF).collect()} == {r["doc_id"] for r in apart.collect()}

    mixed = step(mix, apart)
    assert identity(mixed.distinct().collect()) == identity(apart.collect())

    packed = pack(spark, mixed, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed.collect()}
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_small_sources_repeat(spark):
    """In the mixing stage no document is lost and rare sources come more often."""
    rows = [(i, f"some words of document {i}", "big" if i < 90 else "small") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.mix(spark, docs, SF).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in got}
    assert counts["big"] == 90 and 10 < counts["small"] <= 40


def test_names():
    assert sorted(n for n in queries.QUERIES) == sorted(
        ["op1_best_fit_packing", "op2_source_mixing", "op3_license_scans", "op4_sharding", "op5_exact_dedup", "op6_substring_dedup",
         "op7_quality_rules", "op8_simhash_near_dedup", "op9_suffix_array_dedup", "op10_secret_scans", "op11_pii", "op12_conversation_structure_repair", "op13_ranked_lexical_search"]
    )
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_near_dedup_by_similarity(spark):
    """The stage against brute force: texts joined by five-word similarity of 0.8 or more, most of them far apart in SimHash bits."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(20):
        base = [word() for _ in range(rng.randint(60, 200))]
        texts.append(base)
        for edits in (1, 2, 3, 4, 6):
            texts.append([word() if i in set(rng.sample(range(len(base)), edits)) else w for i, w in enumerate(base)])
    rows = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    far = 0
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                far += (simhash.fingerprint(rows[a][1]) ^ simhash.fingerprint(rows[b][1])).bit_count() > simhash.RADIUS
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert far > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {i for i in range(len(sets)) if root(i) == i}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == want


def test_near_dedup_by_simhash(spark, monkeypatch):
    """The stage goes by op8's groups first; the shingles of what they link are compared exactly."""
    calls, groups = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: calls.append(1) or groups(*a, **k))
    base = [f"w{i}" for i in range(31)] * 30
    texts = [base + [f"x{k}_{i}" for i in range(20)] for k in range(2)]
    texts.append(["y", *texts[1]])
    assert (simhash.fingerprint(" ".join(texts[0])) ^ simhash.fingerprint(" ".join(texts[1]))).bit_count() <= simhash.RADIUS
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 1] and calls


def components(sets):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    groups: dict = {}
    for i in range(len(sets)):
        groups.setdefault(root(i), []).append(i)
    return sorted(groups.values())


@pytest.mark.parametrize(("turns", "part"), [(near.TURNS, near.PART), (0, 7), (2, 3)])
def test_near_dedup_of_a_crowded_cell(spark, monkeypatch, turns, part):
    """Many copies with edits of their own, of two texts: the components of all pairs, whatever the number of turns."""
    monkeypatch.setattr(near, "PART", part)
    rng = random.Random(12)
    texts = []
    for base in ([f"w{i}" for i in range(120)], [f"v{i}" for i in range(90)]):
        for k in range(25):
            edits = set(rng.sample(range(len(base)), rng.randint(0, 5)))
            texts.append([f"x{k}_{i}" if i in edits else w for i, w in enumerate(base)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    groups: dict = {}
    for r in near.near_duplicates(docs.withColumn("key", F.col("doc_id").cast("string")), turns).collect():
        groups.setdefault(r["root"], []).append(r["doc_id"])
    want = components([{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts])
    assert 2 < len(want) < 40 and sorted(map(sorted, groups.values())) == want


def test_near_dedup_does_not_pair_the_copies_of_one_text(spark, monkeypatch):
    """Copies with edits of their own that are too far apart meet by what is rare in them, not each with each; what is similar among them is found."""
    compared, made = near._compared, []
    monkeypatch.setattr(near, "_compared", lambda *a: made.append(compared(*a)) or made[-1])
    rng = random.Random(13)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(150):
        edits = {rng.randint(a, a + 25) for a in (6, 36, 66)}
        texts.append([f"x{k}_{i}" if i in edits else w for i, w in enumerate(base)])
    texts += [[*texts[k], "tail"] for k in range(0, 150, 12)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    groups: dict = {}
    for r in near.near_duplicates(docs.withColumn("key", F.col("doc_id").cast("string")), 1).collect():
        groups.setdefault(r["root"], []).append(r["doc_id"])
    want = components([{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts])
    assert len(want) == 150 and sorted(map(sorted, groups.values())) == want
    assert len(made) == 2 and made[-1][2] < 2 * len(texts)


def test_near_dedup_takes_few_jobs(spark):
    """Their number does not depend on the rows, and what the driver keeps of them stays small."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(base, 1) + base[: rng.randint(40, 60)] + base) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.col("doc_id").cast("string"))
    before = spark.range(1).count() and spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    near.near_duplicates(docs).count()
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before < 300


def test_near_dedup_of_odd_rows(spark, documents, corpus):
    """Nulls, empty texts, repeated rows: one row of a group stays, also of rows that repeat id and text. An empty table has none."""
    rows = corpus + [(5, "one"), (None, None), (200, "ONE"), (201, "")]
    left = corpus_pipeline.drop_near_copies(spark, documents(rows), SF).collect()
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()} for w in words]
    want = [min((rows[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0))[0] for group in components(sets)]
    assert sorted((r["doc_id"] for r in left), key=str) == sorted(want, key=str)
    assert corpus_pipeline.drop_near_copies(spark, documents([]), SF).collect() == []


@pytest.mark.parametrize("n", [1, 3, 7])
def test_mixing_of_repeated_rows(spark, n):
    """Rows that repeat id and text are read as often as their source wants it, not once for each pair of them."""
    rows = [(i, f"words of document number {i} here", "big") for i in range(60)] + [(500, "small one", "small")] * n + [(500, "small one", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.mix(spark, docs, SF).groupBy("source", "doc_id").count().collect()
    want = mixing.mixed(docs, keep=("doc_id", "source")).groupBy("source", "doc_id").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
