"""Both substring operators against brute force; the parts they are made of against plain versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from terrapulse.llm import induced, suffix_arrays, suffix_trees, windows


def plain_words(rows, w=20):
    places = {}
    order = lambda d: (d is None, d or 0)
    for d, t in rows:
        words = (t or "").encode().split()
        for i in range(len(words) - w + 1):
            key = tuple(words[i : i + w])
            places[key] = min(places.get(key, (order(d), i)), (order(d), i))
    out = []
    for d, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - w + 1):
            if places[tuple(words[i : i + w])] < (order(d), i):
                gone[i : i + w] = [True] * w
        kept = [x for x, g in zip(words, gone, strict=True) if not g]
        out.append((d, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def plain_bytes(rows, w=400):
    seen = {}
    for _, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - w + 1):
            seen[data[i : i + w]] = seen.get(data[i : i + w], 0) + 1
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - w + 1):
            if seen[data[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [windows.FREQUENT, 2])
def test_words_equal_brute_force(documents, corpus, monkeypatch, frequent):
    monkeypatch.setattr(windows, "FREQUENT", frequent)
    got = [tuple(r) for r in suffix_trees.removal_counts(documents(corpus)).collect()]
    assert sorted(got, key=str) == plain_words(corpus)
    assert sum(r[2] for r in got) > 500


def test_bytes_equal_brute_force(documents, corpus):
    got = [tuple(r) for r in suffix_arrays.removal_counts(documents(corpus)).collect()]
    assert sorted(got, key=str) == plain_bytes(corpus)
    assert sum(r[2] for r in got) > 2000


def test_empty_tables(documents):
    assert suffix_trees.removal_counts(documents([])).count() == 0
    assert suffix_arrays.removal_counts(documents([])).count() == 0


def test_texts_and_spans_are_returned(documents, corpus):
    rows = [r for r in corpus if r[0] in (10, 40, 71)]
    texts = {r["doc_id"]: r for r in suffix_trees.without_repeats(documents(rows)).collect()}
    assert texts[10]["text"] == " ".join(corpus[7][1].split()) and texts[10]["n_removed"] == 0
    spans = {r["doc_id"]: r for r in suffix_arrays.without_repeats(documents(rows)).collect()}
    assert spans[71]["kept"] == b"" and spans[71]["spans"] == [0, 3000]


def test_blocks_cut_no_window(monkeypatch):
    """Every window is in exactly one segment, however small the blocks; equal windows have equal anchors."""
    rng = np.random.default_rng(3)
    texts = [[b"w%d" % x for x in rng.integers(0, 9, n)] for n in (5, 19, 20, 300, 70)]
    whole: dict[bytes, int] = {}
    for block in (1 << 19, 64, 33):
        monkeypatch.setattr(windows, "BLOCK", block)
        seen = set()
        for s in windows.segments(suffix_trees.WORDS, texts):
            for text, start, n, anchor in zip(s.text, s.start, s.windows, s.anchor, strict=True):
                for i in range(start, start + n):
                    assert (text, i) not in seen
                    seen.add((text, i))
                    key = b" ".join(texts[text][i : i + 20])
                    assert whole.setdefault(key, int(anchor)) == int(anchor)
        assert seen == {(t, i) for t, words in enumerate(texts) for i in range(len(words) - 19)}


@pytest.mark.parametrize("in_memory", [2, 1 << 20])
def test_induced_sorting(in_memory):
    """Order and common prefixes equal a plain sort, with the queue on disk and in memory."""
    rng = np.random.default_rng(7)
    for trial in range(200):
        text = rng.integers(1, rng.integers(2, 5), rng.integers(1, 50))
        text = np.append(np.tile(text, 1 + trial % 3), 0)
        want = sorted(range(len(text)), key=lambda i: tuple(text[i:]), reverse=True)
        blocks = list(induced.sorted_with_prefixes(text, int(text.max()) + 1, 9, in_memory))
        at, lcp = (np.concatenate([b[k] for b in blocks]) for k in (0, 1))
        assert at.tolist() == want
        for i in range(1, len(want)):
            a, b = text[want[i - 1] :], text[want[i] :]
            n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert lcp[i] == min(n, 9)


def test_names_beyond_induction(monkeypatch):
    monkeypatch.setattr(induced, "INDUCED_NAMES", 1)
    text = np.append(np.tile([2, 1, 3, 1, 2, 2], 20), 0)
    blocks = list(induced.sorted_with_prefixes(text, 4, 1000))
    assert np.concatenate([b[0] for b in blocks]).tolist() == sorted(range(len(text)), key=lambda i: tuple(text[i:]), reverse=True)


def test_prefix_groups_of_any_size():
    """Splitting by longer and longer prefixes changes nothing."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 400)
    suffixes = np.arange(400 - 5)
    order = rng.permutation(len(suffixes))
    want = suffix_trees.later_leaves(words, suffixes, order, 5)
    assert want.any() and not want.all()
    for group in (1, 7, 60):
        assert (suffix_trees.later_leaves(words, suffixes, order, 5, group) == want).all()
