"""Substring dedup by prefix-partitioned suffix trees.

The suffixes are those that start a window of words with a repeated anchor. They
are split by their first word, groups that are too large for memory by their next
word, and so on: prefixes of variable length, each group small. Every group's
subtree is built from the top down, one word a level, without suffixes that have
become leaves. The internal nodes that reach the depth of a window are its
repeats; of a node's leaves the one that starts first in the corpus is spared.

Defined results: a null or empty text, and one shorter than a window, lose
nothing. Rows with equal ids count as one place: neither is earlier than the
other. A null doc_id comes after all others. Repeated rows are answered one by
one. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrapulse.llm.windows import Kind, passed_on, removed

WINDOW = 20
#: Suffixes of one subtree.
GROUP = 1 << 20


def _units(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15) if words else np.zeros(0, np.uint64)


WORDS = Kind(
    window=WINDOW,
    gram=8,
    fine=18,
    parse=lambda text: text.encode("utf-8", "replace").split(),
    units=_units,
    content=lambda words, a, b: b" ".join(words[a:b]),
    anchors_per_byte=1 / 40,
)


def later_leaves(words: np.ndarray, suffixes: np.ndarray, order: np.ndarray, window: int, group: int = GROUP) -> np.ndarray:
    """Which suffixes share their first `window` words with one that is earlier by `order` (equal orders: neither is)."""
    later = np.zeros(len(suffixes), bool)
    stack = [(np.arange(len(suffixes)), 0)]
    while stack:
        some, depth = stack.pop()
        if len(some) > group and depth < window:
            # Too large: its prefix grows by a word.
            by = np.argsort(words[suffixes[some] + depth], kind="stable")
            some = some[by]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(words[suffixes[some] + depth]) != 0]))
            stack += [(part, depth + 1) for part in np.split(some, heads[1:]) if len(part) > 1]
            continue
        node = np.zeros(len(some), np.int64)
        width = int(words.max()) + 1 if len(words) else 1
        for level in range(depth, window):
            if not len(some):
                break
            _, node, leaves = np.unique(node * width + words[suffixes[some] + level], return_inverse=True, return_counts=True)
            inner = leaves[node] > 1
            some, node = some[inner], node[inner]
        if len(some):
            # Deep internal nodes: all leaves but the first are repeats.
            first = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, node, order[some])
            later[some[order[some] > first[node]]] = True
    return later


def intervals(flags: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true values, as int32."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).astype(np.int32)


def _repeats(table: pa.Table) -> pa.Table:
    """Of each segment: the windows that start earlier elsewhere, for its first place and for all others."""
    anchors = table.column("anchor").to_numpy()
    n, places = table.column("n").to_numpy(), table.column("places").to_numpy()
    docs, starts = table.column("doc").to_numpy(), table.column("start").to_numpy()
    _, of, size = np.unique(anchors, return_inverse=True, return_counts=True)
    compared = np.flatnonzero((size[of] > 1) | (places > 1))
    contents = table.column("content")
    first: dict[int, np.ndarray] = {}
    windows = np.array([c.as_py().count(b" ") + 2 - WINDOW for c in contents], np.int64)
    if len(compared):
        number: dict[bytes, int] = {}
        parts = [np.array([number.setdefault(w, len(number)) for w in contents[int(i)].as_py().split(b" ")], np.int64) for i in compared]
        lengths = np.array([len(p) for p in parts])
        begin = np.cumsum(lengths) - lengths
        per = windows[compared]
        inside = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        suffixes = np.repeat(begin, per) + inside
        doc, start = np.repeat(docs[compared], per), np.repeat(starts[compared], per) + inside
        by = np.lexsort((start, doc))
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(np.concatenate([[0], (np.diff(doc[by]) != 0) | (np.diff(start[by]) != 0)]))
        later = later_leaves(np.concatenate(parts), suffixes, order, WINDOW)
        for i, flags in zip(compared, np.split(later, np.cumsum(per)[:-1]), strict=True):
            if flags.any():
                first[int(i)] = intervals(flags)
    rows = [i for i in range(len(anchors)) if n[i] > 1 or i in first]
    none = np.zeros(0, np.int32)
    return pa.table(
        {
            **passed_on(table, rows),
            "first": pa.array([first.get(i, none).tobytes() for i in rows], pa.binary()),
            "others": pa.array([np.array([0, windows[i]], np.int32).tobytes() for i in rows], pa.binary()),
        }
    )


_FIELDS = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
_TEXT_FIELDS = [("text", pa.string()), ("n_removed", pa.int64())]


def _kept(words: list[bytes], covered: np.ndarray | None) -> list[bytes]:
    return words if covered is None else [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]


def _counts(words: list[bytes], covered: np.ndarray | None) -> tuple[int, int, str]:
    kept = _kept(words, covered)
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _text(words: list[bytes], covered: np.ndarray | None) -> tuple[str, int]:
    kept = _kept(words, covered)
    return b" ".join(kept).decode(), len(words) - len(kept)


def removal_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return removed(docs, WORDS, _repeats, _counts, _FIELDS, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed): each text without the words of later repeats, joined by single spaces."""
    return removed(docs, WORDS, _repeats, _text, _TEXT_FIELDS, "doc_id long, text string, n_removed long")
