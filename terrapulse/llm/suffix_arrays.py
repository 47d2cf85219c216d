"""Substring dedup by suffix arrays, sorted by external induction.

Windows of bytes with a repeated anchor come together by anchor, equal stretches
once. A stretch that stands for several places repeats as a whole. Stretches of
one place are sorted with those of the same anchor: their suffixes by induced
sorting, with common prefixes. A window repeats if it shares its length with a
neighbour in that order.

Defined results: a null or empty text, and one shorter than a window, lose
nothing. Every place of a repeated window is removed, in the same text too; rows
with equal ids and repeated rows count as different places. An empty table gives
no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrapulse.llm.induced import sorted_with_prefixes
from terrapulse.llm.suffix_trees import intervals
from terrapulse.llm.windows import Kind, passed_on, removed

WINDOW = 400
#: Stretches are sorted together up to so many bytes. One anchor's stretches are never parted: if they are more, the sort works on disk.
SORTED_BYTES = 2 << 20

_HASHES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

BYTES = Kind(
    window=WINDOW,
    gram=128,
    fine=360,
    parse=lambda text: text.encode("utf-8", "replace"),
    units=lambda data: _HASHES[np.frombuffer(data, np.uint8)],
    content=lambda data, a, b: data[a:b],
    anchors_per_byte=1 / 100,
)


def repeated_windows(contents: list[bytes], window: int) -> list[np.ndarray]:
    """Of each content: which of its windows also start elsewhere in these contents."""
    lengths = np.array([len(c) for c in contents])
    begin = np.cumsum(lengths + 1) - lengths - 1
    # Bytes are symbols from 2 on; 1 parts the contents, 0 ends the text.
    text = np.frombuffer(b"\0".join(contents), np.uint8).astype(np.int16) + 2
    text = np.concatenate([text, [0]]).astype(np.int16)
    text[begin[1:] - 1] = 1
    starts = np.zeros(len(text), bool)
    for b, n in zip(begin.tolist(), lengths.tolist(), strict=True):
        starts[b : b + n - window + 1] = True
    found = np.zeros(len(text), bool)
    last = None
    for at, lcp in sorted_with_prefixes(text, 258, window):
        if last is not None and len(at) and lcp[0] >= window:
            found[[last, at[0]]] = True
        near = np.flatnonzero(lcp[1:] >= window)
        found[at[near]] = True
        found[at[near + 1]] = True
        last = at[-1]
    found &= starts
    return [found[b : b + n - window + 1] for b, n in zip(begin.tolist(), lengths.tolist(), strict=True)]


def _repeats(table: pa.Table) -> pa.Table:
    """Of each segment: the windows that start elsewhere too."""
    anchors = table.column("anchor").to_numpy()
    n, places = table.column("n").to_numpy(), table.column("places").to_numpy()
    contents = table.column("content")
    _, of, size = np.unique(anchors, return_inverse=True, return_counts=True)
    # Only places that stand alone are in question, and only if there is something to compare them with.
    alone = np.zeros(len(size), bool)
    alone[of[(n == 1) & ((size[of] > 1) | (places > 1))]] = True
    compared = np.flatnonzero(alone[of])
    compared = compared[np.argsort(of[compared], kind="stable")]
    flags: dict[int, np.ndarray] = {}
    part: list[int] = []
    held = 0
    for k, i in enumerate(compared.tolist()):
        part.append(i)
        held += len(contents[i].as_py())
        ends = k + 1 == len(compared) or of[compared[k + 1]] != of[i]
        if ends and (held >= SORTED_BYTES or k + 1 == len(compared)):
            for j, f in zip(part, repeated_windows([contents[j].as_py() for j in part], WINDOW), strict=True):
                if n[j] == 1 and f.any():
                    flags[j] = intervals(f)
            part, held = [], 0
    rows = [i for i in range(len(anchors)) if n[i] > 1 or i in flags]
    pairs = [flags[i] if n[i] == 1 else np.array([0, len(contents[i].as_py()) - WINDOW + 1], np.int32) for i in rows]
    packed = pa.array([p.tobytes() for p in pairs], pa.binary())
    return pa.table({**passed_on(table, rows), "first": packed, "others": packed})


_FIELDS = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
_TEXT_FIELDS = [("kept", pa.binary()), ("spans", pa.list_(pa.int64()))]


def _kept(data: bytes, covered: np.ndarray | None) -> bytes:
    return data if covered is None else np.frombuffer(data, np.uint8)[~covered].tobytes()


def _counts(data: bytes, covered: np.ndarray | None) -> tuple[int, int, int, str]:
    kept = _kept(data, covered)
    spans = 0 if covered is None else len(intervals(covered)) // 2
    return len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def _text(data: bytes, covered: np.ndarray | None) -> tuple[bytes, list[int]]:
    return _kept(data, covered), [] if covered is None else intervals(covered).tolist()


def removal_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return removed(docs, BYTES, _repeats, _counts, _FIELDS, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, spans): the bytes that are left, which may break characters, and starts and ends of what went."""
    return removed(docs, BYTES, _repeats, _text, _TEXT_FIELDS, "doc_id long, kept binary, spans array<long>")
