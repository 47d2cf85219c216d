"""Secret scans: fixed forms, and windows of high Shannon entropy over candidate strings.

Candidates are maximal runs of one character class. A window slides over each
candidate and its entropy follows from the one before by one count up and one
down; windows over the class's threshold join into spans. Candidates that match
the allow-list are left out, and so is a span inside one of a fixed form.

Defined results: a null or empty text has no spans. Spans are in code points, end
exclusive. Rows are scanned one by one, repeated ones too, and in any order; no
text is cut. A null doc_id stays null. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import texts

#: The forms that are always reported, in the order in which equal starts are listed. Matched on bytes, so case means ASCII.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

#: Bytes of text that are scanned at once.
_BLOCK = 4 << 20


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the length of its windows and the bits per character from which a window is suspicious."""

    alphabet: bytes
    window: int
    bits: float


_DIGITS, _LOWER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass(_DIGITS + b"abcdefABCDEF", 24, 3.1),
    CharClass(_DIGITS + _LOWER + _LOWER.upper() + b"+/_=-", 24, 3.9),
)

#: Candidates that are no secrets: words and identifiers without digits, plain numbers, UUIDs, dates, version paths.
ALLOWED = (
    re.compile(rb"[A-Za-z+/_=-]*"),
    re.compile(rb"[0-9_=+/-]*"),
    re.compile(rb"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(rb"([A-Za-z]+[/_-]+)*v?[0-9]{1,4}([_/-][0-9]{1,4})*([/_-]+[A-Za-z]+)*"),
)


def high_windows(run: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """The joined spans of all windows of `run` with an entropy of at least `bits` a character, by incremental counts."""
    if len(run) < window:
        return []
    part = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts = [0] * 256
    total, most, spans = 0.0, (math.log2(window) - bits) * window + 1e-9, []
    for i, byte in enumerate(run):
        c = counts[byte]
        total += part[c + 1] - part[c]
        counts[byte] = c + 1
        if i + 1 >= window:
            if total <= most:
                start = i + 1 - window
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
            gone = run[i + 1 - window]
            c = counts[gone]
            total += part[c - 1] - part[c]
            counts[gone] = c - 1
    return spans


def _table(alphabet: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(alphabet, np.uint8)] = True
    return table


_HEX = _table(_DIGITS + b"abcdef")
_TABLES = [_table(c.alphabet) for c in CLASSES]


def runs(data: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the maximal runs of the class with at least so many bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    edges = np.flatnonzero(np.diff(inside))
    pairs = edges.reshape(-1, 2)
    return pairs[pairs[:, 1] - pairs[:, 0] >= least]


def scan(block: list[bytes]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, in bytes. A line break between the texts belongs to no form and no class."""
    data = b"\n".join(block)
    array = np.frombuffer(data, np.uint8)
    starts = np.cumsum([0] + [len(x) + 1 for x in block])
    found: list[list[tuple[str, int, int]]] = [[] for _ in block]

    def add(kind: str, a: int, b: int) -> None:
        i = int(np.searchsorted(starts, a, "right")) - 1
        found[i].append((kind, a - int(starts[i]), b - int(starts[i])))

    for i, text in enumerate(block):
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found[i] += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    for m in ACCESS.finditer(data):
        if m.end() - m.start() >= LEAST_ACCESS:
            add("access", *m.span())
    for a, b in runs(array, _HEX, LEAST_HEX).tolist():
        add("hex", a, b)
    fixed = [list(spans) for spans in found]
    high: list[list[tuple[int, int]]] = [[] for _ in block]
    for kind, table in zip(CLASSES, _TABLES, strict=True):
        for a, b in runs(array, table, kind.window).tolist():
            run = data[a:b]
            if any(allowed.fullmatch(run) for allowed in ALLOWED):
                continue
            i = int(np.searchsorted(starts, a, "right")) - 1
            at = a - int(starts[i])
            for x, y in high_windows(run, kind.window, kind.bits):
                high[i].append((at + x, at + y))
    for i, spans in enumerate(high):
        found[i] += [("entropy", a, b) for a, b in _merged(spans) if not any(s <= a and b <= e for _, s, e in fixed[i])]
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans with those that overlap joined, as both classes may see one secret."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _in_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The spans in code points, in order."""
    if not spans:
        return []
    first = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    spans = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [{"kind": k, "start": int(first[a]), "end": int(first[b])} for k, a, b in spans]


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the spans of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, block, size = [], [], 0

            def flush() -> None:
                out.extend(_in_points(t, s) for t, s in zip(block, scan(block), strict=True))
                block.clear()

            for text in batch.column("text"):
                block.append(text.as_py().encode("utf-8", "replace"))
                size += len(block[-1])
                if size >= _BLOCK:
                    flush()
                    size = 0
            if block:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPANS_ARROW)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(run, SPANS)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """(doc_id, text): the texts with every span replaced by the mask; overlapping spans by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                data = text.as_py().encode("utf-8", "replace")
                at, parts = 0, []
                for _, a, b in sorted(scan([data])[0], key=lambda s: s[1:]):
                    if a >= at:
                        parts += [data[at:a], mask.encode()]
                    at = max(at, b)
                out.append((b"".join(parts) + data[at:]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return texts(docs).mapInArrow(run, "doc_id long, text string")
