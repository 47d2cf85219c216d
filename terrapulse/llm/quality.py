"""Quality rules: counted base rules, and a logistic regression over hashed word and character n-grams.

The classifier is trained on a bounded sample of the labelled rows (TRAIN_ROWS of
each class, those with the smallest hash of their id), calibrated by Platt
scaling on a quarter of it that the training doesn't see, weighted as the classes
stand among all labels. Scoring goes over whole texts in Arrow batches: features
are mean frequencies, so a score is a mean of weights and no feature vector is
built. The weights have a fixed size.

Defined results: a null or empty text has no words and fails the base rules.
Without labels of both classes every document has probability 1, and the base
rules decide alone. Repeated rows are judged one by one; a null doc_id has no
label. Of clashing labels for one id the lowest counts. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import mixed, texts

#: The bound on the labelled rows of each class that training reads.
TRAIN_ROWS = 1000
#: Hashed features of each family: words, word pairs, and characters by 3, 4 and 5 (as bytes).
SLOTS = 1 << 15
FAMILIES = 5
#: Mean frequencies are small; this brings them to the order of one.
SCALE = 100.0
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20
#: Documents with a lower probability of good quality are rejected.
THRESHOLD = 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more. `ids` number the text's distinct words."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * np.int64(len(ids) + 1) + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] >= 2
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


@dataclass(frozen=True)
class Parsed:
    """One text: its bytes, its words' numbers, and a hash of each distinct word."""

    data: bytes
    ids: np.ndarray
    hashes: np.ndarray


def parse(text: str) -> Parsed:
    data = text.encode("utf-8", "replace")
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in data.split()], dtype=np.int64)
    return Parsed(data, ids, np.array([zlib.crc32(w) for w in number], dtype=np.uint64))


def counted(p: Parsed) -> tuple[int, int, int, int, int]:
    array = np.frombuffer(p.data, np.uint8)
    points = int(((array & 0xC0) != 0x80).sum())
    lines = [x for x in p.data.split(b"\n") if x and not x.isspace()]
    return len(p.ids), points - int(_SPACES[array].sum()), int(_SYMBOLS[array].sum()), len(lines) - len(set(lines)), repeat_words(p.ids)


def features(p: Parsed) -> Iterator[tuple[int, np.ndarray]]:
    """The slots of the text's n-grams, as (family, slots of a block of it)."""
    odd, top = np.uint64(0x9E3779B97F4A7C15), np.uint64(49)

    def slots(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * odd) >> top).astype(np.int64)

    if len(p.ids):
        words = mixed(p.hashes)[p.ids]
        yield 0, slots(words)
        with np.errstate(over="ignore"):
            yield 1, slots(words[:-1] * np.uint64(3) + words[1:])
    for at in range(0, len(p.data), BLOCK):
        b = np.frombuffer(p.data, np.uint8, min(BLOCK + 4, len(p.data) - at), at).astype(np.uint64)
        grams = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)
        for family, n in ((2, 3), (3, 4), (4, 5)):
            if n > 3:
                grams = grams[:-1] | b[n - 1 :] << np.uint64(8 * n - 8)
            yield family, slots(grams[:BLOCK])


def vector(p: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """The text's sparse vector: slots of all families, and scaled mean frequencies."""
    counts = np.zeros((FAMILIES, SLOTS))
    for family, found in features(p):
        counts[family] += np.bincount(found, minlength=SLOTS)
    counts *= SCALE / np.maximum(1, counts.sum(axis=1, keepdims=True))
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts.ravel()[at].astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, p: Parsed) -> float:
        total, n = [0.0] * FAMILIES, [0] * FAMILIES
        for family, found in features(p):
            total[family] += float(self.weights[family * SLOTS : (family + 1) * SLOTS][found].sum(dtype=np.float64))
            n[family] += len(found)
        return self.bias + SCALE * sum(t / k for t, k in zip(total, n, strict=True) if k)

    def probability(self, p: Parsed) -> float:
        return float(_sigmoid(self.slope * self.score(p) + self.shift))


#: What holds without labels.
NO_MODEL = Model(np.zeros(FAMILIES * SLOTS, np.float32), 0.0, 0.0, 50.0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(slots: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, steps: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on the whole sample, some documents at a time; both classes weigh the same."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    parts = []
    for some in np.array_split(np.arange(len(y)), -(-len(y) // 64)):
        # The documents' own arrays are used as they are: a copy would double the sample.
        parts.append((some, [slots[i] for i in some], [values[i] for i in some]))
    w, bias = np.zeros(FAMILIES * SLOTS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = ridge * w, 0.0
        for some, slot, value in parts:
            at, x, row = np.concatenate(slot), np.concatenate(value), np.repeat(np.arange(len(some)), [len(s) for s in slot])
            miss = (_sigmoid(np.bincount(row, w[at] * x, len(some)) + bias) - y[some]) * share[some]
            g += np.bincount(at, miss[row] * x, len(w))
            gb += miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-10)
        bias -= step * mb / (np.sqrt(vb) + 1e-10)
    return w.astype(np.float32), float(bias)


def calibrate(scores: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling by Newton's method, with his smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([scores, np.ones_like(scores)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ theta)
        g = x.T @ ((p - target) * share) + 1e-6 * theta
        h = (x * (p * (1 - p) * share)[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, g)
        theta -= move / max(1.0, np.abs(move).max() / 2)
    return float(theta[0]), float(theta[1])


def _fitted(got: pa.Table, size: dict[int, int]) -> Model:
    """The model of the sample's (doc_id, quality, at, x). `size` has the labels of each class."""
    got = got.sort_by("doc_id")
    y = got.column("quality").to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        return NO_MODEL
    at = [np.frombuffer(a.as_buffer(), np.int32) for a in got.column("at")]
    x = [np.frombuffer(a.as_buffer(), np.float32) for a in got.column("x")]
    # Every fourth row of each class is held out.
    rank = np.empty(len(y), np.int64)
    for c in (0, 1):
        rank[y == c] = np.arange((y == c).sum())
    held = rank % 4 == 3
    if any((y[held] == c).sum() == 0 for c in (0, 1)):
        held[:] = True
        seen = np.ones(len(y), bool)
    else:
        seen = ~held
    take = np.flatnonzero(seen)
    w, bias = fit([at[i] for i in take], [x[i] for i in take], y[take])
    take = np.flatnonzero(held)
    scores = np.array([float((w[at[i]] * x[i]).sum()) + bias for i in take])
    weight = np.where(y[take] == 1, size[1] / (y[take] == 1).sum(), size[0] / (y[take] == 0).sum())
    return Model(w, bias, *calibrate(scores, y[take], weight / weight.sum()))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of the labels' `quality` column. At most `rows` documents of each class are read, as sparse vectors.

    The sample meets in one task and never in the driver, which gets the weights.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    size = dict(known.groupBy("quality").count().collect())
    if len(size) < 2:
        return NO_MODEL
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("quality = 0").orderBy(*order).limit(rows).union(known.where("quality = 1").orderBy(*order).limit(rows))
    # One text of each id, so that the rows are bounded as the ids are; combined before the shuffle.
    chosen = texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = chosen.select("doc_id", "quality", "text")

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [vector(parse(t)) for t in part["text"]]
            yield part[["doc_id", "quality"]].assign(at=[a.tobytes() for a, _ in found], x=[x.tobytes() for _, x in found])

    def learned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(parts)
        if got:
            model = _fitted(pa.Table.from_batches(got), size)
            yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": model.bias, "slope": model.slope, "shift": model.shift}])

    kind = sample.schema["doc_id"].dataType.simpleString()
    vectors_of = sample.mapInPandas(vectors, f"doc_id {kind}, quality int, at binary, x binary")
    found = vectors_of.repartition(1).mapInArrow(learned, "weights binary, bias double, slope double, shift double").collect()
    if not found:
        return NO_MODEL
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"], found[0]["slope"], found[0]["shift"])


RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean"


def judged(docs: DataFrame, model: Model, threshold: float = THRESHOLD, payload: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, counts, base_failed, probability, kept) of each row, and the columns named in `payload`, unchanged."""
    carried = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", *[c for c in payload if c != "doc_id"], F.coalesce("text", F.lit("")).alias("_text"))
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    names = [*COUNTS, "base_failed", "probability", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = carried.value
        for batch in batches:
            rows = []
            for text in batch.column("_text"):
                p = parse(text.as_py())
                n = counted(p)
                failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
                chance = model.probability(p)
                rows.append((*n, failed, chance, not failed and chance >= threshold))
            rest = [name for name in batch.schema.names if name != "_text"]
            columns = [batch.column(name) for name in rest] + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*rest, *names])

    kept = [f for f in source.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + RESULT
    return source.mapInArrow(run, schema)
