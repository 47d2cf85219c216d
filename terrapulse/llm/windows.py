"""Windows that repeat anywhere in a corpus, found without moving any text that can't.

The front and the back of the two substring operators. A window of W units (words
or bytes) has an anchor: its smallest gram of K units, by hash. Equal windows have
equal anchors, so equal windows meet if they are dealt by anchor. Consecutive
windows with one anchor form a segment, one stretch of text.

1. Rows are dealt to buckets of a few MB. A bucket sends its distinct anchors, as
   packed arrays, to shards that find those which occur twice or more.
2. Each bucket cuts out its segments with such anchors. Equal segments are one row
   for each bucket, then one row in all, with the number of rows they stand for
   and the place of the first.
3. A back end gets the distinct segments by anchor and says which windows of each
   repeat. The answers go back to the buckets, which cover the windows' units.

The text is shuffled once, as the buckets' exchange serves all three steps, and so
is each bucket's copy of a segment.
An anchor that very many windows have (a frequent line in changing contexts) is
refined by the smallest gram of K2 units, which no shorter frequent passage fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import mixed

#: UTF-8 bytes of text in a bucket, on average.
BUCKET_BYTES = 4 << 20
#: Units that are hashed at once; positions in a block fit into _PLACE bits.
BLOCK = 1 << 19
_PLACE = np.uint64(20)
_PLACES = np.uint64((1 << 20) - 1)
#: Anchors that a shard compares, on average.
SHARD_ANCHORS = 1 << 20
#: Windows with one anchor from which it is refined.
FREQUENT = 10_000
#: UTF-8 bytes of input for each shard of the back end.
SHARD_BYTES = 8 << 20

_LAST = np.iinfo(np.int64).max
_N = (1 << 20) + 4096
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    steps = np.full(_N, base % (1 << 64), np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

ANCHORS = "shard int, bucket int, anchors binary, counts binary"
REPEATED = "bucket int, anchors binary, frequent binary"
SEGMENTS = "bucket int, anchor long, base long, digest binary, content binary, n long, doc long, start long, places int"
#: What a back end returns for a segment: windows that repeat, as start and end pairs of int32, in the first segment and in all others.
ANSWERS = "digest binary, anchor long, base long, doc long, start long, buckets array<int>, first binary, others binary"


@dataclass(frozen=True)
class Kind:
    """How a text is seen: `units` gives hashes of its units, `content` the bytes of a stretch of them."""

    window: int
    gram: int
    fine: int
    parse: Callable[[str], object]
    units: Callable[[object], np.ndarray]
    content: Callable[[object, int, int], bytes]
    anchors_per_byte: float


def _grams(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive units."""
    n = len(units)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(units * _POWERS[:n], dtype=np.uint64)])
        return mixed((sums[k:] - sums[:-k]) * _INVERSES[: n - k + 1])


def _smallest(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _anchors(units: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the place of the leftmost gram that gives it."""
    grams = _grams(units, k)
    best = _smallest((grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64), window - k + 1)
    place = (best & _PLACES).astype(np.int64)
    return grams[place], place


@dataclass(frozen=True)
class Segments:
    """Runs of windows: which text, the first unit there, how many windows, the anchor before and after refining, and how many places give it."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    base: np.ndarray
    anchor: np.ndarray
    places: np.ndarray


def segments(kind: Kind, texts: list[object], frequent: np.ndarray | None = None) -> Iterator[Segments]:
    """All windows of the texts, as segments, block by block. Anchors in `frequent` (sorted) are refined."""
    w = kind.window
    block: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        units = kind.units(text)
        # A long text is taken in parts that share w - 1 units, so that each window is in one part.
        for at in range(0, len(units) - w + 1, BLOCK):
            part = units[at : at + BLOCK + w - 1]
            if size + len(part) > BLOCK + w and block:
                yield _cut(kind, block, frequent)
                block, size = [], 0
            block.append((i, at, part))
            size += len(part)
    if block:
        yield _cut(kind, block, frequent)


def _cut(kind: Kind, block: list[tuple[int, int, np.ndarray]], frequent: np.ndarray | None) -> Segments:
    w = kind.window
    units = np.concatenate([part for _, _, part in block])
    lengths = np.array([len(part) for _, _, part in block])
    begin = np.cumsum(lengths) - lengths
    base, place = _anchors(units, w, kind.gram)
    anchor = base
    if frequent is not None and len(often := np.flatnonzero(_in(base, frequent))):
        fine, _ = _anchors(units, w, kind.fine)
        anchor = base.copy()
        with np.errstate(over="ignore"):
            anchor[often] = mixed(base[often] * np.uint64(5) + fine[often])
    n = len(anchor)
    valid = np.ones(n, bool)
    for edge in range(1, w):  # windows that run over a text's end
        at = begin[1:] - edge
        valid[at[(at >= 0) & (at < n)]] = False
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (base[1:] != base[:-1]) | ~valid[:-1]
    heads = np.flatnonzero(new & valid)
    moved = np.zeros(n, bool)
    moved[1:] = place[1:] != place[:-1]
    moved[heads] = True
    ends = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
    steps = np.concatenate([[0], np.cumsum(moved & valid)])
    part = np.searchsorted(begin, heads, "right") - 1
    text = np.array([i for i, _, _ in block])[part]
    offset = np.array([at for _, at, _ in block])[part]
    return Segments(text, heads - begin[part] + offset, ends - heads + 1, base[heads], anchor[heads], steps[ends + 1] - steps[heads])


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def _parsed(kind: Kind, table: pa.Table) -> list[object]:
    return [kind.parse(t.as_py()) for t in table.column("text")]


def _ids(table: pa.Table) -> list[int]:
    return [_LAST if d is None else d for d in table.column("doc_id").to_pylist()]


def _send_anchors(kind: Kind, shards: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = list(segments(kind, _parsed(kind, table)))
        anchors = np.concatenate([s.base for s in found]) if found else np.zeros(0, np.uint64)
        places = np.concatenate([s.places for s in found]) if found else np.zeros(0, np.int64)
        anchors, at = np.unique(anchors, return_inverse=True)
        counts = np.bincount(at, places, len(anchors)).astype(np.uint32)
        shard = (mixed(anchors ^ np.uint64(77)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(s, order[a:b]) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return pa.table(
            {
                "shard": pa.array([s for s, _ in rows], pa.int32()),
                "bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "anchors": pa.array([anchors[i].tobytes() for _, i in rows], pa.binary()),
                "counts": pa.array([counts[i].tobytes() for _, i in rows], pa.binary()),
            }
        )

    return run


def _find_repeated(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("anchors")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.int64)
    anchors, at = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(at, counts, len(anchors))
    rows = []
    for bucket, part in zip(table.column("bucket").to_pylist(), parts, strict=True):
        of = n[np.searchsorted(anchors, part)]
        if (of >= 2).any():
            rows.append((bucket, part[of >= 2].tobytes(), part[of >= FREQUENT].tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "anchors", "frequent"])


def _sorted_anchors(table: pa.Table, name: str) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint64))


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _cut_out(kind: Kind) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        repeated, frequent = _sorted_anchors(right, "anchors"), _sorted_anchors(right, "frequent")
        rows: dict[bytes, list] = {}
        if len(repeated) and len(left):
            parsed, ids = _parsed(kind, left), _ids(left)
            for s in segments(kind, parsed, frequent):
                keep = np.flatnonzero(_in(s.base, repeated))
                lists = [x[keep].tolist() for x in (s.text, s.start, s.windows, s.anchor.view(np.int64), s.base.view(np.int64), s.places)]
                for text, start, windows, anchor, base, places in zip(*lists, strict=True):
                    content = kind.content(parsed[text], start, start + windows + kind.window - 1)
                    row = rows.get(key := _digest(content))
                    if row is None:
                        rows[key] = [anchor, None if base == anchor else base, key, content, 1, ids[text], start, places]
                    else:
                        row[4] += 1
                        row[5], row[6] = min((row[5], row[6]), (ids[text], start))
        bucket = left.column("bucket")[0].as_py() if len(left) else 0
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        columns = [pa.array([r[i] for r in rows.values()], k) for i, k in enumerate(kinds)]
        names = ["anchor", "base", "digest", "content", "n", "doc", "start", "places"]
        return pa.table([pa.array([bucket] * len(rows), pa.int32()), *columns], names=["bucket", *names])

    return run


def cover(covered: np.ndarray, start: int, pairs: np.ndarray, window: int) -> None:
    """Marks the units of the windows in the (start, end) pairs, counted from `start`."""
    for a, b in pairs.reshape(-1, 2).tolist():
        covered[start + a : start + b + window - 1] = True


def _finish(kind: Kind, digest: Callable[[object, np.ndarray], tuple], fields: list[tuple[str, pa.DataType]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parsed, ids = _parsed(kind, left), _ids(left)
        masks: dict[int, np.ndarray] = {}
        if len(right) and len(left):
            answers = {}
            for r in right.select(["digest", "doc", "start", "first", "others"]).to_pylist():
                answers[r["digest"]] = (r["doc"], r["start"], np.frombuffer(r["first"], np.int32), np.frombuffer(r["others"], np.int32))
            wanted = np.unique(right.column("anchor").to_numpy().view(np.uint64))
            # Frequent anchors without an answer here need not be refined again: nothing of theirs is looked up.
            frequent = np.unique(right.column("base").drop_null().to_numpy().view(np.uint64))
            for s in segments(kind, parsed, frequent):
                keep = np.flatnonzero(_in(s.anchor, wanted))
                for text, start, windows in zip(*[x[keep].tolist() for x in (s.text, s.start, s.windows)], strict=True):
                    answer = answers.get(_digest(kind.content(parsed[text], start, start + windows + kind.window - 1)))
                    if answer is None:
                        continue
                    pairs = answer[2] if (ids[text], start) == answer[:2] else answer[3]
                    if len(pairs):
                        if text not in masks:
                            masks[text] = np.zeros(len(kind.units(parsed[text])), bool)
                        cover(masks[text], start, pairs, kind.window)
        rows = []
        for i, text in enumerate(parsed):
            rows.append(digest(text, masks.get(i)))
        columns = [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields)]
        return pa.table([left.column("doc_id"), *columns], names=["doc_id", *[n for n, _ in fields]])

    return run


def passed_on(table: pa.Table, rows: list[int]) -> dict[str, pa.ChunkedArray]:
    """The columns of some segments that a back end passes on."""
    taken = table.take(pa.array(rows, pa.int64()))
    columns = {c: taken.column(c) for c in ("digest", "anchor", "base", "doc", "start", "buckets")}
    return columns | {"buckets": columns["buckets"].cast(pa.list_(pa.int32()))}


def removed(docs: DataFrame, kind: Kind, back_end: Callable[[pa.Table], pa.Table], digest, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """One row per row of `docs`: what `digest` makes of its text and of the units that repeated windows cover (None: none).

    The back end gets the distinct segments of a shard (content, n, places and what
    it passes on), all those of an anchor together.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    dealt = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"))
    shards = max(1, round(total * kind.anchors_per_byte / SHARD_ANCHORS))
    anchors = dealt.groupBy("bucket").applyInArrow(_send_anchors(kind, shards), ANCHORS)
    repeated = anchors.groupBy("shard").applyInArrow(_find_repeated, REPEATED)
    # One row per bucket and segment, dealt once: all segments of an anchor are in one shard, where equal ones are
    # joined, compared and answered without moving their texts again. A segment lists its buckets, at most all of them.
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // SHARD_BYTES)))).cast("int")
    found = dealt.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(_cut_out(kind), SEGMENTS)
    distinct = (
        found.withColumn("shard", shard)
        .repartition("shard")
        .groupBy("shard", "anchor", "digest")
        .agg(
            F.first("content").alias("content"),
            F.first("base").alias("base"),
            F.sum("n").alias("n"),
            F.min(F.struct("doc", "start")).alias("at"),
            F.max("places").alias("places"),
            F.collect_list("bucket").alias("buckets"),
        )
    )
    answers = distinct.select("*", "at.doc", "at.start").drop("at").groupBy("shard").applyInArrow(back_end, ANSWERS)
    routed = answers.withColumn("bucket", F.explode("buckets")).drop("buckets")
    return dealt.groupBy("bucket").cogroup(routed.groupBy("bucket")).applyInArrow(_finish(kind, digest, fields), schema)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, for any length."""
    n = len(values) - k + 1
    return np.concatenate([_grams(mixed(values[at : min(at + BLOCK, n) + k - 1]), k) for at in range(0, n, BLOCK)])
