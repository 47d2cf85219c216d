"""Best-fit packing of token pieces into sequences of one capacity, planned on the histogram of lengths.

The plan is best-fit decreasing, on counts: it knows how many pieces have each
length, never which. The histogram has at most `capacity` rows and is the only
thing the driver sees. The plan says, for ranges of ranks within a length, which
sequences and offsets they fill; a piece takes its place by joining on its length
and its rank among the pieces of that length.

Defined results: a null or empty text is one piece that holds the end mark alone.
Repeated rows are packed one by one. A null doc_id is packed like any other. An
empty table gives no rows. Special tokens written out in a text become their ids,
as the tokenizer file has them. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import cut, numbered, texts

END = 0
CAPACITY = 2048
#: Pieces that share a bucket, on average, and the least number of buckets: pieces of one length are numbered by bucket.
RANKED_TOGETHER = 500_000
LEAST_BUCKETS = 64
#: More segments than this are joined by a shuffle instead of a broadcast (about 48 bytes each).
BROADCAST_SEGMENTS = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SEGMENTS = "length long, rank_from long, rank_to long, per_sequence long, sequence_from long, base long"


@functools.cache
def _units() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """An encoder of texts to numpy ids, from a byte-level BPE file of the tokenizers library.

    The ids are those of that library; ranks are taken from the file's merges and
    run by tiktoken, which is four times as fast. If a vocabulary's ids don't
    follow its merges, or a text upsets the faster engine, the library itself runs.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = Tokenizer.from_file(path)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    units, vocab = _units(), spec["model"]["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    singles = sorted((i, t) for t, i in vocab.items() if len(t) == 1 and t not in special)
    by_rank = [t for _, t in singles] + merged
    follows = len(singles) == 256 and all(vocab[t] == i for i, t in enumerate(by_rank)) and spec["normalizer"] is None

    def slow(text: str) -> np.ndarray:
        return np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if not follows:
        return slow
    fast = tiktoken.Encoding(
        "own",
        pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
        mergeable_ranks={bytes(units[c] for c in t): i for i, t in enumerate(by_rank)},
        special_tokens=special,
    )

    def encode(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode(text, allowed_special="all"), dtype="<u4")
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # noqa: BLE001  its panics are no Exceptions
            return slow(text)

    return encode


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids; of a longer document the first piece takes the remainder. `with_ids` adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows, kept = [], []
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc.as_py(), k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: segments as SEGMENTS names them.

    Sequences with equal room are kept as ranges of numbers. A length goes to the
    fullest sequences that still take it, as many pieces into each as fit: the
    same fill as best-fit decreasing piece by piece.
    """
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("a piece is longer than a sequence")
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    opened, segments = 0, []

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            fit = room // length
            used = min(n, -(-left // fit))
            whole, taken = min(used, left // fit), min(left, used * fit)
            segments.append((length, rank, rank + taken, fit, first, capacity - room))
            keep(room - fit * length, first, whole)
            if used > whole:
                keep(room - (left - whole * fit) * length, first + whole, 1)
            keep(room, first + used, n - used)
            rank, left = rank + taken, left - taken
    return segments


def packed(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length`. `pieces` is read several times: cut its lineage first."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = plan(histogram, capacity)
    buckets = max(LEAST_BUCKETS, sum(histogram.values()) // RANKED_TOGETHER)
    hashed = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    ranked = numbered(pieces.withColumn("_bucket", hashed), ["length"], "_bucket", order, "_rank").drop("_bucket")
    table = spark.createDataFrame(segments, SEGMENTS)
    if len(segments) <= BROADCAST_SEGMENTS:
        table = F.broadcast(table)
    place = F.col("_rank") - F.col("rank_from")
    return (
        ranked.join(table, "length")
        .where((F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
        .withColumn("sequence_id", F.col("sequence_from") + F.floor(place / F.col("per_sequence")))
        .withColumn("offset", F.col("base") + (place % F.col("per_sequence")) * F.col("length"))
        .drop("_rank", "rank_from", "rank_to", "per_sequence", "sequence_from", "base")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    return packed(cut(tokenized(docs, path, capacity)), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The token sequences, of pieces packed with their ids: at most `capacity` ids a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
