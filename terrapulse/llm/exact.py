"""Exact dedup against a minimal perfect hash of the digests seen before.

The history's distinct digests are dealt to shards by their first bytes. Each
shard is one row of bounded size: a minimal perfect hash (levels of bits, a
digest's slot is the rank of its bit), and in slot order the whole digests, the
winners' ids and the counts. New digests are grouped first, sent to their shard
and looked up there; a slot only counts if all 32 bytes agree. Those that are no
members form groups of their own.

Defined results: a null text is empty. Rows with the same doc_id and the same
text are copies, of which one stays. A null doc_id never wins against another
one; if a group has only null ids, keep_id is null and one of its rows stays. An
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import WORD_BREAKS, cut, join_hot, mixed

#: Digests in a shard of the index, on average: 48 bytes each, a row of about 3 MB.
SHARD_DIGESTS = 65_536

INDEX = "shard int, sizes array<int>, bits binary, digests binary, winners binary, counts binary"
TABLE = "digest binary, keep_id long, group_size long, seen_before boolean"
_NO_ID = np.iinfo(np.int64).max


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WORD_BREAKS, " ")


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, copies): the distinct pairs of id and SHA-256 of the normalised text."""
    pairs = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
    return pairs.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))


def _per_digest(pairs: DataFrame, shards: int) -> DataFrame:
    """One row per digest; combined before the shuffle, so a text with many copies is one row per task."""
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return (
        pairs.groupBy("digest")
        .agg(F.coalesce(F.min("doc_id"), F.lit(int(_NO_ID))).alias("winner"), F.sum("copies").alias("n"))
        .withColumn("shard", shard)
    )


def _slot_words(digests: np.ndarray) -> np.ndarray:
    """Four 64-bit words of each 32-byte digest."""
    return digests.reshape(-1, 32).view("<u8")


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a key falls among the bits of a level; every level mixes the words anew."""
    with np.errstate(over="ignore"):
        seed = mixed(np.array([level + 1], dtype=np.uint64))[0]
        h = mixed(words[:, level % 4] + seed) ^ mixed(words[:, (level + 1) % 4] * np.uint64(3) + seed)
    return (mixed(h) % np.uint64(size)).astype(np.int64)


def perfect_hash(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, all their bits, and the slot of each key: a bijection onto 0..n-1.

    On each level a key that falls alone on its bit takes it; the rest goes on.
    """
    n = len(words)
    slots, left, sizes, levels, base = np.zeros(n, np.int64), np.arange(n), [], [], 0
    while len(left):
        if len(sizes) == 200:
            raise ValueError("the digests are not distinct")
        size = 2 * len(left) + 1
        at = _place(words[left], len(sizes), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(bits.sum())
        sizes.append(size)
        levels.append(bits)
        left = left[~alone]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool), slots


def slots_of(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot that each key would have; -1 if no level takes it. Non-members may get one too."""
    slots, left, at_bit, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0, 0
    for level, size in enumerate(sizes):
        part = bits[at_bit : at_bit + size]
        at = _place(words[left], level, size)
        hit = part[at]
        slots[left[hit]] = base + (np.cumsum(part) - 1)[at[hit]]
        left = left[~hit]
        at_bit, base = at_bit + size, base + int(part.sum())
    return slots


def _joined(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _joined(rows["digest"]).reshape(-1, 32)
    sizes, bits, slots = perfect_hash(_slot_words(digests))
    order = np.argsort(slots)
    return pd.DataFrame(
        {
            "shard": [rows["shard"].iloc[0]],
            "sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [digests[order].tobytes()],
            "winners": [rows["winner"].to_numpy(np.int64)[order].tobytes()],
            "counts": [rows["n"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index over `history`, given as `digested` returns it."""
    return _per_digest(history, shards).groupBy("shard").applyInPandas(_build, INDEX)


def _table(digests: np.ndarray, winners: np.ndarray, counts: np.ndarray, seen: bool) -> pd.DataFrame:
    ids = pd.array(winners, dtype="Int64")
    ids[winners == _NO_ID] = pd.NA
    return pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": ids, "group_size": counts, "seen_before": seen})


def _resolve(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    parts = []
    digests = _joined(probes["digest"]).reshape(-1, 32)
    ids, n = probes["winner"].to_numpy(np.int64), probes["n"].to_numpy(np.int64)
    new = np.ones(len(probes), bool)
    if len(index):
        row = index.iloc[0]
        known = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, counts = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
        sizes = [int(x) for x in row["sizes"]]
        slots = slots_of(_slot_words(digests), sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool))
        found = slots >= 0
        found[found] = (known[slots[found]] == digests[found]).all(axis=1)
        np.minimum.at(winners, slots[found], ids[found])
        np.add.at(counts, slots[found], n[found])
        parts.append(_table(known, winners, counts, True))
        new = ~found
    parts.append(_table(digests[new], ids[new], n[new], False))
    return pd.concat(parts, ignore_index=True)


def resolve(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """One row per digest of history or arrivals: who stays, how many rows, and whether the history had it."""
    probes = _per_digest(arrivals, shards)
    return index.groupBy("shard").cogroup(probes.groupBy("shard")).applyInPandas(_resolve, TABLE)


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, seen_before), one row per row of `docs`.

    Plays two loads of one table: the ids up to the median are the history and
    are indexed, the others arrive and are looked up.
    """
    pairs = cut(digested(docs))
    total, middle = pairs.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.percentile_approx("doc_id", 0.5)).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False))
    shards = max(1, -(-total // SHARD_DIGESTS))
    index = cut(build_index(pairs.where(old), shards))
    table = cut(resolve(index, pairs.where(~old), shards))
    rows = join_hot(pairs, table, "digest", "group_size", total, F.col("doc_id"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "seen_before",
    )
