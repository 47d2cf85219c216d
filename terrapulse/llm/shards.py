"""Shards of near equal bytes by fixed virtual slots.

Every record hashes to one of thousands of virtual slots, for good. Bytes are
summed per slot, and a slot-to-shard map says where each slot lives. Rebalancing
edits that map: it moves slots and raises the version, records never rehash. The
map has a row per virtual slot, so it is small and is planned on the driver.

A slot of several rows that weighs over a 64th of a shard (a hot key) is split in
the map: it gets several parts, and a record's part follows from the rest of the
record and, among repeated rows, from its place in the input.

Defined results: a null text has no bytes, so size 1 and checksum 0. A null
doc_id hashes like any other value, spread by its text. Repeated rows are placed
one by one. An empty table gives no rows, and a map that deals the slots evenly.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm.common import cut, numbered

#: Virtual slots: some hundred for each shard, so that a slot is a small part of one.
SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, and the shard of each (slot, part)."""

    version: int
    shards: int
    home: dict[tuple[int, int], int]
    parts: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def even(slots: int, shards: int) -> SlotMap:
        return SlotMap(1, shards, {(s, 0): s % shards for s in range(slots)})

    def rebalanced(self, weight: dict[tuple[int, int], int], parts: dict[int, int] | None = None, shards: int | None = None) -> SlotMap:
        """The next version, for `weight` bytes in each (slot, part): the fullest shards shed slots, the emptiest take them.

        Overfull shards shed their smallest slots first, and the shed ones are
        dealt largest first; then the fullest and the emptiest shard exchange
        slots while that brings them closer.
        """
        shards, parts = shards or self.shards, {**self.parts, **(parts or {})}
        units = {(s, p): weight.get((s, p), 0) for s in {s for s, _ in self.home} for p in range(parts.get(s, 1))}
        home = {u: h for u in units if (h := self.home.get(u)) is not None and h < shards}
        load, mean = [0] * shards, sum(units.values()) / shards
        for u, h in home.items():
            load[h] += units[u]
        shed = [u for u in units if u not in home]
        for u in sorted(home, key=lambda u: (units[u], u)):
            if load[home[u]] > mean and units[u] > 0:
                load[home[u]] -= units[u]
                shed.append(u)
                del home[u]
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for u in sorted(shed, key=lambda u: (-units[u], u)):
            x, s = heapq.heappop(heap)
            home[u] = s
            heapq.heappush(heap, (x + units[u], s))
        _level(home, units, shards)
        return SlotMap(self.version + 1, shards, home, {s: n for s, n in parts.items() if n > 1})

    def moved(self, other: SlotMap) -> int:
        """How many entries live elsewhere in `other`."""
        return sum(other.home.get(u) != h for u, h in self.home.items())

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, p, self.parts.get(s, 1), h) for (s, p), h in sorted(self.home.items())]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, part int, parts int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Each version is written once, next to those before it."""
        self.frame(spark).coalesce(1).write.parquet(f"{folder}/version={self.version:06d}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/version={version:06d}").collect()
        home = {(r["vslot"], r["part"]): r["shard"] for r in rows}
        return SlotMap(version, rows[0]["shards"], home, {r["vslot"]: r["parts"] for r in rows if r["parts"] > 1})


def _level(home: dict[tuple[int, int], int], units: dict[tuple[int, int], int], shards: int, steps: int = 400) -> None:
    """Moves or swaps one slot at a time between the fullest and the emptiest shard, in place, at most `steps` times."""
    members: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in range(shards)]
    for u, h in home.items():
        members[h].append((units[u], u))
    for m in members:
        m.sort()
    load = [sum(w for w, _ in m) for m in members]
    for _ in range(steps):
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        half = (load[full] - load[empty]) / 2
        # (how far from half the gap, what goes over, what comes back): nothing may come back.
        best = (half, None, None)
        back = [(0, None), *members[empty]]
        weights = [w for w, _ in back]
        for out in members[full]:
            at = bisect.bisect_left(weights, out[0] - half)
            for k in (at - 1, at):
                if 0 <= k < len(back):
                    best = min(best, (abs(out[0] - weights[k] - half), out, back[k]), key=lambda b: b[0])
        _, out, got = best
        if out is None:
            return
        for unit, source, target in ((out, full, empty), *([(got, empty, full)] if got[1] is not None else [])):
            members[source].remove(unit)
            bisect.insort(members[target], unit)
            load[source] -= unit[0]
            load[target] += unit[0]
            home[unit[1]] = target


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, spread) of each row; no text goes on from here."""
    bytes_: Column = F.coalesce(F.octet_length("text"), F.lit(0))
    return docs.select(
        "doc_id",
        (bytes_ + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("vslot"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("spread", F.xxhash64("text_crc32", "size", "row"))


def splits(rows: DataFrame, shards: int) -> dict[int, int]:
    """Parts of the slots that hold several rows and over a 64th of a shard's mean; at most 64 slots a shard, so a short list."""
    per_slot = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    most = max(1, sum(r["bytes"] for r in per_slot) // (64 * shards))
    return {r["vslot"]: min(r["n"], -(-r["bytes"] // most)) for r in per_slot if r["bytes"] > most and r["n"] > 1}


def parted(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    """Adds the part of its slot that each row is in."""
    listed = F.broadcast(rows.sparkSession.createDataFrame(sorted(parts.items()), "vslot int, parts int"))
    part = F.pmod("spread", F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(listed, "vslot", "left").withColumn("part", part).drop("parts")


def weights(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Bytes per virtual slot and part: one row for each comes to the driver."""
    return {(r["vslot"], r["part"]): r["bytes"] for r in rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes")).collect()}


def placed(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Adds shard, and the gapless place in it, to `parted` rows. The map is broadcast: a row per virtual slot and part."""
    frame = slot_map.frame(rows.sparkSession).select("vslot", "part", "shard")
    homed = rows.join(F.broadcast(frame), ["vslot", "part"]).withColumn("bucket", F.col("vslot") * F.lit(1 << 16) + F.col("part"))
    return numbered(homed, ["shard"], "bucket", ["doc_id", "size", "text_crc32", "row"], "place")


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """The rows with their shard and place, and the map in force: an even first version, edited for this table's bytes."""
    rows = cut(slotted(docs, slots))
    parts = splits(rows, shards)
    rows = parted(rows, parts)
    slot_map = SlotMap.even(slots, shards).rebalanced(weights(rows), parts)
    return placed(rows, slot_map), slot_map
