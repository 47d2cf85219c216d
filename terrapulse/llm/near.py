"""Near-duplicates by word shingles: texts whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

Every text has BANDS fingerprints, each of ROWS min-hashes of its shingles; texts
that agree in a fingerprint share a cell. Two texts of similarity 0.8 share none
with a probability of 3 in a million, more similar ones with less. No pair is
linked by its cell alone: the sets are compared whole (as 64-bit hashes of the shingles).

Equal sets are one node. In each of TURNS turns every cell that still holds nodes
of several groups compares those outside its largest group with one node of it, its
centre, another one each time. What is found joins groups by their labels only: a
label is a node that the group is joined with, so equal labels are never wrong, and
no components are computed before the end. What is outside after the turns meets
the nodes of other groups with which it shares one of its rarest shingles, early
enough in the order of rarity to be similar at all.

Defined results: words are compared in lower case (ASCII); a text of less than five
words is one shingle, and all texts without words are equal. Rows with equal
keys give equal results. Null ids are carried like others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import Scratch, cut, join_hot, mixed
from terrapulse.llm.simhash import _LOWER, components

SHINGLE = 5
#: Similarity as a fraction: 4/5.
SIMILAR = (4, 5)
BANDS = 42
ROWS = 6
#: Turns in which cells compare with their centres, at most; the turns end when fewer than 1 of GAIN comparisons finds a link.
TURNS = 8
GAIN = 10
#: Nodes of either side that one part holds when the smaller and the larger sets with a rare shingle meet.
PART = 256
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 15


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(data[a:b]) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist(), strict=True)], dtype=np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The BANDS fingerprints of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), _BLOCK):
            some = found[at : at + _BLOCK]
            least = np.minimum(least, np.array([(some * f).min() for f in _FACTORS], dtype=np.uint64))
        value = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            value = mixed(value ^ least[r::ROWS])
    return value.view(np.int64)


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, key, digest, size, bands) of each row; the digest is that of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "digest", "size", "bands"],
            )

    source = docs.select("doc_id", "key", F.coalesce("text", F.lit("")).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, key string, digest binary, size int, bands array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    """(v, shingles) for rows of (v, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(sets, pa.list_(pa.int64()))], ["v", "shingles"])

    return texts.mapInArrow(run, "v long, shingles array<bigint>")


def _alike(both: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b members, of which they share `both`, are similar enough."""
    up, down = SIMILAR
    return (both * (up + down)) >= (a + b) * up


def _fits(a: str, b: str) -> Column:
    """Whether sets of so many members can be similar enough at all."""
    up, down = SIMILAR
    return (F.least(a, b) * down) >= (F.greatest(a, b) * up)


def verified(pairs: DataFrame, sets: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Those of the `total` distinct pairs (a, b, and more columns) whose sets are similar. `counts` says how many pairs have a node as b."""
    found = pairs.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("set_a")), "a")
    table = sets.join(counts, "v").select(F.col("v").alias("b"), F.col("shingles").alias("set_b"), "n")
    found = join_hot(found, table, "b", "n", total, F.col("a"), counts.withColumnRenamed("v", "b")).drop("n")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return found.where(_alike(both, F.size("set_a"), F.size("set_b"))).drop("set_a", "set_b")


def _compared(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(a, b, la, lb): the similar ones of the pairs, each of which may come from several cells, with the ends' labels; how many they are, of how many."""
    pairs, of = scratch.told(pairs.groupBy("a", "b").agg(F.any_value("la").alias("la"), F.any_value("lb").alias("lb")), n=F.count(F.lit(1)))
    counts = scratch.keep(pairs.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    found, are = scratch.told(verified(pairs, sets, counts, of["n"]), n=F.count(F.lit(1)))
    return found, are["n"], of["n"]


def _turned(members: DataFrame, turn: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The members (cell, v, size, label) of cells with several labels, with their cell's largest label and its centre; and how many there are."""
    mark = F.struct(F.xxhash64(F.lit(turn), "v").alias("mark"), "v", "size")
    per = members.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("m"), F.min(mark).alias("pick"))
    cells = per.groupBy("cell").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label", "pick")).alias("top")).where("n > top.m")
    cells = cells.select("cell", "n", F.col("top.label").alias("main"), F.col("top.pick.v").alias("centre"), F.col("top.pick.size").alias("size2"))
    cells, of = scratch.told(cells, total=F.sum("n"))
    return scratch.keep(join_hot(members, cells, "cell", "n", of["total"], F.col("v"))), of["total"]


def _relabelled(inside: DataFrame, found: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """The members with their groups' labels after the links in `found`: each label follows the smallest one that it is linked to, twice."""
    links = found.select(F.col("la").alias("x"), F.col("lb").alias("y")).union(found.select("lb", "la")).distinct()
    up = scratch.keep(links.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("y")))
    again = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
    size = inside.groupBy(F.col("label").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    table = size.join(up.join(again, "y", "left"), "x", "left").select(F.col("x").alias("label"), F.coalesce("z", "y", "x").alias("after"), "k")
    moved = join_hot(inside.select("cell", "v", "size", "label"), scratch.keep(table), "label", "k", total, F.col("v"))
    return scratch.keep(moved.select("cell", "v", "size", F.col("after").alias("label")))


def _rare(inside: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(shingle, place, v, size, label, outside): the rarest fifth of each node's shingles and one more, numbered by rarity, without those no other node has.

    Similar sets share at least 0.8 of either one, so they share one of these. A
    node of whose shingles more than a fifth is in no other node has no partner and
    leaves before its shingles are moved.
    """
    up, down = SIMILAR
    nodes = inside.groupBy("v").agg(F.any_value("size").alias("size"), F.any_value("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("outside"))
    nodes = scratch.keep(nodes.join(sets, "v"))
    times = nodes.select("v", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    times = scratch.keep(times)
    alone = times.where("n = 1").groupBy("v").agg(F.count(F.lit(1)).alias("alone"))
    rest = nodes.join(alone, "v", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).where((F.col("size") - F.col("alone")) * down >= F.col("size") * up)
    held = rest.select("v", "size", "label", "outside", "alone", F.explode("shingles").alias("shingle"))
    shared, of = scratch.told(times.where("n > 1").select("shingle", "n"), total=F.sum("n"))
    held = join_hot(held, shared, "shingle", "n", of["total"], F.col("v"))
    place = F.col("alone") + F.row_number().over(Window.partitionBy("v").orderBy("n", "shingle"))
    ranked = held.withColumn("place", place).where((F.col("size") - F.col("place") + 1) * down >= F.col("size") * up)
    return ranked.select("shingle", "place", "v", "size", "label", "outside")


def _class(size: Column) -> Column:
    """Sizes within about 3 percent are one class."""
    return F.floor(F.log(size) * 32).cast("int")


def _rest(inside: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of those outside a cell's main group with nodes of other groups, without those whose rarest shingles show that they are not similar.

    Take shingles in order of rarity, the same one for all nodes. At the first one
    that two sets share, both must have enough of them left to be similar. So the
    smaller set is known by its first ninth, the larger one by as many as the
    other's size allows, and sizes meet by class. What very many have in common (a
    line, the text that copies are made from) comes last in the order. Crowded
    meetings are dealt over parts on both sides.
    """
    up, down = SIMILAR
    rare = scratch.keep(_rare(inside, sets, scratch))
    left = F.col("size") - F.col("place") + 1
    small = rare.where(left * (up + down) >= F.col("size") * (2 * up)).withColumn("class", _class(F.col("size")))
    low = F.ceil(F.col("size") * up / down).cast("int")
    high = F.least(F.col("size"), F.floor((left * (up + down)) / up - F.col("size")).cast("int"))
    large = rare.withColumn("low", low).withColumn("high", high).where("low <= high")
    large = large.withColumn("class", F.explode(F.sequence(_class(F.col("low")), _class(F.col("high"))))).drop("low", "high")

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias(name))

    met = count(small, "smaller").join(count(large, "larger"), ["shingle", "class"])
    parts = [F.ceil(F.col(name) / PART).cast("int").alias(name) for name in ("smaller", "larger")]
    crowded = scratch.keep(met.where((F.col("smaller") > PART) | (F.col("larger") > PART)).select("shingle", "class", *parts))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(crowded, ["shingle", "class"], "left")
        rows = rows.withColumn(f"{own}_part", F.pmod(F.xxhash64("v"), F.coalesce(own, F.lit(1))).cast("int"))
        rows = rows.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return rows.drop("smaller", "larger")

    names = ("v", "label", "size", "place", "outside")
    first = dealt(small, "smaller", "larger")
    second = dealt(large, "larger", "smaller").withColumnsRenamed({name: f"{name}2" for name in names})
    order = F.struct("size", "v") < F.struct("size2", "v2")
    enough = F.least(left, F.col("size2") - F.col("place2") + 1) * (up + down) >= (F.col("size") + F.col("size2")) * up
    both = first.join(second, ["shingle", "class", "smaller_part", "larger_part"])
    both = both.where(order & (F.col("label") != F.col("label2")) & (F.col("outside") | F.col("outside2")) & _fits("size", "size2") & enough)
    return both.select(F.col("v").alias("a"), F.col("v2").alias("b"), F.col("label").alias("la"), F.col("label2").alias("lb"))


def _given(linked: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, int]]:
    """(a, b): links of the nodes whose rows have one `joined` in `linked`, each with the smallest of them; and n, how many."""
    of = linked.distinct().join(rows.select("key", "digest").distinct(), "key").select("digest", "joined").distinct()
    ends = scratch.keep(of.join(nodes.select("digest", "v"), "digest").select("v", "joined"))
    first, of = scratch.told(ends.groupBy("joined").agg(F.min("v").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), total=F.sum("n"))
    return scratch.told(join_hot(ends, first, "joined", "n", of["total"], F.col("v")).select(F.col("v").alias("a"), "b").where("a != b"), n=F.count(F.lit(1)))


def near_duplicates(docs: DataFrame, turns: int = TURNS, linked: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, root) for rows of (doc_id, text, key): rows with one root are joined by steps of similar texts. Equal keys have equal texts.

    `linked` has (key, joined): rows with one `joined` are compared with one of them beforehand, and the turns start from what is similar.
    """
    rows = cut(_sketched(docs))
    with Scratch(docs.sparkSession) as scratch:
        nodes = rows.groupBy("digest").agg(F.min("key").alias("key"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("times"))
        # Numbers are given once, as the rows are written.
        nodes, of = scratch.told(nodes.withColumn("v", F.monotonically_increasing_id()), n=F.count(F.lit(1)), rows=F.sum("times"))
        dealt = nodes.select("v", "size", F.explode("bands").alias("cell"))
        shared = scratch.keep(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        members = join_hot(dealt, shared, "cell", "n", of["n"] * BANDS, F.col("v"))
        members = scratch.keep(members.select("cell", "v", "size", F.col("v").alias("label")))
        given, links = (None, {}) if linked is None else _given(linked, rows, nodes, scratch)
        wanted = members.select("v") if given is None else members.select("v").union(given.select("a")).union(given.select("b"))
        chosen = wanted.distinct().join(nodes.select("v", "key"), "v")
        texts = docs.select("key", F.coalesce("text", F.lit("")).alias("_text")).join(chosen, "key")
        sets = scratch.keep(_sets(texts.select("v", "_text")).groupBy("v").agg(F.first("shingles").alias("shingles")))

        edges = [scratch.keep(members.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0))]
        if given is not None:
            counts = scratch.keep(given.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("n")))
            edges = [scratch.keep(verified(given, sets, counts, links["n"]).select("a", "b"))]
            labels = edges[0].groupBy(F.col("a").alias("v")).agg(F.min("b").alias("first"))
            members = members.join(labels, "v", "left").select("cell", "v", "size", F.coalesce("first", "label").alias("label"))
            members = scratch.keep(members)
        turn, last = 0, False
        while True:
            inside, total = _turned(members, turn, scratch)
            if not total:
                break
            if not last:
                pairs = inside.where((F.col("label") != F.col("main")) & _fits("size", "size2"))
                pairs = pairs.select(F.col("v").alias("a"), F.col("centre").alias("b"), F.col("label").alias("la"), F.col("main").alias("lb"))
            else:
                pairs = _rest(inside, sets, scratch)
            found, n_found, n_pairs = _compared(pairs, sets, scratch)
            edges.append(found.select("a", "b"))
            if last:
                break
            members = _relabelled(inside, found, total, scratch)
            turn += 1
            last = turn >= turns or n_found * GAIN < n_pairs
        roots = components(reduce(DataFrame.union, edges))
        table = cut(nodes.join(roots, "v", "left").select("digest", F.coalesce("root", "v").alias("root"), "times"))
    return join_hot(rows.select("doc_id", "key", "digest"), table, "digest", "times", of["rows"], F.col("key")).select("doc_id", "key", "root")
