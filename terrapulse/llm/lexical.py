"""Ranked lexical search by pipelined term partitioning.

The items' terms are dealt to STAGES owners, those of the greatest possible
contribution first. Bundles of items visit the owners one after the other: each
bundle brings sparse accumulators (item, document, score) for every slice of the
documents, is cogrouped with the owner's postings of that slice, and goes on with
their integer contributions added. The last owner is followed by the selection.

What cannot be among an item's best is left behind by an exact bound: after each
owner the score that enough documents have already is known for each item (a
histogram, summed over the slices); an accumulator that stays below it even with
all that the later owners can add is dropped, and so are documents not met yet.

A slice is packed where its documents are read: nothing but postings of the items'
terms leaves the scan. No term, item or document is one task's alone: a frequent
term's postings lie in all slices.

Bounds: an owner's plan lists the terms of one load of items, at most VOCABULARY
terms or those of one item; more items make more loads.

Defined results: a null text has no term. Rows with one item_id (null is one, too)
are one item with all their terms. Rows of documents are ranked one by one,
repeated ones too; ties go by doc_id, null last. Items without a document of
positive score, and empty tables, give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrapulse.llm.common import cut

#: What a term is, and the numbers of the score.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UNIT, NEAR, FAR = 1_000_000_000, 1000, 20
TOP = 50

STAGES = 4
#: Share of all contributions that the owners up to each stage have. The first ones are short: their terms are rare.
SHARES = (0.03, 0.15, 0.5, 1.0)
SLICE_DOCS = 4096
BUNDLE_ITEMS = 256
VOCABULARY = 200_000
#: Buckets of an item's histogram of scores.
BUCKETS = 512

_LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str | None) -> list[str]:
    return [] if text is None else TERM.findall(text.translate(_LOWER))


@dataclass(frozen=True)
class Load:
    """Some items, and what the owners know of their terms. Items are numbered from 0, item i is in bundle i // bundle_items."""

    #: Per term: its weight, the most one document can gain, its owner; items[first[t]:first[t + 1]] use it.
    weight: np.ndarray
    most: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    items: np.ndarray
    #: Per item: what the owners from each stage on can add, at most.
    ahead: np.ndarray
    bundle_items: int
    top: int

    @property
    def width(self) -> np.ndarray:
        """The width of the buckets of each item's histogram."""
        return self.ahead[0] // BUCKETS + 1


def _item_terms(items: DataFrame, vocabulary: int) -> DataFrame:
    """(item_id, item, load, term): distinct terms of the numbered items; consecutive items are one load."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(terms_of(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], ["item_id", "terms"])

    source = items.select("item_id", "text")
    kind = source.schema["item_id"].dataType.simpleString()
    pairs = source.mapInArrow(run, f"item_id {kind}, terms array<string>").select("item_id", F.explode("terms").alias("term")).distinct()
    # One row for each item of the stated query set, in id order.
    upto = Window.orderBy("item_id")
    numbers = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("item_id").alias("_id"), (F.row_number().over(upto) - 1).alias("item"),
        F.floor((F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - 1) / vocabulary).cast("int").alias("load"),
    )
    return pairs.join(numbers, F.col("item_id").eqNullSafe(F.col("_id"))).drop("_id")


def _sliced(docs: DataFrame, terms: dict[str, int], slice_docs: int) -> DataFrame:
    """The documents in slices: one row each, with the packed postings of the terms.

    Documents are numbered within their slice in the order of their ids.
    """
    carried = docs.sparkSession.sparkContext.broadcast(terms)

    def packed(ids: list[pa.Array], lengths: list[int], docs: list[np.ndarray], met: list[np.ndarray], times: list[np.ndarray], sums: tuple[int, int], at: int) -> pa.RecordBatch:
        every = pa.concat_arrays(ids) if ids else pa.array([], source_type)
        order = pc.sort_indices(every, null_placement="at_end")
        place = np.empty(len(every), np.int64)
        place[order.to_numpy()] = np.arange(len(every))
        term = np.concatenate(met) if met else np.zeros(0, np.int64)
        doc = place[np.concatenate(docs)] if docs else np.zeros(0, np.int64)
        tf = np.concatenate(times) if times else np.zeros(0, np.int64)
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(tf, first) if len(term) else tf
        row = {
            "slice": [(TaskContext.get().partitionId() << 32) + at], "n_docs": [sums[0]], "n_terms": [sums[1]],
            "lengths": [np.array(lengths, "<i8")[order.to_numpy()].tobytes()], "terms": [term[first].astype(np.int32)],
            "counts": [np.diff(np.append(first, len(term))).astype(np.int64)], "most": [most.astype(np.int64)],
            "docs": [doc.astype("<u2").tobytes()], "tfs": [tf.astype("<i8").tobytes()],
        }
        columns = [pa.array([every.take(order)], pa.list_(every.type))] + [pa.array(v) for v in row.values()]
        return pa.RecordBatch.from_arrays(columns, ["ids", *row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = carried.value.get, 0
        ids, lengths, docs, met, times, sums = [], [], [], [], [], [0, 0]
        for batch in batches:
            take = []
            for i, text in enumerate(batch.column("text")):
                words = terms_of(text.as_py())
                if not words:
                    continue
                sums[0] += 1
                sums[1] += len(words)
                found, tf = np.unique([k for w in words if (k := number(w)) is not None], return_counts=True)
                if not len(found):
                    continue
                docs.append(np.full(len(found), len(lengths)))
                met.append(found.astype(np.int64))
                times.append(tf)
                lengths.append(len(words))
                take.append(i)
                if len(lengths) == slice_docs:
                    ids.append(batch.column("doc_id").take(pa.array(take, pa.int64())))
                    yield packed(ids, lengths, docs, met, times, tuple(sums), at)
                    ids, lengths, docs, met, times, sums, take, at = [], [], [], [], [], [0, 0], [], at + 1
            if take:
                ids.append(batch.column("doc_id").take(pa.array(take, pa.int64())))
        if sums[0]:
            yield packed(ids, lengths, docs, met, times, tuple(sums), at)

    source = docs.select("doc_id", "text")
    source_type = to_arrow_type(source.schema["doc_id"].dataType)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"ids array<{kind}>, slice long, n_docs long, n_terms long, lengths binary, terms array<int>, counts array<long>, most array<long>, docs binary, tfs binary",
    )


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNIT * tf) // (NEAR * tf + FAR * m)


def _planned(pairs: list[tuple[int, int]], known: dict[int, tuple[int, int]], n_docs: int, n_terms: int, bundle_items: int, top: int) -> Load:
    """The owners of the (item, term) pairs' terms. `known` has the documents and the greatest frequency of those that occur."""
    items, terms = np.array(sorted(pairs, key=lambda p: (p[1], p[0])), np.int64).T
    n = int(terms[-1]) + 1
    df, most_tf = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t, (docs, times) in known.items():
        df[t], most_tf[t] = docs, times
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    least = 50 + 50 * n_docs // n_terms
    most = weight * np.where(most_tf > 0, _gain(np.maximum(most_tf, 1), np.full(n, least)), 0)
    first = np.searchsorted(terms, np.arange(n + 1))
    order = np.argsort(-most, kind="stable")
    work = np.cumsum((df * np.diff(first))[order])
    owner = np.empty(n, np.int64)
    owner[order] = np.minimum(np.searchsorted(np.array(SHARES) * max(1, int(work[-1])), work), STAGES - 1)
    ahead = np.zeros((STAGES + 1, int(items.max()) + 1), np.int64)
    for s in reversed(range(STAGES)):
        ahead[s] = ahead[s + 1]
        np.add.at(ahead[s], items[owner[terms] == s], most[terms[owner[terms] == s]])
    return Load(weight, most, owner, first, items, ahead, bundle_items, top)


def _postings(slices: DataFrame, load: Load, stage: int, n_docs: int, n_terms: int) -> DataFrame:
    """(bundle, slice, ids, size, terms, counts, docs, gains): what the stage's owner has for each bundle and slice; the ids go with the last owner only."""
    carried = slices.sparkSession.sparkContext.broadcast(load)
    kind = slices.schema["ids"].dataType.simpleString()
    last = stage == STAGES - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = carried.value
        bundles = np.unique(load.items // load.bundle_items)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("terms", "counts", "lengths", "docs", "tfs", "slice")}
                terms, counts = (np.array(row[c].as_py(), np.int64) for c in ("terms", "counts"))
                lengths, tfs = (np.frombuffer(row[c].as_py(), "<i8") for c in ("lengths", "tfs"))
                docs = np.frombuffer(row["docs"].as_py(), "<u2")
                own = load.owner[terms] == stage
                held = np.repeat(own, counts)
                m = 100 - 50 + (50 * lengths * n_docs) // n_terms
                gains = np.repeat(load.weight[terms], counts)[held] * _gain(tfs[held], m[docs[held]])
                docs, terms, counts = docs[held], terms[own], counts[own]
                of = np.repeat(np.arange(len(terms)), counts)
                used = [np.unique(load.items[load.first[t] : load.first[t + 1]] // load.bundle_items) for t in terms]
                for b in bundles.tolist():
                    needed = np.array([b in u for u in used], bool)
                    some = needed[of]
                    if last or needed.any():
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([b], pa.int32()), pa.array([row["slice"].as_py()], pa.int64()),
                                batch.column("ids").slice(i, 1) if last else pa.array([None], batch.column("ids").type), pa.array([len(lengths)], pa.int32()),
                                *(pa.array([x.tobytes()], pa.binary()) for x in (terms[needed].astype("<i4"), counts[needed].astype("<i4"), docs[some], gains[some].astype("<i8"))),
                            ],
                            ["bundle", "slice", "ids", "size", "terms", "counts", "docs", "gains"],
                        )

    return slices.mapInArrow(run, f"bundle int, slice long, ids {kind}, size int, terms binary, counts binary, docs binary, gains binary")


CARRIED = "bundle int, slice long, items binary, docs binary, scores binary, buckets array<struct<item:int,bucket:int,n:long>>"
_BUCKETS = pa.list_(pa.struct([("item", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())]))


def _added(bundle: pa.Table, owner: pa.Table, load: Load, stage: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, documents, scores) of each item of a bundle in one slice, after its visit to the owner."""
    rows = owner.to_pylist() if owner.num_rows else []
    terms, counts, docs, gains = (np.frombuffer(rows[0][c], k) if rows else np.zeros(0, k) for c, k in (("terms", "<i4"), ("counts", "<i4"), ("docs", "<u2"), ("gains", "<i8")))
    ends = np.cumsum(counts)
    wanted: dict[int, list[int]] = {}
    number = (bundle if bundle.num_rows else owner).column("bundle")[0].as_py()
    for k, t in enumerate(terms.tolist()):
        for item in load.items[load.first[t] : load.first[t + 1]].tolist():
            if item // load.bundle_items == number:
                wanted.setdefault(item, []).append(k)
    carried: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if bundle.num_rows:
        row = bundle.select(["items", "docs", "scores"]).to_pylist()[0]
        items, at, scores = np.frombuffer(row["items"], "<i4"), np.frombuffer(row["docs"], "<u2"), np.frombuffer(row["scores"], "<i8")
        edges = np.flatnonzero(np.diff(items, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            carried[int(items[a])] = at[a:b], scores[a:b]
    total = np.zeros(1 << 16, np.int64)
    for item in sorted(wanted.keys() | carried.keys()):
        old = carried.get(item)
        if old is not None:
            total[old[0]] = old[1]
        for k in wanted.get(item, ()):
            total[docs[ends[k] - counts[k] : ends[k]]] += gains[ends[k] - counts[k] : ends[k]]
        # Only what can still reach the score that enough documents have is carried on.
        keep = np.flatnonzero((total > 0) & (total + load.ahead[stage + 1][item] >= floor[item]))
        yield item, keep, total[keep].copy()
        total[:] = 0


def _visited(carried: DataFrame | None, postings: DataFrame, load: Load, stage: int, floor: np.ndarray) -> DataFrame:
    """The bundles after their visit to the stage's owner: CARRIED, or (item, doc_id, score) after the last one."""
    session = postings.sparkSession
    shared = session.sparkContext.broadcast((load, floor))
    if carried is None:
        carried = session.createDataFrame([], CARRIED)
    last = stage == STAGES - 1
    kind = postings.schema["ids"].dataType.elementType.simpleString()

    def run(bundle: pa.Table, owner: pa.Table) -> pa.Table:
        load, floor = shared.value
        number, place = ((bundle if bundle.num_rows else owner).column(c)[0].as_py() for c in ("bundle", "slice"))
        width = load.width
        items, docs, scores, buckets = [], [], [], []
        for item, at, total in _added(bundle, owner, load, stage, floor):
            best = np.lexsort((at, -total))[: load.top]
            if last:
                at, total = at[best], total[best]
            items.append(np.full(len(at), item))
            docs.append(at)
            scores.append(total)
            if not last:
                found, n = np.unique(total[best] // width[item], return_counts=True)
                buckets += [{"item": item, "bucket": b, "n": k} for b, k in zip(found.tolist(), n.tolist(), strict=True)]
        items, docs, scores = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (items, docs, scores))
        if last:
            ids = owner.column("ids").combine_chunks().flatten().take(pa.array(docs))
            return pa.table({"item": pa.array(items, pa.int32()), "doc_id": ids, "score": scores})
        return pa.table(
            {
                "bundle": pa.array([number], pa.int32()), "slice": pa.array([place], pa.int64()),
                "items": pa.array([items.astype("<i4").tobytes()]), "docs": pa.array([docs.astype("<u2").tobytes()]), "scores": pa.array([scores.astype("<i8").tobytes()]),
                "buckets": pa.array([buckets], _BUCKETS),
            }
        )

    both = carried.groupBy("bundle", "slice").cogroup(postings.groupBy("bundle", "slice"))
    return both.applyInArrow(run, f"item int, doc_id {kind}, score long" if last else CARRIED)


def _floors(carried: DataFrame, load: Load) -> np.ndarray:
    """A score that the wanted number of documents of each item have at least, so far; 0 if there are fewer."""
    per = carried.select(F.explode("buckets").alias("b")).groupBy("b.item", "b.bucket").agg(F.sum("b.n").alias("n"))
    above = Window.partitionBy("item").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = per.withColumn("n", F.sum("n").over(above)).where(F.col("n") >= load.top).groupBy("item").agg(F.max("bucket").alias("bucket"))
    floor = np.zeros(load.ahead.shape[1], np.int64)
    for item, bucket in known.collect():
        floor[item] = bucket * load.width[item]
    return floor


def search(docs: DataFrame, items: DataFrame, top: int = TOP, slice_docs: int = SLICE_DOCS, bundle_items: int = BUNDLE_ITEMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item. A slice has at most 65,536 documents."""
    pairs = cut(_item_terms(items, vocabulary))
    ids = pairs.select("item_id", "item").distinct()
    parts = []
    for (number,) in sorted(pairs.select("load").distinct().collect()):
        some = pairs.where(F.col("load") == number).select("item", "term").collect()
        terms: dict[str, int] = {}
        base = min(r["item"] for r in some)
        listed = [(r["item"] - base, terms.setdefault(r["term"], len(terms))) for r in some]
        slices = cut(_sliced(docs, terms, slice_docs))
        n_docs, n_terms = slices.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        if not n_docs:
            continue
        rows = slices.select(F.explode(F.arrays_zip("terms", "counts", "most")).alias("p"))
        known = rows.groupBy("p.terms").agg(F.sum("p.counts"), F.max("p.most")).collect()
        load = _planned(listed, {t: (n, most) for t, n, most in known}, n_docs, n_terms, bundle_items, top)
        carried, floor = None, np.zeros(load.ahead.shape[1], np.int64)
        for stage in range(STAGES):
            postings = _postings(slices.where(F.size("ids") > 0), load, stage, n_docs, n_terms)
            carried = cut(_visited(carried, postings, load, stage, floor))
            if stage < STAGES - 1:
                floor = np.maximum(floor, _floors(carried, load))
        parts.append(carried.withColumn("item", (F.col("item") + base).cast("int")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"item int, doc_id {kind}, score long")
    for part in parts:
        found = found.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")
