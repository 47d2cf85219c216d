"""SimHash near-duplicates by BK-trees.

Equal fingerprints are one node. Two fingerprints at most RADIUS bits apart agree
on all but RADIUS of any set of blocks of their bits, so every node is dealt to
one cell for each choice of the agreeing blocks, and all links lie within cells.
Each cell has a BK-tree: a child hangs on the edge of its Hamming distance to the
parent, and a search follows only edges within the radius of its own distance. A
crowded cell has several trees of bounded size; each is searched for all members,
in blocks of bounded size.

A cell never returns pairs, only a spanning forest of its links (a row for each
member at most). Components of all cells' links are found by hooking to the
smallest neighbour, pointer jumping and contraction, all as joins.

Defined results: a text without words has fingerprint zero and is linked like
others. A null doc_id is linked too but is never the smallest; component_id is
null if there is no other. Repeated rows get equal results. An empty table gives
no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import Scratch, cut, join_hot

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Nodes of a cell that are expected on average, at most; more nodes mean more blocks, hence smaller cells.
CELL_NODES = 2048
#: Nodes of one tree; a cell with more has several trees.
TREE_NODES = 20_000
#: Members handled in one task, on average.
TASK_NODES = 200_000
#: Crowded cells that are listed by a broadcast; beyond that the list is joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Pairs of search and node that are looked at together.
_BLOCK = 1 << 19

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, print): the fingerprint's bits as a long; and the columns named in `payload`, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("_text")], dtype=np.uint64)
            rest = [name for name in batch.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in rest), pa.array(found.view(np.int64))], [*rest, "print"])

    source = docs.select("doc_id", *payload, F.coalesce("text", F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, print long")


class Forest:
    """BK-trees over several cells at once. Nodes are numbered; node i holds prints[i]; root[c] is the tree of cell number c."""

    def __init__(self, cells: np.ndarray, prints: np.ndarray):
        """`cells` has the number of each print's cell, from 0 without gaps; prints are distinct within a cell."""
        self.prints = prints
        edges = [np.zeros(0, np.int64)]
        children = [np.zeros(0, np.int64)]
        items, groups, level = np.argsort(cells, kind="stable"), None, 0
        groups = cells[items]
        self.root = np.zeros(0, np.int64)
        while len(items):
            first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            nodes = items[first]
            if level == 0:
                self.root = nodes
            else:
                edges.append(groups[first])
                children.append(nodes)
            of = np.repeat(nodes, np.diff(np.concatenate([first, [len(items)]])))
            rest = np.ones(len(items), bool)
            rest[first] = False
            items, of = items[rest], of[rest]
            # The new group of an item is its parent and its distance to it.
            groups = of * (BITS + 1) + np.bitwise_count(prints[items] ^ prints[of])
            order = np.argsort(groups, kind="stable")
            items, groups, level = items[order], groups[order], level + 1
        self.edges, self.children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]

    def search(self, prints: np.ndarray, cells: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (index into the searched prints, node within the radius)."""
        stack = [(np.arange(len(prints))[at : at + _BLOCK], self.root[cells[at : at + _BLOCK]]) for at in range(0, len(prints), _BLOCK)]
        while stack:
            who, node = stack.pop()
            far = np.bitwise_count(prints[who] ^ self.prints[node]).astype(np.int64)
            near = far <= radius
            if near.any():
                yield who[near], node[near]
            low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(far - radius, 0))
            high = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(far + radius, BITS), "right")
            n = high - low
            if total := int(n.sum()):
                who = np.repeat(who, n)
                at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                node = self.children[at]
                stack += [(who[i : i + _BLOCK], node[i : i + _BLOCK]) for i in range(0, total, _BLOCK)]


def united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i], in place; every element's parent is the smallest of its set afterwards."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def local_links(members: pd.DataFrame, radius: int = RADIUS) -> pd.DataFrame:
    """A spanning forest (a, b) of the links between members (cell, print, in_tree, searches): those who search, and the trees of their cells."""
    prints, of = np.unique(members["print"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    cells, cell = np.unique(members["cell"].to_numpy(np.int64), return_inverse=True)
    tree = np.flatnonzero(members["in_tree"].to_numpy(bool))
    # A cell without tree members here cannot link anything.
    kept, number = np.unique(cell[tree], return_inverse=True)
    forest = Forest(number, prints[of[tree]])
    place = np.full(len(cells), -1)
    place[kept] = np.arange(len(kept))
    probe = np.flatnonzero((place[cell] >= 0) & members["searches"].to_numpy(bool))
    parent = np.arange(len(prints))
    for who, node in forest.search(prints[of[probe]], place[cell[probe]], radius):
        united(parent, of[probe[who]], of[tree[node]])
    linked = np.flatnonzero(parent != np.arange(len(prints)))
    return pd.DataFrame({"a": prints[linked].view(np.int64), "b": prints[parent[linked]].view(np.int64)})


def blocks_for(nodes: int, radius: int = RADIUS) -> int:
    """Blocks such that an even spread puts at most CELL_NODES into a cell."""
    blocks = radius + 1
    while nodes / 2 ** (BITS // blocks * (blocks - radius)) > CELL_NODES and blocks < 3 * radius:
        blocks += 1
    return blocks


def _cells(blocks: int, radius: int) -> Column:
    """The cells of a print: one for each choice of the blocks that agree; the choice and the bits in it, hashed."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    chosen = [sum(c) for c in itertools.combinations(masks, blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]
    return F.array(*[F.xxhash64(F.lit(i), F.col("print").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])


def links(nodes: DataFrame, n_nodes: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join all nodes (print) that are joined by steps of at most `radius` bits. No pair of a cell is lost."""
    blocks = blocks_for(n_nodes, radius)
    cells = _cells(blocks, radius)
    dealt = nodes.select("print", F.explode(cells).alias("cell"))
    trees = F.ceil(F.col("count") / TREE_NODES).cast("int").alias("trees")
    crowded = cut(dealt.groupBy("cell").count().where(F.col("count") > TREE_NODES).select("cell", trees))
    few = crowded.count() <= BROADCAST_CELLS
    whole = dealt.join(F.broadcast(crowded) if few else crowded, "cell", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    # Parts i and j of a crowded cell meet once, in (least, greatest): the former's tree is searched for the latter's prints.
    members = whole.withColumn("part", F.pmod(F.xxhash64("print"), F.col("trees")).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other")
    )
    members = members.select(
        "cell", "print", "trees", F.least("part", "other").alias("tree"), F.greatest("part", "other").alias("block"),
        (F.col("part") <= F.col("other")).alias("in_tree"), (F.col("part") >= F.col("other")).alias("searches"),
    )
    rows = n_nodes * len(list(itertools.combinations(range(blocks), radius)))
    tasks = max(1, -(-rows // TASK_NODES))
    # What meets stays together; which cells share a task is arbitrary.
    task = F.when(F.col("trees") > 1, F.xxhash64("cell", "tree", "block")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(tasks)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return local_links(rows, radius)

    return members.withColumn("task", task).groupBy("task").applyInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge: the smallest vertex of its component.

    Every round hooks each vertex to its smallest neighbour and contracts the
    trees to their roots: at most half of the vertices are left.
    """
    with Scratch(edges.sparkSession) as scratch:
        steps = []
        edges, left = scratch.told(edges.distinct(), n=F.count(F.lit(1)))
        while n := left["n"]:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
            up = scratch.keep(up.select(F.col("a").alias("v"), F.least("a", "m").alias("p"), "n"))
            # Pointers jump, twice as far each time, until all point at the smallest vertex of their tree.
            moved = 1
            while moved:
                over = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
                jumped = up.join(over, "p").select("v", F.col("pp").alias("p"), "n", (F.col("pp") != F.col("p")).alias("moved"))
                up, of = scratch.told(jumped, moved=F.count_if("moved"))
                moved = of["moved"]
            up = up.drop("moved")
            steps.append(up)
            for end in ("a", "b"):
                table = up.select(F.col("v").alias(end), F.col("p").alias("_p"), "n")
                other = "b" if end == "a" else "a"
                edges = join_hot(edges, table, end, "n", 2 * n, F.col(other)).select(F.col("_p").alias(end), other)
            edges, left = scratch.told(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n=F.count(F.lit(1)))
        if not steps:
            return cut(edges.select(F.col("a").alias("v"), F.col("b").alias("root")))
        roots = steps[-1].select("v", F.col("p").alias("root"))
        for up in reversed(steps[:-1]):
            above = roots.select(F.col("v").alias("p"), "root")
            roots = scratch.keep(up.join(above, "p", "left").select("v", F.coalesce("root", "p").alias("root")))
        return cut(roots)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, payload: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, payload, print, root, component_id) of each row.

    component_id is the smallest id that steps of at most `radius` bits lead to,
    root the smallest print.
    """
    prints = cut(fingerprints(docs, payload))
    nodes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    n_nodes, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(links(nodes.select("print"), n_nodes, radius))
    rooted = nodes.join(roots.withColumnRenamed("v", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = cut(rooted)
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")))
    table = join_hot(rooted, least, "root", "members", n_nodes, F.col("print")).select("print", "root", "component_id", "n")
    spread = F.xxhash64("doc_id", *payload)
    return join_hot(prints, table, "print", "n", total, spread).select("doc_id", *payload, "print", "root", "component_id")
