"""External induced sorting of the suffixes of one text, with common-prefix lengths.

Symbols go up from 0, the text's unique end mark. Left-most S suffixes are named
by inducing once from their first symbols; if names repeat, the string of names is
sorted by recursion. From their sorted order all L suffixes are induced going up,
then all S suffixes going down. The suffixes wait in a priority queue of tuples
(symbol, arrival, position, common prefix with the one before of that symbol),
kept on disk beyond a fixed number. A common prefix is one more than the least one
among the sources in between. Lengths are capped, as only those up to a window's
length matter.

A queue spills to unnamed files in the task's own temporary folder: they go with
the task, and a task that is run again writes its own.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from terrapulse.llm.windows import grams

#: Tuples that a queue holds in memory.
IN_MEMORY = 1 << 20
#: Sources that are induced from together.
BLOCK = 1 << 16
#: Names up to which the string of names is sorted by induction; beyond it most names are unique and doubling is short.
INDUCED_NAMES = 2048


class BucketQueue:
    """A priority queue by (symbol, arrival), on disk where it is large. Items are (position, common prefix)."""

    _ITEM = np.dtype([("at", "<i8"), ("lcp", "<i2")])

    def __init__(self, symbols: int, in_memory: int = IN_MEMORY):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.files: dict[int, tuple] = {}
        self.held, self.in_memory = 0, in_memory

    def push(self, symbols: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        """Adds items in order of arrival."""
        if not len(at):
            return
        items = np.empty(len(at), self._ITEM)
        order = np.argsort(symbols, kind="stable")
        items["at"], items["lcp"] = at[order], lcp[order]
        ordered = symbols[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        for symbol, part in zip(ordered[heads].tolist(), np.split(items, heads[1:]), strict=True):
            self.parts[symbol].append(part)
        self.held += len(items)
        if self.held > self.in_memory:
            self._spill()

    def _spill(self) -> None:
        for symbol, parts in enumerate(self.parts):
            if parts:
                if symbol not in self.files:
                    self.files[symbol] = (tempfile.TemporaryFile(prefix="queue-"), [0])
                file, count = self.files[symbol]
                file.seek(0, 2)
                for part in parts:
                    file.write(part.tobytes())
                    count[0] += len(part)
                self.parts[symbol] = []
        self.held = 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Removes and yields blocks of the symbol's items, in order of arrival; what arrives meanwhile stays."""
        kept = self.files.pop(symbol, None)
        parts, self.parts[symbol] = self.parts[symbol], []
        self.held -= sum(map(len, parts))
        if kept is not None:
            file, count = kept
            file.seek(0)
            for at in range(0, count[0], BLOCK):
                items = np.frombuffer(file.read(min(BLOCK, count[0] - at) * self._ITEM.itemsize), self._ITEM)
                yield items["at"].copy(), items["lcp"].copy()
            file.close()
        # Small arrivals are joined, so that runs of one symbol don't end in many tiny steps.
        if parts:
            items = np.concatenate(parts)
            for at in range(0, len(items), BLOCK):
                yield items["at"][at : at + BLOCK].copy(), items["lcp"][at : at + BLOCK].copy()


class _Inducer:
    """One direction of induction: from sources in order to the suffixes one place before them that have the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int, cap: int, in_memory: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queue = BucketQueue(symbols, in_memory)
        #: Least common prefix since the last item of each symbol; -1: there is none yet.
        self.since = np.full(symbols, -1, np.int32)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """`lcp` is the common prefix of each source with the source before it."""
        lcp = lcp.astype(np.int32)
        before = at - 1
        use = np.flatnonzero((at > 0) & self.wanted[before])
        symbols = self.text[before[use]]
        value = np.zeros(len(use), np.int32)
        if self.cap:
            order = np.argsort(symbols, kind="stable")
            place, symbol = use[order], symbols[order]
            head = np.concatenate([[True], symbol[1:] != symbol[:-1]]) if len(symbol) else np.zeros(0, bool)
            least = np.minimum.accumulate(lcp)
            found = np.empty(len(place), np.int32)
            found[head] = np.minimum(self.since[symbol[head]], least[place[head]])
            rest = np.flatnonzero(~head)
            found[rest] = _range_min(lcp, place[rest - 1] + 1, place[rest])
            value[order] = np.minimum(found + 1, self.cap)
            self.since = np.minimum(self.since, least[-1])
            if len(place):
                last = np.flatnonzero(np.concatenate([head[1:], [True]]))
                tail = np.minimum.accumulate(lcp[::-1])[::-1]
                after = place[last] + 1
                self.since[symbol[last]] = np.where(after < len(lcp), tail[np.minimum(after, len(lcp) - 1)], self.cap)
        self.queue.push(symbols, before[use], value.astype(np.int16))


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of x[low..high], by a sparse table."""
    out = np.empty(len(low), x.dtype)
    if not len(low):
        return out
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = x
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        now = level == k
        out[now] = np.minimum(table[low[now]], table[high[now] - (1 << k) + 1])
    return out


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the next one."""
    n = len(text)
    changes = np.flatnonzero(text[1:] != text[:-1])
    run = np.searchsorted(changes, np.arange(n - 1))
    out = np.ones(n, bool)
    out[:-1] = (text[changes] < text[changes + 1])[run]
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """The common prefixes of the suffixes at a[i] and b[i], up to `cap`, by hashes of stretches of halving lengths."""
    out = np.zeros(len(a), np.int64)
    n = len(text)
    length = 1 << max(0, cap.bit_length() - 1)
    while length:
        if length <= n:
            hashes = grams(text.astype(np.uint64) + np.uint64(1), length)
            p, q = a + out, b + out
            fits = (p + length <= n) & (q + length <= n)
            some = np.flatnonzero(fits)
            out[some[hashes[p[some]] == hashes[q[some]]]] += length
        length //= 2
    return np.minimum(out, cap)


def _one_prefix(text: np.ndarray, a: int, b: int, cap: int) -> int:
    x, y = text[a : a + cap], text[b : b + cap]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _induce(text, is_s, seeds, seed_lcp, symbols, cap, in_memory) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, common prefix with the position before it in this order), from the largest suffix to the smallest.

    `seeds` are the left-most S suffixes, sorted (by first symbol at least).
    """
    up = _Inducer(text, ~is_s, symbols, cap, in_memory)
    done = BucketQueue(symbols, in_memory)
    first = np.searchsorted(text[seeds], np.arange(symbols + 1))
    for c in range(symbols):
        last = None
        while up.queue.parts[c] or c in up.queue.files:
            for at, lcp in up.queue.pop(c):
                done.push(np.full(len(at), c), at, lcp)
                up.feed(at, lcp)
                last = int(at[-1])
        for i in range(first[c], first[c + 1], BLOCK):
            at, lcp = seeds[i : min(i + BLOCK, first[c + 1])], seed_lcp[i : min(i + BLOCK, first[c + 1])].copy()
            if i == first[c]:
                lcp[0] = _one_prefix(text, last, int(at[0]), cap) if last is not None and cap else 0
            up.feed(at, lcp)
    down = _Inducer(text, is_s, symbols, cap, in_memory)
    for c in range(symbols - 1, -1, -1):
        last = None
        if c == 0:  # the end mark is the only suffix of its symbol, and no S suffix comes before it
            yield np.array([len(text) - 1]), np.zeros(1, np.int16)
            continue
        while down.queue.parts[c] or c in down.queue.files:
            for at, lcp in down.queue.pop(c):
                yield at, lcp
                down.feed(at, lcp)
                last = int(at[-1])
        # L suffixes come in rising order from the queue; here they are wanted falling.
        blocks = list(done.pop(c))
        carried = np.int16(_one_prefix(text, last, int(blocks[-1][0][-1]), cap) if last is not None and blocks and cap else 0)
        for at, lcp in reversed(blocks):
            falling = np.concatenate([[carried], lcp[:0:-1]]).astype(np.int16)
            carried = lcp[0]
            yield at[::-1], falling
            down.feed(at[::-1], falling)


def _seeds(text: np.ndarray, is_s: np.ndarray, symbols: int, cap: int, in_memory: int) -> np.ndarray:
    """The left-most S suffixes, sorted by their first `cap` symbols at least."""
    left = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    rough = left[np.argsort(text[left], kind="stable")]
    none = np.zeros(len(rough), np.int16)
    is_left = np.zeros(len(text), bool)
    is_left[left] = True
    found = [at[is_left[at]] for at, _ in _induce(text, is_s, rough, none, symbols, 0, in_memory)]
    # The end mark is left-most S too, and the smallest.
    order = np.concatenate(found)[::-1]
    length = np.diff(np.concatenate([left, [len(text)]]))
    place = np.searchsorted(left, order)
    key = _stretch_hashes(text, left)
    same = (length[place[1:]] == length[place[:-1]]) & (key[place[1:]] == key[place[:-1]])
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 == len(left):
        return order
    string = np.empty(len(left), np.int64)
    string[place] = names
    return left[_sorted_suffixes(string, int(names[-1]) + 1, cap, in_memory)]


def _stretch_hashes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A hash of each stretch from one left-most S suffix to the next one, its first symbol included."""
    from terrapulse.llm.common import mixed

    out = np.zeros(len(left), np.uint64)
    ends = np.concatenate([left[1:] + 1, [len(text)]])
    step = 1 << 16
    with np.errstate(over="ignore"):
        for i in range(0, len(left), step):
            a, b = left[i : i + step], ends[i : i + step]
            n = b - a
            begin = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(begin, n)
            symbol = text[np.repeat(a, n) + inside].astype(np.uint64)
            out[i : i + step] = np.add.reduceat(mixed(symbol * np.uint64(0x9E3779B97F4A7C15) + inside.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), begin)
    return out


def _sorted_suffixes(string: np.ndarray, symbols: int, cap: int, in_memory: int) -> np.ndarray:
    """The suffixes of a string of names with a unique smallest end, sorted at least by what makes up the first `cap` symbols."""
    if symbols <= INDUCED_NAMES:
        is_s = _types(string)
        seeds = _seeds(string, is_s, symbols, cap, in_memory)
        blocks = [at for at, _ in _induce(string, is_s, seeds, np.zeros(len(seeds), np.int16), symbols, 0, in_memory)]
        return np.concatenate(blocks)[::-1]
    # Doubling, on groups of equal names only. A name stands for two symbols at least, so enough doublings reach the cap.
    n, step = len(string), 1
    order = np.argsort(string, kind="stable")
    heads = np.concatenate([[True], np.diff(string[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    open_ = np.flatnonzero(~(heads & np.concatenate([heads[1:], [True]])))
    while len(open_) and not (cap and 2 * step >= cap):
        some = order[open_]
        ahead = some + step
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[open_] = some
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = open_[np.maximum.accumulate(np.where(heads, np.arange(len(some)), 0))]
        open_ = open_[~(heads & np.concatenate([heads[1:], [True]]))]
        step *= 2
    return order


def sorted_with_prefixes(text: np.ndarray, symbols: int, cap: int, in_memory: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, common prefix with the position before it), from the largest suffix to the smallest.

    `text` ends in its only 0. Common prefixes are exact up to `cap`, and suffixes
    that share that many symbols stand together, in any order.
    """
    if len(text) == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int16)
        return
    is_s = _types(text)
    seeds = _seeds(text, is_s, symbols, cap, in_memory)
    lcp = np.zeros(len(seeds), np.int16)
    lcp[1:] = common_prefix(text, seeds[:-1], seeds[1:], cap)
    yield from _induce(text, is_s, seeds, lcp, symbols, cap, in_memory)
