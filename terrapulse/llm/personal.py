"""Personal data: fixed forms, and spans found by a semi-Markov conditional random field.

Segments are runs of at most MOST tokens with a digit or an at-sign. Features look
at a whole segment: its digits and groups, separators, checksums, borders and the
words before it. A segmentation's score is the sum of its segments' scores, and of
`adjacent` for an entity that follows another one at once; other tokens score 0.
Training maximises the likelihood of whole segmentations by forward-backward sums;
decoding is a dynamic program over segments of bounded length that chooses borders
and types together. As `adjacent` is never positive, segments with a score of at
most 0 can't be part of the best segmentation, so only the others enter it.

The model is trained on WINDOWS short passages of the corpus, those with the
smallest hash, in which fixed forms are the entities, and on as many passages into
which written variants (and look-alikes such as dates, amounts and keys) are put.

A decoded span is added if it overlaps no fixed form and its odds are at least SURE.

Defined results: a null or empty text has no spans. Spans are in code points, end
exclusive; an entity does not cross a line break. Rows are scanned one by one,
repeated ones too; no text is cut. An empty table trains on written passages only.
A null doc_id stays null. Other columns are not read.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import texts

#: The forms that are always reported. A digit run starts only where no digit is before it, which changes no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
#: What the model tells apart: the fixed kinds and national identifiers with their own checks or groups.
TYPES = (*KINDS, "id")

#: Passages of the corpus that training reads, and their characters.
WINDOWS = 400
BEFORE, BEHIND = 60, 90
#: Tokens and characters of an entity.
MOST, MOST_CHARS = 24, 96
#: Characters before a segment in which words are looked for.
CONTEXT = 24
#: Logarithm of the odds from which a decoded span is reported: nine to one.
SURE = 2.2
STEPS = 80

_LISTED = "array<struct<kind:string,start:long,end:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\S\n]+|.", re.DOTALL)
_DIGIT, _MARK = re.compile(r"[0-9]"), re.compile(r"[0-9@]")
_TRIGGER, _OPENED, _DOT = re.compile(r"[0-9@(\[][0-9]*"), re.compile(r"[(\[](?:at|AT)[)\]]"), re.compile(r"\b(?:dot|DOT)\b")
_SPELT = re.compile(r"[A-Za-z0-9._-]+(?:\x20(?:at|AT)\x20|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]+(?:(?:\x20(?:dot|DOT)\x20|\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]+)+")
_WORDS = (
    re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I),
    re.compile(r"\b(?:ip|host|server|client)\b", re.I),
    re.compile(r"\b(?:card|visa|mastercard|credit|amex)\b", re.I),
    re.compile(r"\b(?:phone|tel|call|mobile|fax|dial|cell)\b", re.I),
    re.compile(r"\b(?:ssn|social|iban|account|passport)\b", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text whatever its runs."""
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        # Another at-sign behind this one starts no earlier than behind it.
        at += 1
        last = max(last, at)
        if found:
            yield start, found.end()
            last = at = found.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed forms, by kind as listed, then by place."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    ips, cards = [], []
    if not _DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            ips.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(("card", *m.span()))
    phones = [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []
    return found + ips + cards + phones


NAMES = (
    "bias", "first_digit", "first_letter", "first_plus", "first_bracket", "first_other", "last_digit", "last_letter", "last_other", "joined_before", "joined_behind",
    "sign_before", "sign_behind", "dot_before", "dot_behind", "d0", "d1_5", "d6_7", "d8_9", "d10", "d11_12", "d13_15", "d16", "d17_19", "d20", "luhn", "not_luhn", "luhn_15",
    "no_letters", "one_at", "many_ats", "quad", "not_quad", "address", "spelt", "groups_334", "groups_324", "date", "colon", "comma", "iban", "only_phone", "only_card",
    "phone_10", "exit_code", "trunk", "compact", "word_email", "word_ip", "word_card", "word_phone", "word_id", "own_word",
)


@dataclass
class Tokens:
    """The tokens of a passage and running sums over them."""

    text: str
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    sums: dict[str, np.ndarray]


_PLAIN = {".": "dot", "-": "hyphen", "(": "bracket", ")": "bracket", "+": "plus", "@": "at", ":": "colon", ",": "comma", "\n": "line"}
_CLASSES = ("digit", "letter", "space", "dot", "hyphen", "bracket", "plus", "at", "colon", "comma", "line", "other")
_KIND = {name: i for i, name in enumerate(_CLASSES)}


def tokens(text: str) -> Tokens:
    spans = [m.span() for m in _TOKEN.finditer(text)]
    kinds = []
    for a, _ in spans:
        c = text[a]
        kinds.append(_KIND["digit" if "0" <= c <= "9" else "letter" if c.isalpha() else _PLAIN.get(c) or ("space" if c.isspace() else "other")])
    start, end = np.array(spans, np.int64).reshape(-1, 2).T
    kind, size = np.array(kinds, np.int64), end - start
    sums = {name: np.concatenate([[0], np.cumsum(np.where(kind == i, size if name in ("digit", "letter") else 1, 0))]) for i, name in enumerate(_CLASSES)}
    sums["groups"] = np.concatenate([[0], np.cumsum(kind == 0)])
    words = [text[a:b].lower() if k == 1 else "" for (a, b), k in zip(spans, kinds, strict=True)]
    for word in ("at", "dot"):
        sums[f"word_{word}"] = np.concatenate([[0], np.cumsum([w == word for w in words])])
    # Over all digits of the passage: sums with every other digit doubled, for either phase.
    digits = np.array([ord(c) - 48 for c in text if "0" <= c <= "9"], np.int64)
    twice = np.where(digits > 4, 2 * digits - 9, 2 * digits)
    for phase in (0, 1):
        sums[f"luhn_{phase}"] = np.concatenate([[0], np.cumsum(np.where(np.arange(len(digits)) % 2 == phase, twice, digits))])
    small = np.array([b - a <= 3 and int(text[a:b]) <= 255 if k == 0 else True for (a, b), k in zip(spans, kinds, strict=True)], bool)
    sums["large"] = np.concatenate([[0], np.cumsum(~small)])
    return Tokens(text, start, end, kind, sums)


def _mod97(word: str) -> bool:
    word = "".join(word.split()).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", word)) and int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1


def candidates(t: Tokens, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): segments of tokens i..j-1 that start in [first, last), have a digit or an at-sign (or one in words) and no line break or space at their ends."""
    n = len(t.kind)
    i = np.repeat(np.arange(first, last), MOST)
    j = i + np.tile(np.arange(1, MOST + 1), last - first)
    fits = j <= n
    i, j = i[fits], j[fits]
    s = t.sums
    held = (s["digit"][j] > s["digit"][i]) | (s["at"][j] > s["at"][i]) | ((s["word_at"][j] > s["word_at"][i]) & ((s["word_dot"][j] > s["word_dot"][i]) | (s["bracket"][j] > s["bracket"][i])))
    space = (t.kind == _KIND["space"]) | (t.kind == _KIND["line"])
    fits = held & (s["line"][j] == s["line"][i]) & ~space[i] & ~space[j - 1] & (t.end[j - 1] - t.start[i] <= MOST_CHARS)
    return i[fits], j[fits]


def features(t: Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """One row for each segment, in the order of NAMES."""
    s, n, text = t.sums, len(t.kind), t.text
    c = {name: s[name][j] - s[name][i] for name in (*_CLASSES, "groups", "word_at", "word_dot", "large")}
    kind, size = t.kind, t.end - t.start
    before = np.where(i > 0, kind[np.maximum(i - 1, 0)], -1)
    behind = np.where(j < n, kind[np.minimum(j, n - 1)], -1)
    after = np.where(j + 1 < n, kind[np.minimum(j + 1, n - 1)], -1)
    earlier = np.where(i > 1, kind[np.maximum(i - 2, 0)], -1)
    k = {name: np.int64(v) for name, v in _KIND.items()}
    head, tail, d = kind[i], kind[j - 1], c["digit"]
    odd = (s["digit"][j] - 1) % 2
    # The last digit is not doubled, so the other phase is.
    total = np.where(odd == 0, s["luhn_1"][s["digit"][j]] - s["luhn_1"][s["digit"][i]], s["luhn_0"][s["digit"][j]] - s["luhn_0"][s["digit"][i]])
    valid = (total % 10 == 0) & (d > 0)
    pure = c["other"] + c["colon"] + c["comma"] + c["at"] + c["letter"] == 0
    plain = pure & (c["plus"] + c["dot"] + c["bracket"] == 0)
    quad = pure & (c["groups"] == 4) & (c["dot"] == 3) & (j - i == 7)

    # Sizes of the last three groups of digits, wherever they are.
    groups = np.flatnonzero(kind == 0)
    upto = s["groups"][j]
    sizes = [np.where(c["groups"] > g, size[groups[np.maximum(upto - 1 - g, 0)]] if len(groups) else 0, 0) for g in range(3)]
    shape = sizes[2] * 100 + sizes[1] * 10 + sizes[0]
    joined = lambda x: (x == k["digit"]) | (x == k["letter"])
    sign = lambda x: (x == k["plus"]) | (x == k["hyphen"]) | (x == k["at"]) | (x == k["other"])
    gaps = c["hyphen"] + c["space"] + c["dot"]
    address = (c["at"] == 1) & (c["space"] == 0) & (c["dot"] > 0) & (tail == k["letter"]) & joined(head) & (c["bracket"] + c["comma"] + c["colon"] == 0)
    for x in np.flatnonzero(address).tolist():
        at = text.find("@", t.start[i[x]])
        address[x] = bool(re.fullmatch(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", text[at + 1 : t.end[j[x] - 1]]))
    spelt = (c["word_at"] == 1) & (c["word_dot"] + c["dot"] > 0) & joined(head) & (tail == k["letter"]) & (c["at"] + c["comma"] == 0)
    for x in np.flatnonzero(spelt).tolist():
        spelt[x] = bool(_SPELT.fullmatch(text, t.start[i[x]], t.end[j[x] - 1]))
    iban = (head == k["letter"]) & (size[i] == 2) & (d >= 10) & (c["dot"] + c["hyphen"] + c["other"] == 0)
    for x in np.flatnonzero(iban).tolist():
        iban[x] = _mod97(text[t.start[i[x]] : t.end[j[x] - 1]])
    starts, of = np.unique(i, return_inverse=True)
    seen = np.zeros((len(starts), len(_WORDS)), bool)
    for x, at in enumerate(t.start[starts].tolist()):
        seen[x] = [bool(w.search(text, max(0, at - CONTEXT), at)) for w in _WORDS]
    words = seen[of]
    phone = pure & (d > 6)
    # The first group: an exit code with a country's, or the 1 before an area's.
    lead = np.array([text[a : min(b, a + 2)] if k == 0 else "" for a, b, k in zip(t.start.tolist(), t.end.tolist(), kind.tolist(), strict=True)])
    exit_code, trunk = lead[i] == "00", (lead[i] == "1") & (shape == 334)
    columns = [
        np.ones(len(i), bool), head == k["digit"], head == k["letter"], head == k["plus"], head == k["bracket"], head > k["bracket"], tail == k["digit"], tail == k["letter"], tail > k["space"],
        joined(before), joined(behind), sign(before), sign(behind), (before == k["dot"]) & joined(earlier), (behind == k["dot"]) & joined(after),
        d == 0, (d > 0) & (d < 6), (d == 6) | (d == 7), (d == 8) | (d == 9), d == 10, (d == 11) | (d == 12), (d > 12) & (d < 16), d == 16, (d > 16) & (d < 20), d > 19,
        plain & valid & (d > 15) & (d < 20), plain & ~valid & (d > 15) & (d < 20), plain & valid & (d == 15), c["letter"] == 0, c["at"] == 1, c["at"] > 1,
        quad & (c["large"] == 0), quad & (c["large"] > 0), address, spelt, pure & (shape == 334) & (gaps + c["bracket"] > 1), plain & (shape == 324) & (c["hyphen"] == 2) & (d == 9),
        pure & (d > 5) & (d < 9) & ((shape == 422) | (shape == 224) | (shape == 222)), c["colon"] > 0, c["comma"] > 0, iban, phone, plain & (d > 12), phone & (d == 10) & (shape == 334) & (gaps > 0), phone & exit_code & (size[i] < 6) & (d > 10) & (d < 16) & (gaps > 0), phone & trunk & (d == 11) & (gaps > 2),
        (gaps == 0) & (c["groups"] == 1), *words.T, words.any(axis=1) & phone,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass(frozen=True)
class Field:
    """Weights by feature and type, and what an entity right behind another one adds (never positive)."""

    weights: np.ndarray
    adjacent: float


def _lse(x: np.ndarray, axis) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


_NEVER = -1e6


def likelihood(by_end: np.ndarray, sizes: np.ndarray, adjacent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(log of the sum over segmentations, what leads to a segment that starts at each token, what follows one that ends there, expected adjacent pairs).

    by_end[w, i, l]: the log of the summed scores of the segment of l + 1 tokens from
    i, over its types, in passage w of sizes[w] tokens.
    """
    w, n, most = by_end.shape
    out, own, enter = (np.full((w, n + 1), _NEVER) for _ in range(3))
    out[:, 0] = 0.0
    for j in range(n + 1):
        if j:
            out[:, j] = np.logaddexp(out[:, j - 1], own[:, j - 1])
            starts = np.arange(max(0, j - most), j)
            own[:, j] = _lse(enter[:, starts] + by_end[:, starts, j - starts - 1], 1)
        enter[:, j] = np.logaddexp(out[:, j], own[:, j] + adjacent)
    rows = np.arange(w)
    z = np.logaddexp(out[rows, sizes], own[rows, sizes])
    # Backward: from behind an entity, and from behind another token.
    rest_own, rest_out = np.full((w, n + most + 1), _NEVER), np.full((w, n + most + 1), _NEVER)
    rest_own[rows, sizes] = rest_out[rows, sizes] = 0.0
    pairs = np.zeros(w)
    for i in range(n - 1, -1, -1):
        ahead = _lse(by_end[:, i] + rest_own[:, i + 1 : i + 1 + most], 1)
        inside = i < sizes
        rest_out[:, i] = np.where(inside, np.logaddexp(rest_out[:, i + 1], ahead), rest_out[:, i])
        rest_own[:, i] = np.where(inside, np.logaddexp(rest_out[:, i + 1], ahead + adjacent), rest_own[:, i])
        pairs += np.exp(np.minimum(own[:, i] + adjacent + ahead - z, 0))
    return z, enter, rest_own, float(pairs.sum())


def fit(passages: list[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS, ridge: float = 0.02) -> Field:
    """The field under which the given entities of the passages are likeliest."""
    parsed = [tokens(text) for text, _ in passages]
    sizes = np.array([len(t.kind) for t in parsed])
    place, rows, gold = [], [], []
    for w, (t, (_, spans)) in enumerate(zip(parsed, passages, strict=True)):
        i, j = candidates(t, 0, len(t.kind))
        known = {(a, b): TYPES.index(kind) for kind, a, b in spans}
        place.append(np.stack([np.full(len(i), w), i, j - i - 1], 1))
        rows.append(features(t, i, j))
        gold.append(np.array([known.get((int(a), int(b)), -1) for a, b in zip(t.start[i], t.end[j - 1], strict=True)], np.int64))
    (w, i, l), x, gold = np.concatenate(place).T, np.concatenate(rows), np.concatenate(gold)
    hit = np.zeros((len(gold), len(TYPES)), np.float32)
    hit[np.flatnonzero(gold >= 0), gold[gold >= 0]] = 1
    weights, adjacent = np.zeros((x.shape[1], len(TYPES))), -1.0
    # Named entities that touch do not occur in the passages, so their expected number is what the gradient lowers.
    m, v, ma, va = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    by_end = np.full((len(passages), int(sizes.max()), MOST), _NEVER)
    for step in range(1, steps + 1):
        scores = (x @ weights.astype(np.float32)).astype(np.float64)
        by_end[w, i, l] = _lse(scores, 1)
        z, enter, rest, pairs = likelihood(by_end, sizes, adjacent)
        chance = np.exp(np.minimum(scores + (enter[w, i] + rest[w, i + l + 1] - z[w])[:, None], 0))
        g = (x.T @ (chance.astype(np.float32) - hit)) / len(passages) + ridge / len(passages) * weights
        ga = pairs / len(passages) + ridge / len(passages) * adjacent
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        ma, va = 0.9 * ma + 0.1 * ga, 0.99 * va + 0.01 * ga * ga
        scale = 0.25 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        weights -= scale * m / (np.sqrt(v) + 1e-8)
        adjacent = min(0.0, adjacent - scale * ma / (np.sqrt(va) + 1e-8))
    return Field(weights.astype(np.float32), float(adjacent))


def decoded(t: Tokens, field: Field) -> list[tuple[str, int, int, float]]:
    """(type, start, end, score) of the entities of the best segmentation."""
    found = []
    for first in range(0, len(t.kind), 512):
        i, j = candidates(t, first, min(first + 512, len(t.kind)))
        if len(i):
            score = features(t, i, j) @ field.weights
            y = score.argmax(axis=1)
            best = score[np.arange(len(i)), y]
            good = best > 0
            found += zip(j[good].tolist(), i[good].tolist(), y[good].tolist(), best[good].tolist(), strict=True)
    # The best total before each place where something starts or ends, with and without an entity that ends there.
    found.sort()
    places, total, ended, back = [0], [0.0], [float("-inf")], [None]
    for j, i, y, s in found:
        at = bisect.bisect_right(places, i) - 1
        touching = places[at] == i
        plain = total[at] if not touching else max(x for x in (total[at - 1] if at else 0.0, total[at] + field.adjacent if total[at] == ended[at] else total[at]))
        value = plain + s
        if places[-1] != j:
            places.append(j)
            total.append(total[-1])
            ended.append(float("-inf"))
            back.append(back[-1])
        if value > total[-1]:
            total[-1], ended[-1] = value, value
            before = at - 1 if touching and at and plain == total[at - 1] and total[at] == ended[at] else at
            back[-1] = (i, j, y, s, back[before])
    out, link = [], back[-1]
    while link:
        i, j, y, s, link = link
        out.append((TYPES[y], int(t.start[i]), int(t.end[j - 1]), s))
    return out[::-1]


def islands(text: str) -> list[tuple[int, int]]:
    """The parts of a text in which entities and what their features see can lie."""
    out: list[tuple[int, int]] = []
    reach = MOST_CHARS + CONTEXT + 2
    marks = [m.span() for m in _TRIGGER.finditer(text) if text[m.start()] not in "([" or m.end() > m.start() + 1 or _OPENED.match(text, m.start())]
    if "dot" in text or "DOT" in text:
        marks = sorted([*marks, *(m.span() for m in _DOT.finditer(text))])
    for start, end in marks:
        a, b = max(0, start - reach), min(len(text), end + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def scan(text: str, field: Field, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The fixed forms, given as `base`, and the spans that the field adds."""
    parts = islands(text)
    if not parts:
        return base
    edges = sorted((a, b) for _, a, b in base)
    added = []
    for a, b in parts:
        for kind, start, end, score in decoded(tokens(text[a:b]), field):
            x, y = start + a, end + a
            k = bisect.bisect_left(edges, (y, 0))
            # Forms may lie within each other, so a few before are looked at.
            if score >= SURE and not any(e > x for _, e in edges[max(0, k - 8) : k]):
                added.append((kind, x, y))
    return sorted(base + added, key=lambda s: (TYPES.index(s[0]), s[1], s[2]))


def find_personal(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, spans) of each row's whole text: the fixed forms, and these with what the field adds."""
    carried = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, out = [], []
            for text in batch.column("text"):
                fixed = base_spans(text.as_py())
                for spans, found in ((base, fixed), (out, scan(text.as_py(), carried.value, fixed))):
                    spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            columns = [batch.column("doc_id"), pa.array(base, _SPANS_ARROW), pa.array(out, _SPANS_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "spans"])

    source = texts(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, base {_LISTED}, spans {_LISTED}")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def passages(docs: DataFrame, windows: int = WINDOWS) -> list[str]:
    """At most so many distinct passages around digits and at-signs, those with the smallest hash.

    A count of the distinct passages says below which hash about half as many again
    as are wanted lie; only those come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for text in batch.column("text"):
                text, done = text.as_py(), 0
                while m := _MARK.search(text, done):
                    line = max(text.rfind("\n", max(0, m.start() - BEFORE), m.start()) + 1, m.start() - BEFORE, 0)
                    end = text.find("\n", m.start(), m.start() + BEHIND)
                    done = end if end >= 0 else m.start() + BEHIND
                    found.append(text[line:done])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["passage"])

    found = texts(docs).select("text").mapInArrow(run, "passage string").withColumn("mark", F.xxhash64("passage"))
    n = found.agg(F.approx_count_distinct("mark")).first()[0]
    if n > 2 * windows:
        found = found.where(F.col("mark") < int(-(1 << 63) + (1.5 * windows + 50) / n * (1 << 64)))
    return [p for _, p in sorted((r["mark"], r["passage"]) for r in found.distinct().collect())[:windows]]


def _written(rng: random.Random) -> tuple[str, str | None]:
    """A written entity, or look-alike (of type None). Numbers are drawn anew each time."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    sep = rng.choice(" -.")

    def card(n: int) -> str:
        body = rng.choice("3456") + d(n - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(digits: str, sizes: tuple[int, ...], between: str) -> str:
        cuts = np.cumsum((0, *sizes))
        return between.join(digits[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def iban() -> str:
        body, land = d(18), rng.choice(("DE", "FR", "ES", "IT"))
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        whole = f"{land}{check:02d}{body}"
        return grouped(whole, (4, 4, 4, 4, 4, 2), rng.choice(("", " ")))

    def email() -> tuple[str, str, str]:
        return word() + rng.choice(("", ".", "_")) + rng.choice((word(), d(2))), word(), rng.choice(("com", "org", "net", "de", "fr"))

    user, host, top = email()
    area, line = f"{rng.randint(200, 989)}", f"{rng.randint(200, 989)}{sep}{d(4)}"
    forms: list[tuple[str, str | None]] = [
        (f"{user}@{host}.{top}", "email"), (f"{user} [at] {host} [dot] {top}", "email"), (f"{user} at {host} dot {top}", "email"), (f"{user}(at){host}.{top}", "email"),
        (".".join(str(rng.randint(0, 255)) for _ in range(4)), "ip"), (grouped(card(16), (4, 4, 4, 4), rng.choice(("", " ", "-"))), "card"), (grouped(card(15), (4, 6, 5), rng.choice(" -")), "card"),
        (f"({area}) {line}", "phone"), (f"{area}{sep}{line}", "phone"), (f"+{rng.randint(1, 99)} {area} {line}", "phone"), (f"1{sep}{area}{sep}{line}", "phone"), (f"00{rng.randint(30, 49)} {d(2)} {d(4)} {d(4)}", "phone"),
        (f"{d(3)}-{d(2)}-{d(4)}", "id"), (iban(), "id"),
        (f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", None), (f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1900, 2099)}", None),
        (f"{rng.randint(0, 23)}:{d(2)}:{d(2)}", None), (f"{rng.randint(1, 999)},{d(3)}.{d(2)}", None), (f"v{rng.randint(0, 30)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}", None),
        (d(rng.randint(1, 15)), None), (d(rng.randint(20, 30)), None), (f"#{d(6)}", None), (f"{rng.randint(1900, 1999)}-{rng.randint(2000, 2099)}", None), (f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", None),
        ("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 32, 40)))), None), ("AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), None),
        (f"@{word()}", None), (f"{word()}@{word()}", None), (f"{word()} at {word()} {d(2)}", None), (f"{word()} dot {word()}", None), (f"{rng.randint(1, 99)}.{d(2)} %", None), (f"{d(4)} {d(4)}", None),
        (f"{d(2)}, {d(2)}, {d(3)} and {d(2)}", None), (f"{word()}_{d(4)}_{d(3)}", None), (f"{d(4)}-{d(4)}-{d(4)}", None), (f"{d(3)}.{d(3)}.{d(3)}", None),
    ]
    return rng.choice(forms)


_LEADS = {"email": ("email", "contact", "write to"), "ip": ("host", "from ip", "server"), "card": ("card", "visa"), "phone": ("call", "tel.", "phone:", "fax"), "id": ("ssn", "iban", "account")}


def written(words: list[str], n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Passages of the given words with one or two written entities or look-alikes each."""
    rng, out = random.Random(seed), []
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    while len(out) < n:
        text, spans = prose(), []
        for _ in range(rng.randint(1, 2)):
            form, kind = _written(rng)
            lead = rng.choice(_LEADS[kind or rng.choice(TYPES)]) if rng.random() < (0.35 if kind else 0.1) else ""
            text += " " + (lead + " " if lead else "")
            fixed = base_spans(form)
            if kind is None and fixed and (fixed[0][1], fixed[0][2]) == (0, len(form)):
                kind = fixed[0][0]
            if kind:
                spans.append((kind, len(text), len(text) + len(form)))
            text += form + rng.choice(("", "", ".", ",", ")")) + " " + prose()
        out.append((text, spans))
    return out


_WORDS_OF_NONE = ["the", "and", "was", "sent", "to", "de", "la", "und", "einer", "que", "on", "new", "list", "page", "name"]


def train(docs: DataFrame, windows: int = WINDOWS) -> Field:
    """The field fitted on at most `windows` passages of the corpus and as many with written entities."""
    seen = passages(docs, windows)
    real, words = [], []
    for passage in seen:
        # A window may begin or end within an entity: it is cut at spaces, and left out if its first characters still have digits.
        inner = passage[passage.find(" ") + 1 : passage.rfind(" ")] if passage.count(" ") > 1 else ""
        words += [w for w in inner.split() if w.isalpha()]
        if not inner or re.search(r"[0-9@+]", inner[:20] + inner[-20:]):
            continue
        spans = base_spans(inner)
        edges = sorted((a, b) for _, a, b in spans)
        if all(x[1] <= y[0] for x, y in zip(edges, edges[1:], strict=False)):
            real.append((inner, spans))
    made = written(sorted(set(words)) or _WORDS_OF_NONE, windows, seed=17)
    return fit([p for p in (*real, *made) if p[0]])
