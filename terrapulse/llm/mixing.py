"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame functions only.

A source with a share p of the tokens gets the weight p^a over the sum of all.
The exponent a is 1 for the natural mixture and 0 for an even one; it is bisected
to the largest value whose weights reach a target entropy (a part of the entropy
of the even mixture), but not below the smallest value at which no source is read
more than `max_repeats` times. The budget of tokens is split by the weights. A
source is read in blocks: whole permutations of all its documents, while its
budget lasts, then the leading documents of one more permutation.

Without a budget, the smallest one is taken that reads every source at least once
as a whole: nothing is lost, and small sources repeat.

Defined results: null is a source of its own. Tokens are the words of the text
(at least 1); a null text has none and counts 1. Repeated rows, equal ids and null
ids count as documents of their own. An empty table gives no rows, one source
gets weight 1. Columns of the input are carried on; names clash with none, as
the added ones are chosen by the caller's prefix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.llm.common import cut

TARGET_ENTROPY = 0.9
MAX_REPEATS = 4.0
#: The exponent is known to so many decimals; it is rounded up, to the natural side.
DECIMALS = 6
#: Points of an interval that are looked at in one pass over the sources: six halvings.
_POINTS = 63
#: Documents of a block that are ordered in one task, on average.
ORDERED_TOGETHER = 2_000


def words() -> Column:
    """Word count as a token count: the runs of `[^\\x20\\x09-\\x0D]` in the text."""
    return F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))


@dataclass(frozen=True)
class Mixture:
    """The exponent, and a frame of (source, docs, tokens, weight, budget, blocks, rest): whole blocks, and tokens of the last one."""

    exponent: float
    sources: DataFrame


def _bisected(holds, low: float = 0.0, high: float = 1.0) -> float:
    """The largest point of the grid of DECIMALS at which `holds` is true, if it is true up to some point; `low` if nowhere.

    `holds` takes many exponents and answers in one pass.
    """
    unit = 10**DECIMALS
    a, b = round(low * unit), round(high * unit)
    if holds([b / unit])[0]:
        return b / unit
    while b - a > 1:
        points = sorted({a + (b - a) * i // (_POINTS + 1) for i in range(1, _POINTS + 1)} - {a, b})
        good = [p for p, yes in zip(points, holds([p / unit for p in points]), strict=True) if yes]
        bad = [p for p in points if p not in set(good)]
        a, b = max([a, *good]), min([b, *bad])
    return a / unit


def temperature(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> float:
    """The exponent for sources with (tokens). Only a few sums for each pass reach the driver, however many sources there are."""
    n, total, most, least = sources.agg(F.count(F.lit(1)), F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not n or n == 1:
        return 1.0
    share = F.col("tokens") / F.lit(total)

    def even_enough(exponents: list[float]) -> list[bool]:
        sums = [x for a in exponents for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.lit(a) * F.log(share)))]
        row = sources.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        # H = log Z - (1/Z) * sum of p^a log p^a
        return [math.log(row[2 * i]) - row[2 * i + 1] / row[2 * i] >= target_entropy * math.log(n) - 1e-12 for i in range(len(exponents))]

    def too_often(exponents: list[float]) -> list[bool]:
        if budget is None:  # the largest source is read once, the smallest most often
            return [(most / least) ** (1 - a) > max_repeats for a in exponents]
        row = sources.agg(*[F.sum(F.pow(share, F.lit(a))).alias(f"s{i}") for i, a in enumerate(exponents)]).first()
        return [budget * (least / total) ** a / row[i] / least > max_repeats for i, a in enumerate(exponents)]

    wanted = _bisected(even_enough)
    floor = _bisected(too_often)
    # One step above the last exponent that repeats too often; 0 if none does.
    floor = min(1.0, floor + 10**-DECIMALS) if floor or too_often([0.0])[0] else 0.0
    return max(wanted, floor)


def mixture(tokens: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> Mixture:
    """The mixture for rows of (source, tokens)."""
    sources = cut(tokens.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))
    exponent = temperature(sources, target_entropy, max_repeats, budget)
    total, most = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    power = F.pow(F.col("tokens") / F.lit(total or 1), F.lit(exponent))
    scale = sources.agg(F.sum(power)).first()[0] or 1.0
    if budget is None and most:
        # The tokens over the weight of the largest source: the budget at which it is read once. No other source needs more.
        share = F.lit(most) * F.pow(F.col("tokens") / F.lit(most), F.lit(exponent))
    else:
        share = F.lit(budget or 0) * power / F.lit(scale)
    # What is owed is whole tokens; a hair is added so that the largest source's own budget isn't rounded below its size.
    owed = F.floor(share + 1e-6).cast("long")
    frame = sources.select(
        "source", "docs", "tokens", (power / F.lit(scale)).alias("weight"), owed.alias("budget"),
        F.floor(owed / F.col("tokens")).cast("int").alias("blocks"), (owed % F.col("tokens")).alias("rest"),
    )
    return Mixture(exponent, cut(frame))


def mixed(
    docs: DataFrame, tokens: Column | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
    budget: int | None = None, seed: int = 7, prefix: str = "mix_", keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """The mixture's rows: the columns `keep` of `docs` (all by default), then block, place in the block, tokens and weight, with `prefix`.

    A row appears once for each block that reads it. Within a block, documents are
    ordered by the md5 of seed, block and id; of a last, broken block those are
    read whose tokens fit into what is left, counted in that order from the start.
    """
    names = list(keep or docs.columns)
    carried = [F.col(c).alias(f"c_{c}") for c in names]
    counted = F.greatest(F.coalesce(words() if tokens is None else tokens, F.lit(0)), F.lit(1)).cast("long")
    rows = docs.select(*carried, F.col("source").alias("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), counted.alias("tokens"))
    made = mixture(docs.select(F.col("source"), counted.alias("tokens")), target_entropy, max_repeats, budget)
    found = made.sources.withColumnsRenamed({"source": "s", "tokens": "s_tokens"})
    rows = rows.join(found, F.col("source").eqNullSafe(F.col("s")))
    last = F.col("blocks") + (F.col("rest") > 0).cast("int")
    rows = rows.select("*", F.explode(F.when(last > 0, F.sequence(F.lit(1), last))).alias("block"))
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.col("block"), F.col("id")))
    # Buckets are ranges of the order, so many that none is large; hashing deals them evenly.
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / ORDERED_TOGETHER))
    bucket = F.floor(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    group = F.struct(F.coalesce("source", F.lit("")).alias("a"), F.col("source").isNull().alias("b"), "block")
    rows = rows.withColumn("mark", mark).withColumn("bucket", bucket).withColumn("part", group)
    return _within(rows, names, prefix)


def _within(rows: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """Numbers each block and breaks off the last one where its budget ends."""
    keys = ["part", "bucket"]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("tokens").alias("_t"))
    before = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("t0"))
    inside = Window.partitionBy(*keys).orderBy("mark", "id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_i", F.count(F.lit(1)).over(inside)).withColumn("_c", F.sum("tokens").over(inside)).join(starts, keys)
    read = (F.col("block") <= F.col("blocks")) | (F.col("t0") + F.col("_c") <= F.col("rest"))
    return rows.where(read).select(
        *[F.col(f"c_{c}").alias(c) for c in names],
        F.col("block").alias(f"{prefix}block"),
        (F.col("n0") + F.col("_i") - 1).alias(f"{prefix}place"),
        F.col("tokens").alias(f"{prefix}tokens"),
        F.col("weight").alias(f"{prefix}weight"),
    )
