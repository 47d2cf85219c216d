"""Growth ranking of territories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.constants import BASELINE_MONTHS, RANKING_LIMIT
from terrapulse.operators.indicators import opening_indicators

RANKING_COLUMNS = (
    "territorio_id",
    "valor_atual",
    "baseline",
    "variacao_pct",
    "tendencia",
    "posicao",
    "total",
)


#: Splitters of the whole order, at most: a power of two. Each part has about one in so many of the rows.
SPLITTERS = 4096


def _order() -> list[Column]:
    return [F.desc("variacao_pct"), F.coalesce("territorio_id", F.lit("")).asc()]


def eligible(items: DataFrame) -> DataFrame:
    """Items that can be ranked: those with a relative change."""
    return items.filter(F.col("variacao_pct").isNotNull())


def ranked(items: DataFrame, limit: int | None = RANKING_LIMIT) -> DataFrame:
    """Position by relative change, ties by territory, and the total taken before the limit.

    A limit of n keeps the first n, a negative limit drops the last ones, and
    None keeps all.
    """
    numbered = numbered_by_change(eligible(items))
    if limit is not None:
        last = F.lit(limit) if limit >= 0 else F.col("total") + limit
        numbered = numbered.filter(F.col("posicao") <= last)
    return numbered


def _place() -> Column:
    """Where a row stands: rises along the order, equal changes by territory."""
    fall = F.when(F.col("variacao_pct") == 0, F.lit(0.0)).otherwise(-F.col("variacao_pct"))
    return F.struct(fall.alias("fall"), F.coalesce("territorio_id", F.lit("")).alias("territory"))


def splitters(items: DataFrame, n: int = SPLITTERS) -> DataFrame:
    """One row with at most n places in order: of the territories with one hash modulo n, the one with the least other hash."""
    picked = items.groupBy(F.pmod(F.xxhash64("territorio_id"), F.lit(n)).alias("_slot")).agg(
        F.min_by(_place(), F.struct(F.xxhash64("territorio_id", F.lit(n)), _place())).alias("_place")
    )
    return picked.agg(F.sort_array(F.collect_list("_place")).alias("_splitters"))


def _part(place: Column, found: Column, n: int) -> Column:
    """How many splitters are not after the place, by halving steps."""
    steps = F.array(*[F.lit(n >> k) for k in range(n.bit_length())])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= F.size(found)) & (F.get(found, at + step - 1) <= place), at + step).otherwise(at),
    )


def parted(items: DataFrame, n: int = SPLITTERS) -> DataFrame:
    """Adds `_part`, which rises along the order and is even over the rows: equal changes are split by territory."""
    found = splitters(items, n).scalar()
    return items.withColumns({"_place": _place(), "_splitters": found}).withColumn("_part", _part(F.col("_place"), F.col("_splitters"), n)).drop("_place", "_splitters")


def numbered_by_change(items: DataFrame) -> DataFrame:
    """Adds `posicao` and `total` for the whole order, without gathering the rows in one task.

    Parts between sampled splitters are numbered apart. A row's position is its
    place in its part plus the rows of the parts before.
    """
    rows = parted(items)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy().orderBy("_part")
    before = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*_order()))
    return (
        rows.withColumn("_inside", inside)
        .join(F.broadcast(before), "_part")
        .withColumn("posicao", (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_inside", "_before")
    )


def position_of(items: DataFrame, territory: str) -> DataFrame:
    """Position of one territory and the total: one row, by counting who is ahead.

    The position is null when the territory cannot be ranked, the total when nobody can.
    """
    chosen = eligible(items)
    own = chosen.filter(F.col("territorio_id") == territory).select(F.max("variacao_pct")).scalar()
    pct, mine = F.col("variacao_pct"), F.col("_own")
    ahead = (pct > mine) | ((pct == mine) & (F.col("territorio_id") < territory))
    return chosen.withColumn("_own", own).agg(
        F.when(F.max("_own").isNotNull(), F.count_if(ahead) + 1).alias("posicao_ranking"),
        F.nullif(F.count(F.lit(1)), F.lit(0)).alias("total_ranking"),
    )


def ranking_items(
    counts: DataFrame, reference: Column | dt.date | str, *, category: str | None = None
) -> DataFrame:
    """Opening indicators of all territories at the reference month.

    Only the baseline window and the reference month are read: a territory
    without openings there has a zero baseline and cannot be ranked.
    """
    return opening_indicators(counts, reference, category=category, history=BASELINE_MONTHS)


def growth_ranking(
    counts: DataFrame,
    reference: Column | dt.date | str,
    *,
    category: str | None = None,
    limit: int | None = RANKING_LIMIT,
) -> DataFrame:
    """Territories by relative growth of openings."""
    return ranked(ranking_items(counts, reference, category=category), limit).select(*RANKING_COLUMNS)
