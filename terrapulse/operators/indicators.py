"""Baseline, trend and the reason an indicator is missing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.constants import (
    ACCELERATING,
    BASELINE_MONTHS,
    HISTORY_MONTHS,
    INCOMPLETE_MONTH,
    MIN_BASELINE_MONTHS,
    MIN_TREND_MONTHS,
    SHORT_HISTORY,
    SLOWING,
    STABLE,
    TREND_THRESHOLD,
    ZERO_BASELINE,
)
from terrapulse.functions.months import as_date, month_index, month_start, shift_month
from terrapulse.operators.counts import coverage, metrics_by_month, of_category, of_territory
from terrapulse.operators.series import KEYS, opening_series

INDICATOR_COLUMNS = (
    "valor_atual",
    "baseline",
    "variacao_pct",
    "motivo_baseline",
    "tendencia",
    "tendencia_pct",
    "motivo_tendencia",
    "motivo_indisponivel",
)
# Month distances to the reference month: recent and previous window of the trend.
_RECENT = (0, 2)
_PREVIOUS = (3, 5)


Pair = tuple[Column, Column]


def _mean(pair: Pair, minimum: int) -> Column:
    """Mean from (number of points, sum), null below the minimum number of points."""
    points, total = pair
    return F.when(points >= minimum, F.try_divide(total, points))


def baseline_change(value: Column, baseline: Column) -> Column:
    """Relative change against the mean of the earlier months."""
    return F.when(baseline != 0, (value - baseline) / baseline)


def trend_change(now: Column, then: Column) -> Column:
    """Relative change between two windows; from zero to zero is no change."""
    return F.when(then != 0, (now - then) / then).when((then == 0) & (now == 0), 0.0)


def trend_label(now: Column, then: Column, threshold: float = TREND_THRESHOLD) -> Column:
    """Label of a trend; null when a window is too thin. Any move away from zero accelerates."""
    change = trend_change(now, then)
    return F.when(
        now.isNotNull() & then.isNotNull(),
        F.when(change.isNull() | (change > threshold), ACCELERATING)
        .when(change < -threshold, SLOWING)
        .otherwise(STABLE),
    )


def _indicators(
    df: DataFrame,
    value: Column,
    baseline: Pair,
    recent: Pair,
    previous: Pair,
    *,
    threshold: float = TREND_THRESHOLD,
    min_baseline: int = MIN_BASELINE_MONTHS,
    min_trend: int = MIN_TREND_MONTHS,
) -> DataFrame:
    """Both indicators from (points, total) pairs.

    Baseline: mean of the earlier months. Trend: mean of the last three months,
    the reference month included, against the three before. One reason for
    display: baseline missing, then trend missing, then percentage missing.
    """
    df = df.withColumns(
        {
            "valor_atual": value,
            "baseline": _mean(baseline, min_baseline),
            "_now": _mean(recent, min_trend),
            "_then": _mean(previous, min_trend),
        }
    )
    base, now, then = F.col("baseline"), F.col("_now"), F.col("_then")
    thin = now.isNull() | then.isNull()
    return df.withColumns(
        {
            "variacao_pct": baseline_change(F.col("valor_atual"), base),
            "motivo_baseline": F.when(base.isNull(), SHORT_HISTORY).when(base == 0, ZERO_BASELINE),
            "tendencia": trend_label(now, then, threshold),
            "tendencia_pct": trend_change(now, then),
            "motivo_tendencia": F.when(thin, SHORT_HISTORY).when(
                trend_change(now, then).isNull(), ZERO_BASELINE
            ),
            "motivo_indisponivel": F.when(base.isNull() | thin, SHORT_HISTORY).when(
                base == 0, ZERO_BASELINE
            ),
        }
    )


def _span_points(span: tuple[int, int], history: int) -> int:
    """Months of a distance span that lie in a series filled `history` months back."""
    return max(0, min(span[1], history) - span[0] + 1)


def indicators_at(
    series: DataFrame,
    reference: Column | dt.date | str,
    *,
    filled: int | None = None,
    window: int = BASELINE_MONTHS,
    keys: tuple[str, ...] = KEYS,
    wanted: DataFrame | None = None,
    **rules,
) -> DataFrame:
    """Indicators of every key at one reference month, from points `mes`, `valor`.

    `filled=None`: only the months that are there count. `filled=n`: the series
    counts as zero-filled `n` months back, so the number of points is known and
    no filler rows are made. `wanted` gives the keys to report, also those
    without a point.

    One grouped aggregation with conditional sums: partial sums are built on the
    map side, so a key with very many rows costs no more than others.
    """
    ref = as_date(reference)
    if filled is not None:
        series = series.filter(F.col("mes").between(shift_month(ref, -filled), month_start(ref)))
    # The reference may be a subquery: as a column it is planned once, not once per use.
    series = series.withColumn("_ref", ref)
    distance = month_index("_ref") - month_index("mes")
    spans = {"_base": (1, window), "_recent": _RECENT, "_previous": _PREVIOUS}
    sums = [F.sum(F.when(F.col("mes") == F.col("_ref"), F.col("valor"))).alias("_value")]
    for name, (low, high) in spans.items():
        inside = distance.between(low, high)
        sums.append(F.sum(F.when(inside, F.col("valor"))).alias(name))
        if filled is None:
            sums.append(F.count_if(inside).alias(f"{name}_n"))
    grouped = series.groupBy(*keys).agg(*sums)
    if wanted is not None:
        grouped = wanted.select(*keys).distinct().join(grouped, list(keys), "left")

    def pair(name: str) -> Pair:
        total = F.coalesce(F.col(name), F.lit(0.0)).cast("double")
        if filled is None:
            return F.coalesce(F.col(f"{name}_n"), F.lit(0)), total
        return F.lit(_span_points(spans[name], filled)), total

    value = F.coalesce(F.col("_value"), F.lit(0.0)).cast("double")
    found = _indicators(grouped, value, pair("_base"), pair("_recent"), pair("_previous"), **rules)
    return found.select(*keys, *INDICATOR_COLUMNS)


def opening_indicators(
    counts: DataFrame,
    reference: Column | dt.date | str,
    *,
    territory: str | None = None,
    category: str | None = None,
    wanted: DataFrame | None = None,
    history: int = HISTORY_MONTHS,
) -> DataFrame:
    """Openings at a month. Absent months are zeros, so the counts need no grouping by month first."""
    chosen = of_category(of_territory(counts, territory), category)
    series = chosen.withColumn("valor", F.col("contagem"))
    return indicators_at(series, reference, filled=history, wanted=wanted)


def balance_indicators(
    event_counts: DataFrame,
    *,
    territory: str | None = None,
    category: str | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Balance of openings and disappearances at the last event month. Absent months are unknown.

    Without any event the reference month is null and every key has a short history.
    """
    last = coverage(event_counts).select("mes_fim").scalar()
    series = metrics_by_month(event_counts, territory=territory, category=category).select(
        "territorio_id", "mes", F.col("saldo").cast("double").alias("valor")
    )
    return indicators_at(series, last, wanted=wanted)


def series_indicators(
    series: DataFrame, *, window: int = BASELINE_MONTHS, keys: tuple[str, ...] = KEYS, **rules
) -> DataFrame:
    """Indicators at every point of a series, by frames of calendar months.

    Only the months that are there count; zero-fill first where absence means zero.
    """
    order = Window.partitionBy(*keys).orderBy(month_index("mes"))

    def pair(low: int, high: int) -> Pair:
        frame = order.rangeBetween(-high, -low)
        total = F.coalesce(F.sum("valor").over(frame), F.lit(0.0))
        return F.count("valor").over(frame), total

    found = _indicators(
        series, F.col("valor"), pair(1, window), pair(*_RECENT), pair(*_PREVIOUS), **rules
    )
    return found.select(*keys, "mes", *INDICATOR_COLUMNS)


def indicators_for_months(
    requested: DataFrame,
    counts: DataFrame,
    complete_until: Column | dt.date | str,
    *,
    category: str | None = None,
    history: int = HISTORY_MONTHS,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Opening indicators for each requested key and month, from one series per key.

    The series counts as zero-filled from `history` months before the last
    requested month of the key up to it. Months after `complete_until` are not
    complete yet. Requested months and counts are summed in one shuffle; the
    windows then see one row per month of a key.
    """
    asked = requested.select(*keys, "mes").withColumns({"valor": F.lit(0.0), "_asked": F.lit(True)})
    known = opening_series(counts, category=category).withColumn("_asked", F.lit(False))
    months = (
        asked.unionByName(known)
        .groupBy(*keys, "mes")
        .agg(F.sum("valor").alias("valor"), F.max("_asked").alias("_asked"))
        .withColumn("_at", month_index("mes"))
    )
    per_key = Window.partitionBy(*keys)
    months = months.withColumn(
        "_start", F.max(F.when(F.col("_asked"), F.col("_at"))).over(per_key) - history
    ).withColumn("valor", F.when(F.col("_at") >= F.col("_start"), F.col("valor")).otherwise(0.0))
    order = per_key.orderBy("_at")
    back = F.col("_at") - F.col("_start")

    def pair(low: int, high: int) -> Pair:
        total = F.coalesce(F.sum("valor").over(order.rangeBetween(-high, -low)), F.lit(0.0))
        points = F.greatest(F.lit(0), F.least(F.lit(high), back) - low + 1)
        return points, total

    found = _indicators(
        months.filter(F.col("_start").isNotNull()),
        F.col("valor"),
        pair(1, BASELINE_MONTHS),
        pair(*_RECENT),
        pair(*_PREVIOUS),
    ).filter("_asked")
    found = found.withColumn("_late", F.col("mes") > as_date(complete_until))
    late = F.col("_late")
    blank = {
        "valor_atual": F.when(late, 0.0).otherwise(F.col("valor_atual")),
        **{
            c: F.when(~late, F.col(c))
            for c in ("baseline", "variacao_pct", "tendencia", "tendencia_pct")
        },
        **{
            c: F.when(late, INCOMPLETE_MONTH).otherwise(F.col(c))
            for c in ("motivo_baseline", "motivo_tendencia", "motivo_indisponivel")
        },
    }
    return found.withColumns(blank).select(*keys, "mes", *INDICATOR_COLUMNS)
