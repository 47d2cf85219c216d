"""Monthly series: sums, zero-fill, last months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import HISTORY_MONTHS, SPARKLINE_MONTHS
from terrapulse.functions.months import as_date, month_start, shift_month
from terrapulse.operators.counts import coverage, of_category, of_territory

KEYS = ("territorio_id",)


def monthly_sums(counts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One point per key and month: `mes`, `valor`."""
    return counts.groupBy(*keys, "mes").agg(F.sum("contagem").cast("double").alias("valor"))


def opening_series(
    counts: DataFrame, *, territory: str | None = None, category: str | None = None
) -> DataFrame:
    """Monthly openings of one territory or, in the same job, of all of them."""
    return monthly_sums(of_category(of_territory(counts, territory), category))


def zero_fill(
    series: DataFrame,
    reference: Column | dt.date | str,
    months: int = HISTORY_MONTHS,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """A point for each month from `months` before the reference up to it; absent months are 0.0.

    Every key of the series is kept, also one whose points all lie outside.
    """
    ref = as_date(reference)
    first, last = shift_month(ref, -months), month_start(ref)
    spine = (
        series.select(*keys)
        .distinct()
        .select(*keys, F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("mes"))
    )
    points = series.filter(F.col("mes").between(first, last)).select(*keys, "mes", "valor")
    return spine.join(points, [*keys, "mes"], "left").select(
        *keys, "mes", F.coalesce("valor", F.lit(0.0)).alias("valor")
    )


def last_months(
    series: DataFrame, reference: Column | dt.date | str, months: int = SPARKLINE_MONTHS
) -> DataFrame:
    """The points of the last months up to the reference."""
    ref = as_date(reference)
    return series.filter(F.col("mes").between(shift_month(ref, 1 - months), ref))


def sparkline(
    counts: DataFrame,
    reference: Column | dt.date | str,
    *,
    category: str | None = None,
    months: int = SPARKLINE_MONTHS,
) -> DataFrame:
    """Zero-filled openings of the last months for every territory."""
    return last_months(
        zero_fill(opening_series(counts, category=category), reference, HISTORY_MONTHS), reference, months
    )


def as_points(series: DataFrame, keys: tuple[str, ...] = KEYS, out: str = "serie") -> DataFrame:
    """One row per key with its points in month order; only for the few months of a display."""
    return series.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("mes", "valor"))).alias(out)
    )


def default_period(event_counts: DataFrame, today: Column | dt.date | str | None = None) -> DataFrame:
    """The last complete month: the one before the last event month, else the month of `today`. One row."""
    day = F.current_date() if today is None else as_date(today)
    return coverage(event_counts).select(
        F.coalesce(shift_month("mes_fim", -1), month_start(day)).alias("periodo")
    )
