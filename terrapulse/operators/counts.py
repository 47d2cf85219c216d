"""Event counts, start-date counts, and the metrics read from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.constants import (
    BREAKDOWN_LIMIT,
    COUNTED_TYPES,
    NO_CATEGORY,
    NO_TERRITORY,
    OPENING_TYPES,
    PERMIT_SOURCE,
    REPORT_LIMIT,
    REPORTED_TYPES,
    VANISHED,
)
from terrapulse.functions.months import as_date, in_month_range, month_start
from terrapulse.operators.categories import resolve_category, with_category_name, with_territory_name
from terrapulse.operators.latest import START_FIELDS, latest_observations


def event_counts(events: DataFrame, *more: str) -> DataFrame:
    """Counted events by territory, category, month and type (and more columns); nulls form groups."""
    return (
        events.filter(F.col("event_type").isin(*COUNTED_TYPES))
        .groupBy(
            "territorio_id",
            F.col("payload")["categoria_id"].alias("categoria_id"),
            month_start("data_evento").alias("mes"),
            "event_type",
            *more,
        )
        .agg(F.count(F.lit(1)).alias("contagem"))
    )


def _started(observations: DataFrame, source: str) -> DataFrame:
    """Entities with a start date and a territory; the territory is looked at after the dedup."""
    return (
        latest_observations(observations, START_FIELDS, source=source, with_start_date=True)
        .filter(F.col("territorio_id").isNotNull())
        .withColumn("mes", month_start(F.to_date("inicio_atividade")))
    )


def opening_counts_by_code(observations: DataFrame, source: str = PERMIT_SOURCE) -> DataFrame:
    """Start dates by territory, month and raw activity code, each entity once."""
    return (
        _started(observations, source)
        .groupBy("territorio_id", "mes", "cnae_principal")
        .agg(F.count(F.lit(1)).alias("contagem"))
    )


def by_category(counts_by_code: DataFrame, code_map: DataFrame) -> DataFrame:
    """Counts by raw code summed up per category; unresolved codes form the null category."""
    return (
        resolve_category(counts_by_code, code_map, "cnae_principal")
        .groupBy("territorio_id", "categoria_id", "mes")
        .agg(F.sum("contagem").alias("contagem"))
    )


def opening_counts(
    observations: DataFrame, code_map: DataFrame, source: str = PERMIT_SOURCE
) -> DataFrame:
    """Start dates by territory, category and month, each entity once.

    The small code map is joined before grouping, which saves the shuffle that
    grouping by code first would cost.
    """
    return (
        resolve_category(_started(observations, source), code_map, "cnae_principal")
        .groupBy("territorio_id", "categoria_id", "mes")
        .agg(F.count(F.lit(1)).alias("contagem"))
    )


def of_category(counts: DataFrame, category: str | None) -> DataFrame:
    return counts if category is None else counts.filter(F.col("categoria_id") == category)


def of_territory(counts: DataFrame, territory: str | None) -> DataFrame:
    return counts if territory is None else counts.filter(F.col("territorio_id") == territory)


def _opened() -> Column:
    return F.sum(F.when(F.col("event_type").isin(*OPENING_TYPES), F.col("contagem")).otherwise(0))


def _vanished() -> Column:
    return F.sum(F.when(F.col("event_type") == VANISHED, F.col("contagem")).otherwise(0))


def metrics(
    counts: DataFrame,
    *,
    keys: tuple[str, ...] = ("territorio_id",),
    territory: str | None = None,
    category: str | None = None,
    start: Column | dt.date | str | None = None,
    end: Column | dt.date | str | None = None,
) -> DataFrame:
    """Openings, disappearances and their balance by the given keys of the event counts."""
    chosen = counts.filter(
        F.col("event_type").isin(*COUNTED_TYPES) & in_month_range(F.col("mes"), start, end)
    )
    chosen = of_category(of_territory(chosen, territory), category)
    return (
        chosen.groupBy(*keys)
        .agg(_opened().alias("aberturas"), _vanished().alias("desaparecimentos"))
        .withColumn("saldo", F.col("aberturas") - F.col("desaparecimentos"))
    )


def metrics_map(counts: DataFrame, **filters) -> DataFrame:
    """One row per territory over the whole period, in key order with nulls last."""
    return metrics(counts, keys=("territorio_id",), **filters).orderBy(
        F.asc_nulls_last("territorio_id")
    )


def metrics_by_month(counts: DataFrame, **filters) -> DataFrame:
    """One row per territory and month."""
    return metrics(counts, keys=("territorio_id", "mes"), **filters)


def coverage(counts: DataFrame) -> DataFrame:
    """First and last month with events: one row, nulls when there are none."""
    return counts.agg(F.min("mes").alias("mes_inicio"), F.max("mes").alias("mes_fim"))


def category_breakdown(
    counts: DataFrame, territory: str, month: Column | dt.date | str, limit: int = BREAKDOWN_LIMIT
) -> DataFrame:
    """Largest categories of a territory and month; the month has to be a first day."""
    return (
        counts.filter((F.col("territorio_id") == territory) & (F.col("mes") == as_date(month)))
        .groupBy("categoria_id")
        .agg(F.sum("contagem").alias("contagem"))
        .orderBy(F.desc("contagem"), F.asc_nulls_last("categoria_id"))
        .limit(limit)
    )


def map_dataset(territories: DataFrame, by_territory: DataFrame) -> DataFrame:
    """Every territory with its metrics: balance 0 and a flag when it has none."""
    found = by_territory.select(
        "territorio_id", "aberturas", "desaparecimentos", "saldo", F.lit(True).alias("_found")
    )
    return territories.join(found, "territorio_id", "left").select(
        *territories.columns,
        F.coalesce("saldo", F.lit(0).cast("bigint")).alias("saldo"),
        "aberturas",
        "desaparecimentos",
        F.coalesce("_found", F.lit(False)).alias("tem_dado"),
    )


def balance_domain(dataset: DataFrame) -> DataFrame:
    """Smallest and largest balance of a map dataset, and the pair widened to hold 0 for the legend."""
    present = F.when(F.col("tem_dado"), F.col("saldo"))
    low, high = F.min(present), F.max(present)
    return dataset.agg(
        F.coalesce(low, F.lit(-1).cast("bigint")).alias("minimo"),
        F.coalesce(high, F.lit(1).cast("bigint")).alias("maximo"),
        F.least(F.lit(0).cast("bigint"), low).alias("legenda_minimo"),
        F.greatest(F.lit(0).cast("bigint"), high).alias("legenda_maximo"),
    )


def _ranked_names(counts: DataFrame, partition: list[str], name: str, label: str, limit: int) -> DataFrame:
    by_name = counts.groupBy(*partition, F.col(name).alias("nome")).agg(F.sum("contagem").alias("n"))
    order = Window.partitionBy(*partition).orderBy(F.desc("n"), "nome")
    # The row_number filter becomes a per-task limit before the shuffle.
    return (
        by_name.withColumn("posicao", F.row_number().over(order))
        .filter(F.col("posicao") <= limit)
        .select(
            *partition, F.lit(label).alias("grupo"), F.col("posicao").cast("bigint").alias("posicao"), "nome", "n"
        )
    )


def top_report(
    counts: DataFrame,
    territories: DataFrame,
    categories: DataFrame,
    *,
    by_type: bool = True,
    limit: int = REPORT_LIMIT,
) -> DataFrame:
    """Totals with the largest territories and categories, for each reported event type or overall."""
    if by_type:
        counts = counts.filter(F.col("event_type").isin(*REPORTED_TYPES))
    else:
        counts = counts.withColumn("event_type", F.lit("INICIO_ATIVIDADE"))
    # Names are joined to the sums, not to the single counts.
    summed = counts.groupBy("event_type", "territorio_id", "categoria_id").agg(
        F.sum("contagem").alias("contagem")
    )
    named = with_category_name(
        with_territory_name(summed, territories, F.lit(NO_TERRITORY), "bairro"),
        categories,
        NO_CATEGORY,
    )
    key = ["event_type"]
    total = named.groupBy(*key).agg(F.sum("contagem").alias("n"))
    total = total.select(
        *key,
        F.lit("total").alias("grupo"),
        F.lit(1).cast("bigint").alias("posicao"),
        F.lit("total").alias("nome"),
        "n",
    )
    return total.unionByName(_ranked_names(named, key, "bairro", "bairro", limit)).unionByName(
        _ranked_names(named, key, "categoria", "categoria", limit)
    )
