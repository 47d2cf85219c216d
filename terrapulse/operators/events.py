"""Events inferred from the observations of an entity in two snapshots.

A snapshot is labelled with the first day of a month and covers the month before.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapulse.constants import (
    BUSINESS,
    FIRST_SEEN,
    HIGH,
    LOW,
    MEDIUM,
    OPENED,
    PERMIT_SOURCE,
    RECLASSIFIED,
    VANISHED,
)
from terrapulse.functions.ids import key_id
from terrapulse.functions.months import as_date, month_start, shift_month
from terrapulse.operators.categories import resolve_category
from terrapulse.sources.tables import of_snapshots

# What the rules need of an observation; nested pruning reads no other attribute.
_FACTS = {
    "observacao_id": "observacao_id",
    "territorio_id": "atributos.territorio_id",
    "cnae_principal": "atributos.cnae_principal",
    "inicio_atividade": "atributos.inicio_atividade",
}


def _facts() -> Column:
    return F.struct(*[F.col(path).alias(name) for name, path in _FACTS.items()])


def snapshot_pairs(
    observations: DataFrame,
    previous: Column | dt.date | str,
    current: Column | dt.date | str,
    source: str = PERMIT_SOURCE,
) -> DataFrame:
    """One row per entity seen in either snapshot: `anterior` and `atual`, one of which may be null.

    Each side reads its own date partition and is shuffled once by entity. An
    entity has one row per snapshot, so no key is hot.
    """

    def at(day: Column | dt.date | str, name: str) -> DataFrame:
        return of_snapshots(observations, day, source=source).select(
            "entidade_id", _facts().alias(name)
        )

    return (
        at(previous, "anterior")
        .join(at(current, "atual"), "entidade_id", "full")
        .withColumn("data_evento", as_date(current))
    )


def opened_in_covered_month(start: Column, snapshot: Column) -> Column:
    """Whether a start date (ISO text) lies in the month the snapshot covers."""
    return F.coalesce(month_start(F.try_to_date(start)) == shift_month(snapshot, -1), F.lit(False))


def event_type(before: Column, after: Column, snapshot: Column) -> Column:
    """The event of a pair, or null. A pair gives at most one."""
    old, new = before["cnae_principal"], after["cnae_principal"]
    first_seen = F.when(
        opened_in_covered_month(after["inicio_atividade"], snapshot), OPENED
    ).otherwise(FIRST_SEEN)
    return (
        F.when(after.isNull(), VANISHED)
        .when(before.isNull(), first_seen)
        .when((old != "") & (new != "") & (old != new), RECLASSIFIED)
    )


def confidence(kind: Column) -> Column:
    return F.when(kind == OPENED, HIGH).when(kind == RECLASSIFIED, MEDIUM).otherwise(LOW)


def to_events(pairs: DataFrame, code_map: DataFrame, entity_type: str = BUSINESS) -> DataFrame:
    """Events of snapshot pairs (`entidade_id`, `anterior`, `atual`, `data_evento`).

    Territory and category come from the current observation, or from the last
    known one when the entity vanished.
    """
    before, after, kind = F.col("anterior"), F.col("atual"), F.col("event_type")
    known = F.coalesce(after, before)
    events = pairs.withColumn("event_type", event_type(before, after, F.col("data_evento"))).filter(
        kind.isNotNull()
    )
    events = resolve_category(events, code_map, known["cnae_principal"])
    changed = F.when(
        kind == RECLASSIFIED,
        F.create_map(
            F.lit("cnae_anterior"), before["cnae_principal"],
            F.lit("cnae_atual"), after["cnae_principal"],
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return events.select(
        key_id("entidade_id", "event_type", "data_evento").alias("evento_id"),
        F.lit(entity_type).alias("entity_type"),
        "event_type",
        "entidade_id",
        known["territorio_id"].alias("territorio_id"),
        "data_evento",
        confidence(kind).alias("confianca"),
        F.when(kind == RECLASSIFIED, F.array(before["observacao_id"], after["observacao_id"]))
        .otherwise(F.array(known["observacao_id"]))
        .alias("origem_observacoes"),
        with_category(changed, F.col("categoria_id")).alias("payload"),
    )


def with_category(payload: Column, category: Column) -> Column:
    """Adds `categoria_id` to a payload when it is resolved."""
    return F.when(
        category.isNotNull(), F.map_concat(payload, F.create_map(F.lit("categoria_id"), category))
    ).otherwise(payload)


def detect_events(
    observations: DataFrame,
    code_map: DataFrame,
    previous: Column | dt.date | str,
    current: Column | dt.date | str,
    *,
    source: str = PERMIT_SOURCE,
    entity_type: str = BUSINESS,
) -> DataFrame:
    """Events between two snapshots."""
    return to_events(snapshot_pairs(observations, previous, current, source), code_map, entity_type)


def snapshot_calendar(observations: DataFrame, source: str = PERMIT_SOURCE) -> DataFrame:
    """Each snapshot date with its neighbours: as many rows as there are snapshots."""
    dates = observations.filter(F.col("fonte_id") == source).select("observado_em").distinct()
    # One row per snapshot date, so this unpartitioned window stays as short as the calendar.
    order = Window.orderBy("observado_em")
    return dates.select(
        "observado_em",
        F.lag("observado_em").over(order).alias("_previous"),
        F.lead("observado_em").over(order).alias("_next"),
    )


def all_snapshot_pairs(observations: DataFrame, source: str = PERMIT_SOURCE) -> DataFrame:
    """The pairs of every two consecutive snapshots, from one shuffle by entity.

    Each observation looks at its neighbours in time: it is the current side of
    the pair that ends at its date, and the previous side of the next pair when
    the entity is missing there. An entity has one row per snapshot at most.
    """
    seen = observations.filter(F.col("fonte_id") == source).select(
        "entidade_id", "observado_em", _facts().alias("_facts")
    )
    timeline = Window.partitionBy("entidade_id").orderBy("observado_em")
    # At most one row per calendar date: small whatever the number of observations.
    calendar = F.broadcast(snapshot_calendar(observations, source))
    placed = seen.join(calendar, "observado_em").select(
        "entidade_id",
        "observado_em",
        "_facts",
        "_previous",
        "_next",
        F.when(F.lag("observado_em").over(timeline) == F.col("_previous"), F.lag("_facts").over(timeline)).alias(
            "_before"
        ),
        F.coalesce(F.lead("observado_em").over(timeline) == F.col("_next"), F.lit(False)).alias("_stays"),
    )
    nothing = F.lit(None).cast(placed.schema["_facts"].dataType)
    as_current = F.when(
        F.col("_previous").isNotNull(),
        F.struct(
            F.col("_before").alias("anterior"),
            F.col("_facts").alias("atual"),
            F.col("observado_em").alias("data_evento"),
        ),
    )
    as_vanished = F.when(
        F.col("_next").isNotNull() & ~F.col("_stays"),
        F.struct(
            F.col("_facts").alias("anterior"),
            nothing.alias("atual"),
            F.col("_next").alias("data_evento"),
        ),
    )
    return placed.select(
        "entidade_id", F.inline(F.array_compact(F.array(as_current, as_vanished)))
    )


def detect_all_events(
    observations: DataFrame,
    code_map: DataFrame,
    *,
    source: str = PERMIT_SOURCE,
    entity_type: str = BUSINESS,
) -> DataFrame:
    """Events of every consecutive pair of snapshots."""
    return to_events(all_snapshot_pairs(observations, source), code_map, entity_type)


def event_type_histogram(events: DataFrame) -> DataFrame:
    """Events per type, most common first."""
    return (
        events.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "event_type")
    )
