"""The public queries over the stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import (
    AMBIGUOUS,
    BREAKDOWN_LIMIT,
    MAX_RADIUS_M,
    MIN_ADDRESS_LENGTH,
    NEEDS_TERRITORY,
    NEIGHBOURHOOD,
    NOT_FOUND,
    RANKING_LIMIT,
    UNKNOWN_NAME,
)
from terrapulse.functions.months import as_date
from terrapulse.functions.text import complete_search_text
from terrapulse.operators.categories import listed, with_category_name, with_territory_name
from terrapulse.operators.counts import (
    balance_domain,
    category_breakdown,
    coverage,
    map_dataset,
    metrics_by_month,
    metrics_map,
)
from terrapulse.operators.geocode import resolve_candidates
from terrapulse.operators.indicators import (
    balance_indicators,
    indicators_for_months,
    opening_indicators,
)
from terrapulse.operators.radius import main_hits, radius_hits, radius_totals
from terrapulse.operators.ranking import growth_ranking, position_of, ranking_items
from terrapulse.operators.series import as_points, default_period, sparkline
from terrapulse.operators.territories import as_features
from terrapulse.sources.tables import of_level

Day = Column | dt.date | str


def territory_features(territories: DataFrame) -> DataFrame:
    """Neighbourhoods as GeoJSON features."""
    return as_features(of_level(territories, NEIGHBOURHOOD)).select("feature.*")


def category_list(categories: DataFrame) -> DataFrame:
    return listed(categories)


def event_coverage(event_counts: DataFrame) -> DataFrame:
    return coverage(event_counts)


def _period(event_counts: DataFrame, period: Day | None) -> Column:
    """The reference month: the one asked for, else the last complete one."""
    return default_period(event_counts).scalar() if period is None else as_date(period)


def commerce_metrics(
    event_counts: DataFrame,
    opening_counts: DataFrame,
    *,
    territory: str | None = None,
    category: str | None = None,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Without a territory: one row each, for a map. With one: its monthly series with indicators."""
    chosen = {"territory": territory, "category": category, "start": start, "end": end}
    label = F.lit(category).cast("string").alias("categoria_id")
    if territory is None:
        nothing = F.lit(None)
        return metrics_map(event_counts, **chosen).select(
            "territorio_id",
            label,
            nothing.cast("date").alias("mes"),
            "aberturas",
            "desaparecimentos",
            "saldo",
            nothing.cast("double").alias("baseline"),
            nothing.cast("double").alias("variacao_pct"),
            nothing.cast("string").alias("tendencia"),
            F.lit(NEEDS_TERRITORY).alias("motivo_indisponivel"),
        )
    by_month = metrics_by_month(event_counts, **chosen)
    return (
        with_month_indicators(by_month, event_counts, opening_counts, category=category)
        .withColumn("categoria_id", F.lit(category).cast("string"))
        .select(
            "territorio_id", "categoria_id", "mes", "aberturas", "desaparecimentos", "saldo",
            "baseline", "variacao_pct", "tendencia", "motivo_indisponivel",
        )
        .orderBy("territorio_id", "mes")
    )


def with_month_indicators(
    by_month: DataFrame,
    event_counts: DataFrame,
    opening_counts: DataFrame,
    *,
    category: str | None = None,
) -> DataFrame:
    """Monthly metrics with the opening indicators of the same territory and month."""
    requested = by_month.filter(F.col("territorio_id").isNotNull())
    known = opening_counts.join(requested.select("territorio_id"), "territorio_id", "left_semi")
    indicators = indicators_for_months(
        requested, known, default_period(event_counts).scalar(), category=category
    )
    return by_month.join(indicators, ["territorio_id", "mes"], "left")


def commerce_ranking(
    event_counts: DataFrame,
    opening_counts: DataFrame,
    territories: DataFrame,
    *,
    category: str | None = None,
    period: Day | None = None,
    limit: int | None = RANKING_LIMIT,
) -> DataFrame:
    """Growth ranking with names and the last months of each ranked territory."""
    reference = _period(event_counts, period)
    top = growth_ranking(opening_counts, reference, category=category, limit=limit)
    shown = opening_counts.join(top.select("territorio_id"), "territorio_id", "left_semi")
    points = as_points(sparkline(shown, reference, category=category))
    named = with_territory_name(
        top, territories, F.coalesce(F.col("territorio_id"), F.lit(UNKNOWN_NAME))
    )
    return (
        named.join(points, "territorio_id", "left")
        .select(
            "territorio_id", "nome", "valor_atual", "baseline", "variacao_pct", "tendencia",
            "posicao", "total", "serie",
        )
        .orderBy("posicao")
    )


def territory_summary(
    event_counts: DataFrame,
    opening_counts: DataFrame,
    territories: DataFrame,
    *,
    territory: str,
    category: str | None = None,
    period: Day | None = None,
) -> DataFrame:
    """Both indicators and the ranking position of a territory: one row, none when it is unknown."""
    reference = _period(event_counts, period)
    own = territories.filter(F.col("territorio_id") == territory).select("territorio_id", "nome")

    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        kept = ("valor_atual", "baseline", "variacao_pct", "tendencia", "motivo_indisponivel")
        return df.select("territorio_id", *[F.col(c).alias(f"{prefix}_{c}") for c in kept])

    openings = opening_indicators(
        opening_counts, reference, territory=territory, category=category, wanted=own
    )
    balance = balance_indicators(event_counts, territory=territory, category=category, wanted=own)
    position = position_of(ranking_items(opening_counts, reference, category=category), territory)
    return (
        own.withColumn("periodo", reference)
        .join(prefixed(openings, "aberturas"), "territorio_id")
        .join(prefixed(balance, "saldo"), "territorio_id")
        .join(position.withColumn("territorio_id", F.lit(territory)), "territorio_id")
    )


def territory_breakdown(
    event_counts: DataFrame,
    opening_counts: DataFrame,
    categories: DataFrame,
    *,
    territory: str,
    period: Day | None = None,
    limit: int = BREAKDOWN_LIMIT,
) -> DataFrame:
    """Largest categories of the territory in the reference month, with names."""
    top = category_breakdown(opening_counts, territory, _period(event_counts, period), limit)
    return (
        with_category_name(top, categories, out="nome")
        .select("categoria_id", "nome", "contagem")
        .orderBy(F.desc("contagem"), F.asc_nulls_last("categoria_id"))
    )


def territory_profile(
    event_counts: DataFrame,
    opening_counts: DataFrame,
    territories: DataFrame,
    categories: DataFrame,
    *,
    territory: str,
    category: str | None = None,
    period: Day | None = None,
    start: Day | None = None,
    end: Day | None = None,
    limit: int = BREAKDOWN_LIMIT,
) -> DataFrame:
    """The whole profile of a territory in one row: summary, largest categories and the monthly series.

    Start and end narrow the series only. Both lists are short: `limit` categories, one entry per month.
    """
    def listed_as(df: DataFrame, order: str, out: str) -> DataFrame:
        entries = F.struct(*[F.col(c) for c in df.columns if c != "territorio_id"])
        return df.groupBy("territorio_id").agg(F.array_sort(F.collect_list(entries), _by(order)).alias(out))

    summary = territory_summary(
        event_counts, opening_counts, territories, territory=territory, category=category, period=period
    )
    top = territory_breakdown(event_counts, opening_counts, categories, territory=territory, period=period, limit=limit)
    months = commerce_metrics(event_counts, opening_counts, territory=territory, category=category, start=start, end=end)
    return summary.join(
        listed_as(top.withColumn("territorio_id", F.lit(territory)), "contagem", "categorias"), "territorio_id", "left"
    ).join(listed_as(months, "mes", "serie"), "territorio_id", "left")


def _by(field: str) -> Callable[[Column, Column], Column]:
    """Order of list entries: months rise, counts fall and then category ids rise, without an id last."""
    if field == "mes":
        return lambda a, b: F.when(a["mes"] < b["mes"], -1).when(a["mes"] > b["mes"], 1).otherwise(0)
    return lambda a, b: (
        F.when(a["contagem"] > b["contagem"], -1)
        .when(a["contagem"] < b["contagem"], 1)
        .when(a["categoria_id"].isNull(), 1)
        .when(b["categoria_id"].isNull() | (a["categoria_id"] < b["categoria_id"]), -1)
        .otherwise(1)
    )


def search_points(candidate_lists: DataFrame) -> DataFrame:
    """Search addresses with their status and, when found, their point."""
    return resolve_candidates(candidate_lists)


def point_of(candidate_lists: DataFrame) -> tuple[float, float]:
    """Point of a single search address (first row); an error when not found or ambiguous."""
    found = resolve_candidates(candidate_lists).select("status", "ponto").first()
    if found is None or found["status"] == NOT_FOUND:
        raise LookupError("address not found")
    if found["status"] == AMBIGUOUS:
        raise LookupError("ambiguous address: more than one plausible place")
    return found["ponto"]["lat"], found["ponto"]["lon"]


def point_of_address(candidate_lists: DataFrame, address: str) -> tuple[float, float]:
    """Point of a search text among landed lists, which carry the completed text as `endereco`."""
    if len(address) < MIN_ADDRESS_LENGTH:
        raise ValueError(f"address needs {MIN_ADDRESS_LENGTH} characters")
    return point_of(
        candidate_lists.filter(F.col("endereco") == complete_search_text(F.lit(address)))
    )


def radius_search(
    locations: DataFrame,
    observations: DataFrame,
    entities: DataFrame,
    code_map: DataFrame,
    *,
    lat: float,
    lon: float,
    radius_m: float,
    category: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Businesses in the radius by distance, and one row of totals."""
    if not 0 < radius_m <= MAX_RADIUS_M:
        raise ValueError(f"radius must lie in (0, {MAX_RADIUS_M}]")
    hits = radius_hits(
        locations, observations, entities, code_map,
        lat=lat, lon=lon, radius_m=radius_m, category=category,
    )
    return main_hits(hits), radius_totals(hits)


def address_search(
    candidate_lists: DataFrame,
    locations: DataFrame,
    observations: DataFrame,
    entities: DataFrame,
    code_map: DataFrame,
    *,
    address: str,
    radius_m: float,
    category: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The radius search around an address: its businesses and totals, both with the point that was searched.

    The point is fetched first, as only values reach the file filters of the box.
    """
    lat, lon = point_of_address(candidate_lists, address)
    found = radius_search(
        locations, observations, entities, code_map, lat=lat, lon=lon, radius_m=radius_m, category=category
    )
    hits, totals = (df.withColumns({"ponto_lat": F.lit(lat), "ponto_lon": F.lit(lon)}) for df in found)
    return hits, totals


def map_view(
    territories: DataFrame, event_counts: DataFrame, **filters
) -> tuple[DataFrame, DataFrame]:
    """Every neighbourhood with its metrics, and the balance domain for the colours."""
    names = of_level(territories, NEIGHBOURHOOD).select("territorio_id", "nome")
    dataset = map_dataset(names, metrics_map(event_counts, **filters))
    return dataset, balance_domain(dataset)
