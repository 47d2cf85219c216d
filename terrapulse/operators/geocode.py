"""Reconciliation of two geocoders into one point and confidence per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import (
    AGREEMENT_M,
    AMBIGUOUS,
    BUSINESS,
    CITY,
    EXACT_PRECISION,
    FOUND,
    HIGH,
    LOW,
    MEDIUM,
    NOT_FOUND,
    PERMIT_SOURCE,
    PRIMARY_GEOCODER,
    SAME_PLACE_M,
    SECONDARY_GEOCODER,
    SEVERE_LIMIT,
    SEVERE_M,
    STATE,
)
from terrapulse.functions.geodesy import planar_distance
from terrapulse.functions.text import geocoding_address, number_text
from terrapulse.operators.latest import ADDRESS_FIELDS, latest_observations

LOCATION_COLUMNS = (
    "entidade_id",
    "lat",
    "lon",
    "confianca",
    "fonte_primaria",
    "fonte_secundaria",
    "precisao_geocodebr",
    "distancia_desempate_m",
)


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy("entidade_id").limit(limit)


def pending_first_pass(
    observations: DataFrame,
    entities: DataFrame,
    locations: DataFrame,
    *,
    source: str = PERMIT_SOURCE,
    limit: int | None = None,
) -> DataFrame:
    """Latest address of each business without a location row; missing parts are empty texts.

    The entities still to do are found first, so only their observations are
    grouped; that grouping reuses the partitioning of the join.
    """
    todo = (
        entities.filter(F.col("tipo_entidade") == BUSINESS)
        .select("entidade_id")
        .join(locations.select("entidade_id"), "entidade_id", "left_anti")
    )
    latest = latest_observations(
        observations.join(todo, "entidade_id", "left_semi"), ADDRESS_FIELDS, source=source
    )
    filled = latest.select(
        "entidade_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ADDRESS_FIELDS]
    )
    return _limited(filled, limit)


def geocoder_input(pending: DataFrame) -> DataFrame:
    """Columns the first geocoder reads, with the constant city and state."""
    return pending.select(
        "entidade_id",
        "logradouro",
        "numero",
        "cep",
        F.col("bairro").alias("localidade"),
        F.lit(CITY).alias("municipio"),
        F.lit(STATE).alias("estado"),
    )


def last_result_per_entity(results: DataFrame) -> DataFrame:
    """Several results of one entity: the last line wins."""
    value = F.struct("lat", "lon", "precisao", "tipo_resultado")
    return (
        results.groupBy("entidade_id")
        .agg(F.max_by(value, F.col("position")).alias("_last"))
        .select("entidade_id", "_last.*")
    )


def first_pass_confidence(precision: Column) -> Column:
    """Only an exact house number is final; anything else, or nothing, waits for the second pass."""
    return F.when(precision == EXACT_PRECISION, HIGH).otherwise(LOW)


def needs_second_pass(precision: Column) -> Column:
    return first_pass_confidence(precision) != HIGH


def _whole_point(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def first_pass(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Location rows after the first geocoder; entities without a result stay unresolved."""
    joined = pending.select("entidade_id").join(last_result_per_entity(results), "entidade_id", "left")
    whole = _whole_point(F.col("lat"), F.col("lon"))
    return joined.select(
        "entidade_id",
        F.when(whole, F.col("lat")).alias("lat"),
        F.when(whole, F.col("lon")).alias("lon"),
        first_pass_confidence(F.col("precisao")).alias("confianca"),
        F.lit(PRIMARY_GEOCODER).alias("fonte_primaria"),
        F.lit(None).cast("string").alias("fonte_secundaria"),
        F.col("precisao").alias("precisao_geocodebr"),
        F.lit(None).cast("double").alias("distancia_desempate_m"),
    )


def first_pass_totals(locations: DataFrame) -> DataFrame:
    """How many entities are final and how many wait: one row."""
    return locations.agg(
        F.count_if(~needs_second_pass(F.col("precisao_geocodebr"))).alias("alta"),
        F.count_if(needs_second_pass(F.col("precisao_geocodebr"))).alias("enfileirado"),
    )


def pending_second_pass(
    observations: DataFrame,
    locations: DataFrame,
    *,
    source: str = PERMIT_SOURCE,
    limit: int | None = None,
) -> DataFrame:
    """Low-confidence locations not tried twice yet, with their latest address and first point."""
    waiting = locations.filter(
        (F.col("confianca") == LOW) & F.col("fonte_secundaria").isNull()
    ).select("entidade_id", "lat", "lon", "precisao_geocodebr")
    latest = latest_observations(
        observations.join(waiting.select("entidade_id"), "entidade_id", "left_semi"),
        ADDRESS_FIELDS,
        source=source,
    )
    return _limited(waiting.join(latest, "entidade_id"), limit)


def with_query_address(pending: DataFrame, out: str = "endereco") -> DataFrame:
    return pending.withColumn(out, geocoding_address("logradouro", "numero", "bairro", "cep"))


def resolve_candidates(df: DataFrame, candidates: str = "candidates") -> DataFrame:
    """Adds `status`, `ponto` (lat, lon or null) and `confianca_bruta` from a candidate list.

    None: not found. One, or a second one close to the first: the first is the
    place. A second one elsewhere: ambiguous, no point.
    """
    n = F.coalesce(F.array_size(candidates), F.lit(0))
    first, second = F.get(F.col(candidates), F.lit(0)), F.get(F.col(candidates), F.lit(1))
    point = {
        f"_{axis}{i}": c[axis].cast("double")
        for i, c in ((1, first), (2, second))
        for axis in ("lat", "lon")
    }
    df = df.withColumns({**point, "_n": n, "_best": first}).withColumn(
        "_apart",
        F.when(
            F.col("_n") > 1,
            planar_distance(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2")),
        ),
    )
    known = F.concat(
        F.lit("importance="),
        number_text(F.col("_best")["importance"]),
        F.lit(";type="),
        F.coalesce(F.col("_best")["type"], F.lit("None")),
        F.lit(";"),
    )
    how_many = F.format_string("n_candidatos=%d", F.col("_n"))
    apart = F.concat(how_many, F.format_string(";dist_2o_candidato_m=%.1f", F.col("_apart")))
    same = F.col("_apart") <= SAME_PLACE_M
    status = (
        F.when(F.col("_n") == 0, NOT_FOUND)
        .when((F.col("_n") == 1) | same, FOUND)
        .otherwise(AMBIGUOUS)
    )
    text = F.when(F.col("_n") == 1, F.concat(known, how_many)).when(
        F.col("_n") > 1, F.when(same, F.concat(known, apart)).otherwise(apart)
    )
    point_struct = F.struct(F.col("_lat1").alias("lat"), F.col("_lon1").alias("lon"))
    return (
        df.withColumns({"status": status, "confianca_bruta": text})
        .withColumn("ponto", F.when(F.col("status") == FOUND, point_struct))
        .drop(*point, "_n", "_best", "_apart")
    )


def reconcile(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str) -> DataFrame:
    """Adds `lat`, `lon`, `confianca`, `distancia_desempate_m` from two points, either of which may be missing.

    The second geocoder's point wins when there is one; its distance from the
    first sets the confidence.
    """
    df = df.withColumns(
        {
            "_a": _whole_point(F.col(lat1), F.col(lon1)),
            "_b": _whole_point(F.col(lat2), F.col(lon2)),
        }
    )
    a, b = F.col("_a"), F.col("_b")
    df = df.withColumn(
        "_apart",
        F.when(a & b, planar_distance(F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2))),
    )
    apart = F.col("_apart")
    return (
        df.withColumns(
            {
                "_lat": F.when(b, F.col(lat2)).when(a, F.col(lat1)),
                "_lon": F.when(b, F.col(lon2)).when(a, F.col(lon1)),
                "confianca": F.when(~b, LOW)
                .when(~a, MEDIUM)
                .when(apart <= AGREEMENT_M, HIGH)
                .when(apart <= SEVERE_M, MEDIUM)
                .otherwise(LOW),
                "distancia_desempate_m": apart,
            }
        )
        .withColumns({"lat": F.col("_lat"), "lon": F.col("_lon")})
        .drop("_a", "_b", "_lat", "_lon", "_apart")
    )


def second_pass(pending: DataFrame, candidates: DataFrame, on: str = "entidade_id") -> DataFrame:
    """Location rows after the second geocoder; no candidate list counts as not found."""
    found = resolve_candidates(candidates).select(
        on, F.col("ponto.lat").alias("_lat2"), F.col("ponto.lon").alias("_lon2")
    )
    joined = (
        pending.withColumnsRenamed({"lat": "_lat1", "lon": "_lon1"}).join(found, on, "left")
    )
    return (
        reconcile(joined, "_lat1", "_lon1", "_lat2", "_lon2")
        .withColumns(
            {
                "fonte_primaria": F.lit(PRIMARY_GEOCODER),
                "fonte_secundaria": F.lit(SECONDARY_GEOCODER),
            }
        )
        .select(*LOCATION_COLUMNS)
    )


def confidence_histogram(locations: DataFrame) -> DataFrame:
    return locations.groupBy("confianca").agg(F.count(F.lit(1)).alias("n"))


def severe_disagreements(locations: DataFrame, threshold_m: float = SEVERE_M) -> DataFrame:
    """Entities whose two points lie further apart than the threshold."""
    return locations.filter(F.col("distancia_desempate_m") > threshold_m).select(
        "entidade_id", "distancia_desempate_m"
    )


def largest_disagreements(locations: DataFrame, limit: int = SEVERE_LIMIT) -> DataFrame:
    return (
        severe_disagreements(locations)
        .orderBy(F.desc("distancia_desempate_m"), "entidade_id")
        .limit(limit)
    )
