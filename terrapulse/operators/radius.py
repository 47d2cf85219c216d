"""Radius searches on the WGS 84 ellipsoid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import BUSINESS, MAIN_CONFIDENCES, PERMIT_SOURCE
from terrapulse.functions.geodesy import in_box, place_in_space, within_geodesic_distance
from terrapulse.functions.text import display_address, display_name
from terrapulse.operators.categories import resolve_category
from terrapulse.operators.latest import DISPLAY_FIELDS

_BOX_METRES_PER_DEGREE = 110_500.0


def within_radius(locations: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Locations at most `radius_m` away, with the distance. Boxes are compared before distances."""
    near = locations.filter(
        F.col("lat").isNotNull()
        & F.col("lon").isNotNull()
        & in_box(F.col("lat"), F.col("lon"), lat, lon, radius_m)
    ).withColumns({"_lat0": F.lit(float(lat)), "_lon0": F.lit(float(lon))})
    return within_geodesic_distance(near, "_lat0", "_lon0", "lat", "lon", radius_m).drop(
        "_lat0", "_lon0"
    )


def with_details(
    near: DataFrame, observations: DataFrame, entities: DataFrame, source: str = PERMIT_SOURCE
) -> DataFrame:
    """Adds name, address, code and territory of the latest observation; businesses only.

    The few near entities are joined to the observations before these are
    grouped, so the grouping sees no others.
    """
    businesses = entities.filter(F.col("tipo_entidade") == BUSINESS).select("entidade_id")
    wanted = near.join(businesses, "entidade_id", "left_semi")
    carried = [c for c in wanted.columns if c != "entidade_id"]
    seen = observations.filter(F.col("fonte_id") == source).select(
        "entidade_id",
        F.struct("observado_em", "observacao_id").alias("_at"),
        F.struct(*[F.col(path).alias(name) for name, path in DISPLAY_FIELDS.items()]).alias("_facts"),
    )
    latest = (
        seen.join(wanted, "entidade_id")
        .groupBy("entidade_id")
        .agg(
            F.max_by("_facts", "_at").alias("_facts"),
            *[F.any_value(c).alias(c) for c in carried],
        )
    )
    facts = F.col("_facts")
    return latest.select(
        "entidade_id",
        *carried,
        display_name(facts["nome_fantasia"], facts["nome_empresarial"]).alias("nome"),
        display_address(facts["endereco"], facts["numero"], facts["bairro"]).alias("endereco"),
        facts["cnae_principal"].alias("cnae_principal"),
        facts["territorio_id"].alias("territorio_id"),
    )


def radius_hits(
    locations: DataFrame,
    observations: DataFrame,
    entities: DataFrame,
    code_map: DataFrame,
    *,
    lat: float,
    lon: float,
    radius_m: float,
    category: str | None = None,
) -> DataFrame:
    """All businesses in the radius, of any confidence; the category filter comes first."""
    near = within_radius(
        locations.select("entidade_id", "lat", "lon", "confianca"), lat, lon, radius_m
    )
    hits = resolve_category(with_details(near, observations, entities), code_map, "cnae_principal")
    return hits if category is None else hits.filter(F.col("categoria_id") == category)


def main_hits(hits: DataFrame) -> DataFrame:
    """Hits of high and medium confidence, nearest first."""
    return (
        hits.filter(F.col("confianca").isin(*MAIN_CONFIDENCES))
        .select(
            "entidade_id",
            "nome",
            "endereco",
            "categoria_id",
            "territorio_id",
            "distancia_m",
            "confianca",
            "lat",
            "lon",
        )
        .orderBy("distancia_m", "entidade_id")
    )


def radius_totals(hits: DataFrame, *keys: str) -> DataFrame:
    """Hits counted and hits left out for low confidence, overall or per search point."""
    return hits.groupBy(*keys).agg(*total_columns())


def total_columns() -> list[Column]:
    main = F.col("confianca").isin(*MAIN_CONFIDENCES)
    return [
        F.count_if(main).alias("total"),
        F.count_if(~main).alias("excluidos_baixa_confianca"),
    ]


def _band(lat: Column, height: float) -> Column:
    return F.floor(lat / F.lit(height))


def _cell_width(band: Column, height: float) -> Column:
    """Width in degrees of the cells of a latitude band: about one radius, wider towards the poles."""
    furthest = (F.greatest(F.abs(band), F.abs(band + 1))) * F.lit(height)
    return F.lit(height) / F.greatest(F.cos(F.radians(F.least(furthest, F.lit(90.0)))), F.lit(0.01))


_AXES = ("_px", "_py", "_pz")


def _in_space(df: DataFrame, lat: str, lon: str, mark: str) -> DataFrame:
    axes = place_in_space(F.col(lat), F.col(lon))
    return df.withColumns({f"{axis}{mark}": value for axis, value in zip(_AXES, axes, strict=True)})


# Locations of a grid cell that are compared in one task.
_CELL_ROWS = 20_000


def radius_join(
    locations: DataFrame, points: DataFrame, radius_m: float, *, cell_rows: int = _CELL_ROWS
) -> DataFrame:
    """All (search point, location) pairs at most `radius_m` apart, for many points at once.

    Both sides get grid cells about one radius wide; a point looks into every
    cell its radius reaches, so only locations nearby are compared: on average
    less than four for each pair returned. A cell with more than `cell_rows`
    locations is split into as many parts as it has that many, and points are
    repeated for the parts of such cells only. Straight distances, which are never
    longer, drop candidates before the geodesic formula, nearly all but the pairs returned.
    """
    height = radius_m / _BOX_METRES_PER_DEGREE
    placed = (
        locations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .withColumn("_y", _band(F.col("lat"), height))
        .withColumn("_x", F.floor(F.col("lon") / _cell_width(F.col("_y"), height)))
    )
    crowded = (
        placed.groupBy("_y", "_x").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("_parts")).filter("_parts > 1")
    )
    parts = F.coalesce("_parts", F.lit(1))
    placed = placed.join(crowded, ["_y", "_x"], "left").withColumn(
        "_part", F.pmod(F.xxhash64("entidade_id"), parts).cast("int")
    ).drop("_parts")
    # Dealt by cell over a fixed number of tasks: the rows are few for what is compared, so their size says little of the work.
    spark = locations.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = _in_space(placed, "lat", "lon", "0").repartition(tasks, "_y", "_x", "_part")
    edge = F.abs(F.col("ponto_lat")) + height
    reach = F.when(edge >= 89.0, 180.0).otherwise(
        F.lit(height) / F.cos(F.radians(F.least(edge, F.lit(89.0))))
    )
    searched = _in_space(points, "ponto_lat", "ponto_lon", "1").withColumns({"_centre": _band(F.col("ponto_lat"), height), "_reach": reach})
    searched = searched.withColumn(
        "_y", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col("_centre") + d))
    ).withColumn("_width", _cell_width(F.col("_y"), height))

    def cells(shift: Column) -> Column:
        """Cells reached around the point, moved by whole turns across the date line."""
        centre = F.col("ponto_lon") + shift
        west = F.greatest(centre - F.col("_reach"), F.lit(-180.0))
        east = F.least(centre + F.col("_reach"), F.lit(180.0))
        span = F.sequence(
            F.floor(west / F.col("_width")), F.floor(F.greatest(east, west) / F.col("_width"))
        )
        return F.when(west <= east, span).otherwise(F.array().cast("array<bigint>"))

    turns = F.array(F.lit(0.0), F.lit(-360.0), F.lit(360.0))
    searched = (
        searched.withColumn("_x", F.explode(F.array_distinct(F.flatten(F.transform(turns, cells)))))
        .join(crowded, ["_y", "_x"], "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_centre", "_reach", "_width", "_parts")
    )
    candidates = placed.join(searched, ["_y", "_x", "_part"]).drop("_y", "_x", "_part")
    straight = sum(((F.col(f"{axis}0") - F.col(f"{axis}1")) ** 2 for axis in _AXES), F.lit(0.0))
    # The slack is far above what rounding can do to the coordinates.
    candidates = candidates.filter(straight <= (radius_m + 0.001) ** 2).drop(*[f"{axis}{mark}" for axis in _AXES for mark in "01"])
    return within_geodesic_distance(candidates, "ponto_lat", "ponto_lon", "lat", "lon", radius_m)
