"""Territory features and their extent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_features(territories: DataFrame) -> DataFrame:
    """One GeoJSON feature per territory as a struct; a missing polygon is a null geometry."""
    geometry = F.when(
        F.col("geometria").isNotNull(),
        F.struct(F.lit("MultiPolygon").alias("type"), F.col("geometria").alias("coordinates")),
    )
    properties = F.struct("territorio_id", "nome", "nivel", "territorio_pai_id", "cidade_id")
    return territories.select(
        "territorio_id",
        F.struct(
            F.lit("Feature").alias("type"),
            geometry.alias("geometry"),
            properties.alias("properties"),
        ).alias("feature"),
    )


def bounds(territories: DataFrame, *keys: str) -> DataFrame:
    """Smallest box around all polygons, overall or per key.

    The extent of a row is reduced inside the row, so no vertex is shuffled.
    """
    points = F.flatten(F.flatten("geometria"))
    rows = territories.filter(F.col("geometria").isNotNull()).select(
        *keys,
        F.transform(points, lambda p: p[0]).alias("_lon"),
        F.transform(points, lambda p: p[1]).alias("_lat"),
    )
    return rows.groupBy(*keys).agg(
        F.min(F.array_min("_lon")).alias("lon_min"),
        F.min(F.array_min("_lat")).alias("lat_min"),
        F.max(F.array_max("_lon")).alias("lon_max"),
        F.max(F.array_max("_lat")).alias("lat_max"),
    )
