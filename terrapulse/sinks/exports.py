"""Files for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapulse.operators.geocode import geocoder_input
from terrapulse.operators.territories import as_features


def export_geocoder_input(pending: DataFrame, path: str) -> None:
    """CSV parts with a header, read by the first geocoder."""
    geocoder_input(pending).write.mode("errorifexists").options(
        header="true", encoding="UTF-8", quote='"', escape='"', emptyValue="", nullValue=""
    ).csv(path)


def feature_lines(territories: DataFrame) -> DataFrame:
    """One GeoJSON feature per line; a missing polygon is written as null."""
    return as_features(territories).select(
        F.to_json("feature", {"ignoreNullFields": "false"}).alias("value")
    )


def export_features(territories: DataFrame, path: str) -> None:
    feature_lines(territories).write.mode("errorifexists").text(path)
