"""Landed results of the two geocoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.schemas import strings

RESULT_COLUMNS = ("entidade_id", "lat", "lon", "precisao", "tipo_resultado")
CANDIDATES = (
    "entidade_id string, endereco string, "
    "candidates array<struct<lat:string, lon:string, importance:double, type:string>>"
)


def read_geocoder_results(spark: SparkSession, path: str) -> DataFrame:
    """First-pass results; empty fields are null. `position` keeps the order of the lines."""
    rows = (
        spark.read.schema(strings(*RESULT_COLUMNS))
        .options(header="true", encoding="UTF-8", quote='"', escape='"', emptyValue="", nullValue="")
        .csv(path)
    )
    text = {c: F.nullif(F.col(c), F.lit("")) for c in RESULT_COLUMNS}
    return rows.select(
        "entidade_id",
        text["lat"].cast("double").alias("lat"),
        text["lon"].cast("double").alias("lon"),
        text["precisao"].alias("precisao"),
        text["tipo_resultado"].alias("tipo_resultado"),
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
    )


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Second-pass candidate lists, one JSON line per address, best candidate first."""
    return spark.read.schema(CANDIDATES).json(path)
