"""Activity code to category, and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import NO_CATEGORY, NO_TERRITORY
from terrapulse.functions.text import activity_code


def one_category_per_code(code_map: DataFrame) -> DataFrame:
    """A code mapped to several categories keeps one, so joins never multiply rows."""
    return code_map.groupBy("codigo_cnae").agg(F.max("categoria_id").alias("categoria_id"))


def resolve_category(df: DataFrame, code_map: DataFrame, raw_code: Column | str) -> DataFrame:
    """Adds `categoria_id` from a raw activity code; unknown codes keep a null."""
    lookup = one_category_per_code(code_map).withColumnRenamed("codigo_cnae", "_code")
    return df.withColumn("_code", activity_code(raw_code)).join(lookup, "_code", "left").drop("_code")


def with_category_name(
    df: DataFrame, categories: DataFrame, fallback: str = NO_CATEGORY, out: str = "categoria"
) -> DataFrame:
    """Adds the category name, or the fallback."""
    names = categories.select("categoria_id", F.col("nome").alias("_name"))
    return (
        df.join(names, "categoria_id", "left")
        .withColumn(out, F.coalesce("_name", F.lit(fallback)))
        .drop("_name")
    )


def with_territory_name(
    df: DataFrame, territories: DataFrame, fallback: Column | None = None, out: str = "nome"
) -> DataFrame:
    """Adds the territory name, or the fallback; polygons are never read for it."""
    names = territories.select("territorio_id", F.col("nome").alias("_name"))
    missing = F.lit(NO_TERRITORY) if fallback is None else fallback
    return (
        df.join(names, "territorio_id", "left")
        .withColumn(out, F.coalesce("_name", missing))
        .drop("_name")
    )


def listed(categories: DataFrame) -> DataFrame:
    """Categories in name order."""
    return categories.select("categoria_id", "nome").orderBy("nome")
