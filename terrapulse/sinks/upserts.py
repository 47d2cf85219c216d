"""What a table looks like after a write. Lazy: the result goes to `replace`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.operators.geocode import LOCATION_COLUMNS


def _now(now: Column | dt.datetime | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now)


def overwritten(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows replace the stored rows of the same key (territories, codes, categories)."""
    kept = existing.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new.select(*existing.columns))


def added(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Stored rows stay; only unknown keys are added (code to category)."""
    unknown = new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(unknown.select(*existing.columns))


def entities_after(
    existing: DataFrame, new: DataFrame, now: Column | dt.datetime | None = None
) -> DataFrame:
    """Entities after a load: a stored id wins, every entity of the load is marked as updated."""
    keys = ["tipo_entidade", "identificador_fonte"]
    incoming = (
        new.dropDuplicates(keys).select(*keys, F.col("entidade_id").alias("_id"), F.lit(True).alias("_in"))
    )
    at = _now(now)
    return existing.join(incoming, keys, "full").select(
        F.coalesce("entidade_id", "_id").alias("entidade_id"),
        *keys,
        F.coalesce("criado_em", at).alias("criado_em"),
        F.when(F.col("_in"), at).otherwise(F.col("atualizado_em")).alias("atualizado_em"),
    )


def locations_after(
    existing: DataFrame, new: DataFrame, now: Column | dt.datetime | None = None
) -> DataFrame:
    """Locations after a pass: all fields are replaced but the first geocoding time.

    The review time is set by a second pass only.
    """
    at = _now(now)
    incoming = new.select(*LOCATION_COLUMNS).join(
        existing.select("entidade_id", "geocodificado_em"), "entidade_id", "left"
    )
    incoming = incoming.withColumns(
        {
            "geocodificado_em": F.coalesce("geocodificado_em", at),
            "revisado_em": F.when(F.col("fonte_secundaria").isNotNull(), at),
        }
    )
    return overwritten(existing, incoming, "entidade_id")
