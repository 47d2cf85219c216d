"""Reading stored tables back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import PERMIT_SOURCE
from terrapulse.functions.months import as_date


def of_level(territories: DataFrame, level: str | None = None) -> DataFrame:
    """Territories, optionally of one level."""
    return territories if level is None else territories.filter(F.col("nivel") == level)


def of_snapshots(
    observations: DataFrame, *dates: Column | dt.date | str, source: str = PERMIT_SOURCE
) -> DataFrame:
    """Observations of one source at the given snapshot dates (prunes the date partitions)."""
    wanted = [as_date(day) for day in dates]
    return observations.filter((F.col("fonte_id") == source) & F.col("observado_em").isin(*wanted))
