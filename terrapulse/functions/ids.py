"""Deterministic identifiers: equal input gives an equal id on every retry and re-run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_id(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *parts))
