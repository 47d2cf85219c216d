from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from terrapulse.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Applies column functions to literals: `values(f, a, b)` gives f(a), f(b)."""
    from pyspark.sql import functions as F

    def apply(function, *inputs):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
        return [r["y"] for r in df.orderBy("i").select(function(F.col("x")).alias("y")).collect()]

    return apply
