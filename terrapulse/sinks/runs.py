"""Run audit: one row per run, also for a run that fails."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from terrapulse.constants import RUN_FAILED, RUN_OK
from terrapulse.schemas import RUN
from terrapulse.sinks.tables import append


@dataclass
class Run:
    read: int = 0
    written: int = 0
    failed: int = 0


@contextmanager
def audited(spark: SparkSession, path: str, job: str) -> Iterator[Run]:
    """Times a run and appends its row; an error is recorded and raised again."""
    run, started = Run(), dt.datetime.now(dt.timezone.utc)

    def record(status: str) -> None:
        row = (
            str(uuid.uuid4()), job, started, dt.datetime.now(dt.timezone.utc), status,
            run.read, run.written, run.failed,
        )
        append(spark.createDataFrame([row], RUN).coalesce(1), path)

    try:
        yield run
    except Exception:
        record(RUN_FAILED)
        raise
    record(RUN_OK)
