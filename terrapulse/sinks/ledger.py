"""What a job has already consumed of a date-partitioned table.

A partition is known by the names of its files, so nothing is opened to find out
what is new: a partition that got more files since is new again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terrapulse.sinks.tables import _child_names, append, read_appended

_SCHEMA = "job string, partition string, files string, at timestamp"


def partitions(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Each partition's value and a digest of its file names. One listing for each partition."""
    out = {}
    for name in _child_names(spark, path):
        if name.startswith(f"{column}="):
            files = sorted(n for n in _child_names(spark, f"{path}/{name}") if not n.startswith(("_", ".")))
            if files:
                out[name.removeprefix(f"{column}=")] = hashlib.md5("\n".join(files).encode()).hexdigest()
    return out


@dataclass(frozen=True)
class Ledger:
    """The consumed partitions of all jobs, in one append-only table."""

    spark: SparkSession
    path: str

    def pending(self, job: str, found: dict[str, str]) -> dict[str, str]:
        """Those of the partitions that the job has not consumed as they are now."""
        rows = read_appended(self.spark, self.path, _SCHEMA).filter(F.col("job") == job)
        newest = rows.groupBy("partition").agg(F.max_by("files", "at").alias("files"))
        known = {r["partition"]: r["files"] for r in newest.collect()}
        return {p: files for p, files in found.items() if known.get(p) != files}

    def record(self, job: str, consumed: dict[str, str]) -> None:
        if consumed:
            rows = self.spark.createDataFrame([(job, p, f) for p, f in sorted(consumed.items())], "job string, partition string, files string")
            append(rows.withColumn("at", F.current_timestamp()).coalesce(1), self.path)
