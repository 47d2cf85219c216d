"""Keyed tables in hash buckets, with a manifest for each version.

A version is a manifest: which folder holds each bucket's rows. A merge reads and
writes the buckets that its rows fall into, and publishes a manifest that keeps the
folders of all others, so a load costs what it touches. Readers take the newest
manifest with a `_SUCCESS` mark; a job that fails before leaves the table as it was.

Bucket numbers come from a hash of the key, so a key is in one bucket and buckets are
about even. Their number is set when the table is made and kept in its manifests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.sinks.tables import _child_names, _files, empty

#: Buckets of a new table; a bucket of a table of 100 GB has about 100 MB.
BUCKETS = 1024
#: Versions whose files are kept for readers and for differences between versions.
KEPT_VERSIONS = 4

_MANIFEST, _DATA = "manifest-", "data-"
_COLUMNS = "bucket int, folder string, buckets int"


@dataclass(frozen=True)
class BucketedTable:
    """A table under `path`, one row for each key."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def versions(self) -> list[int]:
        """The complete versions, oldest first."""
        names = [n for n in _child_names(self.spark, self.path) if n.startswith(_MANIFEST)]
        return sorted(int(n.removeprefix(_MANIFEST)) for n in names if "_SUCCESS" in _child_names(self.spark, f"{self.path}/{n}"))

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows, by default of the newest version. At most as many as there are buckets."""
        return {bucket: folder for bucket, folder, _ in self._entries(version)}

    def _entries(self, version: int | None) -> list:
        versions = self.versions()
        if version is None:
            if not versions:
                return []
            version = versions[-1]
        return self.spark.read.schema(_COLUMNS).json(f"{self.path}/{_MANIFEST}{version:08d}").collect()

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, of the chosen buckets only; empty before the first write."""
        folders = [f"{self.path}/{folder}" for bucket, folder in sorted(self.manifest(version).items()) if only is None or bucket in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else empty(self.spark, self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self._count())).cast("int")

    def _count(self) -> int:
        entries = self._entries(None)
        return entries[0]["buckets"] if entries else self.buckets

    def changed(self, old: int, new: int) -> set[int]:
        """The buckets whose rows may differ between two versions."""
        before, after = self.manifest(old), self.manifest(new)
        return {b for b in before.keys() | after.keys() if before.get(b) != after.get(b)}

    def merge(self, new: DataFrame, after: Callable[[DataFrame, DataFrame], DataFrame], sort_by: tuple[str | Column, ...] = ()) -> int:
        """Publishes what `after` makes of the stored rows and the new ones, bucket by bucket; returns the number of touched buckets.

        `after` gets the stored rows of the touched buckets only, and must keep rows in
        their keys. The new rows are read twice: stage them if they are costly.
        """
        bucket = self.bucket()
        # At most one row for each bucket.
        touched = {r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect()}
        if not touched:
            return 0
        used = [int(n.rpartition("-")[2]) for n in _child_names(self.spark, self.path) if n.startswith((_MANIFEST, _DATA))]
        version = max(used, default=0) + 1
        folder = f"{_DATA}{version:08d}"
        columns = self.read(only=set()).columns
        rows = after(self.read(only=touched), new).select(*columns).withColumn("bucket", bucket).hint("rebalance", "bucket")
        if sort_by:
            rows = rows.sortWithinPartitions("bucket", *sort_by)
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written = {int(n.removeprefix("bucket=")) for n in _child_names(self.spark, f"{self.path}/{folder}") if n.startswith("bucket=")}
        kept = {b: f for b, f in self.manifest().items() if b not in touched}
        self._publish(version, kept | {b: f"{folder}/bucket={b}" for b in written})
        return len(touched)

    def _publish(self, version: int, manifest: dict[int, str]) -> None:
        entries = self.spark.createDataFrame([(b, f, self._count()) for b, f in sorted(manifest.items())], _COLUMNS)
        entries.coalesce(1).write.mode("errorifexists").json(f"{self.path}/{_MANIFEST}{version:08d}")
        self._clean()

    def _clean(self) -> None:
        """Old manifests go, and folders that none of the kept ones names."""
        versions = self.versions()
        kept, gone = versions[-KEPT_VERSIONS:], versions[:-KEPT_VERSIONS]
        if not gone:
            return
        named = {f for v in kept for f in self.manifest(v).values()}
        fs, where = _files(self.spark, self.path)
        old = {f for v in gone for f in self.manifest(v).values()} - named
        for folder in sorted(old) + [f"{_MANIFEST}{v:08d}" for v in gone]:
            fs.delete(where.suffix(f"/{folder}"), True)
