"""Stored tables on plain parquet.

Append-only tables (observations, events, runs) are date-partitioned and get new
files only. Tables that change are written whole into a new folder next to the
old one, so a job never overwrites what it reads and a failed job leaves the
table as it was: readers take the newest folder with a `_SUCCESS` mark.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terrapulse.session import staged

_VERSION = "version-"


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path itself."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _child_names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _versions(spark: SparkSession, path: str) -> list[str]:
    names = [n for n in _child_names(spark, path) if n.startswith(_VERSION)]
    return sorted(n for n in names if "_SUCCESS" in _child_names(spark, f"{path}/{n}"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only table, empty before its first write."""
    if not any(not n.startswith(("_", ".")) for n in _child_names(spark, path)):
        return empty(spark, schema)
    return spark.read.schema(schema).parquet(path)


def read_current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version of a table, empty before its first write."""
    versions = _versions(spark, path)
    if not versions:
        return empty(spark, schema)
    return spark.read.schema(schema).parquet(f"{path}/{versions[-1]}")


def replace(df: DataFrame, path: str, sort_by: tuple[str, ...] = ()) -> int:
    """Writes the whole table as a new version; returns its number of rows."""
    spark = df.sparkSession
    versions = _versions(spark, path)
    # Higher than any earlier folder, so a folder left by a failed job is never reused.
    used = [int(n.removeprefix(_VERSION)) for n in _child_names(spark, path) if n.startswith(_VERSION)]
    target = f"{path}/{_VERSION}{max(used, default=0) + 1:08d}"
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    df.write.mode("errorifexists").parquet(target)
    # The version before stays for readers that have just opened it; older ones go.
    fs, where = _files(spark, path)
    for old in versions[:-1]:
        fs.delete(where.suffix(f"/{old}"), True)
    return spark.read.parquet(target).count()


def append_once(
    new: DataFrame,
    path: str,
    schema: str,
    keys: tuple[str, ...],
    partition: str,
    only: Iterable[dt.date | str] | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Appends the rows whose key is not stored yet; returns how many there were.

    Rows of `new` have to be unique by key. `only` names the partitions `new`
    can touch, so the stored side reads no others. Rows of partitions that are not
    stored at all are appended as they are; of the others only the keys are compared,
    and whole rows are looked up again for the keys that are missing, if there are
    any: `new` may be read twice, stage it if it is costly. Rows are balanced by
    partition before the write: no swarm of small files, no single huge one. They
    are counted as they are written, so other writers don't change the count.
    `shape` makes the table's rows of those of `new`, which have the partition column
    too: where it widens rows, it runs after they are balanced.
    """
    spark = new.sparkSession
    stored = read_appended(spark, path, schema)
    if only is not None:
        stored = stored.filter(F.col(partition).isin([F.lit(str(v)).cast("date") for v in only]))
    shape = shape or (lambda df: df)
    fresh = shape(new.hint("rebalance", partition))
    # One name for each stored partition.
    days = [unquote(n.partition("=")[2]) for n in _child_names(spark, path) if n.startswith(f"{partition}=")]
    if days:
        known = F.coalesce(F.col(partition).cast("string").isin(days), F.lit(False))
        held = shape(new.filter(known))
        missing = staged(held.select(*keys).join(stored.select(*keys), list(keys), "left_anti").distinct())
        fresh = shape(new.filter(~known).hint("rebalance", partition))
        if not missing.isEmpty():
            # Keys with nulls equal no stored key, but their own row here.
            same = [F.col(f"_new.{k}").eqNullSafe(F.col(f"_missing.{k}")) for k in keys]
            again = held.alias("_new").join(missing.alias("_missing"), same, "left_semi").select(*held.columns)
            fresh = fresh.unionByName(again.hint("rebalance", partition))
    written = Observation()
    fresh.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(partition).parquet(path)
    return written.get["n"]


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
