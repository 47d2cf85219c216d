"""Monthly permit files: `;`-separated Latin-1, one file per snapshot month."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.schemas import PERMIT_COLUMNS, strings
from terrapulse.sources.records import records

# File name of a snapshot.
NAME_GLOB = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-01_Alvaras_-_Base_de_Dados.csv"
NAME_PATTERN = r"^\d{4}-\d{2}-01_Alvaras_-_Base_de_Dados\.csv$"
NAME_SEPARATOR = "_Alvaras_"

# A column behind the last named one: filled only by a line with too many fields.
SURPLUS = "_surplus"


def csv_options(multi_line: bool = True) -> dict[str, str]:
    return {
        "sep": ";",
        "encoding": "ISO-8859-1",
        "header": "true",
        "nullValue": "***",
        "quote": '"',
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "mode": "PERMISSIVE",
    }


def snapshot_date(file_name: Column) -> Column:
    """Snapshot month from the file name."""
    return F.to_date(F.substring_index(file_name, NAME_SEPARATOR, 1), "yyyy-MM-dd")


def list_snapshots(spark: SparkSession, directory: str) -> DataFrame:
    """Names and dates of the snapshot files; other files are ignored. Reads no content."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", NAME_GLOB).load(directory).select("path")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), snapshot_date(name).alias("observado_em"))


def latest_snapshot(spark: SparkSession, directory: str) -> str:
    """Name of the newest snapshot file; an error when there is none."""
    newest = list_snapshots(spark, directory).agg(F.max("file_name").alias("n")).first()["n"]
    if newest is None:
        raise FileNotFoundError(f"no permit snapshot in {directory}")
    return newest


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a file; reads its first line only."""
    return tuple(spark.read.options(**csv_options()).csv(path).columns)


def read_permits(
    spark: SparkSession,
    directory: str,
    file_name: str | None = None,
    *,
    every_snapshot: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Raw lines of the newest snapshot, of the named one, or of all snapshots.

    Every column is text and is found by its name in the header; a column the
    file lacks is null. `snapshot_ref`, `observado_em` and the line position come
    from the file. Quoted fields may hold line breaks; a file is read by several
    tasks all the same. `multi_line=False` saves the search for them.
    """
    if every_snapshot:
        # One row per file of the folder; files of one header are one scan.
        paths = [r["path"] for r in list_snapshots(spark, directory).collect()]
    else:
        name = file_name or latest_snapshot(spark, directory)
        if not re.match(NAME_PATTERN, name):
            raise ValueError(f"not a permit snapshot: {name}")
        paths = [f"{directory.rstrip('/')}/{name}"]
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        by_header.setdefault(header(spark, path), []).append(path)
    scan = _record_scan if multi_line else _scan
    scans = [scan(spark, names, files) for names, files in by_header.items()]
    if not scans:
        raise FileNotFoundError(f"no permit snapshot in {directory}")
    return reduce(DataFrame.unionByName, scans)


def _scan(
    spark: SparkSession, names: tuple[str, ...], paths: list[str], multi_line: bool = False
) -> DataFrame:
    """The lines as the CSV source reads them; with `multi_line` a file is one task."""
    lines = (
        spark.read.schema(strings(*[f"`{n}`" for n in names], SURPLUS))
        .options(**csv_options(multi_line))
        .csv(paths)
    )
    return _permit_columns(with_file_position(lines), names)


def _record_scan(spark: SparkSession, names: tuple[str, ...], paths: list[str]) -> DataFrame:
    """The same rows as a whole file gives, from records that several tasks put together."""
    options = {k: v for k, v in csv_options().items() if k not in ("header", "encoding")}
    found = records(spark, paths).where("line > 0")
    fields = F.from_csv("record", strings(*[f"`{n}`" for n in names], SURPLUS), options)
    placed = found.select(
        fields.alias("f"), "path", "line", F.element_at(F.split("path", "/"), -1).alias("name")
    ).select(
        "f.*",
        F.col("path").alias("snapshot_ref"),
        snapshot_date(F.col("name")).alias("observado_em"),
        F.struct("path", F.lit(0).cast("bigint").alias("block"), "line").alias("position"),
    )
    return _permit_columns(placed, names)


def _permit_columns(placed: DataFrame, names: tuple[str, ...]) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in PERMIT_COLUMNS if c not in names}
    return placed.withColumns(missing).select(
        *PERMIT_COLUMNS, SURPLUS, "snapshot_ref", "observado_em", "position"
    )


def with_file_position(lines: DataFrame) -> DataFrame:
    """Adds the snapshot, its date and the place of a line within it, for first-line-wins rules."""
    return lines.select(
        *[c for c in lines.columns],
        F.col("_metadata.file_path").alias("snapshot_ref"),
        snapshot_date(F.col("_metadata.file_name")).alias("observado_em"),
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
    )


def overlong_lines(lines: DataFrame) -> DataFrame:
    """Lines with more fields than the header; a load should stop on them."""
    return lines.filter(F.col(SURPLUS).isNotNull())
