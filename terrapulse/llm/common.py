"""What the operators share: lineage cuts, joins and numbering that no hot key can stall."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.session import shared_folder
from terrapulse.sinks.tables import _files

#: A key is hot if it has more than one part in so many of all rows. There are at most so many hot keys, whatever the input.
SHARE = 2000

#: `[^\x20\x09-\x0D]+`, as bytes.split() without arguments splits it.
WORD_BREAKS = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder. Removed when nothing refers to them any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """The written tables of an iteration, in a folder of their own below the shared one that goes when the iteration ends.

    The planner knows the sizes of written tables. A checkpoint keeps the estimate
    of its plan, which multiplies from join to join: after some rounds the number
    itself takes the driver's memory and time. What leaves the iteration is `cut`.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4()}"
        self.written = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        fs, where = _files(self.spark, self.folder)
        fs.delete(where, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, from a table."""
        path = f"{self.folder}/{self.written}"
        self.written += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def told(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, int]]:
        """The same rows, from a table, and aggregates of them, taken as they are written; null is 0."""
        seen = Observation()
        kept = self.keep(df.observe(seen, *[F.coalesce(figure, F.lit(0)).alias(name) for name, figure in figures.items()]))
        return kept, {name: seen.get.get(name, 0) for name in figures}


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column's name can clash; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, spread: Column, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of `rows` with the one row of `table` for each key; keys are not null.

    `count` in `table` says how many rows have the key. Keys with more than
    1/SHARE of all `total` rows are dealt over as many parts as they have shares;
    `spread` chooses the part. The list of hot keys has at most SHARE rows and is
    broadcast. It comes from `counts`, a written table of the keys' counts, where
    `table` itself is costly to make.
    """
    most = max(1, total // SHARE)
    parts = F.when(F.col(count) > most, F.ceil(F.col(count) / most)).otherwise(1).cast("int")
    hot = (table if counts is None else counts).where(F.col(count) > most).select(key, parts.alias("_parts"))
    dealt = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int"))
        .drop("_parts")
    )
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [key, "_part"]).drop("_part")


def numbered(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds the gapless number, from 0, of each row in its group, ordered by bucket and then `order`.

    Rows meet in one task only if they share group and bucket. The rest is a
    running sum over the buckets' counts. Group and bucket are not null.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_inner", inner).join(starts, keys).withColumn(name, F.col("_start") + F.col("_inner") - 1).drop("_start", "_inner")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def chunks(n: int, size: int) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (the one of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
