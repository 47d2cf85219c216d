"""Records of quoted text files, whose fields may hold line breaks, by several tasks a file.

Files are read line by line in byte ranges. A line with an odd number of quotes opens
or closes a quoted field; counts of lines and odd lines by range, summed up over the
ranges before, number all lines of a file and pair the odd ones. Only the lines of
such pairs are gathered into records, all others are records of their own.

A quote that is no delimiter has to be doubled within a quoted field, as the files'
format wants it. A field that is never closed takes the rest of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.session import staged


def _lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """(path, block, id, odd, value), staged: ranges and ids are given once."""
    text = F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(paths)
    return staged(
        lines.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
            (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).bitwiseAND(1).alias("odd"),
            text.alias("value"),
        )
    )


def records(spark: SparkSession, paths: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, line, record): the number of a record's first line, from 0, and its text without the last line break."""
    lines = _lines(spark, paths, encoding)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    # One row for each range that is read.
    ranges = (
        lines.groupBy("path", "block")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("odd").alias("odds"))
        .select(
            "path", "block", "first",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"),
            F.coalesce(F.sum("odds").over(before), F.lit(0)).alias("odds_before"),
            (F.sum("n").over(whole) - 1).alias("last"),
        )
    )
    numbered = lines.join(ranges, ["path", "block"]).withColumn("line", F.col("lines_before") + F.col("id") - F.col("first"))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("id"))
    odd = numbered.where("odd = 1").select("path", "line", "last", (F.col("odds_before") + inside - 1).alias("rank"))
    pairs = odd.groupBy("path", F.floor(F.col("rank") / 2).alias("pair")).agg(
        F.min("line").alias("record"), F.when(F.count(F.lit(1)) == 2, F.max("line")).otherwise(F.max("last")).alias("end")
    )
    members = pairs.select("path", "record", F.explode(F.sequence("record", "end")).alias("line"))
    numbered = numbered.select("path", "line", "value")
    parts = F.array_sort(F.collect_list(F.struct("line", "value")))
    long = numbered.join(members, ["path", "line"]).groupBy("path", "record").agg(parts.alias("parts"))
    long = long.select("path", F.col("record").alias("line"), F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    short = numbered.join(members.select("path", "line"), ["path", "line"], "left_anti")
    both = short.select("path", "line", F.col("value").alias("record")).unionByName(long)
    return both.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")
