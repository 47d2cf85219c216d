"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables and checkpoints, `spark.checkpoint.dir` of the session.

    Only a local session without that setting gets a temporary folder; a cluster
    has to name one that all executors reach.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="terrapulse-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the shared folder.

    Cuts the lineage where several steps read one expensive result: the result
    survives lost executors, and each step reads only the columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    cores = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("terrapulse")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
