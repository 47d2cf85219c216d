"""From raw documents to packed training sequences, one operator after the other.

Every stage but the last returns the columns of its input, whatever they are
called. A document is known by its id and its text together, so rows without an
id, or ids used twice, lose nothing. Of rows that repeat id and text one stays,
in the stage of exact dedup. The mixing stage reads every source at least once as
a whole; small sources repeat, so documents may come out more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapulse.llm import exact, mixing, near, packing, quality, simhash
from terrapulse.llm.common import cut
from terrapulse.llm.queries import tokenizer_file


def _whole(docs: DataFrame, **keys: Column) -> DataFrame:
    """The whole row in one column, beside the keys: no name of the input can clash with theirs."""
    return docs.select(F.struct("*").alias("row"), *[column.alias(name) for name, column in keys.items()])


def _key() -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules, trained on the labelled rows of what comes in; rejected documents go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = _whole(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    return quality.judged(rows, model, payload=("row",)).where("kept").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the smallest id stays."""
    same = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    kept = exact.deduplicate(docs).where("kept").select(same.alias("id"), "text_sha256")
    rows = _whole(docs, id=same, text_sha256=F.sha2(exact.normalised(F.col("text")), 256))
    # Spark ranks before the shuffle too, so repeated rows never gather.
    first = F.row_number().over(Window.partitionBy("id", "text_sha256").orderBy("id"))
    return rows.withColumn("n", first).where("n = 1").join(kept, ["id", "text_sha256"], "left_semi").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near dedup of texts that share 0.8 of their five-word shingles: SimHash groups (op8) are compared exactly first, then what lies beyond its radius.

    Of each component the row with the smallest id stays; rows without an id come
    last. Of equal rows one stays.
    """
    keyed = docs.select("doc_id", "text", _key().alias("key"))
    linked = simhash.near_duplicates(keyed, payload=("key",)).select("key", F.col("root").alias("joined"))
    found = near.near_duplicates(keyed, linked=linked)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    winners = found.groupBy("root").agg(F.min(order).alias("first")).select("first.key")
    # Spark ranks before the shuffle too, so repeated rows never gather.
    one = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    rows = _whole(docs, key=_key()).join(winners, "key", "left_semi")
    return rows.withColumn("n", one).where("n = 1").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights: each document as often as its source's budget reads it.

    Rows that agree in id, source and text are read some times in all; each comes
    out as often as the others, and what is left over comes from one of them.
    """
    key = F.md5(F.concat(_key(), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))))
    keyed = docs.select("doc_id", "source", "text", key.alias("key"))
    rows_of = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    times = mixing.mixed(keyed, keep=("key",)).groupBy("key").agg(F.count(F.lit(1)).alias("t")).join(rows_of, "key")
    times = cut(times.select("key", F.expr("cast(t div k as int)").alias("each"), F.expr("cast(t % k as int)").alias("over")))
    rows = _whole(docs, key=key).join(times, "key")
    again = rows.where("each > 0").withColumn("time", F.explode(F.sequence(F.lit(1), "each"))).select("row.*")
    if times.where("over > 0").isEmpty():
        return again
    one = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    over = rows.where("over > 0").withColumn("n", one).where("n = 1").withColumn("time", F.explode(F.sequence(F.lit(1), "over")))
    return again.unionByName(over.select("row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", accept),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: A trained classifier, hashes and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents in `sf_dir`. Each stage's rows are cut off before the next one reads them several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
