"""The registered queries: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapulse.llm import dialogues, exact, lexical, licences, mixing, packing, personal, quality, secrets, shards, simhash, suffix_arrays, suffix_trees
from terrapulse.llm.sql import EXACT, LEXICAL, MIXING


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_read(spark, folder, "documents"), tokenizer_file())


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mixed(_read(spark, folder, "documents"), keep=("doc_id", "source"))
    return rows.select(
        "doc_id",
        "source",
        F.col("mix_block").alias("block"),
        F.col("mix_place").alias("place"),
        F.col("mix_tokens").alias("tokens"),
        F.round("mix_weight", 9).alias("weight"),
    )


def op3_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scanned(_read(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.size("licences").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct("licences.family")), ",").alias("families"),
        F.size(F.filter("licences", lambda x: x["confirmed"])).alias("n_confirmed"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["paragraph"], x["family"])), ",").alias("paragraphs"),
    )


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows, slot_map = shards.sharded(_read(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.lit(slot_map.version).alias("map_version"),
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.deduplicate(_read(spark, folder, "documents"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_trees.removal_counts(_read(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    model = quality.train(docs, _read(spark, folder, "labels"))
    return quality.judged(docs, model)


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_arrays.removal_counts(_read(spark, folder, "documents"))


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, folder, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.joined(of("assign", "access", "hex")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    found = personal.find_personal(docs, personal.train(docs))

    def fixed(*kinds: str) -> Column:
        return F.filter("base", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(fixed(kind)).cast("long").alias(f"n_{kind}") for kind in personal.KINDS],
        F.sha2(personal.joined(F.col("base")), 256).alias("base_sha256"),
        personal.joined(F.col("spans")).alias("spans"),
    )


def op12_conversation_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogues.repair(_read(spark, folder, "conversations"))


def op13_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.search(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_license_scans": op3_license_scans,
    "op4_sharding": op4_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_pii": op11_pii,
    "op12_conversation_structure_repair": op12_conversation_structure_repair,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

ORACLES: dict[str, str] = {"op2_source_mixing": MIXING, "op5_exact_dedup": EXACT, "op13_ranked_lexical_search": LEXICAL}
