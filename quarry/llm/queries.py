"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import chat, decontam, exact_dedup, langid, near_dup, packing, secrets, sharding, suffix_dedup, token_files
from quarry.llm.common import documents


def tokenizer_path() -> str:
    """The vocabulary that the packing queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_pigeonhole_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(documents(spark, sf_dir))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op9_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(documents(spark, sf_dir), tokenizer_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_probminhash, op3_chat_perspectives, op4_pigeonhole_decontam, op5_crf_langid, op6_secret_ledger, op7_suffix_dedup, op8_cost_packing, op9_bit_packing, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_perspectives": chat.SQL, "op10_exact_dedup": exact_dedup.SQL}
