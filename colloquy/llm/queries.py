"""The operators of this package as registered queries over the given tables: name to callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    exact_dedup, filter_audit, language, merkle, mixing, near_dedup, packing, pivot_topk, secrets, sharding, substring, token_counts,
    token_files,
)
from colloquy.llm.common import documents, prepare
from colloquy.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).drop("secrets")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    manifest = token_files.write_ids(documents(spark, sf_dir), folder, public_tokenizers.path(WORD_BPE), end_id=2)
    return token_files.read_ids(manifest, folder)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("key")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = shared_folder(spark, "token-counts")
    return token_counts.count_tokens(documents(spark, sf_dir), cache, public_tokenizers.path(BYTE_BPE))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir)).drop("nth")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_token_files": op2_token_files,
    "op3_sharding": op3_sharding,
    "op4_pivot_topk": op4_pivot_topk,
    "op5_near_dedup": op5_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_substring": op12_substring,
    "op13_merkle": op13_merkle,
}


def queries() -> dict[str, Query]:
    def prepared(query: Query) -> Query:
        return lambda spark, sf_dir: query(prepare(spark), sf_dir)

    return {name: prepared(query) for name, query in QUERIES.items()}
