"""The queries of this subpackage, each over its whole table, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.llm import ann, bpe_codec, filter_audit, hard_negatives, near_dedup, packing, pii, quality, sharding, substring_dedup, token_binary, token_count, toxicity
from narralake.llm.common import id_and_text, load



#: The pipeline's protected runs of repeats, see corpus_pipeline; the query protects none.
STOCK_WORDS = 25


def _vocabulary(name: str) -> str:
    """Path of a public tokenizer file; operators take it as a parameter."""
    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(load(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(id_and_text(load(spark, sf_dir, "documents")), load(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _vocabulary("byte_bpe_50k.json")
    coded = bpe_codec.encode(load(spark, sf_dir, "documents"), name, _vocabulary("byte_bpe_50k.tiktoken"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_files(spark, load(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("byte_bpe_50k.tiktoken"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(load(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(load(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(load(spark, sf_dir, "documents"), k=4, percent=80)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(load(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load(spark, sf_dir, "embeddings"), label=label, every=100, positives=5, negatives=5)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_token_files": op5_token_files,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_near_dedup": op8_near_dedup,
    "op9_packing": op9_packing,
    "op10_ann": op10_ann,
    "op11_pii": op11_pii,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op12_hard_negatives": hard_negatives.SQL, "op13_filter_audit": filter_audit.SQL}
