"""The registered corpus queries: thin calls of the operators with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aularank.llm import op1_chat, op2_mixing, op3_licences, op4_urls, op5_tokens, op6_sharding, op7_quality, op8_decontaminate, op9_simhash, op10_packing, op11_collocations, op12_toxic, op13_negatives, oracles
from aularank.llm.common import table

CHAT_TOKENIZER = "byte_bpe_50k.json"
COUNT_MODEL = "piece_bpe_32k.model"
SHARDS = 40


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    with open(public_tokenizers.path(CHAT_TOKENIZER), encoding="utf-8") as f:
        formatted = op1_chat.format_turns(turns, f.read())
    return op1_chat.digests(formatted).drop("n_tokens", "n_loss_tokens")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing.score(table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licences.license_scan(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_urls.judge(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_MODEL))


def op6_sharding_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op6_sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op9_simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_collocations.collocations(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op12_toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return scored.select("doc_id", "held_out", "score", "predicted", "n_spans")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


SPARK = {f.__name__: f for f in (op1_chat_formatting, op2_lm_scoring, op3_license_scans, op4_url_filters, op5_token_counts, op6_sharding_bytes, op7_quality_rules,
                                 op8_benchmark_decontamination, op9_simhash_near_dedup, op10_best_fit_packing,
                                 op11_phrase_collocations, op12_toxicity, op13_hard_negatives)}
SQL = {
    "op1_chat_formatting": oracles.CHAT,
    "op4_url_filters": oracles.urls(op4_urls.PATH_RULES, op4_urls.PATTERNS),
    "op8_benchmark_decontamination": oracles.DECONTAMINATION,
    "op11_phrase_collocations": oracles.COLLOCATIONS,
    "op13_hard_negatives": oracles.NEGATIVES,
}
