"""One registered query for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .chat_quotes import link_quotes
from .collocations import collocations
from .decontaminate import find_contamination
from .jaccard_join import jaccard_join
from .language_model import score, train, training_split
from .mixing import weighted_fair_mix
from .order_minhash import edited_fingerprints
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .sharding import assign_shards
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .whitening import whiten

SHARDS = 40


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "n_spans"
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir), percent=90, shingle=3).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir), most_documents=100, most_of_host=0.1, shared_documents=10).drop("key", "removed")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir), keep_first=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


def op6_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(_documents(spark, sf_dir), benchmark).select(
        "doc_id", "item_id", "start", "n_aligned", "n_equal", "item_words"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_documents(spark, sf_dir).select("doc_id", "text"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = training_split(_documents(spark, sf_dir).select("doc_id", "text"))
    model = train(docs.where("not held_out"))
    scored = score(docs, model)
    return training_split(scored).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return weighted_fair_mix(docs, keep_text=False).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "virtual_finish"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_chat_quotes": op6_chat_quotes,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_language_model": op9_language_model,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_order_minhash": op12_order_minhash,
    "op13_whitening": op13_whitening,
}

# the others draw by hash, learn models, or sum checksums and logarithms: see tests/llm
SQL: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op2_ngram_jaccard_join": oracles.OP2,
    "op3_quality_rules": oracles.OP3,
    "op5_suffix_dedup": oracles.OP5,
    "op11_collocations": oracles.OP11,
}
