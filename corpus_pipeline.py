"""A training corpus from the table `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps; `run` writes every stage's rows
as Parquet to the shared folder and the next stage reads them from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.decontaminate import decontaminate
from tablewright.llm.jaccard_join import keep_one_of_each
from tablewright.llm.mixing import mixed_documents
from tablewright.llm.quality_rules import apply_quality_rules
from tablewright.llm.sharding import assign_shards
from tablewright.session import cut_lineage


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their host share."""
    kept = apply_quality_rules(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return keep_one_of_each(docs, percent=80, shingle=5)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the table `benchmark`."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in service order, each as often as its source's weight asks for."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, slot and size."""
    return assign_shards(docs, 40)


STAGES = [
    ("quality", reject_low_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_copies),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages hash, verify and queue: no SQL for the whole, see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
