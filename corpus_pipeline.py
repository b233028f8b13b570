"""From raw documents to a sharded training mix. Part of the llm package; each stage applies one of its operators to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import decontamination, jaccard_join, language_id, mixing, sharding
from tessel.llm.common import clearing, remove, scratch, table

SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    return language_id.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    return jaccard_join.without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target asks for."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's shard."""
    return sharding.add_shard(docs, SHARDS)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Language ID has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's rows are written before the next; what a stage needed on the way, and the rows before, are deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch(spark, f"stage-{i}")
        with clearing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
