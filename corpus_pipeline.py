"""From raw documents to shards of a training mix: five stages, each one corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failsig.llm import decontam, gam, mixing, shards, simhash
from failsig.llm.common import table
from failsig.operators.scale import frozen


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the classifier accepts. It is fitted on ``docs`` and the labels table."""
    return gam.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by the benchmark table."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.emitted(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard of each and its place there."""
    rows = shards.sharded(docs)
    clash = {"size", "shard", "slot"}
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in clash]
    return rows.select(*kept, "size", "shard", "slot")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_target_weights),
    ("sharding", sharding),
]

# the first stage fits a model and the second links fingerprints until nothing changes
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = frozen(docs)
    return docs
