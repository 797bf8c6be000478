"""AGG-10..14, SRT-2: totals over the knowledge base and over one ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import SCHEMA_VERSION

UNCATEGORIZED = "uncategorized"


def category_or(blank: str) -> Column:
    return F.when(F.col("category") != "", F.col("category")).otherwise(blank)


def category_patterns(core: DataFrame) -> DataFrame:
    """AGG-11: patterns per category."""
    return core.groupBy(category_or(UNCATEGORIZED).alias("category")).agg(
        F.count(F.lit(1)).alias("patterns")
    )


def totals(core: DataFrame, runs_seen: DataFrame) -> DataFrame:
    """AGG-10, AGG-12, AGG-15: one row, zeros when there is nothing yet."""
    patterns = core.agg(
        F.count(F.lit(1)).alias("pattern_count"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_occurrences"),
        F.count_if(F.col("count") > 1).alias("recurring"),
    )
    runs = runs_seen.agg(F.count_distinct("run_id").alias("runs_scanned"))
    return _one_row(patterns, runs)


def _one_row(*parts: DataFrame) -> DataFrame:
    """The columns of tables of one row each, in one row."""
    names = [c for p in parts for c in p.columns]
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), parts
    )
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def index_document(core: DataFrame, runs_seen: DataFrame) -> DataFrame:
    """The head of the index as one row. Its two long lists stay tables of their own:
    :func:`index_entries` and the run ids."""
    categories = category_patterns(core).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("category", "patterns")))
        ).alias("categories")
    )
    return _one_row(totals(core, runs_seen).drop("recurring"), categories).withColumn(
        "schema_version", F.lit(SCHEMA_VERSION)
    )


def index_entries(core: DataFrame) -> DataFrame:
    """SRT-2: patterns, most frequent first."""
    return core.select("signature_hash", "title", "count", "category", "last_seen").orderBy(
        F.desc("count"), "signature_hash"
    )


def ingest_stats(failures: DataFrame, known: DataFrame) -> DataFrame:
    """AGG-13, SET-3: failures read (duplicates included), distinct hashes, hashes not in
    ``known``. Counted per hash first, so only one row per hash meets the known patterns."""
    per_hash = failures.groupBy("signature_hash").agg(F.count(F.lit(1)).alias("n"))
    old = known.select("signature_hash", F.lit(True).alias("_old"))
    return per_hash.join(old, "signature_hash", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("failures"),
        F.count(F.lit(1)).alias("patterns"),
        F.count_if(F.col("_old").isNull()).alias("new_patterns"),
    )


def failures_per_artifact(failures: DataFrame) -> DataFrame:
    """AGG-14: artifacts with at least one failure."""
    return failures.groupBy("run_id", "artifact_id").agg(F.count(F.lit(1)).alias("failures"))
