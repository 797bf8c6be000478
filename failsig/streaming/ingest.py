"""STR-1..3: incremental ingest with Structured Streaming.

Parsing and fingerprinting are stateless; the state is the knowledge base, which each
micro-batch is folded into. A batch that is delivered again is recognised by its query and its
number, and a failure that is delivered again by the ledger, so occurrences count once. A query
that starts anew, with a fresh checkpoint, has another id: its batches are all new. Late failures
only move minima and maxima, and records that land before their run or artifact wait in the
knowledge base for it; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.fold import KEY
from ..operators.scale import frozen, release
from ..plans.failures import (
    LOG_KEY,
    parse_without_suite,
    record_failures,
    run_artifacts,
    runs_covered,
)
from ..plans.jobs import ingest
from ..sources import schemas
from ..sources.knowledge_base import KnowledgeBase


def _write(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict,
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _query(batch: DataFrame, source: str) -> str:
    """The source's name with the id of the query, which lives as long as its checkpoint."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{source}:{query}"


def stream_failures(
    failures: DataFrame, kb: KnowledgeBase, checkpoint: str, source: str, **trigger
) -> StreamingQuery:
    """STR-1 for a stream of fingerprinted failures. ``trigger`` defaults to what is there now."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest(kb, batch, None, _query(batch, source), batch_id)

    return _write(failures, each, checkpoint, trigger or {"availableNow": True})


def stream_logs(
    logs: DataFrame,
    run_tables: Callable[[], tuple[DataFrame, DataFrame]],
    kb: KnowledgeBase,
    checkpoint: str,
    source: str,
    **trigger,
) -> StreamingQuery:
    """STR-1 for a stream of logs.

    Logs are parsed in the stream, once; each micro-batch holds the small failure records, and a
    bare row for a clean log, whose run is covered too.
    ``run_tables`` gives the failed runs and the artifacts; it is called per batch, so rows that
    landed meanwhile are seen. Records whose run or artifact has no row yet are kept and tried
    again with each later batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        query = _query(batch, source)
        if kb.has_batch(query, batch_id):
            return
        # stored: the run ids, both joins and what waits are read from it
        schema = ", ".join(f"{c} {t}" for c, t in batch.dtypes)
        records = frozen(batch.unionByName(kb.pending(schema)))
        ids = records.select("run_id").distinct()
        keys = records.select(*LOG_KEY).distinct()
        runs, artifacts = run_tables()
        runs = runs.join(ids, "run_id", "left_semi")
        artifacts = artifacts.join(keys, LOG_KEY, "left_semi")
        landed = artifacts.join(runs.select("run_id"), "run_id", "left_semi").select(*LOG_KEY)
        waiting = records.join(landed.distinct(), LOG_KEY, "left_anti")
        failures = record_failures(records, run_artifacts(runs, artifacts))
        ingest(kb, failures, runs_covered(runs, artifacts), query, batch_id, pending=waiting)
        release(records)

    stream = parse_without_suite(logs, keep_clean=True)
    return _write(stream, each, checkpoint, trigger or {"availableNow": True})


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed logs, ``path/run_id=1/artifact_id=2/*.html``, as a stream of the LOGS columns."""
    file = F.col("_metadata.file_path")
    files = (
        spark.readStream.option("pathGlobFilter", "*.html")
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
    )
    return files.select(
        F.regexp_extract(file, r"/run_id=(\d+)/", 1).cast("bigint").alias("run_id"),
        F.regexp_extract(file, r"/artifact_id=(\d+)/", 1).cast("bigint").alias("artifact_id"),
        F.lit(0).alias("file_ord"),
        F.substring_index(file, "/", -1).alias("filename"),
        F.make_valid_utf8("value").alias("html"),
    )


def read_failure_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of failure tables as a stream."""
    return spark.readStream.schema(schemas.FAILURES).parquet(path)


def distinct_occurrences(failures: DataFrame, lateness: str = "7 days") -> DataFrame:
    """STR-2 with bounded state instead of a ledger: one row per occurrence within ``lateness``.

    A failure without a readable time counts as happening when it arrives. Failures that arrive
    later than ``lateness`` are dropped by the watermark; where every failure counts, use the
    ledger.
    """
    happened = F.coalesce(F.try_to_timestamp("created_at"), F.current_timestamp())
    timed = failures.withColumn("event_time", happened).withWatermark("event_time", lateness)
    return timed.dropDuplicatesWithinWatermark(list(KEY))
