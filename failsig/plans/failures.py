"""JN-4, PRJ-2/4: runs, artifacts and logs to fingerprinted failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import artifact_axes, dim_label
from ..functions.normalize import with_fingerprint
from ..operators.parse import BATS, GINKGO, parse_logs
from ..operators.scale import by_merge, salted_join
from ..sources.ci import log_artifacts

LOG_KEY = ["run_id", "artifact_id"]


def run_artifacts(runs: DataFrame, artifacts: DataFrame, suite: str | None = None) -> DataFrame:
    """The log artifacts of ``runs`` with run columns and axes. One run may have most of them,
    so runs are split."""
    run_cols = {"html_url": "run_url", "event": "run_event", "head_sha": "head_sha"}
    known = runs.select(
        "run_id",
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        *[
            (F.coalesce(c, F.lit("")) if c in runs.columns else F.lit("")).alias(name)
            for c, name in run_cols.items()
        ],
    )
    kept = log_artifacts(artifacts).select("run_id", "artifact_id", "name")
    out = salted_join(kept, known, "run_id", spread="artifact_id", salts=8)
    for axis, value in artifact_axes(F.col("name")).items():
        out = out.withColumn(axis, value)
    out = out.drop("name").withColumn("dim_label", dim_label())
    return out if suite is None else out.filter(F.col("suite") == suite)


def runs_covered(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """AGG-12: runs that have at least one log artifact, whatever its suite."""
    held = by_merge(log_artifacts(artifacts).select("run_id"))
    return runs.select("run_id").join(held, "run_id", "left_semi").distinct()


def _seq():
    """SEQ of the schemas; a run without a readable time sorts last."""
    newest_first = -F.unix_seconds(F.try_to_timestamp("created_at"))
    return F.struct(
        F.coalesce(newest_first, F.lit(0)).cast("bigint").alias("run_ord"),
        (-F.col("run_id")).alias("run_tie"),
        F.col("artifact_id").alias("artifact_ord"),
        F.col("file_ord").cast("int").alias("file_ord"),
        F.col("filename").alias("filename"),
        F.col("parser_ord").alias("parser_ord"),
        F.col("pos").alias("pos"),
    ).alias("seq")


def parse_without_suite(logs: DataFrame, keep_clean: bool = False) -> DataFrame:
    """Records of both grammars, for logs whose suite is met later."""
    return parse_logs(logs.withColumn("suite", F.lit("")), keep_clean=keep_clean).drop("suite")


def _fitting(records: DataFrame) -> DataFrame:
    """PAR-6 after the fact: drop records of the grammar that the suite does not have."""
    unfit = ((F.col("suite") == "int") & (F.col("parser_ord") == BATS)) | (
        (F.col("suite") == "sys") & (F.col("parser_ord") == GINKGO)
    )
    return records.filter(~unfit)


def log_failures(logs: DataFrame, artifacts_of_runs: DataFrame) -> DataFrame:
    """Fingerprinted failures of ``logs``; log text is never shuffled.

    ``artifacts_of_runs`` is :func:`run_artifacts`. Texts are parsed where they are read, and the
    small records meet the artifacts, whatever the size of either. What isn't wanted should not
    be read in the first place: give the readers of ``sources.ci`` the keys.
    """
    return record_failures(parse_without_suite(logs), artifacts_of_runs)


def record_failures(records: DataFrame, artifacts_of_runs: DataFrame) -> DataFrame:
    """Fingerprinted failures of :func:`parse_without_suite` records. An artifact with many
    records is split over several tasks."""
    records = records.filter(F.col("parser_ord").isNotNull())  # clean logs
    place = F.struct("filename", "parser_ord", "pos")
    joined = salted_join(
        records.withColumn("_spread", place), artifacts_of_runs, LOG_KEY, "_spread", salts=8
    )
    return _fingerprinted(_fitting(joined))


def _fingerprinted(records: DataFrame) -> DataFrame:
    columns = [
        "run_id",
        "run_url",
        "run_event",
        "head_sha",
        "created_at",
        "artifact_id",
        "suite",
        "mode",
        "priv",
        "distro",
        "dim_label",
        "test_name",
        "suite_name",
        "test_file",
        "error_excerpt",
    ]
    return with_fingerprint(records.select(*columns, _seq())).select(
        *columns, "signature", "signature_hash", "seq"
    )
