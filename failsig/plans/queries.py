"""The registered queries: every operator on the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dimensions import AXES, artifact_axes, dim_label
from ..functions.html import decode_entities, strip_tags
from ..functions.normalize import normalize, with_fingerprint
from ..functions.replies import parse_reply
from ..functions.text import blank_if_null
from ..operators import categorize, fold, index, links, report
from ..operators.long_logs import long_log_records
from ..operators.parse import parse_logs
from ..operators.scale import by_merge, frozen, release, salted_join, scratch
from ..sources import schemas
from ..sources.ci import (
    failed_jobs,
    failed_runs,
    html_logs,
    land_logs,
    log_artifacts,
    unzipped,
)
from ..sources.documents import patterns_of, read_documents, write_documents
from ..sources.knowledge_base import KnowledgeBase
from ..sources.tree import TEST_DIRS, source_lines
from ..streaming.ingest import stream_failures, stream_logs
from . import jobs
from .derived import PATTERN_REPLY, apply_view, log_html, log_texts, table, view
from .failures import log_failures, run_artifacts, runs_covered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- shared inputs ------------------------------------------------------------------------


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fingerprint(fold.complete(view(spark, sf_dir, "failures_v")))


def _stored_form(failures: DataFrame) -> DataFrame:
    """The columns that a knowledge base keeps, the view's ``seq`` being the place."""
    place = F.struct(
        *[F.lit(0).cast("bigint").alias(c) for c in ("run_ord", "run_tie")],
        F.col("seq").alias("artifact_ord"),
        F.lit(0).alias("file_ord"),
        F.lit("").alias("filename"),
        *[F.lit(0).alias(c) for c in ("parser_ord", "pos")],
    )
    return (
        failures.withColumn("seq", place)
        .withColumn("artifact_id", F.lit(0).cast("bigint"))
        .withColumn("suite_name", F.lit(""))
    )


def _occurrences(spark: SparkSession, sf_dir: str, *payload: str) -> DataFrame:
    return fold.occurrences(_failures(spark, sf_dir), payload)


def _stored_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures computed once, as an ingest stores them: several tables are folded from them."""
    return frozen(_failures(spark, sf_dir).drop("error_excerpt"))


def _patterns(spark: SparkSession, sf_dir: str) -> fold.Patterns:
    failures = _stored_failures(spark, sf_dir)
    return fold.fold(fold.occurrences(failures), fold.signatures(failures))


def _categorized(patterns: fold.Patterns) -> fold.Patterns:
    patterns = patterns.with_core(frozen(patterns.core))  # a stored table in a real job
    replies = patterns.core.select("signature_hash", F.expr(PATTERN_REPLY).alias("content"))
    return patterns.with_core(
        categorize.apply_replies(patterns.core, categorize.usable_replies(replies))
    )


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.find_markers(view(spark, sf_dir, "markers_v"))


def _linked(patterns: fold.Patterns, markers: DataFrame) -> fold.Patterns:
    issues = links.pattern_issues(patterns.files, markers)
    return patterns.with_core(links.link(patterns.core, issues))


def _logs(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """run_id and html of one log per run, the text of the named views one after the other."""
    logs = log_texts(spark, sf_dir, *names)
    return logs.select("run_id", log_html(F.concat(*names)).alias("html"))


def _records(logs: DataFrame, suite: str | Column) -> DataFrame:
    suite = F.lit(suite) if isinstance(suite, str) else suite
    return parse_logs(logs.withColumn("suite", suite)).select(
        "run_id",
        "suite",
        "parser_ord",
        "pos",
        "test_name",
        "suite_name",
        "test_file",
        "error_excerpt",
    )


# -- sources, projections ---------------------------------------------------------------


@query
def failed_runs_topn(spark, sf_dir):
    """SRC-1, PRJ-3, SRT-1."""
    runs = failed_runs(view(spark, sf_dir, "runs_v"), limit=20, event="push")
    return runs.select("run_id", "event", "created_at")


@query
def failed_jobs_all(spark, sf_dir):
    """SRC-4."""
    return failed_jobs(view(spark, sf_dir, "jobs_v"))


@query
def artifact_dimensions(spark, sf_dir):
    """SRC-2, PAR-1, PRJ-1, PRJ-5."""
    artifacts = log_artifacts(view(spark, sf_dir, "artifacts_v"))
    return artifacts.select(
        "run_id",
        "artifact_id",
        "name",
        *[c.alias(axis) for axis, c in artifact_axes(F.col("name")).items()],
    ).withColumn("dim_label", dim_label())


@query
def suite_filter(spark, sf_dir):
    """PRJ-2, PRJ-4 and the run side of JN-4: the sys artifacts of all failed runs."""
    runs = failed_runs(view(spark, sf_dir, "runs_v"), limit=None)
    artifacts = run_artifacts(runs, view(spark, sf_dir, "artifacts_v"), suite="sys")
    return artifacts.select("run_id", "artifact_id", "created_at", "run_event", "dim_label")


# -- log parsing ------------------------------------------------------------------------


@query
def strip_html(spark, sf_dir):
    """PAR-2, UDF-1."""
    pages = table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("t"))
    return pages.select("page_id", decode_entities(F.col("t")).alias("text"))


@query
def bats_failures(spark, sf_dir):
    """PAR-4, PAR-5, PAR-7."""
    return _records(_logs(spark, sf_dir, "lines_v"), "sys")


@query
def ginkgo_failures(spark, sf_dir):
    """PAR-3, PAR-5, PAR-7."""
    return _records(_logs(spark, sf_dir, "blocks_v"), "int")


@query
def mixed_log_failures(spark, sf_dir):
    """PAR-6, SET-1: logs with both kinds of text; the suite picks the grammar."""
    suite = F.expr("CASE run_id % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'sys' ELSE 'unit' END")
    return _records(_logs(spark, sf_dir, "lines_v", "blocks_v"), suite)


# -- signatures -------------------------------------------------------------------------


@query
def normalize_chain(spark, sf_dir):
    """NRM-1..17."""
    failures = view(spark, sf_dir, "failures_v")
    return failures.select("seq", normalize(F.col("error_excerpt")).alias("normalized"))


@query
def signature_hash(spark, sf_dir):
    """SIG-1..3."""
    return _failures(spark, sf_dir).select("seq", "signature", "signature_hash")


# -- fold -------------------------------------------------------------------------------


@query
def occurrence_dedupe(spark, sf_dir):
    """AGG-1."""
    occ = _occurrences(spark, sf_dir, "test_name", "created_at")
    return occ.select(*fold.KEY, "seq", "test_name", "created_at")


@query
def pattern_counts(spark, sf_dir):
    """AGG-2, AGG-3, AGG-8, SRT-3: the flagship. Occurrences per signature, ranked."""
    counts = fold.pattern_counts(_occurrences(spark, sf_dir, "test_name", "created_at"))
    return counts.orderBy(F.desc("count"), "title", "signature_hash").drop("seq")


@query
def pattern_tests(spark, sf_dir):
    """AGG-4."""
    names = fold.test_names(_occurrences(spark, sf_dir, "test_name"))
    return names.withColumnRenamed("seq", "first_seq")


@query
def pattern_files(spark, sf_dir):
    """AGG-5."""
    files = fold.source_files(_occurrences(spark, sf_dir, "test_file"))
    return files.withColumnRenamed("seq", "first_seq")


@query
def axis_counts(spark, sf_dir):
    """AGG-6."""
    return fold.axis_counts(_occurrences(spark, sf_dir, *AXES))


@query
def recent_runs(spark, sf_dir):
    """AGG-7, PRJ-11."""
    columns = ("run_url", "run_event", "head_sha", "created_at")
    runs = fold.recent_runs(_occurrences(spark, sf_dir, *columns))
    return runs.select(
        "signature_hash",
        "run_id",
        "created_at",
        "dimensions",
        "url",
        "event",
        "sha",
        F.col("ord").alias("seq"),
    )


@query
def pattern_documents(spark, sf_dir):
    """PRJ-6: nested pattern rows, their lists as text in document order."""
    docs = fold.documents(_patterns(spark, sf_dir))
    return docs.select(
        "signature_hash",
        "part",
        "count",
        F.array_join("tests", "; ").alias("tests"),
        F.array_join("test_files", "; ").alias("test_files"),
        F.array_join(
            F.transform("recent_runs", lambda r: F.concat_ws(" ", r["run_id"], r["dimensions"])),
            "; ",
        ).alias("recent_runs"),
        F.col("dimensions.priv.root").alias("on_root"),
    )


def _windows(failures: DataFrame) -> list[DataFrame]:
    """Two ingest windows that overlap in the middle of each month."""
    day = F.substring("created_at", 9, 2)
    return [failures.filter(day <= "20"), failures.filter(day >= "10")]


def _merged(spark: SparkSession, sf_dir: str) -> fold.Patterns:
    first, second = _windows(_stored_failures(spark, sf_dir))
    ledger = fold.occurrences(first)
    new = fold.unseen(fold.occurrences(second), ledger, second.select("run_id").distinct())
    return fold.merge(
        fold.fold(ledger, fold.signatures(first), batch=0),
        fold.fold(new, fold.signatures(second), batch=1),
    )


@query
def incremental_merge(spark, sf_dir):
    """JN-5, JN-6, AGG-9: two overlapping ingests, one after the other."""
    return _merged(spark, sf_dir).core.select(
        "signature_hash", "signature", "title", "count", "first_seen", "last_seen"
    )


@query
def incremental_axes(spark, sf_dir):
    """AGG-9: axis counts after two overlapping ingests."""
    return _merged(spark, sf_dir).axes


@query
def incremental_recent(spark, sf_dir):
    """AGG-9: recent runs after two overlapping ingests."""
    return _merged(spark, sf_dir).recent.select(
        "signature_hash", "run_id", "dimensions", "ord.batch", "ord.seq"
    )


@query
def incremental_tests(spark, sf_dir):
    """AGG-9: test names after two overlapping ingests."""
    tests = _merged(spark, sf_dir).tests
    return tests.select("signature_hash", "test_name", "ord.batch", "ord.seq")


@query
def incremental_files(spark, sf_dir):
    """AGG-9: source files after two overlapping ingests."""
    return _merged(spark, sf_dir).files.select("signature_hash", "file", "ord.batch", "ord.seq")


@query
def document_roundtrip(spark, sf_dir):
    """SRC-6, PRJ-6, SNK-1: lists of patterns written as documents in short parts and read back."""
    path = scratch(spark)
    write_documents(fold.documents(_patterns(spark, sf_dir), part_items=2), path)
    back = patterns_of(read_documents(spark, path, lines=True))
    order = Window.partitionBy("signature_hash").orderBy("ord")

    def placed(rows: DataFrame, kind: str, value: str) -> DataFrame:
        place = (F.row_number().over(order) - 1).alias("place")
        return rows.select("signature_hash", F.lit(kind).alias("kind"), F.col(value).alias("value"), place)

    return placed(back.tests, "test", "test_name").union(placed(back.files, "file", "file"))


# -- knowledge base ---------------------------------------------------------------------


def _knowledge(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """A knowledge base after two overlapping ingests, of failures that are fingerprinted once."""
    kb = KnowledgeBase(spark, scratch(spark))
    failures = frozen(_stored_form(_failures(spark, sf_dir)))
    for window in _windows(failures):
        jobs.ingest(kb, window)
    release(failures)
    return kb


@query
def kb_lookup(spark, sf_dir):
    """SRC-7: the most frequent pattern, by its hash."""
    kb = _knowledge(spark, sf_dir)
    top = kb.patterns().core.orderBy(F.desc("count"), "signature_hash").first()
    return kb.lookup(top["signature_hash"] if top else "").select("signature_hash", "title", "count")


@query
def kb_runs_seen(spark, sf_dir):
    """SRC-8."""
    return _knowledge(spark, sf_dir).runs_seen()


@query
def index_files(spark, sf_dir):
    """SNK-2: the entries of the index as written."""
    path = scratch(spark)
    jobs.write_index(_knowledge(spark, sf_dir), path)
    kind = "signature_hash string, title string, count bigint, category string, last_seen string"
    rows = spark.read.schema(kind).json(f"{path}/patterns")
    return rows.select("signature_hash", "title", "count", "category", "last_seen")


@query
def report_files(spark, sf_dir):
    """SNK-3: the frequency table of the report as written."""
    path = scratch(spark)
    jobs.write_tables(jobs.report_tables(_knowledge(spark, sf_dir)), path)
    return spark.read.parquet(f"{path}/frequency")


@query
def pattern_lookup(spark, sf_dir):
    """SRC-7 as a join: failures with the state of the pattern they belong to."""
    failures = _stored_failures(spark, sf_dir)
    occ = fold.occurrences(failures, ("test_name", "created_at"))
    counts = fold.pattern_counts(occ).select("signature_hash", "count")
    return salted_join(
        failures.select("seq", "signature_hash"), counts, "signature_hash", spread="seq"
    )


# -- index ------------------------------------------------------------------------------


@query
def index_summary(spark, sf_dir):
    """AGG-10, AGG-12, AGG-15, RPT-5, SET-2: totals, the runs being those of two windows."""
    failures = _stored_failures(spark, sf_dir)
    first, second = _windows(failures)
    runs = first.select("run_id").union(second.select("run_id")).distinct()
    core = fold.fold(fold.occurrences(failures), fold.signatures(failures)).core
    return index.totals(core, runs)


@query
def index_entries(spark, sf_dir):
    """SRT-2."""
    return index.index_entries(_categorized(_patterns(spark, sf_dir)).core)


@query
def category_counts(spark, sf_dir):
    """AGG-11, PRJ-8."""
    return index.category_patterns(_categorized(_patterns(spark, sf_dir)).core)


@query
def runs_coverage(spark, sf_dir):
    """AGG-12: failed runs with a log artifact."""
    runs = failed_runs(view(spark, sf_dir, "runs_v"), limit=None)
    return runs_covered(runs, view(spark, sf_dir, "artifacts_v"))


@query
def ingest_stats(spark, sf_dir):
    """AGG-13, SET-3: the second window against the patterns of the first."""
    first, second = _windows(_stored_failures(spark, sf_dir))
    return index.ingest_stats(second, fold.signatures(first))


# -- markers ----------------------------------------------------------------------------


@query
def marker_scan(spark, sf_dir):
    """PAR-8."""
    return _markers(spark, sf_dir).select("issue", "file", "line", "text")


@query
def link_issues(spark, sf_dir):
    """JN-1, SET-4."""
    files = fold.source_files(_occurrences(spark, sf_dir, "test_file"))
    return links.pattern_issues(files, _markers(spark, sf_dir))


@query
def linked_patterns(spark, sf_dir):
    """JN-2: issue lists written to the patterns."""
    linked = _linked(_patterns(spark, sf_dir), _markers(spark, sf_dir))
    issues = F.array_join(F.col("linked_issues").cast("array<string>"), ",")
    return linked.core.select("signature_hash", issues.alias("issues"))


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = _markers(spark, sf_dir)
    files = fold.source_files(_occurrences(spark, sf_dir, "test_file"))
    return links.unlinked(markers, links.pattern_issues(files, markers))


@query
def stale_markers(spark, sf_dir):
    """JN-3."""
    return _stale(spark, sf_dir).select("issue", "file", "line", "text")


@query
def stale_table(spark, sf_dir):
    """RPT-7, SRT-4."""
    rows = links.stale_table(_stale(spark, sf_dir))
    return rows.select("issue", "file", "line", F.array_join("place.parts", "/").alias("place"))


# -- report -----------------------------------------------------------------------------


@query
def report_frequency(spark, sf_dir):
    """RPT-1, RPT-2, SRT-3."""
    return report.frequency(report.ranked(_categorized(_patterns(spark, sf_dir))))


@query
def report_details(spark, sf_dir):
    """RPT-3."""
    patterns = _linked(_patterns(spark, sf_dir), _markers(spark, sf_dir))
    return report.details(report.ranked(_categorized(patterns)))


@query
def report_recent_runs(spark, sf_dir):
    """RPT-4, SRT-6."""
    return report.recent_run_rows(_patterns(spark, sf_dir).recent)


@query
def recurring_patterns(spark, sf_dir):
    """PRJ-9."""
    return report.recurring(_patterns(spark, sf_dir).core).select("signature_hash", "count")


@query
def category_breakdown(spark, sf_dir):
    """RPT-6, AGG-16, SRT-5, PRJ-10."""
    return report.category_breakdown(_categorized(_patterns(spark, sf_dir)).core)


# -- categorisation ---------------------------------------------------------------------


@query
def prompt_text(spark, sf_dir):
    """JSN-1, PRJ-7."""
    return categorize.prompts(_patterns(spark, sf_dir))


@query
def reply_parse(spark, sf_dir):
    """JSN-2, JSN-3."""
    replies = view(spark, sf_dir, "replies_v").select("id", parse_reply(F.col("content")).alias("r"))
    return replies.select(
        "id",
        F.col("r").isNotNull().alias("parsed"),
        *[blank_if_null(F.col(f"r.{name}")).alias(name) for name in categorize.ANSWER],
    )


@query
def categorize_patterns(spark, sf_dir):
    """UDF-3, JSN-4, PRJ-8: a callback that answers for some tests and fails for others."""

    def answer(prompt: str) -> str:
        if "podman volume" in prompt:
            return '{"category": "storage-environment", "confidence": "low"}'
        if "podman network" in prompt:
            return "```json\n" + '{"category": "network-registry"}' + "\n```"
        if "podman image" in prompt:
            raise TimeoutError
        return "no idea"

    patterns = _patterns(spark, sf_dir)
    replies = categorize.ask(categorize.prompts(patterns), answer)
    core = categorize.apply_replies(patterns.core, categorize.usable_replies(replies))
    return core.select("signature_hash", "category", "confidence")


# -- whole jobs -------------------------------------------------------------------------


def _one_name(artifacts: DataFrame) -> DataFrame:
    return (
        log_artifacts(artifacts)
        .groupBy("run_id", "artifact_id")
        .agg(F.min("name").alias("name"))
        .withColumn("expired", F.lit(False))
    )


def _job_inputs(
    spark: SparkSession, sf_dir: str, stored: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Logs, failed runs and artifacts; the first log artifact of a run carries its log.

    Artifacts that are met several times are better ``stored`` than grouped each time.
    """
    artifacts = _one_name(view(spark, sf_dir, "artifacts_v"))
    artifacts = frozen(artifacts) if stored else artifacts
    first = artifacts.groupBy("run_id").agg(F.min("artifact_id").alias("artifact_id"))
    logs = (
        _logs(spark, sf_dir, "lines_v", "blocks_v")
        .join(by_merge(first), "run_id")
        .select(
            "run_id",
            "artifact_id",
            F.lit(0).alias("file_ord"),
            F.lit("log.html").alias("filename"),
            "html",
        )
    )
    runs = failed_runs(view(spark, sf_dir, "runs_v"), limit=None)
    return logs, runs, artifacts


def _all_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, runs, artifacts = _job_inputs(spark, sf_dir)
    return log_failures(logs, run_artifacts(runs, artifacts))


@query
def log_ingest(spark, sf_dir):
    """JN-4, PAR-1..7, SIG, AGG-1..3, AGG-8: from runs, artifacts and log HTML to patterns."""
    occ = fold.occurrences(_all_failures(spark, sf_dir), ("test_name", "created_at"))
    return fold.pattern_counts(occ).drop("seq")


@query
def log_ingest_shuffled(spark, sf_dir):
    """JN-4 from records that are stored first, as a cut-off job finds them."""
    failures = frozen(_all_failures(spark, sf_dir))
    occ = fold.occurrences(failures, ("test_name", "created_at"))
    return fold.pattern_counts(occ).drop("seq")


def _zipper():
    def pack(bats: pd.Series, ginkgo: pd.Series) -> pd.Series:
        def one(*members: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("readme.txt", "not ok 1 no log")
                for name, text in zip(("bats.html", "ginkgo.html"), members, strict=True):
                    archive.writestr(name, text)
            return out.getvalue()

        return pd.Series([one(*x) for x in zip(bats, ginkgo, strict=True)], dtype=object)

    return F.pandas_udf(pack, "binary")


@query
def zip_log_ingest(spark, sf_dir):
    """SRC-3, UDF-2, JN-4, PRJ-2: every log artifact is an archive of two logs of its run."""
    kinds = ("lines_v", "blocks_v")
    texts = log_texts(spark, sf_dir, *kinds)
    texts = texts.select("run_id", *[log_html(F.col(name)).alias(name) for name in kinds])
    artifacts = _one_name(view(spark, sf_dir, "artifacts_v"))
    held = artifacts.select("run_id", "artifact_id").join(by_merge(texts), "run_id")
    archives = held.select("run_id", "artifact_id", _zipper()("lines_v", "blocks_v").alias("content"))
    runs = failed_runs(view(spark, sf_dir, "runs_v"), limit=None)
    logs = unzipped(archives).filter("error IS NULL").drop("error")
    failures = log_failures(logs, run_artifacts(runs, artifacts))
    return failures.groupBy("run_id", "artifact_id", "suite").agg(F.count("*").alias("failures"))


@query
def stream_late_runs(spark, sf_dir):
    """STR-1: logs as a stream, half of whose runs get their rows only later."""
    logs, runs, artifacts = _job_inputs(spark, sf_dir)
    logs = logs.select(*spark.createDataFrame([], schemas.LOGS).columns)
    root = scratch(spark)
    kb = KnowledgeBase(spark, f"{root}/kb")
    early = runs.filter(F.pmod(F.xxhash64("run_id"), F.lit(2)) == 0)
    landing = F.pmod(F.xxhash64("run_id", F.lit(1)), F.lit(4))
    for part, known in ((landing > 0, early), (landing == 0, runs)):
        logs.filter(part).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(schemas.LOGS).parquet(f"{root}/landed")
        tables = (known, artifacts)
        stream_logs(stream, lambda t=tables: t, kb, f"{root}/stream", "logs").awaitTermination()
    return kb.patterns().core.select("signature_hash", "count", "first_seen", "last_seen")


@query
def landed_log_ingest(spark, sf_dir):
    """SRC-1..3, SRC-8, SNK-1, JN-6, AGG-12: the whole job over log files in folders, in slices of
    a third of the artifacts, most files being of runs that didn't fail."""
    logs, runs, artifacts = _job_inputs(spark, sf_dir, stored=True)
    every = view(spark, sf_dir, "runs_v").select("run_id")
    root = scratch(spark)
    land_logs(logs.join(every, "run_id", "left_semi"), f"{root}/logs", "log.txt")
    kb = KnowledgeBase(spark, f"{root}/kb")
    wanted = run_artifacts(runs, artifacts).count()
    jobs.ingest_logs(
        kb,
        html_logs(spark, f"{root}/logs", "*.txt"),
        runs,
        artifacts,
        per_commit=max(-(-wanted // 3), 1),
    )
    core = kb.patterns().core.select("signature_hash", "count", "first_seen", "last_seen", "title")
    return core.withColumn("runs_covered", F.lit(kb.runs_seen().count()).cast("bigint"))


@query
def long_log_failures(spark, sf_dir):
    """SRC-3, PAR-3..7 by byte ranges: the lines of all runs in eight long logs of each grammar, read
    in 64 splits, whose borders fall anywhere."""
    root = scratch(spark)
    kinds = [
        view(spark, sf_dir, name).select(
            (F.col("run_id") % 8).alias("log"), F.lit(i).alias("artifact_id"), "run_id", "seq",
            log_html(F.col("line")).alias("html"),
        )
        for i, name in enumerate(("blocks_v", "lines_v"))
    ]
    lines = kinds[0].union(kinds[1])
    size = lines.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    of_log = ["log", "artifact_id"]
    lines.repartition(*of_log).sortWithinPartitions(*of_log, "run_id", "seq").select(
        F.col("log").alias("run_id"), "artifact_id", "html"
    ).write.partitionBy("run_id", "artifact_id").text(f"{root}/logs")
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    spark.conf.set(split, str(max(size // 64, 1024)))
    try:
        records = frozen(long_log_records(spark, f"{root}/logs", files="*.txt"))
    finally:
        spark.conf.set(split, before)
    return records.drop("artifact_id", "file_ord", "filename")


@query
def tree_scan(spark, sf_dir):
    """SRC-5, SRT-7: a checkout with the parts as lines of its files, in the four scanned folders
    and another, next to files of other types."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    root = scratch(spark)
    area = F.format_string("%02d-x y", F.col("p_partkey") % 7).alias("area")
    for i, folder in enumerate([*TEST_DIRS, "test/unit"]):
        rows = parts.filter(F.col("p_partkey") % 5 == i).select(
            area, "p_partkey", F.concat_ws(" #", "p_name", "p_size").alias("value")
        )
        lines = rows.repartition("area").sortWithinPartitions("area", "p_partkey").drop("p_partkey")
        lines.write.partitionBy("area").text(f"{root}/{folder}")
        lines.write.partitionBy("area").mode("append").csv(f"{root}/{folder}")
    found = source_lines(spark, root, "*.txt")
    return found.select(
        "dir_ord", F.expr("substring_index(file, '/part-', 1)").alias("folder"), "line", "text"
    )


@query
def failures_per_artifact(spark, sf_dir):
    """AGG-14."""
    return index.failures_per_artifact(_all_failures(spark, sf_dir))


@query
def stream_ingest(spark, sf_dir):
    """STR-1..3, SRC-6..8, SNK-1, JN-5, JN-6: the events as a stream into a knowledge base."""
    root = scratch(spark)
    landed = table(spark, sf_dir, "events")
    landed.filter("false").write.parquet(f"{root}/landed")
    events = spark.readStream.schema(landed.schema).parquet(f"{root}/landed")
    failures = _stored_form(with_fingerprint(fold.complete(apply_view(events, "failures_v"))))
    kb = KnowledgeBase(spark, f"{root}/kb")
    # three landings of whole runs, the second of which brings part of the first again
    run = F.floor(F.col("event_id") / 25)
    last = landed.agg(F.max(run)).first()[0] or 0
    for low, high in ((0, 0.5), (0.3, 0.7), (0.7, 2)):
        part = landed.filter((run >= low * last) & (run < high * last + (high > 1)))
        part.write.mode("append").parquet(f"{root}/landed")
        stream_failures(failures, kb, f"{root}/stream", "events").awaitTermination()
    return kb.patterns().core.select("signature_hash", "count", "first_seen", "last_seen", "title")
