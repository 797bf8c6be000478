"""The jobs: ingest, link, analyze, report, and moving pattern documents in and out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import categorize, fold, index, links, report
from ..operators.scale import by_merge, frozen, release, with_position
from ..sources.documents import ledger_of, patterns_of, write_documents
from ..sources.knowledge_base import DELTAS, KnowledgeBase
from ..sources.schemas import FAILURES, PATTERN_TABLES
from .failures import LOG_KEY, parse_without_suite, record_failures, run_artifacts, runs_covered


def ingest(
    kb: KnowledgeBase,
    failures: DataFrame,
    runs: DataFrame | None = None,
    source: str = "",
    batch_id: int = -1,
    skipped: DataFrame | None = None,
    pending: DataFrame | None = None,
) -> DataFrame | None:
    """Fold fingerprinted failures into the knowledge base; AGG-13 as the result.

    ``runs`` are the runs the batch covers, with or without failures; by default those with
    failures. Failures and new
    occurrences are stored before they are used again, so logs are parsed once and every table
    is folded from columns on disk. What is written grows with the batch, not with what the
    knowledge base holds; every ``DELTAS`` batches it is compacted. A stream batch that is in
    already changes nothing. A job that counted one of the batch's occurrences meanwhile is
    noticed before the commit, and the batch folded again without it.
    ``skipped`` are logs that could not be read. ``pending`` are records that wait for their
    artifact, in place of those that waited before.
    """
    if batch_id >= 0 and kb.has_batch(source, batch_id):
        return None
    state = kb.state()
    data = kb.new_data(state)
    stored = kb.write("failures", data, failures)
    covered = stored if runs is None else runs
    kb.write("runs_seen", data, covered.select("run_id").distinct())
    if skipped is not None:
        kb.write("skipped", data, skipped)
    bases = []
    if pending is not None:
        kb.write_pending(data, pending)
        bases.append("pending")
    found = frozen(fold.occurrences(stored))
    batch_runs = stored.select("run_id").distinct()

    def overlap(others: list[int]) -> bool:
        """Whether jobs that came in between counted an occurrence of this batch."""
        theirs = reduce(DataFrame.unionByName, [kb.read_data("occurrences", d) for d in others])
        return not found.join(theirs.select(*fold.KEY), list(fold.KEY), "left_semi").isEmpty()

    while True:
        known = kb.patterns(state)
        ledger = kb.ledger(state, batch_runs)
        occ = kb.write_ledger(data, fold.unseen(found, ledger, batch_runs))
        delta = fold.fold(occ, fold.signatures(stored), batch=state.version + 1)
        for name, table in delta.tables().items():
            kb.write(name, data, table)
        deltas = [*PATTERN_TABLES, "ledger_files"]
        if kb.commit(state, data, deltas, bases, True, source, batch_id, conflict=overlap):
            break
        if batch_id >= 0 and kb.has_batch(source, batch_id):
            return None
        state = kb.state()
    release(found)
    if kb.deltas() >= DELTAS:
        kb.compact()
    return index.ingest_stats(stored, known.core)


def ingest_logs(
    kb: KnowledgeBase,
    read_logs: Callable[[DataFrame], DataFrame],
    runs: DataFrame,
    artifacts: DataFrame,
    suite: str | None = None,
    per_commit: int = 500,
) -> list[tuple]:
    """Ingest the logs of ``runs``, newest run first, ``per_commit`` artifacts at a time.

    Each slice is one commit, so a job that is cut off keeps what it has done. ``read_logs`` gets
    a table of the slice's run and artifact ids, at most ``per_commit`` rows that are on disk, and
    should read no other files, as the readers of ``sources.ci`` do; rows with an ``error`` are
    recorded as skipped. It may also give records that are parsed already, as those of
    ``long_log_records``.
    Gives AGG-13 of each slice. The last commit adds the runs without wanted logs.
    """
    newest = F.unix_seconds(F.try_to_timestamp("created_at")).desc_nulls_last()
    wanted = frozen(
        with_position(
            run_artifacts(runs, artifacts, suite), newest, F.desc("run_id"), F.col("artifact_id")
        )
    )
    covered = frozen(runs_covered(runs, artifacts))
    slices = -(-wanted.count() // per_commit)
    stats = []
    for k in range(slices):
        at = F.col("position")
        part = wanted.filter((at >= k * per_commit) & (at < (k + 1) * per_commit)).drop("position")
        logs = read_logs(part.select("run_id", "artifact_id"))
        if "error" not in logs.columns:
            logs = logs.withColumn("error", F.lit(None).cast("string"))
        parsed = "parser_ord" in logs.columns
        records = frozen(logs if parsed else parse_without_suite(logs, keep_clean=True))
        bad = records.filter("error IS NOT NULL").select(
            "run_id", "artifact_id", "filename", "error"
        )
        # most artifacts may have no log or no record, and the join below repeats each
        met = by_merge(records.select(*LOG_KEY).distinct())
        held = part.join(met, LOG_KEY, "left_semi")
        failures = record_failures(records.filter("error IS NULL").drop("error"), held)
        found = ingest(kb, failures, part.select("run_id").distinct(), skipped=bad)
        stats.append(tuple(found.first()))
        release(records)
    rest = covered.join(kb.runs_seen(), "run_id", "left_anti")
    if not slices or not rest.isEmpty():
        nothing = kb.spark.createDataFrame([], FAILURES)
        ingest(kb, nothing, covered)
    return stats


def link(kb: KnowledgeBase, markers: DataFrame) -> None:
    """JN-1, JN-2: write the issues of skip markers to the patterns in the same files."""

    def linked(patterns: fold.Patterns) -> fold.Patterns:
        issues = links.pattern_issues(patterns.files, markers)
        return patterns.with_core(links.link(patterns.core, issues))

    kb.replace_patterns(linked, ["core"])


def analyze(
    kb: KnowledgeBase,
    answer: Callable[[str], str | None] | None,
    force: bool = False,
    tasks: int | None = None,
) -> None:
    """Ask ``answer`` once per pattern without category; without it everything stays as it is.

    Replies are stored before they are used, so a later stage that is lost asks nothing again.
    """
    if answer is None:
        return
    state = kb.state()
    path = f"{kb.root}/replies/version={kb.new_data(state)}"
    replies = categorize.ask(categorize.prompts(kb.patterns(state), force), answer, tasks)
    replies.write.mode("overwrite").parquet(path)
    usable = categorize.usable_replies(kb.spark.read.schema(replies.schema).parquet(path))
    kb.replace_patterns(
        lambda patterns: patterns.with_core(categorize.apply_replies(patterns.core, usable)), ["core"]
    )


def report_tables(kb: KnowledgeBase, markers: DataFrame | None = None) -> dict[str, DataFrame]:
    """RPT-1..7. With ``markers`` there is a table of stale ones."""
    patterns = kb.patterns()
    ranked = report.ranked(patterns)
    tables = {
        "totals": index.totals(patterns.core, kb.runs_seen()),
        "frequency": report.frequency(ranked),
        "details": report.details(ranked),
        "recent_runs": report.recent_run_rows(patterns.recent),
        "categories": report.category_breakdown(patterns.core),
    }
    if markers is not None:
        stale = links.stale_markers(markers, patterns.core)
        tables["stale_markers"] = links.stale_table(stale).orderBy("issue", "place").drop("place")
    return tables


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """SNK-3: one folder per table, in any format Spark writes."""
    for name, table in tables.items():
        table.write.format(fmt).mode("overwrite").save(f"{path.rstrip('/')}/{name}")


def write_index(kb: KnowledgeBase, path: str) -> None:
    """SNK-2: the index head as one JSON row, its patterns and run ids as tables next to it."""
    core, runs = kb.patterns().core, kb.runs_seen()
    head = index.index_document(core, runs).coalesce(1)  # one row
    tables = {"head": head, "patterns": index.index_entries(core), "runs": runs.orderBy("run_id")}
    write_tables(tables, path, "json")


def export_documents(kb: KnowledgeBase, path: str) -> None:
    """SNK-1 as JSON documents."""
    write_documents(fold.documents(kb.patterns()), path)


def import_documents(kb: KnowledgeBase, docs: DataFrame) -> None:
    """Start a knowledge base from pattern documents.

    Documents name only the last runs of a pattern, so they cannot be told apart from
    occurrences that are in already: the knowledge base must be empty.
    """
    state = kb.state()
    if state.version:
        raise ValueError(f"{kb.root} is not empty")
    data = kb.new_data(state)
    ledger = ledger_of(docs)
    kb.write("failures", data, kb.spark.createDataFrame([], FAILURES))
    kb.write_ledger(data, ledger)
    kb.write("runs_seen", data, ledger.select("run_id").distinct())
    for name, table in fold.folded(patterns_of(docs)).tables().items():
        kb.write(name, data, table)
    deltas = [*PATTERN_TABLES, "ledger_files"]
    if not kb.commit(state, data, deltas, appended=True, conflict=lambda others: True):
        raise ValueError(f"{kb.root} is no longer empty")
