"""The jobs for spark-submit: ``python -m failsig ingest|link|analyze|report --kb DIR ...``."""

from __future__ import annotations

import argparse
import importlib

from .operators.links import find_markers
from .operators.long_logs import long_log_records
from .plans import jobs
from .session import session
from .sources import schemas
from .sources.ci import (
    broken_lines,
    failed_runs,
    read_html_logs,
    read_json_table,
    read_zip_logs,
)
from .sources.knowledge_base import KnowledgeBase
from .sources.tree import source_lines


def _function(name: str):
    """``module:function``"""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _ingest(spark, kb, args):
    runs = read_json_table(spark, args.runs, schemas.RUNS)
    artifacts = read_json_table(spark, args.artifacts, schemas.ARTIFACTS)
    for path, schema in ((args.runs, schemas.RUNS), (args.artifacts, schemas.ARTIFACTS)):
        broken = broken_lines(spark, path, schema)
        broken.write.mode("append").parquet(f"{kb.root}/broken_lines")
        print(f"{path}: {broken.count()} broken lines, kept in {kb.root}/broken_lines")
    read_logs = read_zip_logs if args.zip else long_log_records if args.long else read_html_logs
    failed = failed_runs(runs, args.limit, args.event, args.workflow)
    stats = jobs.ingest_logs(
        kb,
        lambda keys: read_logs(spark, args.logs, keys),
        failed,
        artifacts,
        args.suite,
        args.per_commit,
    )
    for failures, patterns, new in stats:
        print(f"{failures} failures, {patterns} patterns, {new} of them new")


def _limit(text: str) -> int | None:
    return None if text == "all" else int(text)


def _link(spark, kb, args):
    jobs.link(kb, find_markers(source_lines(spark, args.checkout)))


def _analyze(spark, kb, args):
    answer = _function(args.answer) if args.answer else None
    jobs.analyze(kb, answer, args.force, args.tasks)


def _report(spark, kb, args):
    markers = find_markers(source_lines(spark, args.checkout)) if args.checkout else None
    jobs.write_tables(jobs.report_tables(kb, markers), args.output, args.format)
    jobs.write_index(kb, f"{args.output.rstrip('/')}/index")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="failsig")
    parser.add_argument("--kb", required=True, help="knowledge base folder")
    sub = parser.add_subparsers(required=True)

    p = sub.add_parser("ingest", help="fold failed runs into the knowledge base")
    p.add_argument("--runs", required=True, help="JSON lines, one per run")
    p.add_argument("--artifacts", required=True, help="JSON lines, one per artifact")
    p.add_argument("--logs", required=True, help="run_id=*/artifact_id=* folders")
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("--zip", action="store_true", help="logs are archives as downloaded")
    kind.add_argument("--long", action="store_true", help="read logs by byte ranges, whatever their size")
    p.add_argument("--limit", type=_limit, default=10, help="how many failed runs, or all")
    p.add_argument("--per-commit", type=int, default=500, help="artifacts between two commits")
    p.add_argument("--event", choices=["push", "pull_request"])
    p.add_argument("--workflow")
    p.add_argument("--suite")
    p.set_defaults(job=_ingest)

    p = sub.add_parser("link", help="link patterns to skip markers")
    p.add_argument("checkout")
    p.set_defaults(job=_link)

    p = sub.add_parser("analyze", help="categorise patterns")
    p.add_argument("--answer", help="module:function from prompt to reply text")
    p.add_argument("--force", action="store_true")
    p.add_argument("--tasks", type=int, help="calls at a time")
    p.set_defaults(job=_analyze)

    p = sub.add_parser("report", help="write the report tables and the index")
    p.add_argument("--output", required=True)
    p.add_argument("--format", default="parquet")
    p.add_argument("--checkout", help="adds the stale markers")
    p.set_defaults(job=_report)

    args = parser.parse_args(argv)
    spark = session()
    args.job(spark, KnowledgeBase(spark, args.kb), args)


if __name__ == "__main__":
    main()
