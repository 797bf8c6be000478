import io
import json
import zipfile

import pytest
from helpers import failures, write_tree
from pyspark.sql import functions as F
from test_parse import BATS, CLEAN, GINKGO

from failsig.operators.links import find_markers
from failsig.operators.scale import frozen
from failsig.plans import jobs
from failsig.plans.failures import log_failures, run_artifacts, runs_covered
from failsig.sources import schemas
from failsig.sources.ci import (
    broken_lines,
    failed_jobs,
    failed_runs,
    log_artifacts,
    read_html_logs,
    read_json_table,
    read_zip_logs,
)
from failsig.sources.documents import read_documents
from failsig.sources.knowledge_base import KnowledgeBase
from failsig.sources.tree import source_lines
from failsig.streaming.ingest import (
    distinct_occurrences,
    read_failure_stream,
    read_log_stream,
    stream_failures,
    stream_logs,
)

RUNS = [
    (1, "ci.yml", "failure", "push", "u1", "a" * 40, "2026-08-14T00:00:00Z"),
    (2, "ci.yml", "failure", "pull_request", "u2", "b" * 40, "2026-08-15T00:00:00Z"),
    (3, "ci.yml", "success", "push", "u3", "c" * 40, "2026-08-16T00:00:00Z"),
    (4, "other.yml", "failure", "push", None, None, None),
    (5, "other.yml", "failure", "push", None, None, None),
]
ARTIFACTS = [
    (1, 11, "int-local-root-fedora-prior.logs", False),
    (1, 12, "sys-local-root-fedora-prior.logs", None),
    (2, 21, "sys-remote-rootless-debian-sid.logs", False),
    (2, 22, "sys-remote-root-debian-sid.logs", True),
    (3, 31, "int-local-root-x.logs", False),
    (4, 41, "notes.zip", False),
    (5, 51, "sys-local-root-x.logs", False),
]
HTML = {11: GINKGO + BATS, 12: BATS, 21: BATS, 22: BATS, 31: GINKGO, 41: GINKGO, 51: CLEAN}


def tables(spark):
    return (
        spark.createDataFrame(RUNS, schemas.RUNS),
        spark.createDataFrame(ARTIFACTS, schemas.ARTIFACTS),
    )


def land_logs(root, zipped=False):
    for run_id, artifact_id, _, _ in ARTIFACTS:
        folder = root / f"run_id={run_id}" / f"artifact_id={artifact_id}"
        folder.mkdir(parents=True)
        html = HTML[artifact_id].encode() + b"\xff"
        if zipped:
            blob = io.BytesIO()
            with zipfile.ZipFile(blob, "w") as archive:
                archive.writestr("readme.txt", "not ok 1 x")
                archive.writestr("a b.html", html)
                archive.writestr("z.html", CLEAN)
            (folder / "logs.zip").write_bytes(blob.getvalue())
        else:
            (folder / "a b+c.html").write_bytes(html)
            (folder / "notes.txt").write_text("not ok 1 x")
    return str(root)


def core_rows(kb):
    rows = kb.patterns().core.collect()
    return {r.title: (r["count"], r.first_seen, r.last_seen) for r in rows}


EXPECTED = {
    "builds with a secret": (1, RUNS[0][6], RUNS[0][6]),
    "panics": (1, RUNS[0][6], RUNS[0][6]),
    "follows the journal": (2, RUNS[0][6], RUNS[1][6]),
    "no cause": (2, RUNS[0][6], RUNS[1][6]),
    "plain name": (2, RUNS[0][6], RUNS[1][6]),
}


def test_run_and_artifact_scans(spark, tmp_path):
    lines = [json.dumps({"run_id": 1, "conclusion": "failure", "x": 1}), "{broken", ""]
    (tmp_path / "runs.json").write_text("\n".join(lines))
    rows = read_json_table(spark, str(tmp_path / "runs.json"), schemas.RUNS).collect()
    assert [r.run_id for r in rows] == [1]
    broken = broken_lines(spark, str(tmp_path / "runs.json"), schemas.RUNS).collect()
    assert [r.line for r in broken] == ["{broken"]
    runs, artifacts = tables(spark)
    assert [r.run_id for r in failed_runs(runs, limit=2).collect()] == [2, 1]
    assert [r.run_id for r in failed_runs(runs, event="push", workflow="ci.yml").collect()] == [1]
    assert failed_runs(runs, limit=None).count() == 4
    assert log_artifacts(artifacts).count() == 5
    covered = runs_covered(failed_runs(runs, limit=None), artifacts)
    assert sorted(r.run_id for r in covered.collect()) == [1, 2, 5]
    rows = spark.createDataFrame([(1, 2, "n", "failure"), (1, 3, "n", "success")], schemas.JOBS)
    assert [r.job_id for r in failed_jobs(rows).collect()] == [2]


@pytest.mark.parametrize("zipped", [False, True])
def test_log_scan(spark, tmp_path, zipped):
    read = read_zip_logs if zipped else read_html_logs
    rows = read(spark, land_logs(tmp_path, zipped)).collect()
    names = {"a b.html", "z.html"} if zipped else {"a b+c.html"}
    assert {r.filename for r in rows} == names and len(rows) == len(ARTIFACTS) * len(names)
    assert {r.artifact_id: r.html for r in rows if r.filename != "z.html"}[12] == BATS + "�"
    assert {r.file_ord for r in rows} == ({1, 2} if zipped else {0})


def test_failures_of_logs(spark, tmp_path):
    runs, artifacts = tables(spark)
    logs = read_html_logs(spark, land_logs(tmp_path))
    wanted = run_artifacts(failed_runs(runs, limit=None), artifacts)
    rows = log_failures(logs, wanted).orderBy("seq").collect()
    # newest run first, then artifact, grammar and place; expired and passed ones are out
    assert [(r.run_id, r.artifact_id, r.test_name) for r in rows] == [
        *[(2, 21, t) for t in ("follows the journal", "no cause", "plain name")],
        *[(1, 11, t) for t in ("builds with a secret", "panics")],
        *[(1, 12, t) for t in ("follows the journal", "no cause", "plain name")],
    ]
    assert rows[0].dim_label == "sys-remote-rootless-debian-sid" and rows[0].run_url == "u2"
    only = run_artifacts(failed_runs(runs, limit=None), artifacts, suite="int")
    assert {r.suite for r in log_failures(logs, only).collect()} == {"int"}


def test_jobs_end_to_end(spark, tmp_path):
    runs, artifacts = tables(spark)
    failed = failed_runs(runs, limit=None)
    logs = read_html_logs(spark, land_logs(tmp_path / "logs"))
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert kb.patterns().core.count() == 0 and kb.runs_seen().count() == 0

    def run():
        parsed = log_failures(logs, run_artifacts(failed, artifacts))
        return tuple(jobs.ingest(kb, parsed, runs_covered(failed, artifacts)).first())

    assert run() == (8, 5, 5)
    assert core_rows(kb) == EXPECTED
    # the same window again changes nothing
    assert run() == (8, 5, 0)
    assert core_rows(kb) == EXPECTED and kb.runs_seen().count() == 3
    assert kb.grown("occurrences").count() == 8 and kb.grown("failures").count() == 16

    tree = tmp_path / "tree"
    path = tree / "test" / "system"
    path.mkdir(parents=True)
    (path / "044-journal.bats").write_text("skip # see #4321\nskip # see #4322\n")
    (path / "900.bats").write_text("skip # see #9999\n")
    markers = find_markers(source_lines(spark, str(tree)))
    jobs.link(kb, markers)
    jobs.analyze(kb, None)
    jobs.analyze(kb, lambda p: '{"category": "test-race"}' if "Test: follows" in p else "?")

    report = {k: t.collect() for k, t in jobs.report_tables(kb, markers).items()}
    assert tuple(report["totals"][0]) == (5, 8, 3, 3)
    assert [r.rank for r in report["frequency"]] == [1, 2, 3, 4, 5]
    top = report["details"][0]
    assert (top.title, top.tracked_by, top.category) == ("follows the journal", "#4321, #4322", "test-race")
    assert [tuple(r) for r in report["categories"]] == [("uncategorized", 6), ("test-race", 2)]
    assert [r.issue for r in report["stale_markers"]] == [9999]
    assert len(report["recent_runs"]) == 8

    # links and categories outlive another ingest
    run()
    row = kb.lookup(top.signature_hash).first()
    assert (row.linked_issues, row.category, row["count"]) == ([4321, 4322], "test-race", 2)

    jobs.write_tables(jobs.report_tables(kb), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "frequency")).count() == 5
    jobs.write_index(kb, str(tmp_path / "index"))
    head = spark.read.json(str(tmp_path / "index" / "head")).first()
    assert (head.pattern_count, head.runs_scanned, head.total_occurrences) == (5, 3, 8)
    assert head.categories.asDict() == {"test-race": 1, "uncategorized": 4}

    # out as documents and in again
    jobs.export_documents(kb, str(tmp_path / "docs"))
    other = KnowledgeBase(spark, str(tmp_path / "kb2"))
    jobs.import_documents(other, read_documents(spark, str(tmp_path / "docs"), lines=True))
    assert core_rows(other) == EXPECTED
    for name, table in kb.patterns().tables().items():
        cols = [c for c in table.columns if c != "ord"]
        copy = other.patterns().tables()[name]
        assert table.select(cols).exceptAll(copy.select(cols)).isEmpty(), name
    kb = other
    assert run() == (8, 5, 0) and core_rows(other) == EXPECTED
    with pytest.raises(ValueError):
        jobs.import_documents(other, read_documents(spark, str(tmp_path / "docs"), lines=True))


def test_broken_documents_are_left_out(spark, tmp_path):
    good = {"signature": "s|e", "signature_hash": "00", "title": "t", "unknown": 1}
    (tmp_path / "00.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "01.json").write_text("{broken")
    (tmp_path / "02.json").write_text(json.dumps({"signature": "s", "title": "t"}))
    rows = read_documents(spark, str(tmp_path)).collect()
    assert [(r.signature_hash, r["count"], r.first_seen, r.category) for r in rows] == [("00", 0, "", "")]


def test_a_lost_job_leaves_no_trace(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase(spark, str(tmp_path))
    first, second = failures(spark, {"run_id": 1}), failures(spark, {"run_id": 2}, start=1)
    jobs.ingest(kb, first, first)

    def lost(*args, **kwargs):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(kb, "commit", lost)
        with pytest.raises(RuntimeError):
            jobs.ingest(kb, second, second)
    assert kb.patterns().core.first()["count"] == 1 and kb.grown("occurrences").count() == 1
    # another job takes the version number of the lost one
    jobs.link(kb, find_markers(source_lines(spark, write_tree(tmp_path / "tree"))))
    assert kb.grown("occurrences").count() == 1
    jobs.ingest(kb, second, second)
    assert kb.patterns().core.first()["count"] == 2 and kb.grown("occurrences").count() == 2


def test_stream_of_logs(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    checkpoint = str(tmp_path / "checkpoint")
    logs = read_log_stream(spark, land_logs(tmp_path / "logs"))

    def run():
        runs, artifacts = tables(spark)
        return failed_runs(runs, limit=None), artifacts

    stream_logs(logs, run, kb, checkpoint, "logs").awaitTermination()
    assert core_rows(kb) == EXPECTED
    once = log_failures(read_html_logs(spark, str(tmp_path / "logs")), run_artifacts(*run()))
    streamed = kb.grown("failures")
    assert streamed.count() == 8 and streamed.drop("seq").exceptAll(once.drop("seq")).isEmpty()
    # run 4 has no log artifact; run 5 only a clean one
    assert sorted(r.run_id for r in kb.runs_seen().collect()) == [1, 2, 5]
    folder = tmp_path / "logs" / "run_id=1" / "artifact_id=12"
    (folder / "late.html").write_text("not ok 1 late\n")
    stream_logs(logs, run, kb, checkpoint, "logs").awaitTermination()
    assert core_rows(kb) == {**EXPECTED, "late": (1, RUNS[0][6], RUNS[0][6])}


def test_stream_counts_once(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    landing = str(tmp_path / "landing")
    batches = [
        failures(spark, *[{"run_id": i} for i in range(a, b)], start=a) for a, b in ((0, 6), (3, 9))
    ]
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(landing)
        stream = read_failure_stream(spark, landing)
        stream_failures(stream, kb, str(tmp_path / "c"), "f").awaitTermination()
    assert kb.patterns().core.first()["count"] == 9
    # a batch that is delivered again is recognised by query and number
    (query,) = {r.source for r in kb._commits().collect()}
    assert jobs.ingest(kb, batches[1], batches[1], query, 1) is None
    # and so are its failures under another number
    jobs.ingest(kb, batches[1], batches[1], "f", 2)
    assert kb.patterns().core.first()["count"] == 9 and kb.runs_seen().count() == 9


def test_watermarked_occurrences(spark, tmp_path):
    failures(spark, {}, {}, {"run_id": 2}, {"run_id": 3, "created_at": ""}).coalesce(1).write.parquet(
        str(tmp_path / "in")
    )
    stream = distinct_occurrences(read_failure_stream(spark, str(tmp_path / "in")))
    query = (
        stream.writeStream.format("memory").queryName("distinct_occurrences")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("distinct_occurrences").count() == 3


def test_command_line(spark, tmp_path):
    from failsig.__main__ import main

    runs, artifacts = tables(spark)
    runs.write.json(str(tmp_path / "runs"))
    artifacts.write.json(str(tmp_path / "artifacts"))
    logs, tree = land_logs(tmp_path / "logs", zipped=True), write_tree(tmp_path / "tree")
    at, kb = str(tmp_path), ["--kb", str(tmp_path / "kb")]
    tables_of_runs = ["--runs", f"{at}/runs", "--artifacts", f"{at}/artifacts", "--logs", logs]
    main([*kb, "ingest", *tables_of_runs, "--zip", "--event", "push", "--suite", "sys"])
    main([*kb, "link", tree])
    main([*kb, "analyze"])
    main([*kb, "report", "--output", f"{at}/out", "--format", "json", "--checkout", tree])
    assert spark.read.json(f"{at}/out/frequency").count() == 3
    assert spark.read.json(f"{at}/out/stale_markers").count() == 5


def test_a_fresh_checkpoint_is_another_query(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    for k in range(2):
        landing = str(tmp_path / f"landing{k}")
        failures(spark, {"run_id": k}, start=k).coalesce(1).write.parquet(landing)
        stream = read_failure_stream(spark, landing)
        stream_failures(stream, kb, str(tmp_path / f"c{k}"), "f").awaitTermination()
    assert kb.patterns().core.first()["count"] == 2


def test_logs_that_land_before_their_run_wait_for_it(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    checkpoint = str(tmp_path / "checkpoint")
    logs = read_log_stream(spark, land_logs(tmp_path / "logs"))
    landed = [{1}, {1, 5}, {1, 2, 5}]
    runs, artifacts = tables(spark)

    def run():
        return failed_runs(runs, limit=None).filter(runs.run_id.isin(landed[0])), artifacts

    for k in range(3):
        note = tmp_path / "logs" / "run_id=3" / "artifact_id=31" / f"more{k}.html"
        note.write_text("nothing")
        stream_logs(logs, run, kb, checkpoint, "logs").awaitTermination()
        assert {r.run_id for r in kb.runs_seen().collect()} == landed[0]
        if k < 2:
            landed.pop(0)
    assert core_rows(kb) == EXPECTED


def test_long_documents_come_back_whole(spark, tmp_path):
    from failsig.operators import fold
    from failsig.sources.documents import write_documents

    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    rows = [
        {"run_id": i, "test_name": f"t{i % 7}", "test_file": f"f{i % 5}.go:3"} for i in range(30)
    ]
    one = failures(spark, *rows).withColumn("signature_hash", F.lit("00"))
    jobs.ingest(kb, one)
    write_documents(fold.documents(kb.patterns(), part_items=2), str(tmp_path / "docs"))
    other = KnowledgeBase(spark, str(tmp_path / "kb2"))
    jobs.import_documents(other, read_documents(spark, str(tmp_path / "docs"), lines=True))
    for name, column in (("tests", "test_name"), ("files", "file")):
        want = [r[column] for r in kb.patterns().tables()[name].orderBy("ord").collect()]
        got = [r[column] for r in other.patterns().tables()[name].orderBy("ord").collect()]
        assert got == want and len(want) in (5, 7)
    assert other.patterns().core.count() == kb.patterns().core.count()


def test_archives_nobody_wants_are_not_read(spark, tmp_path):
    root = land_logs(tmp_path / "logs", zipped=True)
    (tmp_path / "logs/run_id=3/artifact_id=31/logs.zip").write_bytes(b"broken")
    (tmp_path / "logs/run_id=1/artifact_id=11/logs.zip").write_bytes(b"broken too")
    runs, artifacts = tables(spark)
    failed = failed_runs(runs, limit=None)
    logs = read_zip_logs(spark, root, [(2, 21)])
    plan = logs._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "run_id" in plan.split("PartitionFilters: [")[1][:80]
    assert {r.artifact_id for r in logs.collect()} == {21}
    # the same with a table of keys, of which the driver sees nothing
    keys = frozen(spark.createDataFrame([(0, 2, 21), (1, 3, 31)], "n int, run_id long, artifact_id long"))
    for read, path in ((read_zip_logs, root), (read_html_logs, land_logs(tmp_path / "html"))):
        logs = read(spark, path, keys.filter("n < 1").select("run_id", "artifact_id"))
        plan = logs._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert {r.artifact_id for r in logs.collect()} == {21}

    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    stats = jobs.ingest_logs(
        kb, lambda keys: read_zip_logs(spark, root, keys), failed, artifacts, per_commit=2
    )
    assert len(stats) == 2 and sum(s[0] for s in stats) == 6
    (bad,) = kb.grown("skipped").collect()
    assert (bad.run_id, bad.artifact_id) == (1, 11) and bad.error.startswith("BadZipFile")
    assert sorted(r.run_id for r in kb.runs_seen().collect()) == [1, 2, 5]
    want = {k: v for k, v in EXPECTED.items() if k not in ("builds with a secret", "panics")}
    assert core_rows(kb) == want


def test_stale_rows_keep_scan_order(spark, tmp_path):
    from failsig.operators.links import stale_table

    for folder in ("test/farm", "test/system", "test/system/a", "elsewhere"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "x.bats").write_text("# a\nskip # see #4321\nskip # see #4321\n")
    markers = find_markers(source_lines(spark, str(tmp_path)))
    rows = stale_table(markers).orderBy("issue", "place").collect()
    assert [(r.file, r.line) for r in rows] == [
        ("test/system/a/x.bats", 2),
        ("test/system/x.bats", 2),
        ("test/farm/x.bats", 2),
    ]
