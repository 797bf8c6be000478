from helpers import folded, write_tree
from pyspark.sql import functions as F

from failsig.operators import links, report
from failsig.sources.tree import source_lines


def markers_of(spark, tmp_path):
    return links.find_markers(source_lines(spark, write_tree(tmp_path / "check out")))


def test_marker_scan(spark, tmp_path):
    rows = markers_of(spark, tmp_path).orderBy("dir_ord", F.split("file", "/"), "line").collect()
    assert [(r.issue, r.file, r.line) for r in rows] == [
        (123456, "test/e2e/a/z_test.go", 2),
        (4444, "test/e2e/a/z_test.go", 3),
        (1234, "test/e2e/a-b/z_test.go", 1),
        (31002, "test/e2e/snapshot_test.go", 2),
        (31001, "test/system/171-quota.bats", 2),
    ]
    assert rows[-1].text == 'skip "FIXME #31001: selinux"'


def test_marker_distance_and_case(spark):
    lines = ["skip " + "x" * 80 + "#1234", "skip" + "x" * 81 + " #1234", "Skipped: #0012", "askip #77777", "skip#123"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line int, text string")
    got = {r.line: r.issue for r in links.find_markers(df).collect()}
    # a run of word characters behind "skip" is part of the keyword
    assert got == {1: 1234, 2: 12, 3: 77777}


def test_link_by_file_name(spark, tmp_path):
    markers = markers_of(spark, tmp_path)
    p = folded(
        spark,
        {"test_name": "a", "test_file": "other/root/171-quota.bats:45"},
        {"test_name": "b", "test_file": "test/e2e/build_test.go:116"},
        {"test_name": "c", "test_file": "z_test.go"},
    )
    core = links.link(p.core, links.pattern_issues(p.files, markers))
    assert {r.title: r.linked_issues for r in core.collect()} == {
        "a": [31001],
        "b": [],
        "c": [1234, 4444, 123456],
    }
    # links found earlier stay
    again = links.link(core, links.pattern_issues(p.files, markers.filter("issue = 1234")))
    assert {r.title: r.linked_issues for r in again.collect()}["a"] == [31001]
    stale = links.stale_table(links.stale_markers(markers, core)).collect()
    assert [tuple(r)[:3] for r in stale] == [(31002, "test/e2e/snapshot_test.go", 2)]


def test_stale_table_shows_a_file_once(spark):
    df = spark.createDataFrame([(1234, "a", 9), (1234, "a", 3), (1234, "b", 5)], "issue int, file string, line int")
    rows = links.stale_table(df).orderBy("issue", "place").collect()
    assert [tuple(r)[:3] for r in rows] == [(1234, "a", 3), (1234, "b", 5)]


def sample(spark):
    p = folded(
        spark,
        {"test_name": "b|" + "x" * 200, "run_id": 1},
        {"test_name": "b|" + "x" * 200, "run_id": 2, "priv": "rootless", "mode": ""},
        {"test_name": "a", "suite": "", "mode": "", "priv": "", "distro": ""},
        {"test_name": "c"},
    )
    given = F.when(F.col("title") == "a", "test-race").otherwise("")
    core = p.core.withColumn("category", given).withColumn("confidence", F.lit("high"))
    return p.with_core(core.withColumn("linked_issues", F.array(F.lit(7), F.lit(12))))


def test_report_tables(spark):
    ranked = report.ranked(sample(spark))
    rows = report.frequency(ranked).orderBy("rank").collect()
    assert [(r.rank, r["count"], r.title, r.dimensions, r.category) for r in rows] == [
        (1, 2, "b\\|" + "x" * 77, "**sys**, **local**, root/rootless, **fedora-prior**", "_uncategorized_"),
        (2, 1, "a", "-", "test-race"),
        (3, 1, "c", "**sys**, **local**, **root**, **fedora-prior**", "_uncategorized_"),
    ]
    detail = report.details(ranked).filter("rank = 2").first()
    assert (detail.first_seen, detail.tracked_by) == ("2026-08-15", "#7, #12")
    assert detail.category == "test-race (confidence: high)"


def test_category_breakdown(spark):
    p = sample(spark)
    rows = report.category_breakdown(p.core).collect()
    assert [tuple(r) for r in rows] == [("uncategorized", 3), ("test-race", 1)]
    none = p.core.withColumn("category", F.lit(""))
    assert report.category_breakdown(none).count() == 0
    tie = p.core.filter("title in ('a', 'c')")
    assert [r.category for r in report.category_breakdown(tie).collect()] == ["test-race", "uncategorized"]


def test_five_recent_runs(spark):
    p = folded(spark, *[{"run_id": i} for i in range(9)])
    rows = report.recent_run_rows(p.recent).orderBy("run_rank").collect()
    assert len(rows) == 5
    assert tuple(rows[0])[1:] == (
        1, "sys-local-root-fedora-prior", "https://ci.invalid/1", "push", "2026-08-15",
    )
