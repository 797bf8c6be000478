"""Joins whose sides Spark estimates too low: none of them may pass the driver."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from failsig.operators import scale
from failsig.plans import queries
from failsig.plans.derived import log_texts
from failsig.plans.queries import QUERIES
from failsig.sources.ci import html_logs, land_logs, read_html_logs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    at = datetime(2026, 8, 15, 10)
    events = [(i, at, i % 7, "error") for i in range(60)] + [(None, at, 1, "view")]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string"
    spark.createDataFrame(events, schema).write.parquet(f"{root}/events.parquet")
    orders = [(i, "F" if i else "O", "1-URGENT", at) for i in range(3)]
    schema = "o_orderkey bigint, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"
    spark.createDataFrame(orders, schema).write.parquet(f"{root}/orders.parquet")
    items = [(r, n, 10 * r + n, n, "R", "F") for r in range(3) for n in (1, 2)]
    schema = (
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint,"
        " l_returnflag string, l_linestatus string"
    )
    spark.createDataFrame(items, schema).write.parquet(f"{root}/lineitem.parquet")
    return root


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["failures_per_artifact", "log_ingest", "zip_log_ingest"])
def test_no_log_or_exploded_key_is_broadcast(spark, tables, name):
    df = QUERIES[name](spark, tables)
    assert "BroadcastExchange" not in plan(df)
    assert df.count()


def test_stored_records_come_of_no_broadcast(spark, tables, monkeypatch):
    plans = []

    def stored(df):
        plans.append(plan(df))
        return scale.frozen(df)

    monkeypatch.setattr("failsig.plans.queries.frozen", stored)
    assert QUERIES["log_ingest_shuffled"](spark, tables).count()
    assert len(plans) == 1 and "BroadcastExchange" not in plans[0]


def test_texts_of_several_views_are_those_of_each(spark, tables):
    both = {r.run_id: r for r in log_texts(spark, tables, "lines_v", "blocks_v").collect()}
    assert sorted(both) == [0, 1, 2]  # no log without a run
    for name in ("lines_v", "blocks_v"):
        one = log_texts(spark, tables, name).filter("run_id IS NOT NULL").collect()
        assert {r.run_id: r[name] for r in one} == {k: r[name] for k, r in both.items()}
    assert both[2].blocks_v.count("\n    [It] ") == 10  # a block for each event


def test_salted_join_broadcasts_neither_side(spark):
    left = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    right = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = scale.salted_join(left, right, "k", spread="id")
    assert "Broadcast" not in plan(joined)
    assert joined.count() == 100


def test_landed_logs_come_of_no_broadcast(spark, tables):
    logs, _, _ = queries._job_inputs(spark, tables)
    assert "BroadcastExchange" not in plan(logs)
    assert sorted(r.run_id for r in logs.collect()) == [0, 1, 2]


def test_folders_are_listed_once_for_all_slices(spark, tmp_path):
    def land(artifact):
        folder = tmp_path / "run_id=1" / f"artifact_id={artifact}"
        folder.mkdir(parents=True)
        (folder / "log.html").write_text(f"log {artifact}")

    for artifact in (1, 2):
        land(artifact)
    read = html_logs(spark, str(tmp_path))
    land(3)  # a second listing would find it
    for artifact in (1, 2):
        keys = spark.createDataFrame([(1, artifact)], "run_id bigint, artifact_id bigint")
        whole = read_html_logs(spark, str(tmp_path), keys)
        assert read(keys).collect() == whole.collect()
    assert read(None).count() == 2


def test_landed_files_are_read_back_by_key(spark, tmp_path):
    """Also where names need escapes, ids are missing, and wanted ids are wider than those there."""
    root = str(tmp_path / "a b%41+c")
    rows = [(1, 10, "one\ntwo é"), (2, 20, None), (2, 21, "x"), (3, None, "y")]
    schema = "run_id bigint, artifact_id bigint, html string"
    land_logs(spark.createDataFrame(rows, schema), root, "log.txt")
    read = html_logs(spark, root, "*.txt")
    found = sorted(map(tuple, read(None).select("run_id", "artifact_id", "html").collect()), key=str)
    assert found == [(1, 10, "one\ntwo é\n"), (2, 20, "\n"), (2, 21, "x\n"), (3, None, "y\n")]
    keys = [(1, 10), (2, 21), (3, None), (5_000_000_000, 50_000_000_000)]
    wanted = spark.createDataFrame(keys, "run_id bigint, artifact_id bigint")
    kept = read(wanted)
    assert sorted((r.run_id, r.html) for r in kept.collect()) == [(1, "one\ntwo é\n"), (2, "x\n")]
    assert kept.select("filename").distinct().collect() == [("log.txt",)]
    assert read(wanted.filter("run_id > 3")).count() == 0
    # other files are not opened: they may be gone
    (tmp_path / "a b%41+c/run_id=2/artifact_id=20/log.txt").unlink()
    assert kept.count() == 2


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    rows = spark.range(70).select(
        (F.col("id") % 35).alias("run_id"), F.col("id").alias("artifact_id"), F.lit("x").alias("html")
    )
    land_logs(rows, str(tmp_path))
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        read = html_logs(spark, str(tmp_path))
    finally:
        spark.sparkContext.setJobGroup("others", "others")
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    assert stages and max(s.numTasks for s in stages) <= 8 * spark.sparkContext.defaultParallelism
    assert read(None).select("artifact_id").distinct().count() == 70


def test_a_failure_of_two_windows_is_fingerprinted_once(spark, tables, monkeypatch):
    plans, ingest = [], queries.jobs.ingest

    def seen(kb, window, *more):
        plans.append(plan(window))
        return ingest(kb, window, *more)

    monkeypatch.setattr(queries.jobs, "ingest", seen)
    assert QUERIES["kb_runs_seen"](spark, tables).count()
    assert len(plans) == 2 and not any("regexp_replace" in p for p in plans)
