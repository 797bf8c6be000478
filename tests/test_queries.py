"""Every registered query against its SQL on the smallest tables, and what the plans look like."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from failsig.plans.oracle import ORACLE
from failsig.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def in_order(rows):
    return sorted(rows, key=lambda row: tuple((x is None, str(x)) for x in row))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    result = sql.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = result.fetchall()
    assert in_order([tuple(row[c] for c in columns) for row in got]) == in_order(expected)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["signature_hash", "count", "first_seen", "last_seen", "title"]
    counts = [r["count"] for r in df.collect()]
    assert counts == sorted(counts, reverse=True) and counts[0] > 1


def plan(spark, name, kind="executedPlan"):
    query = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution()
    return getattr(query, kind)().toString()


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.items() <= entry.queries().items()


def test_every_rule_and_cap_has_data(spark):
    """Each normalisation rule changes a row of the derived failures, and so does each cut."""
    import re

    from failsig.functions.normalize import RULES
    from failsig.plans.derived import view

    rows = view(spark, SF_DIR, "failures_v").collect()
    fired = set()
    for row in rows:
        text = row["error_excerpt"]
        for i, (pattern, replacement, ignore_case) in enumerate(RULES):
            after = re.sub(pattern, replacement, text, flags=re.IGNORECASE if ignore_case else 0)
            if after != text:
                fired.add(i)
            text = after
    assert fired == set(range(len(RULES)))
    assert any(len(r["error_excerpt"]) > 2000 for r in rows)
    assert any(len(r["test_name"]) > 120 and "|" in r["test_name"] for r in rows)
    assert any(len(r["head_sha"]) > 12 for r in rows)


def test_recent_runs_are_cut_before_the_shuffle(spark):
    text = plan(spark, "recent_runs")
    assert text.index("WindowGroupLimit") < text.rindex("Exchange hashpartitioning(signature_hash")
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["signature_hash", "pattern_counts", "link_issues", "log_ingest"])
def test_the_regex_chain_runs_once(spark, name):
    assert plan(spark, name, "optimizedPlan").count("<SHA256>") == 2  # test name and error


def test_scans_are_pruned(spark):
    text = plan(spark, "failed_runs_topn")
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in text or "o_orderstatus" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:" in text
    assert "o_totalprice" not in text and "TakeOrderedAndProject" in text


def test_log_text_is_not_shuffled(spark, tmp_path):
    """The join with run data comes after the parser."""
    from test_jobs import land_logs, tables

    from failsig.plans.failures import log_failures, run_artifacts
    from failsig.sources.ci import failed_runs, read_html_logs

    runs, artifacts = tables(spark)
    logs = read_html_logs(spark, land_logs(tmp_path))
    wanted = run_artifacts(failed_runs(runs, limit=None), artifacts)
    text = log_failures(logs, wanted)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.splitlines() if "value#" in line and "FileScan" in line)
    depth = scan.index("FileScan")
    below = text[: text.index(scan)].splitlines()
    # walk up from the scan to the parser: no exchange in between
    for line in reversed(below):
        at = len(line) - len(line.lstrip(" :+-*"))
        if at < depth:
            depth = at
            assert "Exchange hashpartitioning" not in line
            if "Generate inline" in line:
                break
    else:
        raise AssertionError("no parser above the scan")


@pytest.mark.parametrize("name", ["link_issues", "pattern_counts", "log_ingest_shuffled", "stale_markers"])
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
