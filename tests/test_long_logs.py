"""Logs read by byte ranges give the records of whole logs, wherever the ranges end."""

import random

import pytest
from pyspark.sql import functions as F
from test_parse import BATS, GINKGO

from failsig.operators import long_logs
from failsig.operators.long_logs import bats_summary, ginkgo_summary, long_log_records
from failsig.plans.failures import parse_without_suite
from failsig.sources.ci import read_html_logs

HEADER = "* [FAILED] [1]\nSuite {0}\n /x/test/e2e/a.go:{0}\n [It] test {0}\n /x/test/e2e/a.go:{0}\n"


def piece(rng):
    n = rng.randrange(1, 99)
    noise = "".join(rng.choice("ab #`'|<>&;\n ") for _ in range(rng.randrange(60)))
    return rng.choice(
        [
            lambda: GINKGO,
            lambda: BATS,
            lambda: f"ok {n} |035| fine in {n}ms\n",
            lambda: f"not ok {n}{n}\n",
            lambda: f"not ok {n} |04{n % 10}| name {n} in 3ms\n# one\nplain\n#  in test file t/{n}.bats, line {n})\n",
            lambda: f"not ok {n} x\n" + "".join(f"# line {i}\n" for i in range(n)) + "#  `cmd' failed late\n",
            lambda: HEADER.format(n) + "word and more\n" * n,
            lambda: HEADER.format(n) + "pre\n" * (n % 7) + " [FAILED] why " + "long " * n * 9 + "\n"
            + "middle\n" * n + f"  In [It] at: /x/test/e2e/b.go:{n}\nrest\n",
            lambda: HEADER.format(n) + "[FAILED] no place\n" * 3,
            lambda: "* [FAILED] not a header\n\nanything\n",
            lambda: f"<span\ntitle='x\n{n}'>in a <b>tag</b></span>\n",
            lambda: f"text &amp; more &lt;b&gt; &#10;not ok {n} decoded &eacute;\n",
            lambda: "\n" * (n % 9),
            lambda: "[FAILED] alone\n In [It] at: /y/test/e2e/z.go:3\n",
            lambda: noise.replace("<", "").replace(">", "") + "\n",
            lambda: "a <\n> b <> c\n",
            lambda: "café   # sep \x0b end\r\n",
        ]
    )()


def log(seed, n=14):
    rng = random.Random(seed)
    return "".join(piece(rng) for _ in range(n)) + rng.choice(["", "end", "<never closed\nok 3 x\nnot ok 4 y"])


def land(path, logs):
    for i, text in enumerate(logs):
        folder = path / f"run_id={i}/artifact_id={10 * i}"
        folder.mkdir(parents=True)
        (folder / "a log.html").write_bytes(text.encode())
    return str(path)


def key(rows):
    return sorted(map(tuple, rows))


@pytest.fixture
def split_size(spark):
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_same_records_for_every_split_size(spark, tmp_path, split_size):
    logs = [log(seed) for seed in range(12)] + ["", "\n", "ok", GINKGO, BATS, BATS + GINKGO]
    root = land(tmp_path / "logs", logs)
    whole = parse_without_suite(read_html_logs(spark, root))
    expected = key(whole.select(*whole.columns).collect())
    assert len(expected) > 80
    for size in (400, 1500, 1 << 20):
        split_size(size)
        got = long_log_records(spark, root)
        assert got.columns == whole.columns
        rows = key(got.collect())
        assert rows == expected, next((a, b) for a, b in zip(rows, expected) if a != b)


def ranges(text, size):
    """The lines of each byte range, and what Spark would say of the ranges."""
    data, out, at = text.encode(), [], 0
    lines = data.split(b"\n")
    if lines and not lines[-1]:
        lines.pop()
    for line in lines:
        start = at // size * size
        if not out or out[-1][0] != start:
            out.append((start, []))
        out[-1][1].append(line.decode())
        at += len(line) + 1
    return out


def by_ranges(text, size):
    """The blocks of one log, by the parts of the operator that don't need Spark."""
    parts = ranges(text, size)
    closing = [sum(">" in x for x in lines) for _, lines in parts]
    opened = None
    heads = []
    for k, (start, lines) in enumerate(parts):
        later = any(closing[k + 1 :])
        heads.append(
            {
                "start": start,
                "closing": closing[k],
                "later": later,
                "inside": bool(opened) and (later or closing[k] > 0),
                "first": k == 0,
                "last": k == len(parts) - 1,
            }
        )
        for line in lines:
            if ">" in line:
                opened = "<" in line[line.rindex(">") :]
            else:
                opened = opened or "<" in line
    found, edges = [], {long_logs.GINKGO: [], long_logs.BATS: []}
    for head, (start, lines) in zip(heads, parts):

        def emit(r, start=start):
            if r["part"] == "whole":
                found.append((r["parser_ord"], (start, r["seq"]), "\n".join(r["lines"])))
            else:
                edges[r["parser_ord"]].append({**r, "start": start})

        part = long_logs._Range(head, emit)
        for line in lines:
            part.line(line)
        part.end()
    for kind, rows in edges.items():
        found += [(kind, k, "\n".join(lines)) for k, lines in long_logs._joined(kind, rows)]
    return [(kind, text) for kind, _, text in sorted(found)]


def test_blocks_for_every_split_size(monkeypatch):
    """Very many borders: each range of a few bytes must leave the blocks as they are."""
    monkeypatch.setattr(long_logs, "TIDY", 30)
    for seed in range(60):
        text = log(seed, 6)
        whole = by_ranges(text, 1 << 30)
        for size in (1, 7, 40, 111, 350, 999):
            assert by_ranges(text, size) == whole, (seed, size)


@pytest.mark.parametrize("summary", [ginkgo_summary, bats_summary])
def test_summaries_add_up(summary):
    for seed in range(200):
        rng = random.Random(seed)
        lines = log(seed, 5).split("\n")
        a, b = sorted(rng.randrange(1, len(lines) + 1) for _ in range(2))
        parts = [summary(x) for x in (lines[:a], lines[a:b], lines[b:]) if x]
        once = summary(lines)
        assert summary([x for p in parts for x in p]) == once
        assert summary(once) == once


def test_a_long_block_stays_small(spark, tmp_path, split_size):
    """One failure of 40 MB: what is kept of it is a few kilobytes."""
    text = HEADER.format(1) + "# noise of a long run\n" * 2_000_000 + "[FAILED] at last\n In [It] at: /x/test/e2e/a.go:9\n"
    root = land(tmp_path / "logs", [text + "not ok 1 a\n" + "# diag\n" * 100_000])
    split_size(1 << 20)
    one, two = long_log_records(spark, root).orderBy("parser_ord").collect()
    assert (one.error_excerpt, one.test_file) == ("at last", "test/e2e/a.go:9")
    assert two.error_excerpt == "\n".join(["diag"] * 12)


def test_only_wanted_logs_are_read(spark, tmp_path, split_size):
    root = land(tmp_path / "logs", [BATS, GINKGO, BATS])
    split_size(100)
    keys = spark.createDataFrame([(2, 20)], "run_id long, artifact_id long")
    rows = long_log_records(spark, root, keys).collect()
    assert {r.artifact_id for r in rows} == {20} and len(rows) == 3
    plan = long_log_records(spark, root).select(F.max("pos"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_ingest_of_long_logs(spark, tmp_path, split_size):
    from test_jobs import EXPECTED, core_rows, land_logs, tables

    from failsig.plans import jobs
    from failsig.sources.ci import failed_runs
    from failsig.sources.knowledge_base import KnowledgeBase

    root = land_logs(tmp_path / "logs")
    runs, artifacts = tables(spark)
    split_size(300)
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    jobs.ingest_logs(
        kb, lambda keys: long_log_records(spark, root, keys), failed_runs(runs, limit=None), artifacts
    )
    assert core_rows(kb) == EXPECTED
