import random

import pytest
from helpers import failures, folded
from pyspark.sql import functions as F

from failsig.functions.dimensions import AXES
from failsig.operators import fold, index
from failsig.operators.scale import salted_join, with_position


def one(patterns):
    (row,) = patterns.core.collect()
    return row


def test_runs_add_up_in_one_pattern(spark):
    row = one(folded(spark, {"run_id": 1}, {"run_id": 2}))
    assert (row["count"], row.title) == (2, "volume list shows labels")


def test_a_run_and_label_count_once(spark):
    assert one(folded(spark, {}, {}, {}))["count"] == 1


def test_labels_of_one_run_count_apart(spark):
    assert one(folded(spark, {"distro": "fedora"}, {"distro": "debian"}))["count"] == 2


def test_axis_counts(spark):
    p = folded(
        spark,
        {"run_id": 1, "priv": "rootless"},
        {"run_id": 2, "priv": "rootless"},
        {"run_id": 3, "priv": "root", "mode": ""},
    )
    got = {(r.axis, r.value): r.n for r in p.axes.collect()}
    assert got == {
        ("suite", "sys"): 3,
        ("mode", "local"): 2,
        ("priv", "rootless"): 2,
        ("priv", "root"): 1,
        ("distro", "fedora-prior"): 3,
    }


def test_time_range_ignores_order_and_blanks(spark):
    times = ["", "2026-08-10T00:00:00Z", "2026-08-01T00:00:00Z"]
    row = one(folded(spark, *[{"run_id": i, "created_at": t} for i, t in enumerate(times)]))
    assert (row.first_seen, row.last_seen) == (times[2], times[1])
    row = one(folded(spark, {"created_at": ""}))
    assert (row.first_seen, row.last_seen) == ("", "")


def test_ten_latest_runs(spark):
    p = folded(spark, *[{"run_id": i} for i in range(1, 16)])
    assert one(p)["count"] == 15
    runs = p.recent.orderBy(F.desc("ord")).collect()
    assert [r.run_id for r in runs] == list(range(15, 5, -1))
    assert runs[0].sha == "0123456789ab" and runs[0].dimensions == "sys-local-root-fedora-prior"


def test_different_failures_stay_apart(spark):
    assert folded(spark, {"test_name": "build"}, {"test_name": "run"}).core.count() == 2


def brute_force(records):
    """The fold written as a loop over records in order."""
    patterns = {}
    for r in records:
        p = patterns.setdefault(
            r.signature_hash,
            dict(count=0, first="", last="", tests=[], files=[], axes={}, runs=[], title=r.test_name[:120], keys=set()),
        )
        if (r.run_id, r.dim_label) in p["keys"]:
            continue
        p["keys"].add((r.run_id, r.dim_label))
        p["count"] += 1
        if r.created_at:
            p["first"] = min(p["first"] or r.created_at, r.created_at)
            p["last"] = max(p["last"], r.created_at)
        if r.test_name not in p["tests"]:
            p["tests"].append(r.test_name)
        file = r.test_file.split(":")[0]
        if file and file not in p["files"]:
            p["files"].append(file)
        for axis in AXES:
            if r[axis]:
                values = p["axes"].setdefault(axis, {})
                values[r[axis]] = values.get(r[axis], 0) + 1
        p["runs"] = [(r.run_id, r.dim_label), *p["runs"]][:10]
    return patterns


def random_changes(n, seed):
    """A third of the rows share one signature."""
    rng = random.Random(seed)
    return [
        {
            "test_name": f"test {rng.randint(1, 9)}" if rng.random() < 0.34 else f"t{rng.randint(0, 5)}x",
            "run_id": rng.randint(1, 40),
            "distro": rng.choice(["a", "b", ""]),
            "created_at": rng.choice(["", f"2026-08-{rng.randint(10, 28)}T00:00:00Z"]),
            "test_file": rng.choice(["", "x/a.bats:1", "x/b.bats:2", "c.go"]),
        }
        for _ in range(n)
    ]


def as_dict(docs):
    return {
        d.signature_hash: dict(
            count=d["count"],
            first=d.first_seen,
            last=d.last_seen,
            tests=d.tests,
            files=d.test_files,
            axes=d.dimensions,
            runs=[(r.run_id, r.dimensions) for r in d.recent_runs],
            title=d.title,
        )
        for d in docs.collect()
    }


@pytest.mark.parametrize("partitions", [1, 7])
def test_fold_equals_a_loop(spark, partitions):
    """Rows in any order over any number of partitions give the same patterns."""
    df = failures(spark, *random_changes(600, 1))
    expected = brute_force(df.orderBy("seq").collect())
    for p in expected.values():
        del p["keys"]
    shuffled = df.orderBy(F.xxhash64("seq")).repartition(partitions)
    p = fold.fold(fold.occurrences(shuffled), fold.signatures(shuffled))
    assert as_dict(fold.documents(p)) == expected


def test_batches_equal_a_loop(spark):
    """Three batches with overlap, merged one by one."""
    changes = random_changes(450, 2)
    batches = [failures(spark, *changes[a:b]) for a, b in ((0, 200), (150, 350), (300, 450))]
    records = [r for b in batches for r in b.orderBy("seq").collect()]
    expected = brute_force(records)
    for p in expected.values():
        del p["keys"]
    state, ledger = None, None
    for i, b in enumerate(batches):
        occ = fold.occurrences(b)
        if state is None:
            state, ledger = fold.fold(occ, fold.signatures(b), i), occ.select(*fold.KEY)
        else:
            new = fold.unseen(occ, ledger, b.select("run_id").distinct())
            state = fold.merge(state, fold.fold(new, fold.signatures(b), i))
            ledger = ledger.union(new.select(*fold.KEY))
    assert as_dict(fold.documents(state)) == expected


def test_long_lists_go_on_in_further_rows(spark):
    p = folded(spark, *[{"test_name": f"test {i}", "run_id": i} for i in range(25)])
    docs = fold.documents(p, part_items=10).orderBy("part").collect()
    assert [len(d.tests) for d in docs] == [10, 10, 5]
    assert [t for d in docs for t in d.tests] == [f"test {i}" for i in range(25)]
    assert [d["count"] for d in docs] == [25, None, None]


def test_positions_are_consecutive(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = with_position(df, F.desc("v")).collect()
    assert sorted((r.position, r.v) for r in rows) == [(i, 999 - i) for i in range(1000)]
    assert with_position(df.filter("v < 0"), F.col("v")).count() == 0


def test_salted_join_is_a_join(spark):
    left = spark.range(0, 300).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (5, "d")], "k bigint, v string")
    got = salted_join(left, right, "k", spread="id", salts=4)
    assert got.exceptAll(left.join(right, "k")).count() == 0 and got.count() == 300


def test_totals(spark):
    p = folded(spark, {"run_id": 1}, {"run_id": 2}, {"test_name": "other"})
    runs = spark.createDataFrame([(1,), (2,), (2,), (3,)], "run_id bigint")
    assert index.totals(p.core, runs).first().asDict() == {
        "pattern_count": 2,
        "total_occurrences": 3,
        "recurring": 1,
        "runs_scanned": 3,
    }
    none = p.core.filter("false")
    assert tuple(index.totals(none, runs.filter("false")).first()) == (0, 0, 0, 0)
    head = index.index_document(p.core, runs).first()
    assert head.categories == {"uncategorized": 2} and head.schema_version == "1.0"
    assert index.index_document(none, runs).first().categories == {}


def test_ingest_stats(spark):
    df = failures(spark, {}, {}, {"test_name": "other"})
    known = failures(spark, {})
    assert tuple(index.ingest_stats(df, known.distinct()).first()) == (3, 2, 1)
    assert [r.failures for r in index.failures_per_artifact(df).collect()] == [3]
