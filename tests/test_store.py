"""The pattern store: deltas, compaction, several writers, lost jobs."""

import os
import threading

import pytest
from helpers import failures
from pyspark.sql import functions as F

from failsig.operators import fold
from failsig.plans import jobs
from failsig.sources import knowledge_base
from failsig.sources.knowledge_base import KnowledgeBase
from failsig.sources.schemas import PATTERN_TABLES


def batch(spark, k, n=6):
    """Failures of two runs; every batch has patterns of its own and shares others."""
    changes = [
        {
            "run_id": 10 * k + i % 2,
            "error_excerpt": f"broken thing {'shared' if i < 3 else 'x' * (k + 1)} at step",
            "test_name": f"test {i % 4} of {k % 2}",
            "suite": ["sys", "int", "unit"][(i + k) % 3],
            "created_at": f"2026-0{1 + k % 9}-15T10:0{i}:00Z",
        }
        for i in range(n)
    ]
    return failures(spark, *changes, start=100 * k)


def rows(patterns):
    """All rows but the batch numbers, which only order them."""
    out = {}
    for name, table in patterns.tables().items():
        columns = sorted(c for c in table.columns if c != "ord")
        out[name] = sorted(map(str, table.select(*columns).collect()))
    return out


def whole(spark, ks):
    """The same patterns from one fold after another, without a store."""
    total = None
    for number, k in enumerate(ks, 1):
        df = batch(spark, k)
        part = fold.fold(fold.occurrences(df), fold.signatures(df), batch=number)
        total = part if total is None else fold.merge(total, part)
    return rows(total)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def folders(path, table):
    return sorted(f for f in os.listdir(f"{path}/{table}") if f.startswith("version="))


def test_batches_add_up_like_one_fold(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    ks = [3, 1, 3]
    for k in ks:
        jobs.ingest(kb, batch(spark, k))
    assert kb.deltas() == len(ks) - 1
    expected = whole(spark, [3, 1])  # the second time nothing counts
    assert rows(kb.patterns()) == expected
    assert kb.compact() and kb.deltas() == 0
    assert rows(kb.patterns()) == expected
    assert not kb.compact()
    jobs.ingest(kb, batch(spark, 6))
    assert rows(kb.patterns()) == whole(spark, [3, 1, 6])


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    """A store of many patterns is not written again for a small batch."""
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    many = spark.range(20_000).select(
        F.concat(F.lit("broken "), F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop")).alias("e"),
        F.col("id").alias("n"),
    )
    one = failures(spark, {})
    big = one.drop("error_excerpt", "signature", "signature_hash").crossJoin(many)
    big = big.select(
        *[c for c in one.columns if c in big.columns],
        F.col("e").alias("error_excerpt"),
        F.col("e").alias("signature"),
        F.substring(F.sha2("e", 256), 1, 16).alias("signature_hash"),
    )
    jobs.ingest(kb, big)
    store = sum(size(f"{kb.root}/{t}") for t in PATTERN_TABLES)
    for k in (2, 3):
        before = size(kb.root)
        jobs.ingest(kb, batch(spark, k))
        # a small batch costs some small files, far less than any table of the store
        assert size(kb.root) - before < store / 10
    assert kb.patterns().core.count() == 20_000 + 3


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    for k in (1, 2):
        jobs.ingest(kb, batch(spark, k))
    for row in kb.patterns().core.collect():
        found = kb.lookup(row["signature_hash"])
        assert found.collect() == [row]
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
        assert scans and all("(bucket#" in line and "EqualTo(signature_hash," in line for line in scans)


def test_a_batch_opens_only_the_ledger_files_of_its_runs(spark, tmp_path):
    """One very old and one new run open two files, whatever lies between them."""
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    for k in range(1, 6):
        jobs.ingest(kb, batch(spark, k))

    def opened(*runs):
        wanted = spark.createDataFrame([(r,) for r in runs], "run_id long")
        return kb.ledger(kb.state(), wanted).inputFiles()

    old_and_new = opened(10, 51)
    assert len(old_and_new) == 2
    both = spark.read.parquet(*old_and_new)
    assert both.filter("run_id in (10, 51)").count() == (
        kb.grown("occurrences").filter("run_id in (10, 51)").count()
    )
    assert opened(999) == [] and len(opened(20, 20, 999)) == 1
    assert kb.compact() and len(kb.state().tables["ledger_files"]) == 1
    assert sorted(opened(10, 51)) == sorted(old_and_new)
    # a batch across all times counts what is new in it and nothing twice
    mixed = batch(spark, 1).union(batch(spark, 6))
    jobs.ingest(kb, mixed)
    counts = {r["signature_hash"]: r["count"] for r in kb.patterns().core.collect()}
    df = batch(spark, 1)
    for k in range(2, 7):
        df = df.union(batch(spark, k))
    expected = fold.pattern_counts(fold.occurrences(df)).collect()
    assert counts == {r["signature_hash"]: r["count"] for r in expected}


def test_a_lost_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    for k in (1, 2, 3):
        jobs.ingest(kb, batch(spark, k))
    before, state = rows(kb.patterns()), kb.state()

    def lost(*args, **kwargs):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(kb, "commit", lost)
        with pytest.raises(OSError, match="lost"):
            kb.compact()
    assert kb.state() == state and rows(kb.patterns()) == before
    assert len(folders(kb.root, "core")) == 4
    # the folder it left goes when it is old
    monkeypatch.setattr(knowledge_base, "ORPHANED", -1)
    assert kb.clean() == len(PATTERN_TABLES) + 1  # and the index of the ledger
    assert len(folders(kb.root, "core")) == 3 and rows(kb.patterns()) == before


def test_old_folders_go_after_a_while(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knowledge_base, "KEPT", 1)
    monkeypatch.setattr(jobs, "DELTAS", 2)
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    for k in range(1, 6):
        jobs.ingest(kb, batch(spark, k))
    assert kb.deltas() < 2 and len(folders(kb.root, "core")) <= 4
    assert rows(kb.patterns()) == whole(spark, range(1, 6))


def test_two_writers_lose_nothing(spark, tmp_path):
    """Each reads the same state; the second one to commit keeps its delta as written."""
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    jobs.ingest(kb, batch(spark, 1))
    errors = []

    def work(ks):
        try:
            for k in ks:
                jobs.ingest(KnowledgeBase(spark, kb.root), batch(spark, k))
        except Exception as e:  # shown below
            errors.append(e)

    writers = [threading.Thread(target=work, args=(ks,)) for ks in ([2, 3], [4, 5], [5, 2])]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors
    core = {r["signature_hash"]: r["count"] for r in kb.patterns().core.collect()}
    df = batch(spark, 1)
    for k in (2, 3, 4, 5):
        df = df.union(batch(spark, k))
    # batches that came twice count once, in whichever order they were in
    expected = fold.pattern_counts(fold.occurrences(df)).collect()
    assert core == {r["signature_hash"]: r["count"] for r in expected}
    versions = sorted(r["version"] for r in kb._commits().collect())
    assert versions == list(range(1, 8))


def test_the_second_of_two_equal_batches_is_folded_again(spark, tmp_path, monkeypatch):
    """Both read the ledger before either wrote to it."""
    kb, other = (KnowledgeBase(spark, str(tmp_path / "kb")) for _ in range(2))
    publish, first = kb._publish, []

    def late(version, text):
        if not first:
            first.append(1)
            jobs.ingest(other, batch(spark, 2))
        return publish(version, text)

    monkeypatch.setattr(kb, "_publish", late)
    jobs.ingest(kb, batch(spark, 2))
    assert {k: v for k, v in rows(kb.patterns()).items() if k != "core"} == {
        k: v for k, v in whole(spark, [2]).items() if k != "core"
    }
    assert kb.grown("occurrences").count() == fold.occurrences(batch(spark, 2)).count()


def test_a_base_takes_along_later_deltas(spark, tmp_path, monkeypatch):
    kb, other = (KnowledgeBase(spark, str(tmp_path / "kb")) for _ in range(2))
    for k in (1, 2):
        jobs.ingest(kb, batch(spark, k))
    publish, first = kb._publish, []

    def late(version, text):
        if not first:
            first.append(1)
            jobs.ingest(other, batch(spark, 3))
        return publish(version, text)

    monkeypatch.setattr(kb, "_publish", late)
    assert kb.compact() and kb.deltas() == 1
    assert rows(kb.patterns()) == whole(spark, [1, 2, 3])


def test_of_two_bases_one_starts_anew(spark, tmp_path, monkeypatch):
    """A change of all patterns isn't lost to a compaction that read them before."""
    kb, other = (KnowledgeBase(spark, str(tmp_path / "kb")) for _ in range(2))
    for k in (1, 2):
        jobs.ingest(kb, batch(spark, k))
    publish, first = kb._publish, []

    def titled(patterns):
        return patterns.with_core(patterns.core.withColumn("title", F.lit("new")))

    def late(version, text):
        if not first:
            first.append(1)
            other.replace_patterns(titled, ["core"])
        return publish(version, text)

    monkeypatch.setattr(kb, "_publish", late)
    assert not kb.compact()
    assert {r["title"] for r in kb.patterns().core.collect()} == {"new"}
    # and the other way round the change is made again, on the new base
    first.clear()
    monkeypatch.setattr(kb, "_publish", publish)
    jobs.ingest(kb, batch(spark, 3))
    publish_other = other._publish

    def late_too(version, text):
        if not first:
            first.append(1)
            assert kb.compact()
        return publish_other(version, text)

    monkeypatch.setattr(other, "_publish", late_too)
    other.replace_patterns(titled, ["core"])
    assert {r["title"] for r in kb.patterns().core.collect()} == {"new"}
    assert kb.patterns().core.count() == len(whole(spark, [1, 2, 3])["core"])
