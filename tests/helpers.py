"""Small inputs for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from failsig.functions.normalize import with_fingerprint
from failsig.operators import fold
from failsig.sources import schemas

RECORD = {
    "test_name": "volume list shows labels",
    "error_excerpt": "unexpected output",
    "test_file": "test/system/044-journal.bats:71",
    "suite": "sys",
    "mode": "local",
    "priv": "root",
    "distro": "fedora-prior",
    "run_id": 1,
    "created_at": "2026-08-15T10:00:00Z",
    "run_url": "https://ci.invalid/1",
    "run_event": "push",
    "head_sha": "0123456789abcdef",
}


def failures(spark, *changes, start=0):
    """Fingerprinted failures, one per change of the default record, in this order."""
    rows = [{**RECORD, **change, "seq_no": start + i} for i, change in enumerate(changes)]
    schema = ", ".join(
        f"{k} {'bigint' if k in ('run_id', 'seq_no') else 'string'}" for k in [*RECORD, "seq_no"]
    )
    df = with_fingerprint(fold.complete(spark.createDataFrame(rows, schema)))
    zero = F.lit(0).cast("bigint")
    seq = F.struct(
        zero.alias("run_ord"),
        zero.alias("run_tie"),
        F.col("seq_no").alias("artifact_ord"),
        F.lit(0).alias("file_ord"),
        F.lit("").alias("filename"),
        F.lit(0).alias("parser_ord"),
        F.lit(0).alias("pos"),
    )
    df = df.withColumn("seq", seq).withColumn("artifact_id", F.lit(1).cast("bigint"))
    names = spark.createDataFrame([], schemas.FAILURES).columns
    return df.withColumn("suite_name", F.lit("")).select(*names)


def folded(spark, *changes):
    df = failures(spark, *changes)
    return fold.fold(fold.occurrences(df), fold.signatures(df))


def write_tree(root):
    """A checkout with markers in two languages."""
    files = {
        "test/system/171-quota.bats": '@test "quota" {\n    skip "FIXME #31001: selinux"\n}\n',
        "test/e2e/snapshot_test.go": 'func x() {\n\tSkip("FIXME: #31002 - flaky")\n}\n',
        "test/e2e/clean_test.go": "func y() {}\n",
        "test/e2e/a-b/z_test.go": "// skip_if see #1234, skip #5678\n// skip #99\n",
        "test/e2e/a/z_test.go": "line one\r\nfixme (#123456) skipped for #4444\n",
        "test/e2e/notes.txt": "skip #5555\n",
        "pkg/x_test.go": "skip #6666\n",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(root)
