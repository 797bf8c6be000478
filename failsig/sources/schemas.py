"""Schemas of the tables read and written (DDL)."""

from __future__ import annotations

RUNS = (
    "run_id bigint, workflow string, conclusion string, event string, html_url string,"
    " head_sha string, created_at string"
)
ARTIFACTS = "run_id bigint, artifact_id bigint, name string, expired boolean"
JOBS = "run_id bigint, job_id bigint, name string, conclusion string"
LOGS = "run_id bigint, artifact_id bigint, file_ord int, filename string, html string"

# Processing order of a record: newest run first, then artifact, archive member, grammar and
# position in the text. Descending parts are stored negated.
SEQ = (
    "struct<run_ord:bigint,run_tie:bigint,artifact_ord:bigint,file_ord:int,filename:string,"
    "parser_ord:int,pos:int>"
)
ORD = f"struct<batch:bigint,seq:{SEQ}>"

FAILURES = (
    "run_id bigint, run_url string, run_event string, head_sha string, created_at string,"
    " artifact_id bigint, suite string, mode string, priv string, distro string,"
    " dim_label string, test_name string, suite_name string, test_file string,"
    f" error_excerpt string, signature string, signature_hash string, seq {SEQ}"
)
OCCURRENCES = (
    f"signature_hash string, run_id bigint, dim_label string, seq {SEQ}, run_url string,"
    " run_event string, head_sha string, created_at string, suite string, mode string,"
    " priv string, distro string, test_name string, test_file string"
)

CORE = (
    "signature_hash string, count bigint, first_seen string, last_seen string,"
    f" ord {ORD}, signature string, title string, category string, confidence string,"
    " analysis string, mitigation string, linked_issues array<int>"
)
TESTS = f"signature_hash string, test_name string, ord {ORD}"
FILES = f"signature_hash string, file string, ord {ORD}"
AXES = "signature_hash string, axis string, value string, n bigint"
RECENT = (
    "signature_hash string, run_id bigint, url string, event string, sha string,"
    f" created_at string, dimensions string, ord {ORD}"
)
PATTERN_TABLES = {
    "core": CORE,
    "tests": TESTS,
    "files": FILES,
    "axes": AXES,
    "recent": RECENT,
}
RUNS_SEEN = "run_id bigint"
# which file of the ledger holds occurrences of a run; ``file`` counts from the ledger's folder
LEDGER_FILES = "run_id bigint, file string"
SKIPPED = "run_id bigint, artifact_id bigint, filename string, error string"
# ``data`` names the folders a commit wrote; ``tables`` has the folders that make up each pattern
# table from this commit on, the first of them the base and the others deltas.
COMMITS = (
    "version bigint, source string, batch_id bigint, appended boolean, data bigint,"
    " tables map<string,array<bigint>>"
)

# One JSON document per pattern, or several where its lists are long.
DOCUMENTS = (
    "signature string, signature_hash string, title string, schema_version string,"
    " count bigint, first_seen string, last_seen string, tests array<string>,"
    " test_files array<string>, dimensions map<string,map<string,bigint>>,"
    " recent_runs array<struct<run_id:bigint,url:string,event:string,sha:string,"
    "created_at:string,dimensions:string>>, category string, confidence string,"
    " analysis string, mitigation string, linked_issues array<int>, part int"
)
