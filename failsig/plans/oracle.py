"""The registered queries once more, as plain SQL for an independent engine.

Only the derived inputs (the given tables seen as CI data) and the normalisation rule table are
shared with the Spark side; parsing, folding and reporting are written again in SQL.
"""

from __future__ import annotations

from functools import reduce

from ..functions.normalize import RULES
from ..functions.replies import CATEGORIES, PROMPT_CHARS
from .derived import PATTERN_REPLY, view_sql

_AXES = ("suite", "mode", "priv", "distro")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lines_text(value: str) -> str:
    """A literal that may hold line feeds."""
    return " || chr(10) || ".join(_text(line) for line in value.split("\n"))


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _normalized(x: str) -> str:
    def step(inner: str, rule: tuple[str, str, bool]) -> str:
        pattern, replacement, ignore_case = rule
        flags = "gi" if ignore_case else "g"
        return f"regexp_replace({inner}, {_text(pattern)}, {_text(replacement)}, '{flags}')"

    return _trim(reduce(step, RULES, _trim(x)))


_LABEL = "concat_ws('-', " + ", ".join(f"nullif({a}, '')" for a in _AXES) + ")"


def _fingerprints(source: str, name: str = "f", seq: str = "seq") -> list[str]:
    """CTEs that add label, signature and hash to failures."""
    sig = f"{_normalized('test_name')} || '|' || {_normalized('error_excerpt')}"
    return [
        f"{name}_s AS MATERIALIZED (SELECT *, {seq} AS sq, {_LABEL} AS dim_label, {sig} AS signature"
        f" FROM {source})",
        f"{name} AS MATERIALIZED (SELECT *, substr(sha256(signature), 1, 16) AS signature_hash"
        f" FROM {name}_s)",
    ]


def _occurrences(source: str = "f", name: str = "occ", order: str = "sq") -> list[str]:
    return [
        f"{name} AS MATERIALIZED (SELECT * FROM {source} QUALIFY row_number() OVER"
        f" (PARTITION BY signature_hash, run_id, dim_label ORDER BY {order}) = 1)"
    ]


def _counts(source: str = "occ", name: str = "p", order: str = "sq") -> list[str]:
    return [
        f"{name} AS MATERIALIZED (SELECT signature_hash, any_value(signature) AS signature,"
        " count(*) AS count, coalesce(min(nullif(created_at, '')), '') AS first_seen,"
        " max(created_at) AS last_seen,"
        f" substr(arg_min(test_name, {order}), 1, 120) AS title"
        f" FROM {source} GROUP BY signature_hash)"
    ]


def _sql(ctes: list[str], body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


_F = [view_sql("failures_v"), *_fingerprints("failures_v")]
_OCC = [*_F, *_occurrences()]
_P = [*_OCC, *_counts()]

# patterns with the category that PATTERN_REPLY leads to
_CATEGORIZED = [
    *_P,
    "c AS (SELECT *, CASE WHEN substr(signature_hash, 1, 1) < '5' THEN 'test-race'"
    " WHEN substr(signature_hash, 1, 1) < 'a' THEN 'infrastructure' ELSE '' END AS category,"
    " CASE WHEN substr(signature_hash, 1, 1) < '5' THEN 'high' ELSE '' END AS confidence,"
    " CASE WHEN substr(signature_hash, 1, 1) < '5' THEN 'a' ELSE '' END AS analysis FROM p)",
]
assert "'5'" in PATTERN_REPLY and "'a'" in PATTERN_REPLY

_AXIS_ROWS = "ax AS (" + " UNION ALL ".join(
    f"SELECT signature_hash, '{a}' AS axis, {a} AS value, count(*) AS n FROM occ"
    f" WHERE {a} <> '' GROUP BY ALL"
    for a in _AXES
) + ")"

_SUMMARY = [
    _AXIS_ROWS,
    "per_axis AS (SELECT signature_hash, axis, CASE WHEN count(*) = 1"
    " THEN '**' || min(value) || '**' ELSE string_agg(value, '/' ORDER BY value) END AS t"
    " FROM ax GROUP BY ALL)",
    "summary AS (SELECT signature_hash, string_agg(t, ', ' ORDER BY"
    " list_position(['suite', 'mode', 'priv', 'distro'], axis)) AS dimensions"
    " FROM per_axis GROUP BY ALL)",
]

_ISSUE = r"regexp_extract(text, '(?i)(skip\w*|FIXME)\b[^\n]{0,80}?#([0-9]{4,6})', 2)"
_MARKERS = [
    view_sql("markers_v"),
    f"m AS (SELECT cast({_ISSUE} AS INT) AS issue, file, line,"
    f" substr({_trim('text')}, 1, 200) AS text FROM markers_v WHERE {_ISSUE} <> '')",
]
_LINKS = [
    *_OCC,
    *_MARKERS,
    "l AS (SELECT DISTINCT signature_hash, issue FROM occ JOIN m ON"
    " regexp_extract(split_part(test_file, ':', 1), '[^/]*$')"
    " = regexp_extract(file, '[^/]*$'))",
    "stale AS (SELECT * FROM m WHERE issue NOT IN (SELECT issue FROM l))",
]


def _log_lines(lines: str, name: str) -> list[str]:
    """The logs of a view cut into single lines: run_id, n (line number), t (text).

    Lines stand behind a blank time stamp, but for those that carry their own.
    """
    return [
        f"{name}_t AS (SELECT run_id, string_agg(line, chr(10) ORDER BY seq) || chr(10) AS text"
        f" FROM {lines} GROUP BY run_id)",
        f"{name}_l AS (SELECT run_id, unnest(string_split(text, chr(10))) AS t,"
        f" generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {name}_t)",
        f"{name} AS (SELECT run_id, n, CASE WHEN t LIKE '[+%' THEN t ELSE repeat(' ', 9) || t END"
        f" AS t FROM {name}_l)",
    ]


_PATH = (
    "CASE WHEN strpos({0}, '/test/') > 0 THEN substr({0}, strpos({0}, '/test/') + 1)"
    " WHEN strpos({0}, '/pkg/') > 0 THEN substr({0}, strpos({0}, '/pkg/') + 1)"
    " WHEN strpos({0}, '/libpod/') > 0 THEN substr({0}, strpos({0}, '/libpod/') + 1)"
    " WHEN strpos({0}, '/cmd/') > 0 THEN substr({0}, strpos({0}, '/cmd/') + 1) ELSE {0} END"
)

# Second grammar by lines: a running count of result lines numbers the blocks.
_BATS = [
    view_sql("lines_v"),
    *_log_lines("lines_v", "bl"),
    r"bn AS (SELECT *, count(*) FILTER (regexp_matches(t, '^\s*(not ok|ok)\s+\d+')) OVER"
    " (PARTITION BY run_id ORDER BY n) AS b FROM bl)",
    "bg AS (SELECT run_id, b,"
    r" max(t) FILTER (regexp_matches(t, '^\s*not ok\s+\d+')) AS head,"
    r" arg_min(t, n) FILTER (regexp_matches(t, '^\s*#\s+`.+''\s+failed')) AS cause,"
    r" arg_min(t, n) FILTER (regexp_matches(t, 'in test file \S+\.bats, line \d+')) AS src,"
    r" list(trim(substr(trim(t), 2)) ORDER BY n) FILTER (trim(t) LIKE '#%') AS diag"
    " FROM bn GROUP BY run_id, b HAVING head IS NOT NULL)",
    r"bf AS (SELECT *, regexp_extract(head, '\|([^|]*)\|', 1) AS tag,"
    r" regexp_extract(head, 'not ok\s+\d+\s*(?:\|[^|]*\|)?\s*(.+?)(?:\s+in\s+\d+ms)?\s*$', 1)"
    " AS test_name,"
    r" regexp_extract(src, 'in test file (\S+\.bats), line \d+', 1) || ':' ||"
    r" regexp_extract(src, 'in test file \S+\.bats, line (\d+)', 1) AS found,"
    r" regexp_extract(cause, '`(.+?)''\s+failed', 1) AS cmd,"
    r" regexp_extract(cause, '`.+?''\s+failed(.*)$', 1) AS tail FROM bg)",
    "bats AS (SELECT run_id, 1 AS parser_ord,"
    " cast(row_number() OVER (PARTITION BY run_id ORDER BY b) - 1 AS INT) AS pos, test_name,"
    f" tag AS suite_name, {_PATH.format('coalesce(found, tag)')} AS test_file,"
    " substr(CASE WHEN cause IS NOT NULL THEN '`' || cmd || chr(39) || ' failed' || rtrim(tail)"
    " ELSE coalesce(list_aggregate(diag[1:12], 'string_agg', chr(10)), '') END, 1, 2000)"
    " AS error_excerpt FROM bf)",
]

# First grammar by lines: the header line starts a block and its parts are the lines below it.
_GINKGO = [
    view_sql("blocks_v"),
    *_log_lines("blocks_v", "gl"),
    r"gn AS (SELECT *, count(*) FILTER (regexp_matches(t, '\*\s*\[FAILED\]')) OVER"
    " (PARTITION BY run_id ORDER BY n) AS b FROM gl)",
    "gi AS (SELECT *, row_number() OVER (PARTITION BY run_id, b ORDER BY n) AS i FROM gn"
    " WHERE b > 0)",
    "gg AS (SELECT run_id, b, max(t) FILTER (i = 2) AS suite_line, max(t) FILTER (i = 4) AS it,"
    " max(t) FILTER (i = 5) AS loc,"
    r" arg_min(n, n) FILTER (i > 5 AND regexp_matches(t, '^\s*\[FAILED\]')) AS start,"
    r" arg_min(n, n) FILTER (i > 5 AND regexp_matches(t, '^\s*In \[\w+\] at:')) AS stop,"
    r" arg_min(t, n) FILTER (i > 5 AND regexp_matches(t, '^\s*In \[\w+\] at:')) AS at_line,"
    r" list(trim(t) ORDER BY n) FILTER (i > 5 AND trim(t) <> '') AS rest FROM gi GROUP BY run_id, b)",
    "gm AS (SELECT g.run_id, g.b, string_agg(t, chr(10) ORDER BY n) AS message FROM gg g"
    " JOIN gi ON gi.run_id = g.run_id AND gi.b = g.b AND gi.n >= start AND gi.n < stop"
    " GROUP BY g.run_id, g.b)",
    "ginkgo AS (SELECT run_id, 0 AS parser_ord,"
    " cast(row_number() OVER (PARTITION BY run_id ORDER BY b) - 1 AS INT) AS pos,"
    r" trim(regexp_extract(it, '\[It\]\s*(.+)$', 1)) AS test_name, trim(suite_line) AS suite_name,"
    r" coalesce(regexp_extract(at_line, 'at:\s*(\S+:\d+)', 1), trim(loc)) AS path,"
    r" substr(coalesce(regexp_replace(message, '^\s*\[FAILED\]\s*', ''),"
    " substr(list_aggregate(rest, 'string_agg', chr(10)), 1, 600)), 1, 2000) AS error_excerpt"
    " FROM gg LEFT JOIN gm USING (run_id, b))",
]
_RECORD = "run_id, {suite} AS suite, parser_ord, pos, test_name, suite_name, {file}, error_excerpt"
_BATS_ROWS = "SELECT " + _RECORD.replace("{file}", "test_file") + " FROM bats"
_GINKGO_ROWS = (
    "SELECT " + _RECORD.replace("{file}", _PATH.format("path") + " AS test_file") + " FROM ginkgo"
)
# both views derive from failures_v: name it once
_BATS_ONLY = _BATS
_BOTH = [*_BATS, _GINKGO[0].removeprefix(view_sql("failures_v") + ", "), *_GINKGO[1:]]
_SUITE_OF_RUN = "CASE run_id % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'sys' ELSE 'unit' END"

_NAME = r"^([a-z_]+)-(local|remote|)-(root|rootless|)-([a-z0-9._-]+)$"


def _axes_of(name: str) -> str:
    base = f"regexp_replace({name}, '\\.logs$', '')"
    return (
        f"CASE WHEN regexp_matches({base}, '{_NAME}') THEN regexp_extract({base}, '{_NAME}', 1)"
        f" ELSE {base} END AS suite, "
        + ", ".join(
            f"regexp_extract({base}, '{_NAME}', {i}) AS {axis}"
            for i, axis in enumerate(_AXES[1:], 2)
        )
    )


_ARTIFACTS = [
    view_sql("artifacts_v"),
    f"a AS (SELECT *, {_axes_of('name')} FROM artifacts_v"
    " WHERE NOT expired AND name LIKE '%.logs')",
]
_RUN_ARTIFACTS = [
    *_ARTIFACTS,
    view_sql("runs_v"),
    "ra AS (SELECT a.*, r.created_at, r.event FROM a JOIN runs_v r USING (run_id)"
    " WHERE r.conclusion = 'failure')",
]

# the whole path from runs to failures
_JOB = [
    *_BOTH,
    view_sql("artifacts_v"),
    view_sql("runs_v"),
    "ad AS (SELECT run_id, artifact_id, min(name) AS name FROM artifacts_v"
    " WHERE NOT expired AND name LIKE '%.logs' GROUP BY ALL)",
    f"af AS (SELECT run_id, min(artifact_id) AS artifact_id, arg_min(name, artifact_id) AS name,"
    " FROM ad GROUP BY run_id)",
    f"ax_of AS (SELECT run_id, artifact_id, {_axes_of('name')} FROM af)",
    f"rec AS ({_GINKGO_ROWS.replace('{suite} AS suite, ', '')} UNION ALL"
    f" {_BATS_ROWS.replace('{suite} AS suite, ', '')})",
    "jf AS (SELECT rec.*, ax_of.* EXCLUDE (run_id), r.created_at FROM rec"
    " JOIN ax_of USING (run_id) JOIN runs_v r USING (run_id) WHERE r.conclusion = 'failure'"
    " AND NOT (suite = 'int' AND parser_ord = 1) AND NOT (suite = 'sys' AND parser_ord = 0))",
    *_fingerprints(
        "jf", seq="row(-epoch(cast(rtrim(created_at, 'Z') AS TIMESTAMP)), -run_id, parser_ord, pos)"
    ),
]
_JOB_PATTERNS = _sql(
    [*_JOB, *_occurrences(), *_counts()],
    "SELECT signature_hash, count, first_seen, last_seen, title FROM p",
)

# two overlapping windows; a record of both belongs to the first
_WINDOWS = [
    *_F,
    "w AS (SELECT *, CASE WHEN substr(created_at, 9, 2) <= '20' THEN 0 ELSE 1 END AS batch FROM f)",
    *_occurrences("w", "occ", "batch, sq"),
]
_RECENT = (
    "QUALIFY row_number() OVER (PARTITION BY signature_hash ORDER BY {} ) <= {}"
)

_FULL_REPLY = (
    "CASE WHEN id % 6 = 0 THEN {0} WHEN id % 6 = 1 THEN {1} WHEN id % 6 = 2 THEN {2}"
    " WHEN id % 6 = 3 THEN {3} ELSE '' END"
)

ORACLE: dict[str, str] = {
    "failed_runs_topn": _sql(
        [view_sql("runs_v")],
        "SELECT run_id, event, created_at FROM runs_v WHERE conclusion = 'failure'"
        " AND event = 'push' ORDER BY created_at DESC, run_id DESC LIMIT 20",
    ),
    "failed_jobs_all": _sql(
        [view_sql("jobs_v")], "SELECT * FROM jobs_v WHERE conclusion = 'failure'"
    ),
    "artifact_dimensions": _sql(
        _ARTIFACTS,
        f"SELECT run_id, artifact_id, name, suite, mode, priv, distro, {_LABEL} AS dim_label FROM a",
    ),
    "suite_filter": _sql(
        _RUN_ARTIFACTS,
        "SELECT run_id, artifact_id, created_at, event AS run_event,"
        f" {_LABEL} AS dim_label FROM ra WHERE suite = 'sys'",
    ),
    "strip_html": (
        "SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace("
        "regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'),"
        " '&quot;', '\"'), '&#39;', chr(39)), '&middot;', chr(183)), '&copy;', chr(169)),"
        " '&amp;?', '&', 'g') AS text FROM pages"
    ),
    "bats_failures": _sql(_BATS_ONLY, _BATS_ROWS.replace("{suite}", "'sys'")),
    "ginkgo_failures": _sql(_GINKGO, _GINKGO_ROWS.replace("{suite}", "'int'")),
    "mixed_log_failures": _sql(
        _BOTH,
        f"SELECT * FROM ({_GINKGO_ROWS.replace('{suite}', _SUITE_OF_RUN)} UNION ALL"
        f" {_BATS_ROWS.replace('{suite}', _SUITE_OF_RUN)})"
        " WHERE NOT (suite = 'int' AND parser_ord = 1) AND NOT (suite = 'sys' AND parser_ord = 0)"
        " AND run_id IN (SELECT run_id FROM gl_t) AND run_id IN (SELECT run_id FROM bl_t)",
    ),
    "normalize_chain": _sql(
        [view_sql("failures_v")],
        f"SELECT seq, {_normalized('error_excerpt')} AS normalized FROM failures_v",
    ),
    "signature_hash": _sql(_F, "SELECT seq, signature, signature_hash FROM f"),
    "occurrence_dedupe": _sql(
        _OCC, "SELECT signature_hash, run_id, dim_label, seq, test_name, created_at FROM occ"
    ),
    "pattern_counts": _sql(
        _P, "SELECT signature_hash, count, first_seen, last_seen, title FROM p"
    ),
    "pattern_tests": _sql(
        _OCC,
        "SELECT signature_hash, test_name, min(seq) AS first_seq FROM occ GROUP BY ALL",
    ),
    "pattern_files": _sql(
        _OCC,
        "SELECT signature_hash, split_part(test_file, ':', 1) AS file, min(seq) AS first_seq"
        " FROM occ WHERE test_file <> '' GROUP BY ALL",
    ),
    "axis_counts": _sql([*_OCC, _AXIS_ROWS], "SELECT * FROM ax"),
    "recent_runs": _sql(
        _OCC,
        "SELECT signature_hash, run_id, created_at, dim_label AS dimensions, run_url AS url,"
        " run_event AS event, substr(head_sha, 1, 12) AS sha, seq FROM occ "
        + _RECENT.format("seq DESC", 10),
    ),
    "pattern_documents": _sql(
        [
            *_P,
            "t AS (SELECT signature_hash, test_name AS v, min(seq) AS s FROM occ GROUP BY ALL)",
            "fl AS (SELECT signature_hash, split_part(test_file, ':', 1) AS v, min(seq) AS s"
            " FROM occ GROUP BY ALL)",
            "rr AS (SELECT * FROM occ " + _RECENT.format("seq DESC", 10) + ")",
        ],
        "SELECT p.signature_hash, 0 AS part, p.count,"
        " (SELECT string_agg(v, '; ' ORDER BY s) FROM t WHERE t.signature_hash = p.signature_hash)"
        " AS tests,"
        " (SELECT string_agg(v, '; ' ORDER BY s) FROM fl WHERE fl.signature_hash ="
        " p.signature_hash) AS test_files,"
        " (SELECT string_agg(run_id || ' ' || dim_label, '; ' ORDER BY seq DESC) FROM rr"
        " WHERE rr.signature_hash = p.signature_hash) AS recent_runs,"
        " (SELECT nullif(count(*), 0) FROM occ WHERE occ.signature_hash = p.signature_hash"
        " AND priv = 'root') AS on_root FROM p",
    ),
    "incremental_merge": _sql(
        [*_WINDOWS, *_counts(order="row(batch, sq)")],
        "SELECT signature_hash, signature, title, count, first_seen, last_seen FROM p",
    ),
    "incremental_axes": _sql([*_WINDOWS, _AXIS_ROWS], "SELECT * FROM ax"),
    "incremental_recent": _sql(
        _WINDOWS,
        "SELECT signature_hash, run_id, dim_label AS dimensions, cast(batch AS BIGINT) AS batch,"
        " seq FROM occ " + _RECENT.format("batch DESC, seq DESC", 10),
    ),
    "incremental_tests": _sql(
        _WINDOWS,
        "SELECT signature_hash, test_name, cast(m.b AS BIGINT) AS batch, m.s AS seq FROM (SELECT"
        " signature_hash, test_name, min({'b': batch, 's': sq}) AS m FROM occ GROUP BY ALL)",
    ),
    "incremental_files": _sql(
        _WINDOWS,
        "SELECT signature_hash, file, cast(m.b AS BIGINT) AS batch, m.s AS seq FROM (SELECT"
        " signature_hash, split_part(test_file, ':', 1) AS file, min({'b': batch, 's': sq}) AS m"
        " FROM occ WHERE test_file <> '' GROUP BY ALL)",
    ),
    "document_roundtrip": _sql(
        [
            *_OCC,
            "v AS (SELECT signature_hash, 'test' AS kind, test_name AS value, min(seq) AS s"
            " FROM occ GROUP BY ALL UNION ALL SELECT signature_hash, 'file',"
            " split_part(test_file, ':', 1), min(seq) FROM occ WHERE test_file <> '' GROUP BY ALL)",
        ],
        "SELECT signature_hash, kind, value, cast(row_number() OVER (PARTITION BY signature_hash,"
        " kind ORDER BY s) - 1 AS INT) AS place FROM v",
    ),
    "kb_lookup": _sql(
        [*_WINDOWS, *_counts(order="row(batch, sq)")],
        "SELECT signature_hash, title, count FROM p ORDER BY count DESC, signature_hash LIMIT 1",
    ),
    "kb_runs_seen": "WITH {} SELECT DISTINCT run_id FROM failures_v".format(view_sql("failures_v")),
    "index_files": _sql(
        [*_WINDOWS, *_counts(order="row(batch, sq)")],
        "SELECT signature_hash, title, count, '' AS category, last_seen FROM p",
    ),
    "report_files": _sql(
        [*_WINDOWS, *_counts(order="row(batch, sq)"), *_SUMMARY],
        "SELECT row_number() OVER (ORDER BY count DESC, title, signature_hash) AS rank, count,"
        " substr(replace(title, '|', '\\|'), 1, 80) AS title, coalesce(dimensions, '-')"
        " AS dimensions, '_uncategorized_' AS category FROM p LEFT JOIN summary USING"
        " (signature_hash)",
    ),
    "zip_log_ingest": _sql(
        [
            *_JOB,
            "an AS (SELECT run_id, artifact_id, min(name) AS name FROM artifacts_v"
            " WHERE NOT expired AND name LIKE '%.logs' GROUP BY ALL)",
            f"aa AS (SELECT run_id, artifact_id, {_axes_of('name')} FROM an)",
        ],
        "SELECT run_id, artifact_id, suite, count(*) AS failures FROM rec JOIN aa USING (run_id)"
        " JOIN runs_v r USING (run_id) WHERE r.conclusion = 'failure'"
        " AND NOT (suite = 'int' AND parser_ord = 1) AND NOT (suite = 'sys' AND parser_ord = 0)"
        " GROUP BY ALL",
    ),
    "stream_late_runs": _sql(
        [*_JOB, *_occurrences(), *_counts()],
        "SELECT signature_hash, count, first_seen, last_seen FROM p",
    ),
    "pattern_lookup": _sql(
        _P, "SELECT f.seq, f.signature_hash, p.count FROM f JOIN p USING (signature_hash)"
    ),
    "index_summary": _sql(
        _P,
        "SELECT count(*) AS pattern_count, cast(sum(count) AS BIGINT) AS total_occurrences,"
        " count(*) FILTER (count > 1) AS recurring,"
        " (SELECT count(DISTINCT run_id) FROM f) AS runs_scanned FROM p",
    ),
    "index_entries": _sql(
        _CATEGORIZED, "SELECT signature_hash, title, count, category, last_seen FROM c"
    ),
    "category_counts": _sql(
        _CATEGORIZED,
        "SELECT CASE WHEN category = '' THEN 'uncategorized' ELSE category END AS category,"
        " count(*) AS patterns FROM c GROUP BY 1",
    ),
    "runs_coverage": _sql(_RUN_ARTIFACTS, "SELECT DISTINCT run_id FROM ra"),
    "ingest_stats": _sql(
        _F,
        "SELECT count(*) AS failures, count(DISTINCT signature_hash) AS patterns,"
        " count(DISTINCT signature_hash) FILTER (signature_hash NOT IN (SELECT signature_hash"
        " FROM f WHERE substr(created_at, 9, 2) <= '20')) AS new_patterns"
        " FROM f WHERE substr(created_at, 9, 2) >= '10'",
    ),
    "marker_scan": _sql(_MARKERS, "SELECT issue, file, line, text FROM m"),
    "link_issues": _sql(_LINKS, "SELECT * FROM l"),
    "linked_patterns": _sql(
        _LINKS,
        "SELECT o.signature_hash, coalesce(string_agg(cast(issue AS VARCHAR), ',' ORDER BY issue),"
        " '') AS issues"
        " FROM (SELECT DISTINCT signature_hash FROM occ) o LEFT JOIN l USING (signature_hash)"
        " GROUP BY 1",
    ),
    "stale_markers": _sql(_LINKS, "SELECT issue, file, line, text FROM stale"),
    "stale_table": _sql(
        _LINKS,
        "SELECT issue, file, min(line) AS line, file AS place FROM stale GROUP BY issue, file",
    ),
    "report_frequency": _sql(
        [*_CATEGORIZED, *_SUMMARY],
        "SELECT row_number() OVER (ORDER BY count DESC, title, signature_hash) AS rank, count,"
        " substr(replace(title, '|', '\\|'), 1, 80) AS title, coalesce(dimensions, '-')"
        " AS dimensions, CASE WHEN category = '' THEN '_uncategorized_' ELSE category END"
        " AS category FROM c LEFT JOIN summary USING (signature_hash)",
    ),
    "report_details": _sql(
        [
            *_CATEGORIZED,
            *_SUMMARY,
            *_MARKERS,
            _LINKS[-2],
            "tr AS (SELECT signature_hash, string_agg('#' || issue, ', ' ORDER BY issue) AS t"
            " FROM l GROUP BY ALL)",
        ],
        "SELECT row_number() OVER (ORDER BY count DESC, title, signature_hash) AS rank, title,"
        " count, signature_hash, substr(first_seen, 1, 10) AS first_seen,"
        " substr(last_seen, 1, 10) AS last_seen, coalesce(dimensions, '-') AS dimensions,"
        " coalesce(t, '') AS tracked_by,"
        " category || CASE WHEN confidence <> '' THEN ' (confidence: ' || confidence || ')'"
        " ELSE '' END AS category, analysis, '' AS next_step,"
        " substr(signature, 1, 1200) AS signature"
        " FROM c LEFT JOIN summary USING (signature_hash) LEFT JOIN tr USING (signature_hash)",
    ),
    "report_recent_runs": _sql(
        _OCC,
        "SELECT signature_hash, cast(row_number() OVER (PARTITION BY signature_hash"
        " ORDER BY seq DESC) AS INT) AS run_rank, dim_label AS dimensions,"
        " run_url AS url, run_event AS event, substr(created_at, 1, 10) AS date FROM occ " + _RECENT.format("seq DESC", 5),
    ),
    "recurring_patterns": _sql(_P, "SELECT signature_hash, count FROM p WHERE count > 1"),
    "category_breakdown": _sql(
        _CATEGORIZED,
        "SELECT CASE WHEN category = '' THEN 'uncategorized' ELSE category END AS category,"
        " cast(sum(count) AS BIGINT) AS occurrences FROM c"
        " WHERE EXISTS (SELECT 1 FROM c WHERE category <> '') GROUP BY 1",
    ),
    "prompt_text": _sql(
        [
            *_P,
            _AXIS_ROWS,
            "vals AS (SELECT signature_hash, axis, string_agg(value, '/' ORDER BY value) AS v"
            " FROM ax GROUP BY ALL)",
            "dl AS (SELECT signature_hash, string_agg(axis || '=' || v, ', ' ORDER BY axis) AS d"
            " FROM vals GROUP BY ALL)",
        ],
        "SELECT signature_hash, "
        + _lines_text("A CI test failed. Decide on the most likely root cause.\n\nTest: ")
        + " || title || "
        + _lines_text("\nOccurrences: ")
        + " || count || "
        + _lines_text("\nSeen on: ")
        + " || coalesce(d, 'none recorded') || "
        + _lines_text("\n\nSignature (run-specific tokens removed):\n")
        + f" || substr(signature, 1, {PROMPT_CHARS}) || "
        + _lines_text("\n\nError output:\nnot captured\n\nPick one category:\n")
        + " || "
        + _lines_text("\n".join(f"- {c}" for c in CATEGORIES))
        + " || "
        + _lines_text(
            "\n\nChoose deterministic-regression if the code is broken and would fail again."
            '\nAnswer with one JSON object with the string keys "category", "confidence"'
            ' (high, medium or low), "analysis" and "mitigation".\n'
        )
        + " AS prompt FROM p LEFT JOIN dl USING (signature_hash)",
    ),
    "reply_parse": _sql(
        [
            view_sql("replies_v"),
            r"j AS (SELECT id, regexp_extract(content, '(?s)\{.*\}') AS js FROM replies_v)",
            "v AS (SELECT id, CASE WHEN js <> '' AND json_valid(js) THEN js END AS js FROM j)",
        ],
        "SELECT id, js IS NOT NULL AS parsed,"
        " CASE WHEN list_contains(["
        + ", ".join(_text(c) for c in CATEGORIES)
        + "], trim(json_extract_string(js, '$.category')))"
        " THEN trim(json_extract_string(js, '$.category')) ELSE '' END AS category,"
        " coalesce(substr(trim(json_extract_string(js, '$.confidence')), 1, 16), '')"
        " AS confidence,"
        " coalesce(substr(trim(json_extract_string(js, '$.analysis')), 1, 800), '') AS analysis,"
        " coalesce(substr(trim(json_extract_string(js, '$.mitigation')), 1, 800), '')"
        " AS mitigation FROM v",
    ),
    "categorize_patterns": _sql(
        _P,
        "SELECT signature_hash, CASE WHEN signature LIKE '%podman volume%' THEN 'storage-environment'"
        " WHEN signature LIKE '%podman network%' THEN 'network-registry' ELSE '' END AS category,"
        " CASE WHEN signature LIKE '%podman volume%' THEN 'low' ELSE '' END AS confidence FROM p",
    ),
    "log_ingest": _JOB_PATTERNS,
    "log_ingest_shuffled": _JOB_PATTERNS,
    "landed_log_ingest": _sql(
        [*_JOB, *_occurrences(), *_counts()],
        "SELECT signature_hash, count, first_seen, last_seen, title, (SELECT count(DISTINCT run_id)"
        " FROM ad JOIN runs_v USING (run_id) WHERE conclusion = 'failure') AS runs_covered FROM p",
    ),
    "long_log_failures": _sql(
        [
            *_BOTH,
            f"rec AS ({_GINKGO_ROWS.replace('{suite} AS suite, ', '')} UNION ALL"
            f" {_BATS_ROWS.replace('{suite} AS suite, ', '')})",
        ],
        "SELECT run_id % 8 AS run_id, parser_ord, cast(row_number() OVER (PARTITION BY run_id % 8,"
        " parser_ord ORDER BY run_id, pos) - 1 AS INT) AS pos, test_name, suite_name, test_file,"
        " error_excerpt FROM rec",
    ),
    "tree_scan": (
        "WITH l AS (SELECT p_partkey % 5 AS dir_ord, p_partkey % 7 AS area, p_name || ' #' || p_size AS text,"
        " row_number() OVER (PARTITION BY p_partkey % 5, p_partkey % 7 ORDER BY p_partkey) AS line"
        " FROM part WHERE p_partkey % 5 < 4),"
        # each file ends with a line feed, after which an empty line counts
        " a AS (SELECT * FROM l UNION ALL SELECT dir_ord, area, '', max(line) + 1 FROM l GROUP BY ALL)"
        " SELECT cast(dir_ord AS INT) AS dir_ord, ['test/e2e', 'test/system', 'test/upgrade',"
        " 'test/farm'][dir_ord + 1] || '/area=0' || area || '-x y' AS folder,"
        " cast(line AS INT) AS line, text FROM a"
    ),
    "failures_per_artifact": _sql(
        _JOB, "SELECT run_id, artifact_id, count(*) AS failures FROM f GROUP BY ALL"
    ),
    "stream_ingest": _sql(
        _P, "SELECT signature_hash, count, first_seen, last_seen, title FROM p"
    ),
}
