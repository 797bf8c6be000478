"""SRC-3, PAR-3..7 for logs that fit neither a row nor a task.

A log is read line by line in byte ranges, as Spark splits files. What a range can't know of the
ranges before it is little, and is found in two steps that meet ranges only as short summaries:

* Whether the range begins within a tag. Each range tells whether it has a ``>`` and whether a
  ``<`` is open at its end; a running maximum over the ranges of a file gives the answer.
* Which block its first lines belong to. Each range cuts its own lines into blocks, emits those
  that begin and end in it, and sums up the lines before its first and after its last block start.
  The summaries of a file are then read in order by the same code.

A block is summed up by the lines that a record can come from (the header, the first lines, the
first assertion, diagnostics, ...), of which there are few however long the block is; summing up
parts and then their sum gives the same as summing up the whole. The blocks are parsed by the
expressions that parse whole logs.

Differences from whole logs: a mark of the grammars whose white space goes on in the next line is
only seen where a block's first lines hold it, or as the name of a result line that has none; a
header is at most ``AHEAD`` lines.
"""

from __future__ import annotations

import html
import re
import sys
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.ci import Keys, log_lines
from .parse import (
    BATS,
    BATS_CAUSE,
    BATS_FILE,
    DIAGNOSTIC_LINES,
    EXCERPT_CHARS,
    GINKGO,
    GINKGO_HEADER,
    parse_texts,
)
from .scale import frozen

# workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AHEAD = 12  # lines that may be needed to tell whether a header begins
FIRST_CHARS = EXCERPT_CHARS + 100  # of a block or an assertion that are kept in any case
TIDY = 500  # lines of an open block after which it is summed up

# How the lines begin that matter, as in the patterns of ``parse``.
_HEADER = re.compile(GINKGO_HEADER, re.MULTILINE)
_MAYBE_HEADER = re.compile(r"(?:\[\+[^\]\n]*\]\s*)?[•*]\s*\[FAILED\]")
_ASSERTION = re.compile(r"\s*\[FAILED\]")
_WHERE = re.compile(r"\s*In \[\w+\] at:\s*\S+:\d+")
_RESULT = re.compile(r"\s*(not ok|ok)\s+\d+")
_NAMELESS = re.compile(r"\s*not ok\s+\d+\s*(?:\|[^|]*\|)?\s*$")
_CAUSE = re.compile(BATS_CAUSE)
_FILE = re.compile(BATS_FILE)
_TAG = re.compile(r"<[^>]+>")


def _packed(line: str) -> int:
    return sum(len(part.strip()) + 1 for part in line.splitlines() if part.strip())


def ginkgo_summary(lines: list[str]) -> list[str]:
    """The lines of a block, or of a part of it, that its record can come from."""
    out = []
    first = message = wheres = after = 0
    found = False
    for i, line in enumerate(lines):
        keep = i < AHEAD or first < FIRST_CHARS
        if keep and i >= AHEAD // 2:
            first += _packed(line)
        if not found and i and _ASSERTION.match(line):
            found = keep = True
        if found and message < FIRST_CHARS:
            keep = True
            message += _packed(line)
        if _WHERE.match(line):
            wheres += 1
            after += found
            keep = keep or wheres <= 2 or (found and after <= 3)
        if keep:
            out.append(line)
    return out


def bats_summary(lines: list[str]) -> list[str]:
    """The same for the other grammar; a line in between keeps kept lines apart."""
    out: list[str] = []
    texts = diagnostics = causes = files = 0
    for line in lines:
        if not line.strip():
            continue
        texts += 1  # the second may be the name of the first
        keep = texts <= 2 or bool(_RESULT.match(line))
        if diagnostics < DIAGNOSTIC_LINES:
            found = sum(part.lstrip().startswith("#") for part in line.splitlines())
            diagnostics += found
            keep = keep or found > 0
        if _CAUSE.search(line):
            causes += 1
            keep = keep or causes == 1
        if _FILE.search(line):
            files += 1
            keep = keep or files == 1
        if keep:
            out.append(line)
        elif out[-1] != "-":
            out.append("-")
    return out


class _Blocks:
    """Cuts lines, each with a key, into blocks. Lines before the first start are ``before``."""

    summary: Callable[[list[str]], list[str]]

    def __init__(self, emit: Callable[[tuple, list[str]], None], certain: bool):
        self.emit = emit
        self.certain = certain  # whether the lines begin where no block can be open
        self.before: list[str] = []
        self.key: tuple | None = None
        self.lines = self.before

    def _add(self, line: str) -> None:
        self.lines.append(line)
        if len(self.lines) >= TIDY:
            self.lines[:] = type(self).summary(self.lines)
            if len(self.lines) > TIDY // 2:  # many short lines that are all wanted
                self.lines[TIDY // 2 :] = type(self).summary(self.lines)[TIDY // 2 :]

    def _start(self, line: str, key: tuple) -> None:
        self.close()
        self.key, self.lines = key, [line]

    def close(self) -> None:
        if self.key is not None:
            self._emit()
        self.key, self.lines = None, []

    def _emit(self) -> None:
        self.emit(self.key, type(self).summary(self.lines))

    def finish(self, last: bool) -> list[str]:
        """Take the last lines; those that can't be told yet unless they are the ``last``."""
        return []


class _BatsBlocks(_Blocks):
    summary = staticmethod(bats_summary)

    def __init__(self, emit, certain):
        super().__init__(emit, certain)
        self.nameless = False

    def feed(self, line: str, key: tuple) -> None:
        if not line.strip():
            self._add(line)
            return
        result = _RESULT.match(line)
        if result and self.certain and not self.nameless:
            self._start(line, key)
            self.nameless = bool(_NAMELESS.match(line))
        else:
            # a first line might be the name of a result in the range before; if it is one
            # without a name itself, so might the next be its name
            self.certain = self.certain or not _NAMELESS.match(line)
            self.nameless = False
            self._add(line)

    def _add(self, line):
        if self.key is None or self.lines[0].lstrip().startswith("not"):
            super()._add(line)

    def _emit(self):
        if self.lines[0].lstrip().startswith("not"):
            super()._emit()

    def close(self):
        super().close()
        self.nameless = False


class _GinkgoBlocks(_Blocks):
    summary = staticmethod(ginkgo_summary)

    def __init__(self, emit, certain):
        super().__init__(emit, certain)
        self.ahead: deque[tuple[str, tuple]] = deque()
        self.skip = 0  # lines that belong to the header before

    def feed(self, line: str, key: tuple) -> None:
        self.ahead.append((line, key))
        if len(self.ahead) >= AHEAD:
            self._take()

    def _take(self, last: bool = True) -> bool:
        line, key = self.ahead[0]
        if self.skip:
            self.skip -= 1
        elif _MAYBE_HEADER.match(line):
            found = _HEADER.match("\n".join(x for x, _ in self.ahead))
            if found:
                self.ahead.popleft()
                self._start(line, key)
                self.skip = found[0].count("\n")
                return True
            if not last:
                return False
        self.ahead.popleft()
        self._add(line)
        return True

    def finish(self, last):
        while self.ahead and self._take(last):
            pass
        rest = [line for line, _ in self.ahead]
        self.ahead.clear()
        return rest


_KINDS = {GINKGO: _GinkgoBlocks, BATS: _BatsBlocks}


class _Range:
    """One byte range of a log: text without tags, and what each grammar makes of it."""

    def __init__(self, head: dict, emit: Callable[[dict], None]):
        self.head, self.out = head, emit
        self.inside, self.closing = head["inside"], head["closing"]
        self.seen = 0  # lines with ">"
        self.held: list[str] = []
        self.joins = self.inside  # the first line goes on from the range before
        self.begin: str | None = None
        self.row = 0
        self.machines = {
            kind: make(self._whole(kind), head["first"]) for kind, make in _KINDS.items()
        }

    def _whole(self, kind: int):
        return lambda key, lines: self.out(self._record(kind, "whole", key[1], lines))

    def _record(self, kind: int, part: str, seq: int, lines: list[str]) -> dict:
        return {"parser_ord": kind, "part": part, "seq": seq, "lines": lines}

    def line(self, text: str) -> None:
        closes = ">" in text
        self.seen += closes
        if self.inside:
            if not closes:
                return
            text = text[text.index(">") + 1 :]
            self.inside = False
        at = text.find("<", text.rfind(">") + 1)
        # a tag that nothing closes is text
        self.inside = at >= 0 and (self.head["later"] or self.seen < self.closing)
        self.held.append(_TAG.sub("", text[:at] if self.inside else text))
        if not self.inside:
            whole = "".join(self.held)
            self.held = []
            if self.joins:
                self.begin, self.joins = whole, False
            else:
                self._feed(whole)

    def _feed(self, text: str) -> None:
        for line in html.unescape(text).split("\n"):
            self.row += 1
            for machine in self.machines.values():
                machine.feed(line, (self.head["start"], self.row))

    def end(self) -> None:
        open_text = "".join(self.held) if self.inside else None
        for kind, machine in self.machines.items():
            rest = machine.finish(self.head["last"])
            edges = {
                "begin": self.begin,
                "joins": self.head["inside"],
                "open": open_text,
                "before": type(machine).summary(machine.before),
                "after": None,
                "after_seq": None,
            }
            if machine.key is None:
                edges["before"] = [*edges["before"], *rest]
            else:
                lines = machine.lines
                if kind == BATS and not lines[0].lstrip().startswith("not"):
                    lines = lines[:1]
                edges["after"] = [*type(machine).summary(lines), *rest]
                edges["after_seq"] = machine.key[1]
            self.out({"parser_ord": kind, "part": "edge", "seq": 0, "lines": [], **edges})


def _joined(kind: int, ranges: Iterable[dict]) -> Iterator[tuple[tuple, list[str]]]:
    """The blocks that reach over borders, from the edges of a log's ranges in order."""
    done: list[tuple[tuple, list[str]]] = []
    machine = _KINDS[kind](lambda key, lines: done.append((key, lines)), True)
    open_text = ""
    for r in ranges:
        row = -1_000_000_000

        def feed(lines, start=r["start"], seq=None):
            nonlocal row
            for i, line in enumerate(lines):
                machine.feed(line, (start, row if seq is None else seq + i / 1_000_000))
                row += 1

        if r["joins"]:
            if r["begin"] is None:  # within one line all along
                open_text += r["open"] or ""
                continue
            feed(html.unescape(open_text + r["begin"]).split("\n"))
        feed(r["before"])
        if r["after"] is not None:
            machine.finish(True)
            machine.close()
            machine.before.clear()
            machine.lines = machine.before
            feed(r["after"], seq=r["after_seq"])
        open_text = r["open"] or ""
    machine.finish(True)
    machine.close()
    yield from done


def _borders(lines: DataFrame) -> DataFrame:
    """For each range of each file what it needs to know of the others."""
    tail = F.substring_index("value", ">", -1)
    closes, opens = F.contains("value", F.lit(">")), F.contains(tail, F.lit("<"))
    ranges = (
        lines.withColumn("id", F.monotonically_increasing_id())
        .groupBy("file", "start")
        .agg(
            F.count_if(closes).alias("closing"),
            F.max(F.when(closes, F.col("id"))).alias("closed"),
            F.max(F.when(opens, F.col("id"))).alias("opened"),
        )
    )
    in_order = Window.partitionBy("file").orderBy("start")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    behind = in_order.rowsBetween(1, Window.unboundedFollowing)
    closing = F.when(F.col("closing") > 0, F.col("start"))
    left_open = F.when(
        F.col("opened").isNotNull() & (F.col("closed").isNull() | (F.col("opened") >= F.col("closed"))),
        F.col("start"),
    )
    last_open, last_closed = F.max(left_open).over(before), F.max(closing).over(before)
    later = F.max(closing).over(behind).isNotNull()
    return ranges.select(
        "file",
        "start",
        F.col("closing").cast("int").alias("closing"),
        later.alias("later"),
        (
            last_open.isNotNull()
            & (last_closed.isNull() | (last_open >= last_closed))
            & (later | (F.col("closing") > 0))
        ).alias("inside"),
        F.max("start").over(before).isNull().alias("first"),
        F.max("start").over(behind).isNull().alias("last"),
    )


_PART = (
    "run_id long, artifact_id long, filename string, file long, start long, parser_ord int,"
    " part string, seq double, lines array<string>, begin string, joins boolean, open string,"
    " before array<string>, after array<string>, after_seq double"
)
_LOG = ("run_id", "artifact_id", "filename", "file")


def _arrow() -> pa.Schema:
    texts = pa.list_(pa.string())
    return pa.schema(
        [
            *[(c, pa.int64()) for c in ("run_id", "artifact_id")],
            ("filename", pa.string()),
            *[(c, pa.int64()) for c in ("file", "start")],
            ("parser_ord", pa.int32()),
            ("part", pa.string()),
            ("seq", pa.float64()),
            ("lines", texts),
            ("begin", pa.string()),
            ("joins", pa.bool_()),
            ("open", pa.string()),
            ("before", texts),
            ("after", texts),
            ("after_seq", pa.float64()),
        ]
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow()
    out: list[dict] = []
    now: _Range | None = None
    facts = [*_LOG, "start", "closing", "later", "inside", "first", "last"]
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("file", "start", "value")]
        for i, (file, start, value) in enumerate(zip(*columns, strict=True)):
            if now is None or (now.head["file"], now.head["start"]) != (file, start):
                if now is not None:
                    now.end()
                head = {c: batch[c][i].as_py() for c in facts}
                log = {c: head[c] for c in (*_LOG, "start")}
                now = _Range(head, lambda r, log=log: out.append({**log, **r}))
            now.line(value)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if now is not None:
        now.end()
        yield pa.RecordBatch.from_pylist(out, schema)


def _join(edges: pd.DataFrame) -> pd.DataFrame:
    edges = edges.sort_values("start")
    kind = int(edges.parser_ord.iloc[0])
    rows = [
        {k: (None if v is None or (isinstance(v, float) and v != v) else v) for k, v in r.items()}
        for r in edges.to_dict("records")
    ]
    head = {c: rows[0][c] for c in _LOG}
    out = [
        {**head, "start": key[0], "parser_ord": kind, "seq": float(key[1]), "lines": lines}
        for key, lines in _joined(kind, rows)
    ]
    return pd.DataFrame(out, columns=[*_LOG, "start", "parser_ord", "seq", "lines"])


def long_log_records(
    spark: SparkSession, path: str, wanted: Keys | None = None, files: str = "*.html"
) -> DataFrame:
    """The records of logs of any size, as ``parse_without_suite(read_html_logs(...))`` has them.

    ``path`` and ``wanted`` are those of :func:`failsig.sources.ci.read_html_logs`. A log is read
    by as many tasks as it has splits (``spark.sql.files.maxPartitionBytes``); none of them holds
    more than a batch of lines and the open block's few kept lines. What is broadcast has one
    short row for each split of the wanted logs. A single line must fit a row.
    """
    lines = log_lines(spark, path, wanted, files)
    borders = frozen(_borders(lines))
    parts = frozen(
        lines.join(F.broadcast(borders), ["file", "start"])
        .select(*_LOG, "start", "value", "closing", "later", "inside", "first", "last")
        .mapInArrow(_scan, _PART)
    )
    columns = [*_LOG, "start", "parser_ord", "seq", "lines"]
    joined = (
        parts.filter("part = 'edge'")
        .groupBy("file", "parser_ord")
        .applyInPandas(
            _join,
            "run_id long, artifact_id long, filename string, file long, start long,"
            " parser_ord int, seq double, lines array<string>",
        )
    )
    blocks = parts.filter("part = 'whole'").select(*columns).unionByName(joined)
    kind = F.col("parser_ord")
    texts = blocks.select(
        *_LOG,
        "start",
        kind.alias("kind"),
        "seq",
        F.when(kind == GINKGO, "int").otherwise("sys").alias("suite"),
        F.array_join("lines", "\n").alias("_text"),
    )
    found = frozen(parse_texts(texts, "_text").filter("pos = 0").drop("pos", "suite"))
    # places in a log: those in its range after those of the ranges before
    before = (
        Window.partitionBy("file", "kind").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        found.groupBy("file", "kind", "start")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("file", "kind", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    in_range = Window.partitionBy("file", "kind", "start").orderBy("seq")
    placed = found.withColumn("rank", F.row_number().over(in_range)).join(
        offsets, ["file", "kind", "start"]
    )
    return placed.select(
        "run_id",
        "artifact_id",
        F.lit(0).alias("file_ord"),
        "filename",
        "parser_ord",
        (F.col("offset") + F.col("rank") - 1).cast("int").alias("pos"),
        "test_name",
        "suite_name",
        "test_file",
        "error_excerpt",
    )
