"""PAR-3..7: log text to one row per failed test.

Both grammars run over one evaluation of the stripped text, so a log is read and cleaned once.
Each block is cut out of the text with its failure header at the front, then the fields are
taken from the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import decode_entities, strip_tags
from ..functions.text import first_chars, java_regex, lines_after, pack_lines, rstrip, strip

# The shapes of the two log grammars.
GINKGO_HEADER = (
    r"^(?:\[\+[^\]\n]*\]\s*)?[•*]\s*\[FAILED\].*?\n"
    r"(.+?)\n"
    r"\s*(\S*?test/e2e/\S+?:\d+)\s*\n"
    r"\s*\[It\]\s*(.+?)\n"
    r"\s*(\S*?test/e2e/\S+?:\d+)"
)
GINKGO_DETAIL = r"^\s*\[FAILED\]\s*((?s:.+?))\n\s*In \[\w+\] at:\s*(\S+:\d+)"
BATS_HEADER = r"^\s*not ok\s+(\d+)\s*(?:\|([^|]*)\|)?\s*(.+?)(?:\s+in\s+\d+ms)?\s*$"
BATS_NEXT = r"^\s*(?:not ok|ok)\s+\d+"
BATS_CAUSE = r"^\s*#\s+`(.+?)'\s+failed(.*)$"
BATS_FILE = r"in test file (\S+\.bats), line (\d+)"
REPO_DIRS = ("/test/", "/pkg/", "/libpod/", "/cmd/")
EXCERPT_CHARS = 2000
FALLBACK_CHARS = 600
DIAGNOSTIC_LINES = 12

GINKGO, BATS = 0, 1

_BLOCKS = "array<struct<parser_ord:int,pos:int,block:string>>"


def repo_relative(path: Column) -> Column:
    """PAR-5: cut the checkout prefix. The order of the directories decides, not the position."""
    out = F.when(F.lit(False), path)
    for marker in REPO_DIRS:
        at = F.instr(path, marker)
        out = out.when(at > 0, F.substring(path, at + F.lit(1), F.length(path)))
    return out.otherwise(path)


def _find_blocks(text: Column, parser_ord: int, header: str, until: str) -> Column:
    """All blocks that start with ``header`` and run to a line with ``until`` or to the end.

    The tail is taken line by line: ``until`` is tried once per line, and the possessive loop
    needs no stack however long the block.
    """
    pattern = java_regex(rf"{header}[^\n]*+(?:\n(?!{until})[^\n]*+)*+", "m")
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda block, i: F.struct(
            F.lit(parser_ord).alias("parser_ord"), i.alias("pos"), block.alias("block")
        ),
    )


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, java_regex(pattern, "m"), i)


def _after_header(block: Column, header: str) -> Column:
    return F.substring(block, F.length(_group(block, header, 0)) + F.lit(1), F.length(block))


def _ginkgo_fields(block: Column, rest: Column, where: Column) -> dict[str, Column]:
    """PAR-3: the assertion inside the block, or its first lines when there is none."""
    return {
        "test_name": strip(_group(block, GINKGO_HEADER, 3)),
        "suite_name": strip(_group(block, GINKGO_HEADER, 1)),
        "path": F.when(where != "", where).otherwise(_group(block, GINKGO_HEADER, 4)),
        "error_excerpt": F.when(
            where != "", strip(_group(rest, GINKGO_DETAIL, 1))
        ).otherwise(first_chars(pack_lines(rest), FALLBACK_CHARS)),
    }


def _bats_fields(block: Column, rest: Column, command: Column) -> dict[str, Column]:
    """PAR-4: the named cause, or the first diagnostic lines when there is none."""
    tag = strip(_group(block, BATS_HEADER, 2))
    cause = F.concat(
        F.lit("`"), command, F.lit("' failed"), rstrip(_group(rest, BATS_CAUSE, 2))
    )
    diagnostics = F.transform(F.slice(lines_after(rest, "#"), 1, DIAGNOSTIC_LINES), strip)
    file = _group(rest, BATS_FILE, 1)
    return {
        "test_name": strip(_group(block, BATS_HEADER, 3)),
        "suite_name": tag,
        "path": F.when(
            file != "", F.concat(file, F.lit(":"), _group(rest, BATS_FILE, 2))
        ).otherwise(tag),
        "error_excerpt": F.when(command != "", cause).otherwise(
            F.array_join(diagnostics, "\n")
        ),
    }


def parse_logs(logs: DataFrame, html: str = "html", keep_clean: bool = False) -> DataFrame:
    """PAR-6: one row per failed test, the other columns of ``logs`` kept.

    ``suite`` picks the grammar: ``int`` has only the first, ``sys`` only the second, any other
    suite both. The order of the records of one log is (``parser_ord``, ``pos``). With
    ``keep_clean`` a log without failures gives one row with nulls.
    """
    keep = [c for c in logs.columns if c != html]
    text = logs.select(*keep, strip_tags(F.col(html)).alias("_stripped")).select(
        *keep, decode_entities(F.col("_stripped")).alias("_text")
    )
    return parse_texts(text, "_text", keep_clean)


def parse_texts(logs: DataFrame, text: str, keep_clean: bool = False) -> DataFrame:
    """:func:`parse_logs` of plain text."""
    keep = [c for c in logs.columns if c != text]
    body, suite = F.col(text), F.col("suite")
    none = F.array().cast(_BLOCKS)
    # a plain substring test spares most logs the regular expression
    ginkgo = F.when(
        (suite != "sys") & body.contains("[FAILED]"),
        _find_blocks(body, GINKGO, GINKGO_HEADER, GINKGO_HEADER),
    ).otherwise(none)
    bats = F.when(
        (suite != "int") & body.contains("not ok"),
        _find_blocks(body, BATS, BATS_HEADER, BATS_NEXT),
    ).otherwise(none)
    explode = F.inline_outer if keep_clean else F.inline
    blocks = logs.select(*keep, explode(F.concat(ginkgo, bats)))

    is_ginkgo, block, rest = F.col("parser_ord") == GINKGO, F.col("block"), F.col("_rest")

    def pick(ginkgo_value: Column, bats_value: Column) -> Column:
        return F.when(is_ginkgo, ginkgo_value).otherwise(bats_value)

    # one projection per layer: what several fields share is evaluated once
    found = F.col("_found")
    rests = blocks.withColumn(
        "_rest", pick(_after_header(block, GINKGO_HEADER), _after_header(block, BATS_HEADER))
    ).withColumn("_found", pick(_group(rest, GINKGO_DETAIL, 2), _group(rest, BATS_CAUSE, 1)))
    by_ginkgo = _ginkgo_fields(block, rest, found)
    by_bats = _bats_fields(block, rest, found)
    return rests.select(
        *keep,
        "parser_ord",
        "pos",
        *[pick(by_ginkgo[name], by_bats[name]).alias(name) for name in by_bats],
    ).select(
        *keep,
        "parser_ord",
        "pos",
        "test_name",
        "suite_name",
        repo_relative(F.col("path")).alias("test_file"),
        first_chars(F.col("error_excerpt"), EXCERPT_CHARS).alias("error_excerpt"),
    )
