"""NRM-1..17 and SIG-1..3: from error text to a stable signature hash.

Everything is a chain of replacements on one column, so it runs inside the scan stage.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITESPACE, blank_if_null, first_chars, is_ascii, java_regex, re2_regex, strip

# Fixed values: (pattern, replacement, case-insensitive), applied in this order. Hashes depend
# on every character here. "\1" in a replacement is the first group.
RULES: list[tuple[str, str, bool]] = [
    # timestamps
    (r"\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?", "<TIME>", False),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?", "<TIME>", False),
    (r"\[\d{2}:\d{2}:\d{2}\]", "<TIME>", False),
    # durations
    (r"\b\d+(?:\.\d+)?\s*(?:ms|s|seconds|sec)\b", "<DUR>", False),
    (r"<\+\s*[\d.]+\s*\w*>", "<DUR>", False),
    # addresses and ids
    (r"\b0x[0-9a-fA-F]+\b", "<ADDR>", False),
    (r"\b[0-9a-f]{64}\b", "<SHA256>", False),
    (r"\b[0-9a-f]{12,63}\b", "<ID>", False),
    # paths
    (r"/tmp/CI_\w+", "/tmp/CI_<RAND>", False),
    (r"podman_bats\.\w+", "podman_bats.<RAND>", False),
    (r"/var/tmp/[\w.-]+/podman/", "", False),
    (r"/home/[^/\s]+/", "/<HOME>/", False),
    # random name suffixes, ports, pids
    (r"\b([a-zA-Z][\w-]*?)-[0-9a-z]{6,}\b", r"\1-<RAND>", False),
    (r":\d{4,5}\b", ":<PORT>", False),
    (r"\bpid[= ]\d+\b", "pid=<PID>", True),
    # whatever number is left, then white space
    (r"\b\d+\b", "<N>", False),
    (r"\s+", " ", False),
]
HASH_CHARS = 16


def _ascii_normalizer():
    # local, so that it ships by value and workers need not have this package installed
    rules = [(re2_regex(p, "i" if i else ""), r) for p, r, i in RULES if p != r"\s+"]
    # a blank that stands alone stays as it is
    rules.append((re2_regex(r"[\t-\r\x1c-\x1f]\s*| \s+"), " "))
    space = "".join(c for c in WHITESPACE if c.isascii())

    def clean(text: pa.Array) -> pa.Array:
        text = pc.ascii_trim(text, characters=space)
        for pattern, replacement in rules:
            text = pc.replace_substring_regex(text, pattern, replacement)
        return pc.ascii_trim(text, characters=space)

    return F.arrow_udf(clean, "string")


def normalize(text: Column) -> Column:
    """Strip, replace every run-to-run token in rule order, strip again.

    ASCII texts, which replacements keep so, go to Arrow's RE2 by batches: it looks for the next
    match byte by byte in a table, where Java's classes for Python's Unicode semantics cost ten
    times as much. All others cross as nulls and take the native chain.
    """

    def step(c: Column, rule: tuple[str, str, bool]) -> Column:
        pattern, replacement, ignore_case = rule
        return F.regexp_replace(
            c,
            java_regex(pattern, "iu" if ignore_case else ""),
            replacement.replace("\\1", "$1"),
        )

    native = strip(reduce(step, RULES, strip(text)))
    return F.coalesce(_ascii_normalizer()(F.when(is_ascii(text), text)), native)


def signature(test_name: Column, error_excerpt: Column) -> Column:
    """SIG-1: normalised test identity and normalised error, joined by a bar."""
    return F.concat(normalize(test_name), F.lit("|"), normalize(error_excerpt))


def signature_hash(sig: Column) -> Column:
    """SIG-2: the first 16 hex digits of SHA-256."""
    return blank_if_null(first_chars(F.sha2(sig, 256), HASH_CHARS))


def with_fingerprint(failures: DataFrame) -> DataFrame:
    """SIG-3: add ``signature`` and ``signature_hash``.

    Two projections: the hash refers to the signature column, and Catalyst keeps them apart
    because merging them would run the regex chain twice. Both columns cannot be null, so a join
    on the hash adds no null filter that would run the chain once more.
    """
    test_name, error = (blank_if_null(F.col(c)) for c in ("test_name", "error_excerpt"))
    return failures.withColumn("signature", signature(test_name, error)).withColumn("signature_hash", signature_hash(F.col("signature")))
