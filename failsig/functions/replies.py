"""JSN-1..3: the question asked per pattern, and reading the answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_if_null, first_chars, strip

# The categories, and the lengths kept of each field.
CATEGORIES = (
    "test-race",
    "product-race",
    "network-registry",
    "platform-specific",
    "storage-environment",
    "infrastructure",
    "deterministic-regression",
)
PROMPT_CHARS = 1500
REPLY_CHARS = {"confidence": 16, "analysis": 800, "mitigation": 800}

_REPLY_SCHEMA = (
    "array<struct<category:string,confidence:string,analysis:string,mitigation:string>>"
)


def prompt_text(
    title: Column, count: Column, dimensions: Column, signature: Column, excerpt: Column
) -> Column:
    """JSN-1. ``dimensions`` is the ``axis=v1/v2`` list, blank when none was recorded."""

    def or_else(c: Column, text: str) -> Column:
        return F.when(c != "", c).otherwise(text)

    return F.concat(
        F.lit("A CI test failed. Decide on the most likely root cause.\n\nTest: "),
        title,
        F.lit("\nOccurrences: "),
        count.cast("string"),
        F.lit("\nSeen on: "),
        or_else(dimensions, "none recorded"),
        F.lit("\n\nSignature (run-specific tokens removed):\n"),
        first_chars(signature, PROMPT_CHARS),
        F.lit("\n\nError output:\n"),
        first_chars(or_else(blank_if_null(excerpt), "not captured"), PROMPT_CHARS),
        F.lit("\n\nPick one category:\n" + "\n".join(f"- {c}" for c in CATEGORIES)),
        F.lit(
            "\n\nChoose deterministic-regression if the code is broken and would fail again."
            '\nAnswer with one JSON object with the string keys "category", "confidence"'
            ' (high, medium or low), "analysis" and "mitigation".\n'
        ),
    )


def reply_json(content: Column) -> Column:
    """JSN-2: the JSON text inside a reply, blank when there is none.

    The first fenced part that starts with a brace wins; then first ``{`` to last ``}``.
    """
    parts = F.transform(
        F.split(content, "```"), lambda p: strip(F.regexp_replace(p, r"\Ajson", ""))
    )
    fenced = F.filter(parts, lambda p: p.startswith("{"))
    chosen = F.when(
        content.contains("```") & (F.size(fenced) > 0), F.get(fenced, F.lit(0))
    ).otherwise(content)
    return F.regexp_extract(chosen, r"(?s)\{.*\}", 0)


def parse_reply(content: Column) -> Column:
    """JSN-2 and JSN-3: struct of category, confidence, analysis, mitigation; null if unusable.

    The object is read as a one-element array: trailing text or a second object then makes the
    document invalid instead of being ignored.
    """
    wrapped = F.concat(F.lit("["), reply_json(content), F.lit("]"))
    parsed = F.from_json(wrapped, _REPLY_SCHEMA, {"allowSingleQuotes": "false"})
    # "[]" from a reply without JSON parses to no element, hence null
    reply = F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))
    category = strip(blank_if_null(reply["category"]))
    fields = [
        F.when(category.isin(*CATEGORIES), category).otherwise("").alias("category"),
        *[
            first_chars(strip(blank_if_null(reply[name])), n).alias(name)
            for name, n in REPLY_CHARS.items()
        ],
    ]
    return F.when(reply.isNotNull(), F.struct(*fields))
