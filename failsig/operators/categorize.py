"""JSN-1..4, UDF-3, PRJ-7/8: categorising each unique pattern through a user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_reply, prompt_text
from .fold import Patterns
from .report import dimension_list

ANSWER = ("category", "confidence", "analysis", "mitigation")


def prompts(patterns: Patterns, force: bool = False) -> DataFrame:
    """PRJ-7, JSN-1: a prompt per pattern without category, or per pattern when forced."""
    todo = patterns.core if force else patterns.core.filter(F.col("category") == "")
    return todo.join(dimension_list(patterns.axes), "signature_hash", "left").select(
        "signature_hash",
        prompt_text(
            F.col("title"),
            F.col("count"),
            F.coalesce("dimensions", F.lit("")),
            F.col("signature"),
            F.lit(""),
        ).alias("prompt"),
    )


def ask(
    prompts_: DataFrame, answer: Callable[[str], str | None], tasks: int | None = None
) -> DataFrame:
    """UDF-3, JSN-4: ``answer(prompt)`` for every row; a call that fails gives a null reply.

    A call may take seconds and a prompt few bytes, so the rows are dealt out over ``tasks``
    (by default one per core) instead of by size. That is also the number of calls at a time.
    """
    tasks = tasks or prompts_.sparkSession.sparkContext.defaultParallelism

    def safely(prompt: str) -> str | None:
        try:
            return answer(prompt)
        except Exception:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "signature_hash": batch["signature_hash"],
                    "content": [safely(p) for p in batch["prompt"]],
                }
            )

    dealt = prompts_.repartition(tasks, "signature_hash")
    return dealt.mapInPandas(run, "signature_hash string, content string")


def usable_replies(replies: DataFrame) -> DataFrame:
    """JSN-2, JSN-3: parsed replies that name a known category."""
    return (
        replies.select("signature_hash", parse_reply(F.col("content")).alias("_reply"))
        .select("signature_hash", "_reply.*")
        .filter(F.col("category") != "")
    )


def apply_replies(core: DataFrame, usable: DataFrame) -> DataFrame:
    """PRJ-8: patterns without a usable reply stay as they are."""
    new = usable.select("signature_hash", F.struct(*ANSWER).alias("_reply"))
    joined = core.join(new, "signature_hash", "left")
    for name in ANSWER:
        joined = joined.withColumn(name, F.coalesce(F.col(f"_reply.{name}"), F.col(name)))
    return joined.drop("_reply")
