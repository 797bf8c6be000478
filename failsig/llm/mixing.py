"""Operator 8: mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import frozen, with_position
from .common import SPACES, draw, packed, text_of, words

WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
BUDGET = 1.5  # target tokens, as a multiple of all tokens
MOST = 2.0  # a source's target is at most this multiple of its tokens


def n_tokens(text: Column) -> Column:
    return F.size(words(text, SPACES)).cast("long")


def source_targets(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source of ``sized`` (source, size).

    Tokens are added up before the shuffle, so a hot source costs no more than another. The
    sources are ranked without one task seeing all of them. Targets share ``budget`` times all
    tokens by weight. A source whose share is above ``most`` times its tokens is held there and
    what it leaves is shared anew; a round is one aggregation to a single row, and ends with the
    first that holds no further source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_position(totals, F.col("source").asc_nulls_last(), name="place")
    plan = frozen(
        ranked.select(
            "source",
            "source_size",
            F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]),
                (F.col("place") % len(weights) + 1).cast("int"),
            ).alias("weight"),
            (F.col("source_size") * float(most)).alias("cap"),
        )
    )
    share = 0.0
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    held = -1
    while True:
        full = F.col("cap") <= F.lit(share) * F.col("weight")
        now, capped, open_weight = plan.agg(
            F.count_if(full),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if now == held or not open_weight:
            break
        held = now
        share = (budget * total - capped) / open_weight
    return plan.select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.lit(share) * F.col("weight")).alias("target"),
    )


def mixed(docs: DataFrame, seed: int = 8, **targets) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``size``, ``source_size``, ``target`` and ``copies``.

    The rate of a source is its target over its tokens. A row is emitted floor(rate) times, plus
    once if a hash of ``seed``, its doc_id and its text falls below the fraction: the same in every
    run. Null texts have size 0 and null is a source of its own. Rows without an id or with one in
    common draw by their texts; only rows alike in both draw alike. Without
    tokens at all every target and every number of copies is 0.
    """
    parts = packed(docs).select(
        "row",
        n_tokens(text_of("row.text")).alias("size"),
        F.col("row.source").alias("source"),
    )
    plan = source_targets(parts.select("source", "size"), **targets).withColumnRenamed(
        "source", "of_source"
    )
    joined = parts.join(plan, F.col("source").eqNullSafe(F.col("of_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.concat(
        F.lit(f"{seed}:"),
        F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")),
        F.lit(":"),
        F.md5(text_of("row.text").cast("binary")),
    )
    return joined.select(
        "row",
        "size",
        "source_size",
        "target",
        (F.floor(rate) + F.when(draw(key) < rate - F.floor(rate), 1).otherwise(0)).alias("copies"),
    )


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as ``mixed`` says."""
    rows = mixed(docs, **options)
    return rows.select(
        "row", F.explode(F.expr("array_repeat(true, cast(copies as int))")).alias("copy")
    ).select("row.*")


