"""RPT-1..7: the report as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dimensions import AXES
from ..functions.text import first_chars
from .fold import Patterns
from .index import UNCATEGORIZED, category_or
from .scale import with_position

# Fixed values.
TITLE_CHARS = 80
SIGNATURE_CHARS = 1200
DATE_CHARS = 10
SHOWN_RUNS = 5
NO_CATEGORY = "_uncategorized_"
NO_DIMENSIONS = "-"


def _values(axis: str) -> Column:
    """Sorted values of one axis in ``_pairs``."""
    on_axis = F.filter("_pairs", lambda p: p["axis"] == axis)
    return F.array_sort(F.transform(on_axis, lambda p: p["value"]))


def _axis_texts(axes: DataFrame, text_of, order: tuple[str, ...]) -> DataFrame:
    """signature_hash and one text: the non-empty axes in ``order``, comma-separated."""
    texts = [F.when(F.size(_values(a)) > 0, text_of(a, _values(a))) for a in order]
    return (
        axes.groupBy("signature_hash")
        .agg(F.collect_set(F.struct("axis", "value")).alias("_pairs"))
        .select("signature_hash", F.concat_ws(", ", *texts).alias("dimensions"))
    )


def dimension_summary(axes: DataFrame) -> DataFrame:
    """RPT-2: a single value is bold, several are joined by slashes."""

    def text(_axis: str, values: Column) -> Column:
        only = F.concat(F.lit("**"), F.get(values, F.lit(0)), F.lit("**"))
        return F.when(F.size(values) == 1, only).otherwise(F.array_join(values, "/"))

    return _axis_texts(axes, text, AXES)


def dimension_list(axes: DataFrame) -> DataFrame:
    """``axis=v1/v2`` per axis, axes by name, as stored pattern documents order them."""
    return _axis_texts(
        axes,
        lambda axis, values: F.concat(F.lit(f"{axis}="), F.array_join(values, "/")),
        tuple(sorted(AXES)),
    )


def ranked(patterns: Patterns) -> DataFrame:
    """SRT-3: all pattern columns, the dimension summary and the report rank.

    The rank is global, so it comes from :func:`with_position`, not from a one-task window.
    """
    rows = patterns.core.drop("ord").join(
        dimension_summary(patterns.axes), "signature_hash", "left"
    )
    placed = with_position(
        rows.withColumn("dimensions", F.coalesce("dimensions", F.lit(NO_DIMENSIONS))),
        F.desc("count"),
        F.col("title"),
        F.col("signature_hash"),
    )
    return placed.withColumn("rank", F.col("position") + 1).drop("position")


def frequency(ranked_: DataFrame) -> DataFrame:
    """RPT-1. The bar is escaped before the title is cut."""
    return ranked_.select(
        "rank",
        "count",
        first_chars(F.replace("title", F.lit("|"), F.lit("\\|")), TITLE_CHARS).alias("title"),
        "dimensions",
        category_or(NO_CATEGORY).alias("category"),
    )


def details(ranked_: DataFrame) -> DataFrame:
    """RPT-3."""
    confidence = F.when(
        F.col("confidence") != "",
        F.concat(F.lit(" (confidence: "), "confidence", F.lit(")")),
    ).otherwise("")
    return ranked_.select(
        "rank",
        "title",
        "count",
        "signature_hash",
        first_chars(F.col("first_seen"), DATE_CHARS).alias("first_seen"),
        first_chars(F.col("last_seen"), DATE_CHARS).alias("last_seen"),
        "dimensions",
        F.array_join(
            F.transform("linked_issues", lambda i: F.concat(F.lit("#"), i.cast("string"))), ", "
        ).alias("tracked_by"),
        F.when(F.col("category") != "", F.concat("category", confidence))
        .otherwise("")
        .alias("category"),
        "analysis",
        F.col("mitigation").alias("next_step"),
        first_chars(F.col("signature"), SIGNATURE_CHARS).alias("signature"),
    )


def recent_run_rows(recent: DataFrame) -> DataFrame:
    """RPT-4, SRT-6: the newest five of the at most ten runs kept per pattern."""
    newest = Window.partitionBy("signature_hash").orderBy(F.desc("ord"))
    return (
        recent.withColumn("run_rank", F.row_number().over(newest))
        .filter(F.col("run_rank") <= SHOWN_RUNS)
        .select(
            "signature_hash",
            "run_rank",
            "dimensions",
            "url",
            "event",
            first_chars(F.col("created_at"), DATE_CHARS).alias("date"),
        )
    )


def recurring(core: DataFrame) -> DataFrame:
    """PRJ-9."""
    return core.filter(F.col("count") > 1)


def category_breakdown(core: DataFrame) -> DataFrame:
    """RPT-6, AGG-16, SRT-5: occurrences per category, empty while nothing is categorised.

    Ties follow the report order of each category's first pattern. The window sees one row per
    category.
    """
    report_order = F.struct(-F.col("count"), F.col("title"), F.col("signature_hash"))
    everything = Window.partitionBy(F.lit(0))
    return (
        core.groupBy(category_or(UNCATEGORIZED).alias("category"))
        .agg(
            F.sum("count").alias("occurrences"),
            F.min(report_order).alias("_first"),
            F.max(F.col("category") != "").alias("_given"),
        )
        .withColumn("_given", F.max("_given").over(everything))
        .filter("_given")
        .orderBy(F.desc("occurrences"), "_first")
        .select("category", "occurrences")
    )
