"""AGG-1..9, JN-5/6: failures to occurrences to patterns, at once or batch by batch.

A pattern's lists (tests, files, axis counts, recent runs) live in child tables keyed by the
signature hash, so a pattern with a third of all failures never has to fit one row. Every
column of every table has an order-free merge, hence one union and one partial aggregation
serve both the first batch and any later one.

Order is data: ``seq`` is the position of a record inside its batch, ``ord`` puts the batch
number in front.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dimensions import AXES, dim_label
from ..functions.text import blank_if_null, first_chars, null_if_blank
from .scale import salted_join, with_position

# Fixed values.
SCHEMA_VERSION = "1.0"
TITLE_CHARS = 120
SHA_CHARS = 12
RECENT_RUNS = 10

KEY = ("signature_hash", "run_id", "dim_label")
_OPTIONAL_TEXT = ("run_url", "run_event", "head_sha", "created_at")
PAYLOAD = (*_OPTIONAL_TEXT, *AXES, "test_name", "test_file")


@dataclass(frozen=True)
class Patterns:
    """The tables that make up a set of patterns."""

    core: DataFrame  # one row per signature_hash
    tests: DataFrame  # signature_hash, test_name, ord
    files: DataFrame  # signature_hash, file, ord
    axes: DataFrame  # signature_hash, axis, value, n
    recent: DataFrame  # signature_hash, run_id, url, event, sha, created_at, dimensions, ord

    def with_core(self, core: DataFrame) -> Patterns:
        return Patterns(core, self.tests, self.files, self.axes, self.recent)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def complete(failures: DataFrame) -> DataFrame:
    """PRJ-4, PRJ-5: run columns that are absent or null become blank; add the label."""
    for name in (*_OPTIONAL_TEXT, *AXES):
        present = name in failures.columns
        failures = failures.withColumn(
            name, blank_if_null(F.col(name)) if present else F.lit("")
        )
    return failures.withColumn("dim_label", dim_label())


def occurrences(failures: DataFrame, payload: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """AGG-1: one row per (hash, run, label), the first record winning.

    ``min`` over a struct led by ``seq`` combines before the shuffle, so copies of one failure
    shrink to one row per task. The struct hides unused columns from column pruning: name the
    ``payload`` that is needed if it is not all of it.
    """
    first = F.min(F.struct("seq", *payload)).alias("first")
    return complete(failures).groupBy(*KEY).agg(first).select(*KEY, "first.*")


def unseen(occ: DataFrame, ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """JN-6: drop occurrences that the ledger holds.

    ``ledger`` comes from the files that hold any of ``runs`` (the distinct run ids of the batch)
    and is cut to those before it is shuffled; adaptive execution broadcasts that list when its
    measured size allows.
    """
    known = ledger.select(*KEY).join(runs, "run_id", "left_semi")
    return occ.join(known, list(KEY), "left_anti")


def _first_seen(c: Column) -> Column:
    return blank_if_null(F.min(null_if_blank(c)))


def _first_by_ord(*cols: str) -> Column:
    """The values of ``cols`` on the row with the smallest ``ord``."""
    return F.min(F.struct("ord", *cols)).alias("first")


_FROM_FIRST = (
    "signature",
    "title",
    "category",
    "confidence",
    "analysis",
    "mitigation",
    "linked_issues",
)
_CORE = ("signature_hash", "count", "first_seen", "last_seen", "ord", *_FROM_FIRST)


def _latest(runs: DataFrame) -> DataFrame:
    """AGG-7: the runs ingested last.

    Spark's window group limit keeps ten rows per key and task before the shuffle, so even a
    key with most of the rows sends little to its task.
    """
    newest = Window.partitionBy("signature_hash").orderBy(F.desc("ord"))
    return (
        runs.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= RECENT_RUNS)
        .drop("_rank")
    )


def axis_counts(occ: DataFrame) -> DataFrame:
    """AGG-6. Counted per combination first, so that unpivoting multiplies few rows by four."""
    combos = occ.groupBy("signature_hash", *AXES).agg(F.count(F.lit(1)).alias("n"))
    return (
        combos.unpivot(["signature_hash", "n"], list(AXES), "axis", "value")
        .filter(F.col("value") != "")
        .groupBy("signature_hash", "axis", "value")
        .agg(F.sum("n").alias("n"))
    )


def pattern_counts(occ: DataFrame) -> DataFrame:
    """AGG-2, AGG-3, AGG-8: count, time range and title of each pattern."""
    return (
        occ.groupBy("signature_hash")
        .agg(
            F.count(F.lit(1)).alias("count"),
            _first_seen(F.col("created_at")).alias("first_seen"),
            blank_if_null(F.max("created_at")).alias("last_seen"),
            F.min(F.struct("seq", "test_name")).alias("first"),
        )
        .select(
            "signature_hash",
            "count",
            "first_seen",
            "last_seen",
            F.col("first.seq").alias("seq"),
            first_chars(F.col("first.test_name"), TITLE_CHARS).alias("title"),
        )
    )


def signatures(failures: DataFrame) -> DataFrame:
    """The text behind each hash, kept out of the occurrence shuffle: it is long."""
    return failures.groupBy("signature_hash").agg(F.min("signature").alias("signature"))


def _ord(batch: int) -> Column:
    return F.struct(F.lit(batch).cast("bigint").alias("batch"), F.col("seq").alias("seq"))


def test_names(occ: DataFrame) -> DataFrame:
    """AGG-4: distinct test names with the place of their first appearance."""
    return (
        occ.filter(F.col("test_name") != "")
        .groupBy("signature_hash", "test_name")
        .agg(F.min("seq").alias("seq"))
    )


def source_files(occ: DataFrame) -> DataFrame:
    """AGG-5: distinct source files, without their line numbers."""
    return (
        occ.filter(F.col("test_file") != "")
        .groupBy("signature_hash", F.substring_index("test_file", ":", 1).alias("file"))
        .agg(F.min("seq").alias("seq"))
    )


def recent_runs(occ: DataFrame) -> DataFrame:
    """PRJ-11 and AGG-7 over one batch."""
    return _latest(
        occ.select(
            "signature_hash",
            "run_id",
            F.col("run_url").alias("url"),
            F.col("run_event").alias("event"),
            first_chars(F.col("head_sha"), SHA_CHARS).alias("sha"),
            "created_at",
            F.col("dim_label").alias("dimensions"),
            F.col("seq").alias("ord"),
        )
    )


def fold(occ: DataFrame, texts: DataFrame, batch: int = 0) -> Patterns:
    """Patterns of one batch. ``texts`` is :func:`signatures` of its failures."""
    core = (
        pattern_counts(occ)
        .join(texts, "signature_hash")
        .withColumn("ord", _ord(batch))
        .withColumn("linked_issues", F.array().cast("array<int>"))
    )
    for name in ("category", "confidence", "analysis", "mitigation"):
        core = core.withColumn(name, F.lit(""))

    def ordered(df: DataFrame) -> DataFrame:
        return df.withColumn("ord", _ord(batch)).drop("seq")

    return Patterns(
        core=core.select(*_CORE),
        tests=ordered(test_names(occ)),
        files=ordered(source_files(occ)),
        axes=axis_counts(occ),
        recent=ordered(recent_runs(occ).withColumnRenamed("ord", "seq")),
    )


def merge(old: Patterns, new: Patterns) -> Patterns:
    """JN-5, AGG-9: fold ``new`` into ``old``.

    The rows of both sides share one shuffle per table.
    """
    both = {
        name: table.unionByName(new.tables()[name]) for name, table in old.tables().items()
    }
    return folded(Patterns(**both))


def folded(parts: Patterns) -> Patterns:
    """AGG-9: tables with the rows of any number of batches, as those of one.

    Title, category and links come from the oldest row; counts add up; the rest is a minimum,
    a maximum or the ten newest. The order of the rows doesn't matter.
    """
    core = (
        parts.core
        .groupBy("signature_hash")
        .agg(
            F.sum("count").alias("count"),
            _first_seen(F.col("first_seen")).alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            _first_by_ord(*_FROM_FIRST),
        )
        .select("signature_hash", "count", "first_seen", "last_seen", "first.*")
    )
    return Patterns(
        core=core.select(*_CORE),
        tests=parts.tests
        .groupBy("signature_hash", "test_name")
        .agg(F.min("ord").alias("ord")),
        files=parts.files.groupBy("signature_hash", "file").agg(F.min("ord").alias("ord")),
        axes=parts.axes
        .groupBy("signature_hash", "axis", "value")
        .agg(F.sum("n").alias("n")),
        recent=_latest(parts.recent),
    )


def _nested_list(items: DataFrame, value: str, name: str, part_items: int) -> DataFrame:
    """Arrays of at most ``part_items`` values per (hash, part), in order of appearance."""
    placed = with_position(items, F.col("signature_hash"), F.col("ord"), F.col(value))
    start = placed.groupBy("signature_hash").agg(F.min("position").alias("_start"))
    at = F.col("position") - F.col("_start")
    return (
        salted_join(placed, start, "signature_hash", spread="position")
        .withColumn("part", F.floor(at / part_items).cast("int"))
        .groupBy("signature_hash", "part")
        .agg(F.array_sort(F.collect_list(F.struct("position", value))).alias("_items"))
        .select("signature_hash", "part", F.col(f"_items.{value}").alias(name))
    )


def documents(patterns: Patterns, part_items: int = 100_000) -> DataFrame:
    """PRJ-6: patterns as nested documents, one row each.

    A list longer than ``part_items`` goes on in further rows of the same hash, numbered by
    ``part``; part 0 holds the counts, axes and runs. So no row grows without bound and no list
    is cut.
    """
    none = F.array().cast("array<string>")
    lists = _nested_list(patterns.tests, "test_name", "tests", part_items).join(
        _nested_list(patterns.files, "file", "test_files", part_items),
        ["signature_hash", "part"],
        "full_outer",
    )
    axes = (
        patterns.axes.groupBy("signature_hash", "axis")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(
                "values"
            )
        )
        .groupBy("signature_hash")
        .agg(F.map_from_entries(F.collect_list(F.struct("axis", "values"))).alias("dimensions"))
    )
    runs = (
        patterns.recent.groupBy("signature_hash")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "ord", "run_id", "url", "event", "sha", "created_at", "dimensions"
                    )
                ),
                asc=False,
            ).alias("_runs")
        )
        .select(
            "signature_hash",
            F.transform("_runs", lambda r: r.dropFields("ord")).alias("recent_runs"),
        )
    )
    whole = (
        patterns.core.drop("ord")
        .join(axes, "signature_hash", "left")
        .join(runs, "signature_hash", "left")
        .withColumn("part", F.lit(0))
    )
    return (
        whole.join(lists, ["signature_hash", "part"], "full_outer")
        .withColumn("schema_version", F.lit(SCHEMA_VERSION))
        .withColumn("tests", F.coalesce("tests", none))
        .withColumn("test_files", F.coalesce("test_files", none))
    )
