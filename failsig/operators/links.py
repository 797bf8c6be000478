"""PAR-8, JN-1..3, SRT-4: skip markers, the patterns they track and the stale ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_chars, java_regex, strip
from .scale import salted_join

# Fixed values. An issue number has 4 to 6 digits, so there are fewer than a million of them:
# that bounds every list of issues.
MARKER = r"(skip\w*|FIXME)\b[^\n]{0,80}?#([0-9]{4,6})"
MARKER_TEXT_CHARS = 200


def find_markers(lines: DataFrame) -> DataFrame:
    """PAR-8: source lines with a skip or FIXME marker that names an issue.

    ``lines`` has file, line and text; further columns are kept. The first marker of a line
    counts.
    """
    return (
        lines.withColumn("_issue", F.regexp_extract("text", java_regex(MARKER, "iu"), 2))
        .filter(F.col("_issue") != "")
        .withColumn("issue", F.col("_issue").cast("int"))
        .withColumn("text", first_chars(strip(F.col("text")), MARKER_TEXT_CHARS))
        .drop("_issue")
    )


def basename(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def pattern_issues(files: DataFrame, markers: DataFrame) -> DataFrame:
    """JN-1: signature_hash and issue, distinct, where pattern and marker share a file name.

    Both sides are reduced first: patterns to distinct file names, markers to one list of issues
    for each name, which the digits of an issue bound. So the join gives one row for each pattern
    and name, however many markers a name has. Many patterns can sit in one file, so each file
    name is split over several tasks.
    """
    by_pattern = files.select("signature_hash", basename(F.col("file")).alias("name")).distinct()
    by_name = markers.groupBy(basename(F.col("file")).alias("name")).agg(
        F.collect_set("issue").alias("issues")
    )
    return (
        salted_join(by_pattern, by_name, "name", spread="signature_hash")
        .select("signature_hash", "issues")
        .distinct()
        .select("signature_hash", F.explode("issues").alias("issue"))
        .distinct()
    )


def link(core: DataFrame, issues: DataFrame) -> DataFrame:
    """JN-2: set ``linked_issues`` where there are any; links found earlier are never cleared."""
    found = issues.groupBy("signature_hash").agg(
        F.array_sort(F.collect_set("issue")).alias("_found")
    )
    return (
        core.join(found, "signature_hash", "left")
        .withColumn("linked_issues", F.coalesce("_found", "linked_issues"))
        .drop("_found")
    )


def stale_markers(markers: DataFrame, core: DataFrame) -> DataFrame:
    """JN-3: markers whose issue no pattern is linked to."""
    return unlinked(markers, core.select(F.explode("linked_issues").alias("issue")))


def unlinked(markers: DataFrame, live: DataFrame) -> DataFrame:
    """Markers whose issue is none of the ``live`` ones."""
    return markers.join(live.select("issue").distinct(), "issue", "left_anti")


def stale_table(stale: DataFrame) -> DataFrame:
    """SRT-4: the first line of each issue and file, and its ``place`` in scan order.

    Rows are reported by issue, then place: folder, path part by part, line. Markers without
    ``dir_ord`` count as being in one folder.
    """
    folder = F.col("dir_ord") if "dir_ord" in stale.columns else F.lit(0)
    place = F.struct(
        folder.cast("int").alias("dir_ord"), F.split("file", "/").alias("parts"), "line"
    )
    return (
        stale.groupBy("issue", "file")
        .agg(F.min("line").alias("line"), F.min(place).alias("place"))
        .select("issue", "file", "line", "place")
    )
