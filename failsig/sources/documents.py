"""SRC-6, PRJ-6, SNK-1: pattern documents, one JSON file or line per pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dimensions import AXES
from ..operators.fold import Patterns
from . import schemas

_TEXTS = ("first_seen", "last_seen", "category", "confidence", "analysis", "mitigation")


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of ``path``: a JSON file each, or JSON ``lines``.

    Unknown keys are dropped and absent ones defaulted; a broken document or one without its
    required keys is left out. Rows with a ``part`` above 0 go on with the lists of the document
    of the same hash and need no more than that.
    """
    docs = spark.read.schema(schemas.DOCUMENTS).json(
        path, multiLine=not lines, mode="DROPMALFORMED", pathGlobFilter="*.json"
    )
    docs = docs.withColumn("part", F.coalesce("part", F.lit(0)))
    whole = F.col("signature").isNotNull() & F.col("title").isNotNull()
    docs = docs.filter(F.col("signature_hash").isNotNull() & (whole | (F.col("part") > 0)))
    for name in _TEXTS:
        docs = docs.withColumn(name, F.coalesce(name, F.lit("")))
    return docs.withColumn("count", F.coalesce("count", F.lit(0)))


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON lines in hash order."""
    docs.orderBy("signature_hash", "part").write.json(path)


def _ord(pos: Column, part: Column | None = None) -> Column:
    """Place ``pos`` of ``part`` in batch 0, before everything that is ingested later."""
    part = F.lit(0) if part is None else part
    return (
        F.struct(
            F.lit(0).cast("bigint").alias("batch"),
            F.struct(
                part.cast("bigint").alias("run_ord"),
                *[F.lit(0).cast("bigint").alias(n) for n in ("run_tie", "artifact_ord")],
                F.lit(0).alias("file_ord"),
                F.lit("").alias("filename"),
                F.lit(0).alias("parser_ord"),
                pos.cast("int").alias("pos"),
            ).alias("seq"),
        )
        .cast(schemas.ORD)
        .alias("ord")
    )


def patterns_of(docs: DataFrame) -> Patterns:
    """The tables behind documents; lists keep their order."""

    def items(column: str, name: str) -> DataFrame:
        rows = docs.select("signature_hash", "part", F.posexplode(column).alias("_pos", name))
        return rows.select("signature_hash", name, _ord(F.col("_pos"), F.col("part")))

    axes = docs.select("signature_hash", F.explode("dimensions").alias("axis", "_values")).select(
        "signature_hash", "axis", F.explode("_values").alias("value", "n")
    )
    runs = docs.select(
        "signature_hash", F.size("recent_runs").alias("_n"), F.posexplode("recent_runs")
    )
    return Patterns(
        core=docs.filter("part = 0").select(
            "signature_hash",
            "count",
            "first_seen",
            "last_seen",
            _ord(F.lit(0)),
            "signature",
            "title",
            "category",
            "confidence",
            "analysis",
            "mitigation",
            F.coalesce("linked_issues", F.array().cast("array<int>")).alias("linked_issues"),
        ),
        tests=items("tests", "test_name"),
        files=items("test_files", "file"),
        axes=axes,
        # the list starts with the newest run
        recent=runs.select("signature_hash", "col.*", _ord(F.col("_n") - F.col("pos"))),
    )


def ledger_of(docs: DataFrame) -> DataFrame:
    """The occurrences that documents still name, their recent runs."""
    runs = docs.select("signature_hash", F.explode("recent_runs").alias("r"))
    blank = F.lit("")
    return runs.select(
        "signature_hash",
        "r.run_id",
        F.col("r.dimensions").alias("dim_label"),
        F.col("r.url").alias("run_url"),
        F.col("r.event").alias("run_event"),
        F.col("r.sha").alias("head_sha"),
        "r.created_at",
        *[blank.alias(axis) for axis in AXES],
        blank.alias("test_name"),
        blank.alias("test_file"),
        _ord(F.lit(0)),
    ).withColumn("seq", F.col("ord.seq")).drop("ord")
