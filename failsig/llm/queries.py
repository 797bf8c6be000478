"""The registered queries of the corpus operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam,
    gam,
    langid,
    license,
    merkle,
    mixing,
    pieces,
    pii,
    rules,
    shards,
    simhash,
    suffix,
    whiten,
)
from .common import fold_of, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license.scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_union(F.col("places.label"), F.col("found.label")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max("found.containment"), F.lit(0.0)))
        .alias("score"),
    )


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


@query
def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gam.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "row.doc_id",
        (fold_of(gam.FOLDS, "row.doc_id") == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= gam.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.identified(table(spark, sf_dir, "documents"))
    return rows.select(
        "row.doc_id",
        (fold_of(langid.FOLDS, "row.doc_id") == 1).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        "found.rejected",
    )


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("reasons", ",").alias("reasons"),
    )


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.assigned(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontam.covered("spans")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.personal_data(table(spark, sf_dir, "documents"))

    def line(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("spans", lambda s: s["kind"] != pii.CONTEXT)
    return rows.select(
        "doc_id",
        *[
            F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == F.lit(k)), False))
            .cast("long")
            .alias(f"n_{k}")
            for k in pii.KINDS
        ],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten.whitened(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return rows.select("row.vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "c.whitened",
        "c.explained",
        "identity_error",
    )


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.proved(table(spark, sf_dir, "documents"), present={"text": text}).withColumnRenamed(
        "key", "doc_id"
    )


@query
def op13_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    rows = pieces.encoded(table(spark, sf_dir, "documents"), model or MODEL)
    return rows.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
