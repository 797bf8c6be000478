"""Operator 2: near duplicates by SimHash and multi-index hashing."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.scale import frozen
from .common import content_key, packed, ship, utf8
from .graph import components

SHINGLE = 3  # words
DISTANCE = 2  # bits at most

_HALF = 32  # a fingerprint is two segments of this many bits
_LOW = (1 << _HALF) - 1


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit fingerprint of one whole text, unsigned."""
    found = (text or b"").lower().split()  # lowers A-Z only, and splits at ASCII space only
    if not found:
        return 0
    if len(found) < shingle:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=seed), shingles), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds what a very long text takes
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash of a text given as bytes, as a signed long of the same bits."""

    def run(texts: pa.Array) -> pa.Array:
        values = np.array([simhash(t, shingle) for t in texts.to_pylist()], np.uint64)
        return pa.array(values.view(np.int64))

    return F.arrow_udf(run, "long")(text)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct ``fp`` at ``distance`` bits or fewer, each at least once.

    Multi-index hashing with two segments. If two fingerprints differ in at most r bits, their
    high halves differ in at most floor(r / 2) bits or their low halves in at most
    r - floor(r / 2) - 1. Each print enumerates those small balls around its halves, fetches
    equal halves from the table, and whole distances are verified. A ball holds only values with
    bits set that the print has clear, or the reverse for the table side; equal halves come from
    the ball's centre.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments serve distances up to 3")
    high = F.shiftrightunsigned("fp", _HALF)
    low = F.col("fp").bitwiseAND(F.lit(_LOW))

    def ball(value: Column, radius: int) -> Column:
        near = F.array(value)
        if radius == 1:
            flips = F.transform(F.sequence(F.lit(0), F.lit(_HALF - 1)), _bit)
            clear = F.filter(flips, lambda m: value.bitwiseAND(m) == 0)
            near = F.concat(near, F.transform(clear, lambda m: value.bitwiseOR(m)))
        return near

    radius_high = distance // 2
    radius_low = distance - radius_high - 1
    keys = [(0, high, radius_high)] + ([(1, low, radius_low)] if radius_low >= 0 else [])
    entry = prints.select(
        F.col("fp").alias("b"),
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("seg"), v.alias("half")) for s, v, _ in keys])
        ).alias("key"),
    )
    def tagged(seg: int, halves: Column) -> Column:
        return F.transform(halves, lambda h: F.struct(F.lit(seg).alias("seg"), h.alias("half")))

    probes = F.concat(*[tagged(s, ball(v, r)) for s, v, r in keys])
    probe = prints.select(F.col("fp").alias("a"), F.explode(probes).alias("key"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return (
        probe.join(entry, "key")
        .filter((F.col("a") != F.col("b")) & close)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp``, ``root`` and ``component_id`` of each distinct fingerprint of ``prints`` (doc_id, fp).

    The root is the component's smallest fingerprint, the id its smallest doc_id.

    Equal fingerprints are one class from the start, so copies make no pairs at all.
    """
    first = frozen(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = components(links(first.select("fp"), distance))
    linked = groups.join(first, groups["node"] == first["fp"]).select("fp", "root", "first_id")
    ids = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = linked.join(ids, "root").select(F.col("fp").alias("of"), "root", "component_id")
    return first.join(joined, F.col("fp") == F.col("of"), "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other. A component's id is
    the smallest doc_id in it; null ids count only if there is no other. Repeated rows stay.
    """
    prints = frozen(docs.select("doc_id", fingerprint(utf8(), shingle).alias("fp")))
    found = frozen(classes(prints, distance))  # so that the join below can split hot prints
    return prints.join(found, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def deduplicated(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of its smallest
    doc_id stays, exactly one even if that row is repeated. Only keys and fingerprints are stored;
    texts are shuffled once, to the keys that stay."""
    prints = frozen(
        packed(docs).select(
            "row.doc_id",
            content_key("row.doc_id", "row.text").alias("key"),
            fingerprint(utf8("row.text"), shingle).alias("fp"),
        )
    )
    found = frozen(classes(prints, distance).select("fp", "root"))
    # null ids last, then the key breaks ties
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    of = prints.join(found, "fp")
    stay = frozen(of.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.key").alias("key")))
    rows = packed(docs).withColumn("key", content_key("row.doc_id", "row.text"))
    same = Window.partitionBy("key").orderBy("key")
    return (
        rows.join(stay, "key", "left_semi")
        .withColumn("nth", F.row_number().over(same))
        .filter("nth = 1")
        .select("row.*")
    )


ship(__name__)

