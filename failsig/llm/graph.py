"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import frozen, release


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for the nodes of ``edges``.

    ``edges`` holds pairs ``a``, ``b`` in any order, repeated or not. Large and small stars
    alternate: each node ties its larger neighbours to the smallest it knows, then ties itself
    and its smaller neighbours to that. Paths shorten by halves, so a few rounds do. Each round
    is written to the checkpoint folder and the one before deleted. Nothing but a count and a sum
    of hashes reaches the driver. A hub's neighbours meet only in joins, which adaptive execution
    splits.
    """
    stars = frozen(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .distinct()
    )
    seen = _mark(stars)
    while seen[0]:
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("w")).union(
            stars.select(F.col("m").alias("u"), F.col("v").alias("w"))
        )
        least = both.groupBy("u").agg(F.min("w").alias("m"))
        large = (
            both.filter("w > u")
            .join(least.select("u", F.least("u", "m").alias("m")), "u")
            .select(F.col("w").alias("v"), "m")
            .distinct()
        )
        lowest = large.groupBy("v").agg(F.min("m").alias("low"))
        moved = (
            large.join(lowest, "v")
            .filter("m <> low")
            .select(F.col("m").alias("v"), F.col("low").alias("m"))
        )
        small = lowest.select("v", F.col("low").alias("m")).union(moved).distinct()
        following = frozen(small)
        release(stars)
        stars, mark = following, _mark(following)
        if mark == seen:
            break
        seen = mark
    roots = stars.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
    return stars.select(F.col("v").alias("node"), F.col("m").alias("root")).union(roots)


def _mark(stars: DataFrame) -> tuple:
    wide = F.xxhash64("v", "m").cast("decimal(20,0)")
    return tuple(stars.agg(F.count(F.lit(1)), F.sum(wide)).first())
