"""Operator 6: benchmark decontamination, a prefix-filtered set join of windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import frozen
from .common import NON_WORD, content_key, lower_ascii, packed, text_of, words

WINDOW = 13  # words
AT_ONCE = 200_000  # windows, or words of them, that are broadcast at a time
_COUNTED = "\n"  # no word: stands for the whole row among its words


def item_words(text: Column) -> Column:
    return words(lower_ascii(text), NON_WORD)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item`` and ``win`` (its words) of each distinct window of each item.

    Items of fewer words are one window, null and empty ones none.
    """
    w = F.col("w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), item_words(text_of()).alias("w"))
        .filter(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(w, i, size))).alias("win"))
        .distinct()
    )


def _blocks(rows: DataFrame, key: str) -> list[DataFrame]:
    """``rows`` in parts of about ``AT_ONCE`` rows by a hash of ``key``, however many there are."""
    parts = -(-rows.count() // AT_ONCE)
    if parts <= 1:
        return [rows] * parts
    return [rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)]


def rarity(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token`` and ``seen``: how often each word of the vocabulary stands in all ``texts``."""
    each = texts.select(F.explode("w").alias("token"))
    found = [
        each.join(F.broadcast(part), "token", "left_semi").groupBy("token").count()
        for part in _blocks(vocabulary, "token")
    ]
    counted = reduce(DataFrame.unionAll, found) if found else vocabulary.withColumn("count", F.lit(0))
    counted = counted.withColumnRenamed("count", "seen")
    return vocabulary.join(counted, "token", "left").select(
        "token", F.coalesce("seen", F.lit(0)).alias("seen")
    )


def prefixes(wins: DataFrame, seen: DataFrame) -> DataFrame:
    """``item``, ``win``, its rarest word ``token`` and where that stands in it, ``at`` (from 0).

    Containment of a whole window asks for all its words, so the prefix that two sides must share
    is one word: the rarest, ties by the word itself, the first of several places.
    """
    each = wins.select("win").distinct().select("win", F.posexplode("win").alias("at", "token"))
    first = each.join(seen, "token").groupBy("win").agg(
        F.min(F.struct("seen", "token", "at")).alias("m")
    )
    return wins.join(first, "win").select("item", "win", F.col("m.token"), F.col("m.at"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` (start, end of hit places, merged) and ``items``.

    Rows without a hit have empty arrays. A document's words meet the prefix words of the
    windows; the positional bound drops places where the window would reach over either end of
    the text, and the words of the rest are compared in full. The windows are broadcast in blocks
    of bounded size, one after the other. A row's own number of words travels as one further
    word that all blocks know, so the texts are split into words once for the join and once for
    the counts.
    """
    texts = docs.select(item_words(text_of()).alias("w"))
    wins = frozen(windows(benchmark, size))
    vocabulary = frozen(wins.select(F.explode("win").alias("token")).distinct())
    seen = frozen(rarity(texts, vocabulary))
    rules = frozen(prefixes(wins, seen))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").alias("doc"),
        item_words(text_of()).alias("w"),
    )
    mark = rules.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("item"),
        F.array().cast("array<string>").alias("win"),
        F.lit(_COUNTED).alias("token"),
        F.lit(0).alias("at"),
    )
    blocks = _blocks(rules, "win")
    sides = [mark.unionByName(b) if k == 0 else b for k, b in enumerate(blocks)] or [mark]
    n = F.size("w")
    start = F.col("place") - F.col("at")
    fits = (start >= 0) & (start + F.size("win") <= n)
    counted = F.col("token") == _COUNTED
    found = []
    for side in sides:
        every = rows.select(
            "rid", "doc", "w", F.posexplode(F.concat("w", F.array(F.lit(_COUNTED)))).alias("place", "word")
        )
        pairs = every.join(F.broadcast(side), F.col("word") == F.col("token")).filter(
            counted | (fits & (F.slice("w", F.when(fits, start + 1).otherwise(1), F.size("win")) == F.col("win")))
        )
        found.append(
            pairs.select(
                "rid",
                F.when(counted, F.struct("doc", n.alias("n_words"))).alias("whole"),
                F.when(~counted, F.struct(start.alias("start"), (start + F.size("win")).alias("end"))).alias("span"),
                "item",
            )
        )
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy("rid")
        .agg(
            F.max("whole").alias("whole"),
            F.collect_set("span").alias("spans"),
            F.array_sort(F.collect_set("item")).alias("items"),
        )
        .select(
            "rid",
            F.col("whole.doc").alias("doc_id"),
            F.col("whole.n_words").cast("long").alias("n_words"),
            merged("spans").alias("spans"),
            "items",
        )
    )


def merged(spans: str) -> Column:
    """Overlapping or touching spans made one, in order, in one pass over them sorted."""
    kind = "array<struct<start: int, end: int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc["open"], F.lit(0))
        joins = F.coalesce(x["start"] <= last["end"], F.lit(False))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.struct(
            F.when(joins, acc["done"]).otherwise(F.concat(acc["done"], acc["open"])).cast(kind).alias("done"),
            F.array(F.when(joins, longer).otherwise(x)).cast(kind).alias("open"),
        )

    empty = F.array().cast(kind)
    return F.aggregate(
        F.array_sort(spans),
        F.struct(empty.alias("done"), empty.alias("open")),
        step,
        lambda acc: F.concat(acc["done"], acc["open"]),
    )


def covered(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` of which less than a twentieth of the words is hit."""
    rows = packed(docs).withColumn("key", content_key("row.doc_id", "row.text"))
    found = hits(
        rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), benchmark, size
    )
    # stored: its size decides whether the texts need a shuffle
    bad = frozen(
        found.filter(is_contaminated(covered("spans"), F.col("n_words")))
        .select(F.col("doc_id").alias("key"))
        .distinct()
    )
    return rows.join(bad, "key", "left_anti").select("row.*")
