"""Word rules, row handling and small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"  # what separates words where any other character is part of one
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z is lowered: words are 0-9a-z and non-ASCII
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(module: str) -> None:
    """Send the functions of ``module`` to the workers by value, so they need not have it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: str = "text") -> Column:
    """The text as bytes, empty for null; Arrow hands these to Python without decoding."""
    return text_of(column).cast("binary")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered and nothing else; ``lower`` does the same where all is ASCII, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def words(text: Column, separators: str) -> Column:
    return F.array_remove(F.split(text, separators), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once for each row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on ``key`` alone; SQL engines with md5 can repeat it."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(
        16**13
    )


def content_key(doc: str, text: str) -> Column:
    """What tells rows apart by content: the id, and the text by two hashes and its length."""
    body = text_of(text)
    return F.concat_ws(
        ":",
        F.coalesce(F.col(doc).cast("string"), F.lit("null")),
        F.xxhash64(body),
        F.crc32(body.cast("binary")),
        F.octet_length(body),
    )


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct ``row``: columns that an operator adds can't clash with its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
