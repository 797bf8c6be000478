"""SRC-5, SRT-7: test sources of a checkout, line by line."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_lines

# Folders that are scanned, in scan order, and the file types.
TEST_DIRS = ("test/e2e", "test/system", "test/upgrade", "test/farm")
SOURCE_GLOB = "*.{go,bats}"


def source_lines(spark: SparkSession, root: str, files: str = SOURCE_GLOB) -> DataFrame:
    """file (relative to ``root``), line (from 1), text and dir_ord. Only the four folders are
    listed, and only ``files`` in them read.

    Scan order is dir_ord, then the parts of the path, then line.
    """
    if "://" not in root:
        root = os.path.abspath(root)
    prefix = root.removeprefix("file://").rstrip("/") + "/"
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    relative = F.substring(path, F.instr(path, prefix) + F.lit(len(prefix)), F.length(path))

    found = []
    for i, folder in enumerate(TEST_DIRS):
        try:
            lines = (
                spark.read.option("pathGlobFilter", files)
                .option("recursiveFileLookup", True)
                .text(f"{root.rstrip('/')}/{folder}", wholetext=True)
            )
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # checkouts need not have all of them
        found.append(
            lines.select(
                relative.alias("file"),
                F.lit(i).alias("dir_ord"),
                F.make_valid_utf8("value").alias("_source"),
            )
        )
    if not found:
        return spark.createDataFrame([], "file string, dir_ord int, line int, text string")
    files = reduce(DataFrame.unionAll, found)
    return files.select(
        "file", "dir_ord", F.posexplode(split_lines(F.col("_source"))).alias("_pos", "text")
    ).select("file", "dir_ord", (F.col("_pos") + 1).alias("line"), "text")
