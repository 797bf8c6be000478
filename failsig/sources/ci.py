"""SRC-1..4, UDF-2, PRJ-1/3: runs, artifacts, jobs and logs exported from a CI service."""

from __future__ import annotations

import io
import os
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions.dimensions import is_log_artifact
from ..operators.scale import by_merge, frozen
from . import schemas

_FAILURE = "failure"

# the run and artifact ids of the wanted artifacts: a table with these columns, or a few pairs
Keys = DataFrame | Iterable[tuple[int, int]]


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An exported table in JSON lines. Broken lines are in :func:`broken_lines`."""
    return _json_lines(spark, path, schema).filter("_row._broken IS NULL").select("_row.*").drop(
        "_broken"
    )


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and line of what :func:`read_json_table` can't read."""
    return _json_lines(spark, path, schema).filter("_row._broken IS NOT NULL").select(
        "file", "line"
    )


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    row = F.from_json("line", f"{schema}, _broken string", options)
    return lines.filter(F.trim("line") != "").withColumn("_row", row)


def failed_runs(
    runs: DataFrame,
    limit: int | None = 20,
    event: str | None = None,
    workflow: str | None = None,
) -> DataFrame:
    """SRC-1, SRT-1: failed runs, newest first. ``limit=None`` keeps all of them."""
    out = runs.filter(F.col("conclusion") == _FAILURE)
    if event is not None:
        out = out.filter(F.col("event") == event)
    if workflow is not None:
        out = out.filter(F.col("workflow") == workflow)
    if limit is None:
        return out
    return out.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def failed_jobs(jobs: DataFrame) -> DataFrame:
    """SRC-4."""
    return jobs.filter(F.col("conclusion") == _FAILURE)


def log_artifacts(artifacts: DataFrame) -> DataFrame:
    """SRC-2, PRJ-1: artifacts that still exist and hold logs."""
    return artifacts.filter(~F.coalesce("expired", F.lit(False)) & is_log_artifact(F.col("name")))


def _file_path() -> Column:
    """The path of the row's file, percent-decoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _ids(path: Column) -> list[Column]:
    """``run_id`` and ``artifact_id`` come from ``run_id=.../artifact_id=...`` folders."""
    return [
        F.regexp_extract(path, f".*/{c}=([^/]*)/", 1).try_cast("bigint").alias(c)
        for c in ("run_id", "artifact_id")
    ]


def _one_form(path: Column) -> Column:
    """A path as listed or as a scan names it, which differ where the store has no host."""
    return F.regexp_replace(path, "^([^:/]+):///", "$1:/")


@contextmanager
def _reader(spark: SparkSession, files: str) -> Iterator[DataFrameReader]:
    """A reader of ``files`` below a folder.

    The ids are taken from the paths, as Spark's own discovery of partitions takes time that grows
    with the square of their number (265 s for 229,000 folders). Folders are listed by a few tasks
    a core, where Spark would start one for each, up to 10,000.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(8 * spark.sparkContext.defaultParallelism))
    try:
        yield spark.read.option("pathGlobFilter", files).option("recursiveFileLookup", True)
    finally:
        spark.conf.set(name, before)


def _listed(found: DataFrame) -> DataFrame:
    """path and ids of the files of a scan, from the listing that it has: none is opened."""
    spark, jvm = found.sparkSession, found.sparkSession._jvm
    # an array of strings has no other way into a table; paths are percent-encoded, so without breaks
    text = jvm.org.apache.hadoop.util.StringUtils
    paths = text.getStringCollection(text.join("\n", found._jdf.inputFiles()), "\n")
    rows = spark._jsparkSession.createDataset(paths, jvm.org.apache.spark.sql.Encoders.STRING())
    path = F.col("value")
    return frozen(DataFrame(rows.toDF(), spark).select(_one_form(path).alias("path"), *_ids(path)))


def _wanted(found: DataFrame, wanted: Keys | None, listed: DataFrame | None = None) -> DataFrame:
    """The files of the wanted artifacts; others are not opened.

    Of a table of keys only the paths of files that exist pass the driver, which lists them in any
    case, however many are wanted.
    """
    if wanted is None:
        return found
    path = F.col("_metadata.file_path")
    if isinstance(wanted, DataFrame):
        listed = _listed(found) if listed is None else listed
        keys = by_merge(wanted.select("run_id", "artifact_id"))
        held = listed.join(keys, ["run_id", "artifact_id"], "left_semi").select("path")
        text = found.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
        paths = getattr(held._jdf, "as")(text).collectAsList()
        return found.filter(Column(_one_form(path)._jc.isInCollection(paths)))
    pairs = list(wanted)
    run, artifact = _ids(path)
    return found.filter(run.isin({r for r, _ in pairs}) & artifact.isin({a for _, a in pairs}))


def _ids_from_path(files: DataFrame) -> DataFrame:
    """``run_id`` and ``artifact_id`` come from ``run_id=.../artifact_id=...`` folders."""
    return files.select(
        F.col("run_id").cast("bigint"),
        F.col("artifact_id").cast("bigint"),
        *[c for c in files.columns if c not in ("run_id", "artifact_id")],
    )


def _only(files: DataFrame, wanted: Keys | None) -> DataFrame:
    """The folders of the wanted artifacts; files of other folders are not opened.

    A table of keys is broadcast and prunes the folders when the scan starts, so the keys never
    pass the driver; give a bounded part of a larger one that has a filter of its own, as
    ``ingest_logs`` does.
    """
    if wanted is None:
        return files
    if isinstance(wanted, DataFrame):
        # the folders' numbers have whatever width they were inferred to have
        keys = wanted.select(
            *[F.col(c).cast(files.schema[c].dataType).alias(c) for c in ("run_id", "artifact_id")]
        )
        return files.join(F.broadcast(keys), ["run_id", "artifact_id"], "left_semi")
    pairs = list(wanted)
    runs, artifacts = {r for r, _ in pairs}, {a for _, a in pairs}
    return files.filter(F.col("run_id").isin(runs) & F.col("artifact_id").isin(artifacts))


def _lander(root: str, name: str):
    # local, so that it ships by value and workers need not have this package installed
    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for run, artifact, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{root}/run_id={run}/artifact_id={artifact}"
                os.makedirs(folder, exist_ok=True)
                draft = f"{folder}/.{name}.{attempt}"  # hidden until it is whole
                with open(draft, "wb") as out:
                    out.write((html or b"") + b"\n")
                os.replace(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"logs": [batch.num_rows]})

    return land


def land_logs(logs: DataFrame, path: str, name: str = "log.html") -> None:
    """Write ``logs`` (run_id, artifact_id, html; one row an artifact) as the files that
    :func:`html_logs` reads: ``path/run_id=1/artifact_id=2/log.html``, a line feed at the end.

    In a local or mounted folder Spark's writer starts a ``chmod`` process for each folder, file
    and checksum, six for a log; there the tasks write the files themselves. Other stores get the
    same folders from Spark's writer, which names the files itself, with the ending ``.txt``.
    """
    spark = logs.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(target)
    uri = store.makeQualified(target).toUri()
    rows = logs.select("run_id", "artifact_id", "html")
    if uri.getScheme() != "file":
        rows.write.mode("append").partitionBy("run_id", "artifact_id").text(path)
        return
    ids = [
        F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c)
        for c in ("run_id", "artifact_id")
    ]
    landed = rows.select(*ids, F.col("html").cast("binary")).mapInArrow(
        _lander(uri.getPath(), name), "logs bigint"
    )
    landed.write.format("noop").mode("overwrite").save()


def html_logs(
    spark: SparkSession, path: str, files: str = "*.html"
) -> Callable[[Keys | None], DataFrame]:
    """:func:`read_html_logs` of any number of slices: the folders are listed once, here."""
    with _reader(spark, files) as reader:
        found = reader.text(path, wholetext=True)
    listed: list[DataFrame] = []

    def read(wanted: Keys | None = None) -> DataFrame:
        if isinstance(wanted, DataFrame) and not listed:
            listed.append(_listed(found))
        return _wanted(found, wanted, *listed).select(
            *_ids(F.col("_metadata.file_path")),
            F.lit(0).alias("file_ord"),
            F.substring_index(_file_path(), "/", -1).alias("filename"),
            F.make_valid_utf8("value").alias("html"),
        )

    return read


def read_html_logs(
    spark: SparkSession, path: str, wanted: Keys | None = None, files: str = "*.html"
) -> DataFrame:
    """SRC-3 for unpacked logs: ``path/run_id=1/artifact_id=2/*.html``, or other ``files``.

    ``wanted`` names the (run, artifact) pairs to read, by default all. Given as pairs, others may
    still come where both of their ids are wanted, which the join with the artifacts drops.
    """
    found = spark.read.option("pathGlobFilter", files).text(path, wholetext=True)
    named = found.withColumn("filename", F.substring_index(_file_path(), "/", -1))
    return _ids_from_path(
        _only(named, wanted).select(
            "run_id",
            "artifact_id",
            F.lit(0).alias("file_ord"),
            "filename",
            F.make_valid_utf8("value").alias("html"),
        )
    )


def log_lines(
    spark: SparkSession, path: str, wanted: Keys | None = None, files: str = "*.html"
) -> DataFrame:
    """The logs of :func:`read_html_logs` line by line: one row a line, in order within each byte
    range (``file``, ``start``) that Spark reads by itself."""
    lines = (
        spark.read.option("pathGlobFilter", files)
        .option("lineSep", "\n")
        .text(path)
        .select(
            "run_id",
            "artifact_id",
            F.substring_index(_file_path(), "/", -1).alias("filename"),
            F.xxhash64("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.make_valid_utf8("value").alias("value"),
        )
    )
    return _ids_from_path(_only(lines, wanted))


def _unzipper():
    # local, so that it ships by value and workers need not have this package installed
    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def log(row, i: int, name: str, text: str | None, error: str | None) -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "run_id": [row.run_id],
                    "artifact_id": [row.artifact_id],
                    "file_ord": [i],
                    "filename": [name],
                    "html": pd.Series([text], dtype=object),
                    "error": pd.Series([error], dtype=object),
                }
            )

        for batch in batches:
            for row in batch.itertuples(index=False):
                name, i = "", -1
                try:
                    with zipfile.ZipFile(io.BytesIO(row.content)) as archive:
                        for i, name in enumerate(archive.namelist()):
                            if name.endswith(".html"):
                                text = archive.read(name).decode("utf-8", errors="replace")
                                yield log(row, i, name, text, None)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:
                    # what an archive that is cut, damaged, encrypted or too new raises
                    yield log(row, i, name, None, f"{type(e).__name__}: {e}")

    return unzip


def read_zip_logs(spark: SparkSession, path: str, wanted: Keys | None = None) -> DataFrame:
    """SRC-3, UDF-2 for archives as downloaded: ``path/run_id=1/artifact_id=2/*.zip``.

    Members leave the worker one at a time. An archive that can't be read gives a row with its
    ``error`` and no text, after the members before the damage. ``wanted`` as for
    :func:`read_html_logs`; archives of other artifacts are neither read nor unzipped.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return unzipped(_ids_from_path(_only(files, wanted).select("run_id", "artifact_id", "content")))


def unzipped(archives: DataFrame) -> DataFrame:
    """UDF-2: the logs in ``archives`` (run_id, artifact_id, content)."""
    return archives.mapInPandas(_unzipper(), f"{schemas.LOGS}, error string")
