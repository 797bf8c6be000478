"""SRC-6..8, SNK-1/2: the pattern knowledge base as Parquet tables in one folder.

A job writes its rows into new ``version=ID`` folders and then publishes them with one commit
file, so readers see all of a job or nothing of it and a lost job can simply run again. No table
is rewritten by a batch: a pattern table is a base and the deltas since, in buckets by signature,
and reading folds them. ``compact`` turns them into a new base. ``failures``, ``occurrences`` (the
ledger), ``runs_seen`` and ``skipped`` only grow. ``ledger_files``, kept as bases and deltas too,
names the ledger files of each run, so a batch opens only those that hold one of its runs.

Several writers may work at once. A commit file is created under the next number only if that
number is free; a writer who comes second looks at what was committed meanwhile. Deltas of
different runs add up in any order, so they are kept as written; a base takes along the deltas
that came after it was read; anything else starts anew. Writers in several processes need a file
system whose rename fails if the target exists, as that of HDFS does.
"""

from __future__ import annotations

import json
import secrets
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fold import Patterns, folded
from . import schemas

_GROWING = {
    "failures": schemas.FAILURES,
    "occurrences": schemas.OCCURRENCES,
    "runs_seen": schemas.RUNS_SEEN,
    "skipped": schemas.SKIPPED,
}
# what tables are sorted by; the ledger is met again by run
_SORT = {"occurrences": "run_id", "ledger_files": "run_id"}
_SORT_ELSE = "signature_hash"

_STORED = {**_GROWING, **schemas.PATTERN_TABLES, "ledger_files": schemas.LEDGER_FILES}

BUCKETS = 16  # of pattern tables; a lookup reads one
DELTAS = 20  # after so many, an ingest compacts
KEPT = 5  # commits whose tables stay on disk after a compaction, for readers of older states
ORPHANED = 24 * 3600  # seconds after which folders that no commit names are taken for lost
_RANDOM_BITS = 20  # below the commit number in the name of a folder
_RENAMING = threading.Lock()


@dataclass(frozen=True)
class State:
    """The knowledge base as of one commit: the folders of each pattern table."""

    version: int = 0
    tables: dict[str, list[int]] = field(default_factory=dict)


def _bucket(signature_hash: Column) -> Column:
    return F.pmod(F.xxhash64(signature_hash), F.lit(BUCKETS)).cast("int")


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- reading ------------------------------------------------------------------------

    def _read(self, path: str, schema: str) -> DataFrame:
        """A Parquet table, empty when its folder is not there yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(schemas.COMMITS).json(f"{self.root}/commits/*.json")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schemas.COMMITS)

    def state(self) -> State:
        """What the newest commit says; only its file is read."""
        api, files, _ = self._hadoop()
        folder = api.Path(f"{self.root}/commits")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        newest = max((n for n in names if n.endswith(".json")), default=None)
        if newest is None:
            return State()
        last = self.spark.read.schema(schemas.COMMITS).json(f"{self.root}/commits/{newest}").first()
        return State(last["version"], last["tables"] or {})

    def has_batch(self, source: str, batch_id: int) -> bool:
        """Whether a stream's batch is in already."""
        found = self._commits().filter(
            (F.col("source") == source) & (F.col("batch_id") == batch_id)
        )
        return not found.isEmpty()

    def read_data(self, table: str, data: int) -> DataFrame:
        """The rows that one job wrote."""
        schema = _STORED[table]
        return self._read(f"{table}/version={data}", schema).drop("bucket")

    def _parts(self, state: State, bucket: Column | None = None) -> Patterns:
        """The rows of bases and deltas."""
        tables = {}
        for name, schema in schemas.PATTERN_TABLES.items():
            folders = [f"{self.root}/{name}/version={d}" for d in state.tables.get(name, [])]
            schema += ", version bigint, bucket int"
            rows = (
                self.spark.read.schema(schema)
                .option("basePath", f"{self.root}/{name}")
                .parquet(*folders)
                if folders
                else self.spark.createDataFrame([], schema)
            )
            if bucket is not None:
                rows = rows.filter(F.col("bucket") == bucket)
            tables[name] = rows.drop("version", "bucket")
        return Patterns(**tables)

    def patterns(self, state: State | None = None, bucket: Column | None = None) -> Patterns:
        """SRC-6. A table without deltas is read as it is, the others are folded."""
        state = state or self.state()
        parts = self._parts(state, bucket)
        merged = folded(parts)
        return Patterns(
            **{
                name: (merged if len(state.tables.get(name, [])) > 1 else parts).tables()[name]
                for name in schemas.PATTERN_TABLES
            }
        )

    def lookup(self, signature_hash: str) -> DataFrame:
        """SRC-7: the pattern of one hash. One bucket of the base and of each delta is opened, and
        the filter reaches their sorted files."""
        core = self.patterns(bucket=_bucket(F.lit(signature_hash))).core
        return core.filter(F.col("signature_hash") == signature_hash)

    def grown(self, table: str) -> DataFrame:
        """All committed rows of a table that only grows."""
        rows = self._read(table, f"{_GROWING[table]}, version bigint")
        ingests = self._commits().filter("appended").select(F.col("data").alias("version"))
        return rows.join(ingests, "version", "left_semi").drop("version")

    def runs_seen(self) -> DataFrame:
        """SRC-8."""
        return self.grown("runs_seen").distinct()

    def _ledger_files(self, state: State) -> DataFrame:
        folders = [f"{self.root}/ledger_files/version={d}" for d in state.tables.get("ledger_files", [])]
        if not folders:
            return self.spark.createDataFrame([], schemas.LEDGER_FILES)
        return self.spark.read.schema(schemas.LEDGER_FILES).parquet(*folders)

    def ledger(self, state: State, runs: DataFrame) -> DataFrame:
        """JN-6: the rows of the ledger files that hold any of ``runs``; no other file is opened.

        The index is exact, so a run that is not in yet opens nothing. Only names of files pass the
        driver, which lists what a scan reads in any case.
        """
        held = self._ledger_files(state).join(runs.select("run_id"), "run_id", "left_semi")
        names = [r["file"] for r in held.select("file").distinct().collect()]
        if not names:
            return self.spark.createDataFrame([], schemas.OCCURRENCES)
        files = [f"{self.root}/occurrences/{n}" for n in names]
        return self.spark.read.schema(schemas.OCCURRENCES).parquet(*files)

    def pending(self, schema: str) -> DataFrame:
        """Parsed records of a stream whose run or artifact has not landed yet."""
        (data,) = self.state().tables.get("pending") or [0]
        return self._read(f"pending/version={data}", schema)

    # -- writing ------------------------------------------------------------------------

    def new_data(self, state: State) -> int:
        """A name for the folders of a job that starts from ``state``, unlike any other job's."""
        return (state.version + 1 << _RANDOM_BITS) | secrets.randbelow(1 << _RANDOM_BITS)

    def write(self, table: str, data: int, df: DataFrame) -> DataFrame:
        """Write one table of a job and return it as stored."""
        schema = _STORED[table]
        columns = self.spark.createDataFrame([], schema).columns
        out = df.select(*columns)
        by = []
        if table in schemas.PATTERN_TABLES:
            by = ["bucket"]
            # few files to a bucket, more where one is large
            out = out.withColumn("bucket", _bucket(F.col("signature_hash"))).hint("rebalance", "bucket")
        elif table in _SORT:
            # a run lies in one file, or in several where it is large
            out = out.hint("rebalance", _SORT[table])
        key = _SORT.get(table, _SORT_ELSE)
        if key in columns:
            out = out.sortWithinPartitions(*by, key)
        out.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{table}/version={data}")
        return self.read_data(table, data)

    def write_ledger(self, data: int, occurrences: DataFrame) -> DataFrame:
        """Write a job's part of the ledger and the index of its runs; gives it as stored."""
        stored = self.write("occurrences", data, occurrences)
        name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
        file = F.concat(F.lit(f"version={data}/"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))
        self.write("ledger_files", data, stored.select("run_id", file.alias("file")).distinct())
        return stored

    def write_pending(self, data: int, records: DataFrame) -> None:
        records.write.mode("overwrite").parquet(f"{self.root}/pending/version={data}")

    def commit(
        self,
        state: State,
        data: int,
        deltas: list[str] | None = None,
        bases: list[str] | None = None,
        appended: bool = False,
        source: str = "",
        batch_id: int = -1,
        conflict: Callable[[list[int]], bool] = lambda others: False,
    ) -> bool:
        """Publish what a job that read ``state`` wrote to ``data``; False if it must start anew.

        ``deltas`` are pattern tables it adds rows to, ``bases`` those it replaces. ``conflict``
        is asked about the data of commits that came in between and added rows.
        """
        checked = state.version
        while True:
            now = self.state()
            if now.version > checked:
                between = self._commits().filter(F.col("version") > checked)
                others = [r["data"] for r in between.filter("appended").select("data").collect()]
                if others and appended and conflict(others):
                    return False
                checked = now.version
            tables = dict(now.tables)
            for name in bases or []:
                read = state.tables.get(name, [])
                if now.tables.get(name, [])[: len(read)] != read:
                    return False  # another base was put there
                tables[name] = [data, *now.tables.get(name, [])[len(read) :]]
            for name in deltas or []:
                tables[name] = [*tables.get(name, []), data]
            row = {
                "version": now.version + 1,
                "source": source,
                "batch_id": batch_id,
                "appended": appended,
                "data": data,
                "tables": tables,
            }
            if self._publish(now.version + 1, json.dumps(row)):
                return True

    def _hadoop(self):
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs, root.getFileSystem(conf), conf

    def _publish(self, version: int, text: str) -> bool:
        """Create a commit file with its whole content; False if the number is taken."""
        api, files, conf = self._hadoop()
        draft = api.Path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        target = api.Path(f"{self.root}/commits/{version:020d}.json")
        files.mkdirs(target.getParent())
        context = api.FileContext.getFileContext(files.getUri(), conf)
        # a local folder has no rename that fails if the target exists: one at a time there
        none = self.spark._sc._gateway.new_array(getattr(api, "Options$Rename"), 0)
        try:
            with _RENAMING:
                context.rename(draft, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            files.delete(draft, False)
            return False
        return True

    def replace_patterns(
        self, change: Callable[[Patterns], Patterns], names: list[str] | None = None
    ) -> None:
        """SNK-1: new bases for all pattern tables, or the named ones, made from the present ones.

        If another job replaced one of them meanwhile, ``change`` is applied again.
        """
        names = names or list(schemas.PATTERN_TABLES)
        while True:
            state = self.state()
            data = self.new_data(state)
            changed = change(self.patterns(state)).tables()
            for name in names:
                self.write(name, data, changed[name])
            if self.commit(state, data, bases=names):
                return

    # -- upkeep -------------------------------------------------------------------------

    def deltas(self) -> int:
        """How many deltas a reader of the patterns has to fold."""
        return max([len(d) - 1 for t, d in self.state().tables.items() if t != "pending"], default=0)

    def compact(self) -> bool:
        """Fold bases and deltas into one base per table and drop what no reader needs any more.

        Until its commit nothing has changed, so a compaction that is lost can run again; one that
        meets another base leaves everything to that. Deltas that come in meanwhile stay.
        """
        state = self.state()
        tables = {**self.patterns(state).tables(), "ledger_files": self._ledger_files(state)}
        names = [t for t in tables if len(state.tables.get(t, [])) > 1]
        if not names:
            return False
        data = self.new_data(state)
        for name in names:
            self.write(name, data, tables[name])
        done = self.commit(state, data, bases=names)
        if done:
            self.clean()
        return done

    def clean(self) -> int:
        """Delete folders of pattern tables that only older states name, and those of jobs that
        were lost; gives their number."""
        commits = self._commits().select("version", F.explode("tables").alias("table", "ids"))
        commits = commits.select("version", "table", F.explode("ids").alias("id"))
        newest = self.state().version
        last = commits.groupBy("table", "id").agg(F.max("version").alias("last")).collect()
        named = {(r["table"], r["id"]): r["last"] for r in last}
        api, files, _ = self._hadoop()
        dropped = 0
        for table in [*schemas.PATTERN_TABLES, "ledger_files", "pending"]:
            folder = api.Path(f"{self.root}/{table}")
            if not files.exists(folder):
                continue
            for status in files.listStatus(folder):
                data = int(status.getPath().getName().removeprefix("version="))
                seen = named.get((table, data))
                if seen is None:
                    old = status.getModificationTime() / 1000 < time.time() - ORPHANED
                else:
                    old = seen <= newest - KEPT
                if old:
                    files.delete(status.getPath(), True)
                    dropped += 1
        return dropped
