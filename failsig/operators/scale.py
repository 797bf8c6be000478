"""Helpers that keep group-wise work spread over the cluster whatever the key distribution."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row number below

_JOBS: dict[str, str] = {}  # this driver's own folder in each checkpoint folder
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session within one machine's single process gets a folder of its own where the
    setting is missing, as in tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="failsig-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _delete(jvm, conf, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def scratch(spark: SparkSession) -> str:
    """A new path below this driver's folder in ``spark.checkpoint.dir``, deleted at its end."""
    base = checkpoint_dir(spark)
    if base not in _JOBS:
        _JOBS[base] = f"{base.rstrip('/')}/failsig-{uuid.uuid4().hex}"
        # bound now: the session may be stopped by then
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), _JOBS[base])
    return f"{_JOBS[base]}/{uuid.uuid4().hex}"


def frozen(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as Parquet below ``spark.checkpoint.dir`` and read back.

    Later stages see fixed rows, read only the columns they need, and outlive lost executors. The
    job's tables go when the driver ends, or earlier with ``release``.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``frozen`` that no later step reads."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            spark = table.sparkSession
            _delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Number all rows 0, 1, ... in a total order, without one task seeing all of them.

    The rows are range-partitioned and sorted, then frozen: partition numbers must not change
    between the two uses below. Only the row count of each partition meets in one task, so the
    broadcast side has as many rows as there are partitions.
    """
    rows = frozen(
        df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", _LOCAL_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_id", "_part", "_offset")
    )


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for a join by sorting and merging.

    Before the first stage Spark estimates a side by the compressed bytes of its files, whatever
    is exploded or built from them, and would broadcast one that is many times larger through
    the driver.
    """
    return df.hint("merge")


def salted_join(
    left: DataFrame, right: DataFrame, on: str | list[str], spread: str, salts: int = 32
) -> DataFrame:
    """Inner equi-join that splits each key of ``left`` over ``salts`` tasks, a power of two.

    ``right`` is repeated once per salt, so it should be the smaller side. ``spread`` is a column
    of ``left`` that varies within a key. Neither side is broadcast: what ``right`` was estimated to
    hold leaves the salts out.
    """
    keys = [on] if isinstance(on, str) else on
    # never null, unlike a modulus: the join adds no null filter to push down and evaluate
    salted = left.withColumn("_salt", F.xxhash64(spread).bitwiseAND(F.lit(salts - 1)))
    repeated = right.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return salted.join(by_merge(repeated), [*keys, "_salt"]).drop("_salt")


def spread(df: DataFrame, by: str) -> DataFrame:
    """A scan of less than one split, dealt over all cores by the hash of a key column.

    One small file is one task, however many regular expressions follow. Only an input that is
    smaller than a single split by its file sizes is moved, so a shuffle of at most that many
    bytes is all this can cost; anything larger is read as it lies.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(spark.sparkContext.defaultParallelism, by) if size < split else df
