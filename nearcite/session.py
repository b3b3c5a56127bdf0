"""Session helpers: a local session for tests and bench, and tables in the checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, memory: str = "12g", name: str = "nearcite") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the session names, or a new one in local mode.

    On a cluster a machine-local folder would not survive an executor, so an unset
    ``spark.checkpoint.dir`` is an error there.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="nearcite-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)
    return folder


_WRITTEN: dict[str, list[str]] = {}


def materialize(df: DataFrame, spread: tuple[str, ...] = ()) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and go on from there.

    The plan starts anew at a columnar scan with known sizes, and a lost executor costs no recomputation.
    ``spread`` names columns by which rows are distributed over all cores first: for small tables whose
    rows the next step multiplies, which file sizes cannot tell. (A repartition by the very columns the
    rows are already hashed by would be optimised away and the partitions coalesced.)
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    if spread:
        tasks = spark.sparkContext.defaultParallelism
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # executors may yet be added
            tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        df = df.repartition(tasks, *spread)
    return _store(df, path)


def broadcast_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has at most so many; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _store(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


class Turns:
    """Tables of an iteration: each is written, and the one before it deleted unless it is to be kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.last = spark, None

    def next(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/turn-{uuid.uuid4().hex}"
        stored = _store(df, path)
        if self.last is not None:
            _delete(self.spark, self.last)
            _WRITTEN[self.spark.sparkContext.applicationId].remove(self.last)
        self.last = path
        return stored

    def keep(self) -> None:
        """The newest table is still read by a result."""
        self.last = None


def drop_materialized(spark: SparkSession) -> int:
    """Delete the tables this application has written with ``materialize``; returns how many.

    DataFrames that read them, such as those of a ``Search``, must not be used any more.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    table = context._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(context._jsc.hadoopConfiguration()).delete(table, True)
