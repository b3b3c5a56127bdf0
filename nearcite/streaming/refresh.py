"""Merge arriving source files into a stored corpus, as a stream.

The corpus is stored by key range, in numbered versions. Each micro-batch merges into the latest version below its
own and writes the ranges it touches and the next range map, so a batch that is run again after a failure writes
the same version again, and readers never see a half-written one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nearcite.schema import CORPUS
from nearcite.session import broadcast_small, materialize
from nearcite.sources import ranges
from nearcite.sources.corpus import build_corpus
from nearcite.sources.ranges import ROWS_PER_RANGE, versions

__all__ = ["finish", "publish", "read_latest", "stream_merge", "stream_refresh", "versions"]


def finish(query: StreamingQuery) -> None:
    """Wait until a stream has taken all it found, however long that takes. If it fails, so does this."""
    query.awaitTermination()


def read_latest(spark: SparkSession, folder: str, below: int | None = None, above: int | None = None) -> DataFrame | None:
    """The rows of the newest version, or the newest below a number; None when there is none.

    With ``above`` only a version above that number is an answer: without one, whoever should have written it has not,
    and what stood there before must not pass for its result, so that is an error.
    """
    store = ranges.latest(spark, folder, below)
    if above is not None and (store is None or store.version <= above):
        raise RuntimeError(f"{folder} has no version above {above}: the merge that should have written one has not")
    return None if store is None else store.read()


def publish(corpus: DataFrame, folder: str, version: int, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Store a whole corpus as a version."""
    ranges.create(corpus.select(CORPUS.fieldNames()), folder, rows_per_range, version)


def stream_merge(
    spark: SparkSession,
    in_dir: str,
    target_dir: str,
    checkpoint: str,
    schema: T.StructType = CORPUS,
    rows_of: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Take every file in ``in_dir`` that has not been taken yet, then stop.

    A batch may bring a key several times (later files correct earlier ones); the row of the newest
    file counts. Version 0 is the corpus before the stream; batch n writes version n + 1. Files hold corpus
    rows, or rows of ``schema`` keyed alike from which ``rows_of`` makes corpus rows.
    """
    arriving = (
        spark.readStream.schema(schema)
        .parquet(in_dir)
        .select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("_age"), F.col("_metadata.row_index").alias("_at"))
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        newest = _newest(batch).select(schema.fieldNames())
        rows = (newest if rows_of is None else materialize(rows_of(newest))).select(CORPUS.fieldNames())
        store = ranges.latest(batch.sparkSession, target_dir, below=batch_id + 1)
        if store is None:
            publish(rows, target_dir, batch_id + 1)
        else:
            store.merge(rows, version=batch_id + 1)

    return (
        arriving.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest(batch: DataFrame) -> DataFrame:
    """Of the rows of a key the one in the newest file. Keys and places decide; the rows themselves stay where they are."""
    order = Window.partitionBy("publication_number").orderBy(F.desc("_age"), "_at")
    placed = batch.select("publication_number", "_age", "_at").withColumn("_n", F.row_number().over(order))
    older = materialize(placed.where(F.col("_n") > 1).select("_age", "_at"))
    return batch.join(broadcast_small(older), ["_age", "_at"], "left_anti")


def stream_refresh(
    spark: SparkSession, base_dir: str, research: DataFrame, target_dir: str, checkpoint: str, schema: T.StructType,
    country: str = "US", min_filing: int = 20060101,
) -> StreamingQuery:
    """Merge arriving bibliographic rows: each batch is joined with the semantic source and filtered like a build."""
    return stream_merge(
        spark, base_dir, target_dir, checkpoint, schema, lambda batch: build_corpus(batch, research, country, min_filing)
    )
