"""Upsert a corpus with rebuilt source rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearcite.schema import LINK_COLUMNS


def merge(
    target: DataFrame,
    source: DataFrame,
    key: str = "publication_number",
    update_cols: tuple[str, ...] = LINK_COLUMNS,
) -> DataFrame:
    """New rows are inserted whole; known rows take only ``update_cols`` from the source; nothing is deleted.

    One full outer join, with all columns of both sides in the shape of the target. Several source
    rows for one key make the result undefined, so they raise an error, as a MERGE statement does.
    """
    checked = one_row_per_key(source.select(target.columns), key)
    old, new = F.col("_old.row"), F.col("_new.row")
    both = target.select(key, F.struct(*target.columns).alias("row")).alias("_old").join(
        checked.select(key, F.struct(*target.columns).alias("row")).alias("_new"), key, "full_outer"
    )
    merged = [
        F.when(new.isNotNull() if c in update_cols else old.isNull(), new[c]).otherwise(old[c]).alias(c)
        for c in target.columns
    ]
    return both.select(merged)


def one_row_per_key(source: DataFrame, key: str) -> DataFrame:
    """The rows, failing the job when a key occurs twice. They are shuffled once, by key, as a join needs them next."""
    counted = source.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    repeated = F.raise_error(F.concat(F.lit("several source rows for key "), F.col(key)))
    return counted.where(F.when(F.col("_n") == 1, True).otherwise(repeated.cast("boolean"))).drop("_n")


def merge_dup_check(source: DataFrame, key: str = "publication_number") -> DataFrame:
    """Keys that occur more than once, with their counts; empty when the source can be merged."""
    return source.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def merge_actions(target: DataFrame, source: DataFrame, key: str = "publication_number") -> DataFrame:
    """What a merge does with each key: inserted, updated or untouched."""
    both = target.select(key, F.lit(True).alias("_old")).join(
        source.select(key, F.lit(True).alias("_new")), key, "full_outer"
    )
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "untouched").otherwise("updated")
    return both.select(key, action.alias("action"))


def merge_stats(target: DataFrame, source: DataFrame, key: str = "publication_number") -> DataFrame:
    """``(action, n)``."""
    return merge_actions(target, source, key).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
