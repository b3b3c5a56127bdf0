"""What the operators share: words, row keys, written intermediate tables, broadcasts of checked size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearcite.session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
WORDLESS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """The words of a text, cut at ASCII white space; none for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, wherever the optimizer moves the expression.

    A projected column that a later lambda reads can be inlined into it by filter push-down, and would then
    be computed for every element; a variable of a lambda can't.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(identity: Column, text: Column) -> Column:
    """Equal for rows of equal id and text, also for null ids: rows that repeat both get the same results."""
    digest = F.hex(F.xxhash64(F.coalesce(text, F.lit(""))))
    return F.concat_ws(":", F.coalesce(identity.cast("string"), F.lit("null")), digest)


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns _id, _text (null: empty) and _key of any table."""
    identity, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return df.select(identity.alias("_id"), F.coalesce(text, F.lit("")).alias("_text"), row_key(identity, text).alias("_key"))


def whole_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row as the struct _row, beside its _key: no other column can clash with names from outside."""
    key = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), key.alias("_key"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame (a stored one), marked for broadcast only if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
