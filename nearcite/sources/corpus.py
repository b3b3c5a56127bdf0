"""Read, build, copy and export the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearcite.functions.text import first_name
from nearcite.schema import CORPUS_COLUMNS
from nearcite.session import materialize
from nearcite.sources.ranges import StoredCorpus

MINIMAL_COLUMNS = [
    "publication_number",
    "filing_date",
    "title",
    "abstract",
    "embedding_v1",
    "cited_by",
    "top_terms",
    "primary_assignee",
    "primary_inventor",
]


def read_corpus(spark: SparkSession, name: str) -> DataFrame:
    """A corpus by parquet path, or by table name when it is not a path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def scan_probe(source: DataFrame) -> DataFrame:
    """Any one row, to look at the columns of a source."""
    return source.limit(1)


def filter_build(joined: DataFrame, country: str = "US", min_filing: int = 20060101) -> DataFrame:
    """Rows that belong into a corpus. Dates stay integers, so the test reaches the parquet scan."""
    return joined.where(
        (F.col("country_code") == country)
        & F.col("embedding_v1").isNotNull()
        & (F.col("filing_date") >= min_filing)
    )


def build_corpus(
    base: DataFrame,
    research: DataFrame,
    country: str = "US",
    min_filing: int = 20060101,
    columns: list[str] | None = None,
) -> DataFrame:
    """Join bibliographic and semantic rows, filter, and add the first assignee and inventor."""
    joined = filter_build(base.join(research, "publication_number"), country, min_filing)
    named = joined.withColumns(
        {
            "primary_assignee": first_name(F.col("assignee_harmonized")),
            "primary_inventor": first_name(F.col("inventor_harmonized")),
            "embedding_v1": F.col("embedding_v1").cast("array<double>"),
        }
    )
    return named.select(columns or CORPUS_COLUMNS)


def build_corpus_min(base: DataFrame, research: DataFrame, country: str = "US", min_filing: int = 20060101) -> DataFrame:
    """The narrow first version with nine columns."""
    return build_corpus(base, research, country, min_filing, MINIMAL_COLUMNS)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Store a corpus as plain files sorted by key range; see ``ranges`` for one that lookups and merges read in part."""
    corpus.repartitionByRange("publication_number").sortWithinPartitions("publication_number").write.mode(
        "errorifexists"
    ).parquet(path)


def copy_corpus(spark: SparkSession, source: str, target: str) -> None:
    """Copy the rows as they are. An IVF index is not part of the table and is built anew."""
    spark.read.parquet(source).write.mode("errorifexists").parquet(target)


def query_vectors(queries: DataFrame, corpus: DataFrame | StoredCorpus) -> DataFrame:
    """Embedding of every query id; ids the corpus lacks drop out: ``(query_id, embedding_v1)``."""
    if isinstance(corpus, StoredCorpus):
        ids = queries.select(F.col("query_id").alias("publication_number"))
        found = corpus.lookup(ids, ["publication_number", "embedding_v1"])
        return found.withColumnRenamed("publication_number", "query_id")
    ids = queries.select("query_id").distinct()
    vectors = corpus.select(F.col("publication_number").alias("query_id"), "embedding_v1")
    return vectors.join(ids, "query_id").select("query_id", "embedding_v1")


def id_position_map(df: DataFrame, key: str = "publication_number") -> DataFrame:
    """Position of every key in key order, from 0: ``(key, position)``.

    Range partitions are numbered one after the other: the only thing that is summed up in one place is
    the row count of each partition.
    """
    ranged = materialize(
        df.select(key)
        .repartitionByRange(key)
        .sortWithinPartitions(key)
        .select(
            key,
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        )
    )
    starts = _starts(ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    return ranged.join(starts, "part").select(key, (F.col("start") + F.col("place")).alias("position"))


def _starts(parts: DataFrame) -> DataFrame:
    """``(part, start)``: what stands in all parts before each, from ``(part, n)`` with a row a partition."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def file_row_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each file and where they start in file-name order: ``(file, n_rows, first_row)``."""
    files = (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    # running sums within ranges of files, then over the ranges: one place sees a row a range, not a row a file
    ranged = materialize(files.repartitionByRange("file").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_before", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    starts = _starts(ranged.groupBy("part").agg(F.sum("n_rows").alias("n")))
    return within.join(starts, "part").select("file", "n_rows", (F.col("start") + F.col("_before")).alias("first_row"))
