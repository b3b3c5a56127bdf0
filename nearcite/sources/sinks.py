"""Write result tables, texts and graphs: hash buckets of queries, or one folder per query on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F


def _written(table: DataFrame, order: list[str], per_query: bool) -> DataFrameWriter:
    """Rows of a query together in one file, with ``query_id`` as a column or as the folder."""
    writer = table.repartition("query_id").sortWithinPartitions(*order).write.mode("errorifexists")
    return writer.partitionBy("query_id") if per_query else writer


def write_csv(table: DataFrame, path: str, per_query: bool = False) -> None:
    """The result table with a header, rows in rank order."""
    _written(table, ["query_id", "rank"], per_query).option("header", True).option("escape", '"').csv(path)


def write_text(context: DataFrame, path: str, column: str = "context", per_query: bool = False) -> None:
    """One text per query: a JSON line with its id, or a text file of its own."""
    if per_query:
        _written(context.select("query_id", F.col(column).alias("value")), ["query_id"], True).text(path)
    else:
        _written(context.select("query_id", column), ["query_id"], False).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, file_format: str = "parquet", per_query: bool = False) -> None:
    """Node and edge tables side by side, as parquet or json."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        _written(table, ["query_id"], per_query).format(file_format).save(f"{path}/{name}")


def export_table(df: DataFrame, path: str, key: str = "publication_number") -> None:
    """Plain parquet export in key ranges."""
    df.repartitionByRange(key).write.mode("errorifexists").parquet(path)
