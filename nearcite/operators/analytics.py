"""Counts and distributions over result sets.

Every count is an aggregation Spark combines before the shuffle, followed by a per-query top-n that it
limits before the shuffle, so neither a popular name nor a very large result set lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearcite.functions.text import cpc_label, cpc_section
from nearcite.operators.expand import sequence_key
from nearcite.operators.links import link_count


def unnest_names(results: DataFrame, column: str) -> DataFrame:
    """One row per non-empty name of a ``{name, country}`` array: ``(query_id, row_no, pos, name)``."""
    return (
        results.select("query_id", "row_no", F.posexplode(column).alias("pos", "item"))
        .select("query_id", "row_no", "pos", F.col("item.name").alias("name"))
        .where(F.coalesce(F.col("name"), F.lit("")) != "")
    )


def _count_top(values: DataFrame, column: str, n: int | None) -> DataFrame:
    """Counts per query, largest first; equal counts in order of first appearance."""
    counted = values.groupBy("query_id", column).agg(
        F.count(F.lit(1)).alias("n"), F.min(sequence_key(F.col("row_no"), F.col("pos"))).alias("_first")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "_first", column)
    placed = counted.withColumn("place", F.row_number().over(order))
    if n is not None:
        placed = placed.where(F.col("place") <= n)
    return placed.select("query_id", "place", column, "n")


def top_names(results: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent names: ``(query_id, place, name, n)``. A row that names one twice counts twice."""
    return _count_top(unnest_names(results, column), "name", n)


def cpc_distribution(results: DataFrame, letters_only: bool = True) -> DataFrame:
    """Counts per classification section: ``(query_id, place, section, n, label)``.

    With ``letters_only`` sections are upper-cased letters; otherwise the first character as it is.
    """
    codes = results.select("query_id", "row_no", F.posexplode("cpc").alias("pos", "item"))
    code = F.col("item.code")
    section = cpc_section(code) if letters_only else F.substring(code, 1, 1)
    sections = codes.select("query_id", "row_no", "pos", section.alias("section")).where(F.col("section").isNotNull())
    return _count_top(sections, "section", None).withColumn("label", cpc_label(F.col("section")))


def top_terms(results: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent terms over the results: ``(query_id, place, term, n)``."""
    terms = (
        results.select("query_id", "row_no", F.posexplode("top_terms").alias("pos", "item"))
        .select("query_id", "row_no", "pos", F.col("item.value").alias("term"))
        .where(F.coalesce(F.col("term"), F.lit("")) != "")
    )
    return _count_top(terms, "term", n)


def kpi(results: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """One row per query: result count, distinct first names, mean similarity, expanded rows found."""

    def named(column: str) -> Column:
        return F.count_distinct(F.when(F.col(column) != "", F.col(column)))

    table = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_results"),
        named("primary_assignee").alias("n_assignees"),
        named("primary_inventor").alias("n_inventors"),
        F.avg("similarity_pct").alias("avg_similarity_pct"),
    )
    if expanded is None:
        return table.withColumn("n_expanded", F.lit(0).cast("bigint"))
    found = expanded.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expanded"))
    return table.join(found, "query_id", "left").withColumn("n_expanded", F.coalesce("n_expanded", F.lit(0)))


def citation_counts(df: DataFrame) -> DataFrame:
    """Lengths of the four link arrays; a missing array has length 0."""
    lengths = {
        "forward_citation_count": "cited_by",
        "backward_citation_count": "citation",
        "parent_count": "parent",
        "child_count": "child",
    }
    return df.withColumns({name: link_count(column) for name, column in lengths.items()})


def shared_assignees(ranked: DataFrame, head: int = 10) -> DataFrame:
    """First assignees that occur more than once among the first rows: ``(query_id, assignee, n, first_rank)``."""
    named = F.coalesce(F.col("primary_assignee"), F.lit(""))
    return (
        ranked.where((F.col("rank") <= head) & ~named.isin("", "N/A"))
        .groupBy("query_id", F.col("primary_assignee").alias("assignee"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"))
        .where(F.col("n") > 1)
    )
