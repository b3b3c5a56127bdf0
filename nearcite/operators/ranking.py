"""Similarity, blending, ordering and the tables people read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearcite.functions.text import percent
from nearcite.operators.links import Membership

MODES = {"blended": "blended_score", "similarity": "similarity", "graph": "ppr_score"}

RESULT_COLUMNS = [
    "rank",
    "publication_number",
    "title_text",
    "primary_assignee",
    "primary_inventor",
    "filed",
    "similarity_pct",
    "ppr_pct",
    "blended_pct",
]
STRUCTURAL_COLUMNS = ["rank", "publication_number", "title_text", "primary_assignee", "filed", "ppr_pct"]


def with_similarity(df: DataFrame) -> DataFrame:
    similarity = 1 - F.col("distance")
    return df.withColumn("similarity", similarity).withColumn("similarity_pct", percent(F.col("similarity")))


def number_rows(found: DataFrame) -> DataFrame:
    """``row_no`` 1..n by distance, and whether the row is the query itself.

    With enough equal vectors a query can miss its own result list; its first row then stands in.
    """
    per_query = Window.partitionBy("query_id")
    by_distance = per_query.orderBy("distance", "publication_number")
    itself = F.col("publication_number") == F.col("query_id")
    return (
        found.withColumn("row_no", F.row_number().over(by_distance))
        .withColumn("_has_self", F.max(itself).over(per_query))
        .withColumn("is_query", itself | (~F.col("_has_self") & (F.col("row_no") == 1)))
        .drop("_has_self")
    )


def exclude_self(numbered: DataFrame) -> DataFrame:
    """The results without the query's own row."""
    return numbered.where(~F.col("is_query"))


def blend(results: DataFrame, scores: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Add PPR and blended scores; ``scores`` is ``(query_id, node, ppr_raw, ppr_score)``.

    A result outside the graph scores 0. Queries without any scores keep nulls and
    ``ppr_available = false``. A graph has many more nodes than results: a Bloom filter of the results drops most of
    the others before they are shuffled.
    """
    available = scores.select("query_id").distinct().withColumn("_available", F.lit(True))
    by_id = scores.select("query_id", F.col("node").alias("publication_number"), "ppr_raw", "ppr_score")
    filter_ = Membership(results, ["query_id", "publication_number"])
    by_id = filter_.joined(by_id).where(filter_.may_hold(F.col("query_id"), F.col("publication_number"))).drop("member_bits")
    joined = results.join(by_id, ["query_id", "publication_number"], "left").join(available, "query_id", "left")
    known = F.col("_available").isNotNull()
    for name in ("ppr_raw", "ppr_score"):
        joined = joined.withColumn(name, F.when(known, F.coalesce(name, F.lit(0.0))))
    blended = alpha * F.coalesce("similarity", F.lit(0.0)) + (1 - alpha) * F.col("ppr_score")
    return (
        joined.withColumn("ppr_available", known)
        .withColumn("ppr_pct", percent(F.col("ppr_score")))
        .withColumn("blended_score", blended)
        .withColumn("blended_pct", percent(F.col("blended_score")))
        .drop("_available")
    )


def add_expanded_scores(expanded: DataFrame, scores: DataFrame) -> DataFrame:
    """PPR columns on expanded rows, for queries that have scores."""
    by_id = scores.select("query_id", F.col("node").alias("publication_number"), "ppr_raw", "ppr_score")
    return expanded.join(by_id, ["query_id", "publication_number"], "left").withColumn(
        "ppr_pct", percent(F.col("ppr_score"))
    )


def rank_results(results: DataFrame, mode: str | Column = "blended") -> DataFrame:
    """Add ``score`` and ``rank``. Similarity decides wherever PPR is not available.

    The mode may be a column, so that every query is ranked in its own; an unknown one ranks by similarity.
    """
    if isinstance(mode, str):
        chosen = F.col(MODES[mode])
    else:
        chosen = F.coalesce(*[F.when(mode == name, F.col(column)) for name, column in MODES.items()], F.col("similarity"))
    score = F.when(F.col("ppr_available"), chosen).otherwise(F.col("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc_nulls_last(), "publication_number")
    return results.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def result_table(ranked: DataFrame) -> DataFrame:
    """The columns on display, PPR columns null where there is no PPR."""
    return ranked.select("query_id", *RESULT_COLUMNS)


def leading(rows: DataFrame, score: str, n: int, digits: int) -> DataFrame:
    """The n rows of highest positive score per query, ties by id: ids and scores, before texts are joined to them."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, digits).desc(), "publication_number")
    return rows.where(F.col(score) > 0).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def structural_top(expanded: DataFrame, n: int = 10) -> DataFrame:
    """Expanded rows the graph ranks highest, positive scores only."""
    order = Window.partitionBy("query_id").orderBy(F.round("ppr_pct", 10).desc(), "publication_number")
    return (
        expanded.where(F.col("ppr_pct") > 0)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("query_id", *STRUCTURAL_COLUMNS)
    )
