"""Per-query text: result blocks, graph context, prompts and the query card.

Only a fixed number of rows per query (5, 10 or 20) ever reaches an aggregate that builds text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearcite.functions.text import content_key, fill_template, fixed4_text, or_na, percent_text
from nearcite.operators.analytics import shared_assignees

BLOCKS = 5
ABSTRACT_IN_BLOCK, ABSTRACT_IN_CARD, ABSTRACT_IN_PROMPT = 500, 600, 800
EDGE_LINES, SHARED_HEAD, EXPANDED_LINES, CARD_TERMS = 20, 10, 3, 8

# Headings of the context sections.
CITATIONS_HEADING = "\nCitation relationships between results:\n"
SHARED_HEADING = "\nShared assignees:\n"
IMPORTANT_HEADING = "\nStructurally important patents discovered via citation network:\n"

PLAIN_TEMPLATE = """Starting document: {query_id}
Title: {title}
Abstract: {abstract}

Documents nearest to it by their vectors:

{results}

Describe in simple sentences what these documents deal with, who owns them, and where they differ from
the starting document. Say so where the texts above do not tell."""

GRAPH_TEMPLATE = """Starting document: {query_id}
Title: {title}
Abstract: {abstract}

Documents near it. Each has a similarity of vectors and a rank value (PPR) from the links around the
starting document; their order weighs both.

{results}

Explain which of these documents the links make central and what joins them to the starting document.
Then list what they have in common, with the number of a document behind every statement."""


def _lines(rows: DataFrame, order: str, name: str, separator: str = "\n") -> DataFrame:
    """One text per query out of few ``(query_id, order, line)`` rows."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "line")))
    text = F.array_join(F.transform(ordered, lambda item: item["line"]), separator)
    return rows.groupBy("query_id").agg(text.alias(name))


def _block(*score_line: Column) -> Column:
    return F.concat(
        F.lit("Result "),
        F.col("rank").cast("string"),
        F.lit(": "),
        F.col("publication_number"),
        F.lit("\nTitle: "),
        F.col("title_text"),
        F.lit("\nAssignee: "),
        F.coalesce("primary_assignee", F.lit("N/A")),
        F.lit("\nAbstract: "),
        F.substring("abstract_text", 1, ABSTRACT_IN_BLOCK),
        F.lit("\n"),
        *score_line,
        F.lit("\n---"),
    )


def context_plain(ranked: DataFrame) -> DataFrame:
    """The first five results as text: ``(query_id, context)``."""
    block = _block(F.lit("Similarity: "), percent_text(F.col("similarity")))
    return _lines(ranked.where(F.col("rank") <= BLOCKS).select("query_id", "rank", block.alias("line")), "rank", "context")


def context_graph(ranked: DataFrame, edges: DataFrame, expanded: DataFrame) -> DataFrame:
    """Blocks with three scores, citations between results, shared assignees, important expanded rows.

    ``ranked`` and ``expanded`` carry the PPR columns, ``edges`` are those between results. Sections
    without content are left out.
    """
    block = _block(
        F.lit("Text Similarity: "),
        percent_text(F.col("similarity")),
        F.lit(" | Graph Importance (PPR): "),
        fixed4_text(F.coalesce("ppr_raw", F.lit(0.0))),
        F.lit(" | Blended: "),
        percent_text(F.coalesce("blended_score", "similarity")),
    )
    blocks = _lines(ranked.where(F.col("rank") <= BLOCKS).select("query_id", "rank", block.alias("line")), "rank", "blocks")

    per_query = Window.partitionBy("query_id")
    cited = edges.withColumn("n", F.row_number().over(per_query.orderBy("src", "dst"))).where(F.col("n") <= EDGE_LINES)
    cited = cited.select("query_id", "n", F.format_string("  %s --[%s]--> %s", "src", "edge_type", "dst").alias("line"))

    shared = shared_assignees(ranked, SHARED_HEAD).select(
        "query_id",
        F.struct((-F.col("n")).alias("n"), "first_rank").alias("n"),
        F.format_string("  %s: %d patents", "assignee", "n").alias("line"),
    )

    important = per_query.orderBy(F.round("ppr_raw", 12).desc(), "publication_number")
    found = (
        expanded.where(F.col("ppr_raw") > 0)
        .withColumn("n", F.row_number().over(important))
        .where(F.col("n") <= EXPANDED_LINES)
        .select(
            "query_id",
            "n",
            F.concat(
                F.lit("  "),
                F.col("publication_number"),
                F.lit(": "),
                F.col("title_text"),
                F.lit(" (PPR: "),
                fixed4_text(F.col("ppr_raw")),
                F.lit(")"),
            ).alias("line"),
        )
    )
    headed = {
        "citations": (CITATIONS_HEADING, _lines(cited, "n", "citations")),
        "shared": (SHARED_HEADING, _lines(shared, "n", "shared")),
        "important": (IMPORTANT_HEADING, _lines(found, "n", "important")),
    }
    joined = blocks
    for _, section in headed.values():
        joined = joined.join(section, "query_id", "left")
    sections = [F.concat(F.lit(title), F.col(name)) for name, (title, _) in headed.items()]
    return joined.select("query_id", F.concat_ws("\n", "blocks", *sections).alias("context"))


def prompt(
    context: DataFrame,
    query_rows: DataFrame,
    plain_template: str = PLAIN_TEMPLATE,
    graph_template: str = GRAPH_TEMPLATE,
) -> DataFrame:
    """Fill the template that fits: ``(query_id, ppr_available, prompt, content_key)``.

    ``context`` is ``(query_id, ppr_available, context)``; the key identifies the context text.
    """
    about = query_rows.select("query_id", "publication_number", "title_text", "abstract_text")
    slots = {
        "query_id": F.col("publication_number"),
        "title": F.col("title_text"),
        "abstract": F.substring("abstract_text", 1, ABSTRACT_IN_PROMPT),
        "results": F.col("context"),
    }
    text = F.when(F.col("ppr_available"), fill_template(graph_template, slots)).otherwise(
        fill_template(plain_template, slots)
    )
    return context.join(about, "query_id").select(
        "query_id", "ppr_available", text.alias("prompt"), content_key(F.col("context")).alias("content_key")
    )


def query_card(query_rows: DataFrame) -> DataFrame:
    """What the card of the query document shows."""
    terms = F.transform(
        F.slice(F.coalesce("top_terms", F.array().cast("array<struct<value:string>>")), 1, CARD_TERMS),
        lambda item: item["value"],
    )
    return query_rows.select(
        "query_id",
        "publication_number",
        "title_text",
        or_na(F.col("primary_assignee")).alias("assignee"),
        or_na(F.col("primary_inventor")).alias("inventor"),
        "filed",
        "published",
        "granted",
        F.substring("abstract_text", 1, ABSTRACT_IN_CARD).alias("abstract"),
        F.filter(terms, lambda term: F.coalesce(term, F.lit("")) != "").alias("terms"),
    )
