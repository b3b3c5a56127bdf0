"""Node and edge tables of the network view, neighbourhoods and attribute filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearcite.functions.text import node_size, score_color, score_tier, similar_width, unit_score, whole_percent
from nearcite.operators.expand import links_between
from nearcite.operators.links import Membership, link_pieces
from nearcite.schema import LINK_COLUMNS
from nearcite.session import materialize

# Fixed values of the network view.
EDGE_COLORS = {
    "similar": "#105BD8",
    "cites": "#4773AA",
    "cited_by": "#8BA6CA",
    "parent": "#FF9D1E",
    "child": "#DD361C",
}
# How many links of each kind a small view draws.
LINK_CAPS = {"citation": 10, "cited_by": 10, "parent": 5, "child": 5}
QUERY_COLOR, QUERY_SIZE = "#0B3D91", 45

# How each link array is drawn: (edge type, hover title, width, opacity, dashes).
_DRAWN = {
    "citation": ("cites", "Cites", 1.0, 0.3, True),
    "cited_by": ("cited_by", "Cited by", 1.0, 0.3, True),
    "parent": ("parent", "Parent", 1.5, 0.4, False),
    "child": ("child", "Child", 1.5, 0.4, False),
}
_NODE_COLUMNS = [
    "query_id",
    "node",
    "kind",
    "label",
    "hover",
    "color",
    "size",
    "shape",
    "score",
    "score_pct",
    "tier",
]
_EDGE_COLUMNS = ["query_id", "src", "dst", "kind", "title", "width", "color", "opacity", "dashes"]


def viz_nodes(query_rows: DataFrame, results: DataFrame, expanded: DataFrame, score: str = "score") -> DataFrame:
    """Query, result and expanded nodes with colour, size and text.

    ``query_rows`` and ``results`` are disjoint. Where a query is missing from its own list, its row is a
    stand-in, drawn as a result without a score; the query may then be among the expanded rows, and is
    still drawn once.
    """
    stand_ins = query_rows.where(F.col("publication_number") != F.col("query_id"))
    expanded = expanded.where(F.col("publication_number") != F.col("query_id"))
    own = query_rows.select(
        "query_id",
        F.col("query_id").alias("node"),
        F.lit("query").alias("kind"),
        F.col("query_id").alias("label"),
        F.concat(
            F.lit("QUERY: "),
            F.col("query_id"),
            F.lit("\n"),
            F.when(F.col("publication_number") == F.col("query_id"), F.col("title_text")).otherwise(""),
        ).alias("hover"),
        F.lit(QUERY_COLOR).alias("color"),
        F.lit(QUERY_SIZE).alias("size"),
        F.lit("dot").alias("shape"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("int").alias("score_pct"),
        F.lit(None).cast("int").alias("tier"),
    )
    shown = _scored_nodes(results, F.col(score), "result", "dot", "", "Score")
    found = _scored_nodes(expanded, F.col("ppr_score"), "expanded", "triangle", " (Citation Network)", "PPR")
    standing = _scored_nodes(stand_ins, F.lit(None).cast("double"), "result", "dot", "", "Score")
    return own.unionByName(shown).unionByName(standing).unionByName(found)


def _scored_nodes(rows: DataFrame, score: Column, kind: str, shape: str, suffix: str, score_name: str) -> DataFrame:
    pub, pct = F.col("publication_number"), F.col("score_pct")
    return (
        rows.withColumn("score", unit_score(score))
        .withColumn("score_pct", whole_percent(F.col("score")))
        .select(
            "query_id",
            pub.alias("node"),
            F.lit(kind).alias("kind"),
            F.concat(pub, F.lit("\n"), pct, F.lit("%")).alias("label"),
            F.concat(
                pub,
                F.lit(f"{suffix}\n"),
                F.col("title_text"),
                F.lit("\nAssignee: "),
                F.coalesce("primary_assignee", F.lit("N/A")),
                F.lit(f"\n{score_name}: "),
                pct,
                F.lit("%"),
            ).alias("hover"),
            score_color(F.col("score")).alias("color"),
            node_size(F.col("score")).alias("size"),
            F.lit(shape).alias("shape"),
            "score",
            "score_pct",
            score_tier(F.col("score")).alias("tier"),
        )
        .select(_NODE_COLUMNS)
    )


def viz_edges(
    results: DataFrame,
    rows: DataFrame,
    source: DataFrame,
    caps: dict[str, int] | None = None,
    score: str = "score",
) -> DataFrame:
    """Edges of the view, repeated pairs included.

    One ``similar`` edge from the query to each of ``results``; then the links of every row of ``rows``
    (``(query_id, publication_number)``: the query, results and expanded rows), as far as they end in
    such a row. With ``caps`` (such as LINK_CAPS) only the first positions of each array count, before
    that test. Rows of a block of queries meet blocks of links; no link is shuffled to each row.
    """
    weight = unit_score(F.col(score))
    similar = results.select(
        "query_id",
        F.col("query_id").alias("src"),
        F.col("publication_number").alias("dst"),
        F.lit("similar").alias("kind"),
        F.concat(F.lit("Score: "), whole_percent(weight), F.lit("%")).alias("title"),
        similar_width(weight).alias("width"),
        F.lit(EDGE_COLORS["similar"]).alias("color"),
        F.lit(0.4).alias("opacity"),
        F.lit(False).alias("dashes"),
    )
    first = source.select(
        "publication_number", *[F.slice(c, 1, caps[c]).alias(c) if caps else F.col(c) for c in LINK_COLUMNS]
    )
    drawn = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(title).alias("title"),
                F.lit(width).alias("width"),
                F.lit(EDGE_COLORS[kind]).alias("color"),
                F.lit(opacity).alias("opacity"),
                F.lit(dashes).alias("dashes"),
            )
            for kind, title, width, opacity, dashes in _DRAWN.values()
        ]
    )
    citations = (
        links_between(rows, link_pieces(first))
        .withColumn("drawn", F.get(drawn, F.array_position(F.array(*[F.lit(d[0]) for d in _DRAWN.values()]), F.col("edge_type")).cast("int") - 1))
        .select("query_id", "src", "dst", *[F.col(f"drawn.{c}").alias(c) for c in _EDGE_COLUMNS[3:]])
    )
    return similar.unionByName(citations)


def khop(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """Distance from the seeds ignoring edge direction: ``(query_id, node, hop)``, null beyond k.

    ``seeds`` is ``(query_id, node)``, each once. A step joins only the newest ring with the edges; every
    ring is written once, so the plan does not grow with k. Bloom filters drop most edges that leave no node of
    the ring, and most nodes out of reach, before they are shuffled.
    """
    both = edges.select("query_id", "src", "dst").unionByName(
        edges.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    reached = seeds.select("query_id", "node", F.lit(0).alias("hop"))
    ring = reached.select("query_id", F.col("node").alias("src"))
    for step in range(1, k + 1):
        filter_ = Membership(ring, ["query_id", "src"])
        near = filter_.joined(both).where(filter_.may_hold(F.col("query_id"), F.col("src"))).drop("member_bits")
        beyond = near.join(ring, ["query_id", "src"], "left_semi").select("query_id", F.col("dst").alias("node")).distinct()
        new = materialize(beyond.join(reached, ["query_id", "node"], "left_anti"))
        reached = reached.unionByName(new.withColumn("hop", F.lit(step)))
        ring = new.select("query_id", F.col("node").alias("src"))
    filter_ = Membership(reached, ["query_id", "node"])
    nodes = filter_.joined(nodes.select("query_id", "node"))
    may_be = filter_.may_hold(F.col("query_id"), F.col("node"))
    near = nodes.where(may_be).drop("member_bits").join(reached, ["query_id", "node"], "left")
    return near.unionByName(nodes.where(~may_be).select("query_id", "node", F.lit(None).cast("int").alias("hop")))


def _shown_value(df: DataFrame, name: str) -> Column:
    """A property as text; null when it is empty, zero or false, which never matches.

    Whole numbers read without a decimal point.
    """
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        return F.when(value, F.lit("true"))
    if isinstance(kind, T.NumericType):
        whole = value.cast("double") == F.floor(value.cast("double"))
        text = F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
        return F.when(value != 0, text)
    return F.nullif(value.cast("string"), F.lit(""))


def filter_nodes(nodes: DataFrame, prop: str, values: list[str]) -> DataFrame:
    """Nodes whose property is one of the values: ``(query_id, node)``."""
    return nodes.where(_shown_value(nodes, prop).isin(*values)).select("query_id", "node").distinct()


def filter_edges(edges: DataFrame, prop: str, values: list[str]) -> DataFrame:
    """Both ends of the edges whose property is one of the values: ``(query_id, node)``."""
    return (
        edges.where(_shown_value(edges, prop).isin(*values))
        .select("query_id", F.explode(F.array("src", "dst")).alias("node"))
        .distinct()
    )
