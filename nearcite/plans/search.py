"""A search from query ids to every table people read, for any number of queries at once."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearcite.operators import analytics, context, expand, network, ranking
from nearcite.operators.ivf import IvfIndex, ivf_topk
from nearcite.operators.knn import knn_join
from nearcite.operators.pagerank import minmax_normalize, personalized_pagerank
from nearcite.operators.resolve import resolve_ids
from nearcite.schema import LINK_COLUMNS, NEIGHBOR_COLUMNS, SEARCH_COLUMNS
from nearcite.session import materialize
from nearcite.sources.corpus import query_vectors


def resolved_queries(inputs: DataFrame, corpus: DataFrame, mode: str = "auto") -> DataFrame:
    """Distinct ids that the inputs name and the corpus has: ``(query_id)``."""
    resolved = resolve_ids(inputs, corpus, mode)
    return resolved.where("found").select(F.col("publication_number").alias("query_id")).distinct()


class Search:
    """The tables of one batch of searches, each built on first use.

    Tables that several others read are narrow (ids and scores) and are written to the checkpoint
    folder; titles, texts and arrays are joined to them only where a table shows them.
    """

    def __init__(
        self,
        queries: DataFrame,
        corpus: DataFrame,
        k: int = 20,
        max_neighbors: int | None = None,
        damping: float = 0.85,
        similarity_weight: float = 0.6,
        with_graph: bool = True,
        index: IvfIndex | None = None,
        nprobe: int | None = None,
        exact: bool = True,
    ):
        self.queries, self.corpus, self.k = queries, corpus, k
        self.max_neighbors, self.damping, self.similarity_weight = max_neighbors, damping, similarity_weight
        self.with_graph, self.index, self.nprobe, self.exact = with_graph, index, nprobe, exact

    # ids and scores

    @cached_property
    def vectors(self) -> DataFrame:
        return materialize(query_vectors(self.queries, self.corpus))

    @cached_property
    def found(self) -> DataFrame:
        """``(query_id, publication_number, distance, row_no, is_query)``, the query's own row included."""
        if self.index is None:
            nearest = knn_join(self.vectors, self.corpus, self.k)
        else:
            nearest = ivf_topk(self.vectors, self.index, self.k, self.nprobe, self.exact)
        return materialize(ranking.number_rows(nearest), spread=("publication_number", "query_id"))

    @cached_property
    def expanded_ids(self) -> DataFrame:
        """``(query_id, publication_number, first_seen)`` of the neighbours that the corpus has."""
        neighbors = expand.citation_neighbors(self.found, self.corpus, self.max_neighbors)
        return materialize(expand.fetch_neighbors(neighbors, self.corpus, ["publication_number"]))

    @cached_property
    def nodes(self) -> DataFrame:
        return materialize(expand.graph_nodes(self.found, self.expanded_ids))

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(expand.graph_edges(self.nodes, self.corpus))

    @cached_property
    def scores(self) -> DataFrame:
        """``(query_id, node, ppr_raw, ppr_score)``; no rows for a query whose graph has no ranking."""
        raw = personalized_pagerank(self.nodes, self.edges, self.damping)
        return minmax_normalize(materialize(raw))

    @cached_property
    def scored(self) -> DataFrame:
        """Results without the query's own row, with similarity, PPR and blended scores."""
        results = ranking.exclude_self(ranking.with_similarity(self.found))
        if self.with_graph:
            return materialize(ranking.blend(results, self.scores, self.similarity_weight))
        none = F.lit(None).cast("double")
        columns = ("ppr_raw", "ppr_score", "ppr_pct", "blended_score", "blended_pct")
        return results.withColumn("ppr_available", F.lit(False)).withColumns({c: none for c in columns})

    @cached_property
    def result_edges(self) -> DataFrame:
        """Edges between results; none for a query without a ranking."""
        between = expand.result_edges(self.edges, self.scored)
        return between.join(self.scores.select("query_id").distinct(), "query_id", "left_semi")

    # rows with metadata

    def with_corpus(self, rows: DataFrame, columns: list[str] = SEARCH_COLUMNS) -> DataFrame:
        return expand.with_display_text(rows.join(self.corpus.select(columns), "publication_number"))

    @cached_property
    def results(self) -> DataFrame:
        """What the vector search returns: corpus columns, distance and similarity, own row included."""
        return self.with_corpus(ranking.with_similarity(self.found))

    @cached_property
    def query_rows(self) -> DataFrame:
        return self.with_corpus(self.found.where("is_query"))

    @cached_property
    def expanded_scores(self) -> DataFrame:
        """Expanded ids and, where there is a ranking, their PPR columns."""
        return ranking.add_expanded_scores(self.expanded_ids, self.scores)

    @cached_property
    def expanded(self) -> DataFrame:
        """Expanded rows with metadata and PPR columns. Scores come first, so texts move once a document, not once a row."""
        return self.with_corpus(self.expanded_scores, NEIGHBOR_COLUMNS)

    def expanded_top(self, n: int, score: str, digits: int) -> DataFrame:
        """Those expanded rows with metadata that a table of the n best of a query can show."""
        return self.with_corpus(ranking.leading(self.expanded_scores, score, n, digits), NEIGHBOR_COLUMNS)

    def ranked(self, mode: str = "blended") -> DataFrame:
        """Scored results with rank, score and metadata but without link arrays."""
        columns = [c for c in SEARCH_COLUMNS if c not in LINK_COLUMNS]
        return self.with_corpus(ranking.rank_results(self.scored, mode), columns)

    # tables

    def result_table(self, mode: str = "blended") -> DataFrame:
        return ranking.result_table(self.ranked(mode))

    def structural_top(self, n: int = 10) -> DataFrame:
        return ranking.structural_top(self.expanded_top(n, "ppr_pct", 10), n)

    def kpi(self) -> DataFrame:
        return analytics.kpi(self.ranked("similarity"), self.expanded_ids if self.with_graph else None)

    def top_names(self, column: str, n: int = 10) -> DataFrame:
        """Most frequent names, results in display order deciding ties."""
        return analytics.top_names(self._in_display_order(), column, n)

    def cpc_distribution(self) -> DataFrame:
        return analytics.cpc_distribution(self._in_display_order())

    def _in_display_order(self) -> DataFrame:
        return self.ranked().drop("row_no").withColumnRenamed("rank", "row_no")

    def analytics(self, n: int = 10) -> DataFrame:
        """Names, sections and metrics as one long table: ``(query_id, kind, place, item, value)``."""
        tables = {
            "assignee": self.top_names("assignee_harmonized", n).withColumnRenamed("name", "item"),
            "inventor": self.top_names("inventor_harmonized", n).withColumnRenamed("name", "item"),
            "cpc": self.cpc_distribution().withColumnRenamed("label", "item"),
        }
        parts = [
            table.select("query_id", F.lit(kind).alias("kind"), "place", "item", F.col("n").cast("double").alias("value"))
            for kind, table in tables.items()
        ]
        metrics = ["n_results", "n_assignees", "n_inventors", "avg_similarity_pct", "n_expanded"]
        pairs = F.array(
            *[
                F.struct(F.lit(i + 1).alias("place"), F.lit(m).alias("item"), F.col(m).cast("double").alias("value"))
                for i, m in enumerate(metrics)
            ]
        )
        parts.append(self.kpi().select("query_id", F.lit("metric").alias("kind"), F.inline(pairs)))
        return reduce(DataFrame.unionByName, parts)

    def viz_nodes(self, mode: str = "blended") -> DataFrame:
        return network.viz_nodes(self.query_rows, self.ranked(mode), self.expanded)

    def viz_edges(self, mode: str = "blended", caps: dict[str, int] | None = None) -> DataFrame:
        rows = self.found.select("query_id", "publication_number").unionByName(
            self.expanded_ids.select("query_id", "publication_number")
        )
        shown = ranking.rank_results(self.scored, mode).select("query_id", "publication_number", "score")
        stand_ins = self.found.where(F.col("is_query") & (F.col("publication_number") != F.col("query_id")))
        stand_ins = stand_ins.select("query_id", "publication_number", F.lit(None).cast("double").alias("score"))
        return network.viz_edges(shown.unionByName(stand_ins), rows, self.corpus, caps)

    def network(self, mode: str = "blended") -> DataFrame:
        """Every node of the view with the number of edges leaving and entering it."""
        edges = self.viz_edges(mode)
        ends = edges.select("query_id", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
            edges.select("query_id", F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
        )
        degrees = ends.groupBy("query_id", "node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
        zero = F.lit(0).cast("bigint")
        return (
            self.viz_nodes(mode)
            .join(degrees, ["query_id", "node"], "left")
            .withColumns({"n_out": F.coalesce("n_out", zero), "n_in": F.coalesce("n_in", zero)})
        )

    def context(self, mode: str = "blended") -> DataFrame:
        """``(query_id, ppr_available, context)``: with the graph where there is a ranking, else plain."""
        ranked = self.ranked(mode)
        plain = context.context_plain(ranked.where(~F.col("ppr_available"))).withColumn("ppr_available", F.lit(False))
        if not self.with_graph:
            return plain.select("query_id", "ppr_available", "context")
        expanded = self.expanded_top(context.EXPANDED_LINES, "ppr_raw", 12)
        graph = context.context_graph(ranked.where("ppr_available"), self.result_edges, expanded)
        graph = graph.withColumn("ppr_available", F.lit(True))
        return plain.unionByName(graph).select("query_id", "ppr_available", "context")

    def prompt(self, mode: str = "blended") -> DataFrame:
        return context.prompt(self.context(mode), self.query_rows)

    def query_card(self) -> DataFrame:
        return context.query_card(self.query_rows)


def second_level_knn(results: DataFrame, corpus: DataFrame, k: int, index: IvfIndex | None = None) -> DataFrame:
    """Nearest neighbours of every parent and child of the results.

    ``results`` is ``(query_id, publication_number)``. Returns ``(query_id, via_id, publication_number,
    distance)``. A relative that many results share is searched once, through the index where there is one.
    """
    family = F.array_distinct(F.concat(expand.link_ids(corpus, "parent"), expand.link_ids(corpus, "child")))
    relatives = corpus.select("publication_number", family.alias("family"))
    via = (
        results.select("query_id", "publication_number")
        .join(relatives, "publication_number")
        .select("query_id", F.explode("family").alias("via_id"))
        .where(F.coalesce(F.col("via_id"), F.lit("")) != "")
        .distinct()
    )
    vectors = materialize(query_vectors(via.select(F.col("via_id").alias("query_id")), corpus))
    nearest = knn_join(vectors, corpus, k) if index is None else ivf_topk(vectors, index, k, exact=True)
    nearest = nearest.withColumnRenamed("query_id", "via_id")
    return via.join(nearest, "via_id").select("query_id", "via_id", "publication_number", "distance")
