"""Every registered query with its plain SQL counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from nearcite.functions import text
from nearcite.operators import analytics, expand, ivf, links, merge, network, ranking, status
from nearcite.operators import context as contexts
from nearcite.operators.knn import knn_join, knn_join_mixed
from nearcite.operators.pagerank import minmax_normalize, personalized_pagerank, top_scores
from nearcite.operators.resolve import cleaned_inputs, resolve_ids
from nearcite.plans.lifecycle import lifecycle, refresh_index, stored_index
from nearcite.plans.search import Search, resolved_queries, second_level_knn
from nearcite.schema import CORPUS
from nearcite.session import checkpoint_dir, materialize
from nearcite.sources import corpus as corpora
from nearcite.sources import ranges, sinks
from nearcite.sources.derived import Derived
from nearcite.streaming import refresh
from nearcite.streaming.status import read_states, stream_status

NOW = datetime(2024, 2, 10)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The stored tables that queries start from: corpus, resolved query ids, and one search over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.source = spark, Derived(spark, folder)
        self.max_neighbors: int | None = None  # no cap, unless a caller sets one

    @cached_property
    def base(self) -> DataFrame:
        return self.source.base()

    @cached_property
    def research(self) -> DataFrame:
        return self.source.research()

    @cached_property
    def corpus(self) -> DataFrame:
        return materialize(corpora.build_corpus(self.base, self.research))

    @cached_property
    def store(self) -> ranges.StoredCorpus:
        """The corpus by key range; in about 32 of them, as small as these tables are."""
        return ranges.create(self.corpus, f"{checkpoint_dir(self.spark)}/store-{uuid.uuid4().hex}", max(1, self.corpus.count() // 32))

    @cached_property
    def snapshot_store(self) -> ranges.StoredCorpus:
        return ranges.create(self.snapshot, f"{checkpoint_dir(self.spark)}/store-{uuid.uuid4().hex}", max(1, self.snapshot.count() // 32))

    @cached_property
    def snapshot(self) -> DataFrame:
        return materialize(self.source.snapshot())

    @cached_property
    def queries(self) -> DataFrame:
        return materialize(resolved_queries(self.source.inputs(), self.corpus))

    @cached_property
    def links(self) -> DataFrame:
        return materialize(links.link_table(self.corpus))

    @cached_property
    def search(self) -> Search:
        return Search(self.queries, self.corpus, max_neighbors=self.max_neighbors)

    @cached_property
    def search100(self) -> Search:
        return Search(self.queries, self.corpus, k=100)

    @cached_property
    def index(self) -> ivf.IvfIndex:
        return stored_index(self.corpus)

    @cached_property
    def given_index(self) -> ivf.IvfIndex:
        """An index whose centroids are the mean vectors of the labels, in their order."""
        values = self.source.table("embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x"))
        means = values.groupBy("label", "at").agg(F.avg("x").alias("m")).orderBy("label", "at").toPandas()  # labels x 64
        centers = means["m"].to_numpy().reshape(means["label"].nunique(), -1)
        return ivf.index_from_centers(self.corpus, centers)

    def raw_vectors(self) -> tuple[DataFrame, DataFrame]:
        rows = self.source.table("embeddings").select("vec_id", "embedding")
        return rows.withColumnRenamed("vec_id", "query_id"), rows


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, folder)
    return _TABLES[key]


def forget_tables() -> None:
    """Make the next query build its inputs again."""
    _TABLES.clear()


def query(oracle: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, folder: build(tables(spark, folder))
        if oracle:
            ORACLES[build.__name__] = oracles.sql(oracle)
        return build

    return register


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounding that exact halves do not split."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + 10.0 ** -(digits + 4), digits)


def joined(column: str, field: str) -> Column:
    """A list of structs as one text."""
    return F.array_join(F.transform(column, lambda x: F.coalesce(x[field], F.lit(""))), "|").alias(column)


_r = oracles._r

# Sources


@query("""SELECT publication_number, application_number, filing_date, publication_date, grant_date, primary_assignee,
  primary_inventor FROM corpus""")
def scan_corpus(t: Tables) -> DataFrame:
    return t.corpus.select(
        "publication_number", "application_number", "filing_date", "publication_date", "grant_date",
        "primary_assignee", "primary_inventor",
    )


@query("SELECT count(*) AS n_rows, count(publication_number) AS n_keys FROM (SELECT * FROM docs LIMIT 1)")
def scan_probe(t: Tables) -> DataFrame:
    probe = corpora.scan_probe(t.base)
    return probe.agg(F.count(F.lit(1)).alias("n_rows"), F.count("publication_number").alias("n_keys"))


@query(f"""SELECT publication_number, application_number, filing_date, publication_date, grant_date, title_value AS title,
  abstract_value AS abstract, round(list_sum(vec), 6) AS vector_sum, len(vec)::INTEGER AS vector_size,
  {oracles._list('cited_by')} AS cited_by, {oracles._list('citation')} AS citation, {oracles._list('parent')} AS parent,
  {oracles._list('child')} AS child, coalesce({oracles._names('assignees')}, '') AS assignee_harmonized,
  coalesce({oracles._names('inventors')}, '') AS inventor_harmonized, primary_assignee, primary_inventor,
  (SELECT string_agg(code, '|' ORDER BY pos) FROM cpcs x WHERE x.vec_id = c.vec_id) AS cpc,
  (SELECT string_agg(term, '|' ORDER BY pos) FROM terms x WHERE x.vec_id = c.vec_id) AS top_terms
  FROM corpus c""")
def build_corpus(t: Tables) -> DataFrame:
    return corpora.build_corpus(t.base, t.research).select(
        "publication_number", "application_number", "filing_date", "publication_date", "grant_date",
        F.col("title.value").alias("title"), F.col("abstract.value").alias("abstract"),
        F.round(F.aggregate("embedding_v1", F.lit(0.0), lambda a, x: a + x), 6).alias("vector_sum"),
        F.size("embedding_v1").alias("vector_size"),
        *[joined(c, "publication_number") for c in ("cited_by", "citation", "parent", "child")],
        joined("assignee_harmonized", "name"), joined("inventor_harmonized", "name"),
        "primary_assignee", "primary_inventor", joined("cpc", "code"), joined("top_terms", "value"),
    )


@query(f"""SELECT publication_number, filing_date, title_value AS title, abstract_value AS abstract,
  round(list_sum(vec), 6) AS vector_sum, {oracles._list('cited_by')} AS cited_by,
  (SELECT string_agg(term, '|' ORDER BY pos) FROM terms x WHERE x.vec_id = c.vec_id) AS top_terms,
  primary_assignee, primary_inventor FROM corpus c""")
def build_corpus_min(t: Tables) -> DataFrame:
    return corpora.build_corpus_min(t.base, t.research).select(
        "publication_number", "filing_date", F.col("title.value").alias("title"),
        F.col("abstract.value").alias("abstract"),
        F.round(F.aggregate("embedding_v1", F.lit(0.0), lambda a, x: a + x), 6).alias("vector_sum"),
        joined("cited_by", "publication_number"), joined("top_terms", "value"), "primary_assignee", "primary_inventor",
    )


@query("SELECT publication_number, country_code, filing_date FROM docs WHERE country_code = 'US' AND vec IS NOT NULL "
       "AND filing_date >= 20060101")
def filter_build(t: Tables) -> DataFrame:
    rows = t.base.join(t.research, "publication_number")
    return corpora.filter_build(rows).select("publication_number", "country_code", "filing_date")


@query("SELECT publication_number, row_number() OVER (ORDER BY publication_number) - 1 AS position FROM corpus")
def id_position_map(t: Tables) -> DataFrame:
    return corpora.id_position_map(t.corpus)


@query("""SELECT file, n_rows, (sum(n_rows) OVER (ORDER BY file) - n_rows)::BIGINT AS first_row FROM (
  SELECT 'filed=' || filing_date AS file, count(*) AS n_rows FROM docs GROUP BY filing_date)""")
def file_row_ranges(t: Tables) -> DataFrame:
    """Of a copy of all documents with a file for every filing date."""
    path = _new_path(t, "dated")
    rows = t.source.documents().select("publication_number", F.col("filing_date").alias("filed"))
    rows.repartition("filed").write.partitionBy("filed").parquet(path)
    ranges = corpora.file_row_ranges(t.spark, path)
    return ranges.withColumn("file", F.element_at(F.split("file", "/"), -2))


# Identifiers


@query("SELECT input_id, cleaned, formatted, number FROM cleaned")
def resolve_clean(t: Tables) -> DataFrame:
    return cleaned_inputs(t.source.inputs()).select("input_id", "cleaned", "formatted", "number")


def _one_step(step: int) -> str:
    return f"""SELECT i.input_id, m.publication_number, m.input_id IS NOT NULL AS found FROM inputs i LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY pref, size, publication_number) AS rn
      FROM matches WHERE step = {step}) m ON m.input_id = i.input_id AND m.rn = 1"""


@query(_one_step(1))
def resolve_suffix(t: Tables) -> DataFrame:
    return resolve_ids(t.source.inputs(), t.store, steps=("suffix",)).select("input_id", "publication_number", "found")


@query(_one_step(2))
def resolve_prefix(t: Tables) -> DataFrame:
    return resolve_ids(t.source.inputs(), t.store, steps=("prefix",)).select("input_id", "publication_number", "found")


@query(_one_step(3))
def resolve_application(t: Tables) -> DataFrame:
    return resolve_ids(t.source.inputs(), t.corpus, "application").select("input_id", "publication_number", "found")


@query("SELECT input_id, publication_number, step, found FROM resolved")
def resolve_inputs(t: Tables) -> DataFrame:
    return resolve_ids(t.source.inputs(), t.store).select("input_id", "publication_number", "step", "found")


@query("""SELECT 'publication' AS mode, input_id, CASE WHEN step <> 'application' THEN publication_number END AS publication_number,
    found AND step <> 'application' AS found FROM resolved
  UNION ALL
  SELECT 'application', i.input_id, m.publication_number, m.input_id IS NOT NULL FROM inputs i LEFT JOIN (
    SELECT input_id, min(publication_number) AS publication_number FROM matches WHERE step = 3 GROUP BY input_id) m
    USING (input_id)""")
def resolve_ids_mode(t: Tables) -> DataFrame:
    modes = [
        resolve_ids(t.source.inputs(), t.corpus, mode).select(
            F.lit(mode).alias("mode"), "input_id", "publication_number", "found"
        )
        for mode in ("publication", "application")
    ]
    return modes[0].unionByName(modes[1])


@query("SELECT query_id, len(vec)::INTEGER AS vector_size, round(list_sum(vec), 6) AS vector_sum FROM queries")
def query_vector_lookup(t: Tables) -> DataFrame:
    return corpora.query_vectors(t.queries, t.store).select(
        "query_id", F.size("embedding_v1").alias("vector_size"),
        F.round(F.aggregate("embedding_v1", F.lit(0.0), lambda a, x: a + x), 6).alias("vector_sum"),
    )


# Vector search


def _raw_knn(distance: str) -> str:
    q = "(SELECT vec_id AS query_id, embedding::DOUBLE[] AS vec FROM embeddings)"
    c = "(SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings)"
    return f"SELECT query_id, vec_id, {_r('distance')} AS distance FROM ({oracles._nearest(q, c, 'vec_id', distance, 10)})"


def _knn_of_all(t: Tables, distance: str) -> DataFrame:
    queries, corpus = t.raw_vectors()
    found = knn_join(queries, corpus, 10, distance, query_vector="embedding", vector="embedding", key="vec_id")
    return found.withColumn("distance", r("distance"))


@query(_raw_knn(oracles._COSINE))
def vector_topk(t: Tables) -> DataFrame:
    return _knn_of_all(t, "cosine")


@query(_raw_knn("round(list_distance(q.vec, c.vec), 12)"))
def vector_topk_l2(t: Tables) -> DataFrame:
    return _knn_of_all(t, "euclidean")


@query(_raw_knn("round(-list_dot_product(q.vec, c.vec), 12)"))
def vector_topk_dot(t: Tables) -> DataFrame:
    return _knn_of_all(t, "dot_product")


@query(f"SELECT query_id, publication_number, {_r('distance')} AS distance FROM topk")
def knn_all_queries(t: Tables) -> DataFrame:
    found = knn_join(corpora.query_vectors(t.queries, t.corpus), t.corpus, 20)
    return found.withColumn("distance", r("distance"))


@query(f"""SELECT f.query_id, f.publication_number, c.application_number, c.title_value AS title, c.abstract_value AS abstract,
  c.primary_assignee, c.primary_inventor, coalesce({oracles._names('assignees')}, '') AS assignee_harmonized,
  coalesce({oracles._names('inventors')}, '') AS inventor_harmonized, c.filing_date, c.publication_date, c.grant_date,
  {oracles._list('cited_by')} AS cited_by, {oracles._list('citation')} AS citation, {oracles._list('parent')} AS parent,
  {oracles._list('child')} AS child, (SELECT string_agg(code, '|' ORDER BY pos) FROM cpcs x WHERE x.vec_id = c.vec_id) AS cpc,
  (SELECT string_agg(term, '|' ORDER BY pos) FROM terms x WHERE x.vec_id = c.vec_id) AS top_terms, {_r('f.distance')} AS distance
  FROM topk f JOIN corpus c USING (publication_number)""")
def vector_topk_full(t: Tables) -> DataFrame:
    return t.search.results.select(
        "query_id", "publication_number", "application_number", F.col("title.value").alias("title"),
        F.col("abstract.value").alias("abstract"), "primary_assignee", "primary_inventor",
        joined("assignee_harmonized", "name"), joined("inventor_harmonized", "name"),
        "filing_date", "publication_date", "grant_date",
        *[joined(c, "publication_number") for c in ("cited_by", "citation", "parent", "child")],
        joined("cpc", "code"), joined("top_terms", "value"), r("distance").alias("distance"),
    )


@query(f"SELECT query_id, publication_number, {_r('1 - distance')} AS similarity, {_r(oracles._pct('(1 - distance)'))} "
       "AS similarity_pct FROM topk")
def similarity(t: Tables) -> DataFrame:
    return ranking.with_similarity(t.search.found).select(
        "query_id", "publication_number", r("similarity").alias("similarity"), r("similarity_pct").alias("similarity_pct")
    )


@query("SELECT query_id, publication_number, row_no::INTEGER AS row_no FROM found WHERE NOT is_query")
def exclude_self(t: Tables) -> DataFrame:
    return ranking.exclude_self(t.search.found).select("query_id", "publication_number", "row_no")


@query("""SELECT query_id, bool_or(is_query AND row_no = 1) AS self_first,
  bool_and(distance < 1e-9 OR NOT is_query) AS self_at_zero, bool_and(distance >= 0) AS not_negative, count(*) AS n
  FROM found GROUP BY query_id""")
def vector_sanity(t: Tables) -> DataFrame:
    own = F.col("is_query")
    return t.search.found.groupBy("query_id").agg(
        F.bool_or(own & (F.col("row_no") == 1)).alias("self_first"),
        F.bool_and((F.col("distance") < 1e-9) | ~own).alias("self_at_zero"),
        F.bool_and(F.col("distance") >= 0).alias("not_negative"),
        F.count(F.lit(1)).alias("n"),
    )


@query(f"SELECT query_id, publication_number, {_r('distance')} AS distance FROM topk")
def ivf_topk(t: Tables) -> DataFrame:
    """All lists visited: must equal the full search."""
    found = ivf.ivf_topk(t.search.vectors, t.index, 20, nprobe=len(t.index.centers))
    return found.withColumn("distance", r("distance"))


@query(f"SELECT query_id, publication_number, {_r('distance')} AS distance FROM topk")
def ivf_exact(t: Tables) -> DataFrame:
    """Few lists first, then those the distance bound leaves: must equal the full search."""
    return ivf.ivf_topk(t.search.vectors, t.index, 20, exact=True).withColumn("distance", r("distance"))


_PROBED = f"""SELECT query_id, publication_number, {_r('distance')} AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, publication_number) AS rn FROM (
    SELECT q.query_id, c.publication_number, {oracles._COSINE} AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(vec, center) DESC, list_id) AS place
      FROM queries, given_centers) q
    JOIN given_lists l USING (list_id) JOIN corpus c ON c.publication_number = l.publication_number WHERE q.place <= 2))
  WHERE rn <= 20"""


@query(_PROBED)
def ivf_probe(t: Tables) -> DataFrame:
    """Approximate: two lists per query, of an index over centroids that SQL can compute as well."""
    return ivf.ivf_topk(t.search.vectors, t.given_index, 20, nprobe=2).withColumn("distance", r("distance"))


@query("SELECT publication_number, list_id::INTEGER AS list_id FROM given_lists")
def ivf_assign(t: Tables) -> DataFrame:
    return ivf.assign_lists(t.corpus, t.given_index).select("publication_number", "list_id")


@query("""SELECT count(*) AS rows, count(c.publication_number) AS indexed,
  round(count(c.publication_number) * 100e0 / count(*), 6) AS coverage_pct FROM docs d LEFT JOIN corpus c USING (publication_number)""")
def ivf_coverage(t: Tables) -> DataFrame:
    """Of all documents, those of the indexed corpus have a list."""
    table = ivf.ivf_coverage(t.source.documents().select("publication_number"), t.index)
    return table.withColumn("coverage_pct", F.round("coverage_pct", 6))


@query(f"""SELECT round(count(p.publication_number)::DOUBLE / count(*), 9) AS recall
  FROM topk f LEFT JOIN ({_PROBED}) p ON p.query_id = f.query_id AND p.publication_number = f.publication_number""")
def ivf_recall(t: Tables) -> DataFrame:
    """Share of the true neighbours that two lists per query give."""
    found = ivf.ivf_topk(t.search.vectors, t.given_index, 20, nprobe=2)
    return t.spark.range(1).select(F.round(ivf.recall(found, t.search.found), 9).alias("recall"))


def _indexed_raw(t: Tables, distance: str) -> DataFrame:
    """All vectors as they are, each against all, through an index of the distance."""
    queries, corpus = t.raw_vectors()
    index = stored_index(corpus.select(F.col("vec_id").cast("string").alias("publication_number"), "embedding"), distance=distance, vector="embedding")
    found = ivf.ivf_topk(queries, index, 10, exact=True, query_vector="embedding")
    # ties go to the smaller id as text: the number behind it is put back after the search
    return found.select("query_id", F.col("publication_number").cast("bigint").alias("vec_id"), r("distance").alias("distance"))


def _raw_knn_by_text(distance: str) -> str:
    q = "(SELECT vec_id AS query_id, embedding::DOUBLE[] AS vec FROM embeddings)"
    c = "(SELECT vec_id::VARCHAR AS vec_id, embedding::DOUBLE[] AS vec FROM embeddings)"
    return f"SELECT query_id, vec_id::BIGINT AS vec_id, {_r('distance')} AS distance FROM ({oracles._nearest(q, c, 'vec_id', distance, 10)})"


@query(_raw_knn_by_text("round(list_distance(q.vec, c.vec), 12)"))
def ivf_exact_l2(t: Tables) -> DataFrame:
    return _indexed_raw(t, "euclidean")


@query(_raw_knn_by_text("round(-list_dot_product(q.vec, c.vec), 12)"))
def ivf_exact_dot(t: Tables) -> DataFrame:
    return _indexed_raw(t, "dot_product")


@query(f"""SELECT query_id, publication_number, {_r('distance')} AS distance FROM ({oracles._nearest(
  "queries", "(SELECT * FROM named n WHERE publication_number IN (SELECT publication_number FROM corpus UNION SELECT publication_number FROM snapshot))",
  "publication_number", oracles._COSINE, 20)})""")
def ivf_update(t: Tables) -> DataFrame:
    """An index of the snapshot, brought up to the merged corpus by its new rows alone: must equal a full search."""
    index = refresh_index(stored_index(t.snapshot), t.snapshot, t.corpus)
    return ivf.ivf_topk(t.search.vectors, index, 20, exact=True).withColumn("distance", r("distance"))


_VIA = """SELECT DISTINCT f.query_id, l.other AS via_id FROM found f JOIN links l USING (publication_number)
  WHERE NOT f.is_query AND l.rel_no >= 2"""


@query(f"""SELECT v.query_id, v.via_id, k.publication_number, {_r('k.distance')} AS distance FROM ({_VIA}) v JOIN (
  {oracles._nearest("(SELECT publication_number AS query_id, vec FROM corpus)", "corpus", "publication_number", oracles._COSINE, 5)}
  ) k ON k.query_id = v.via_id""")
def second_level(t: Tables) -> DataFrame:
    results = ranking.exclude_self(t.search.found)
    return second_level_knn(results, t.corpus, 5, t.index).withColumn("distance", r("distance"))


_NUMBER = "substr(query_id, 4, 7)::INTEGER"


@query(f"""SELECT query_id, publication_number, {_r('distance')} AS distance FROM found100
  WHERE row_no <= 5 + {_NUMBER} % 96""")
def vector_topk_mixed(t: Tables) -> DataFrame:
    """Every query asks for a number of neighbours of its own, 5 to 100."""
    asked = t.search100.vectors.withColumn("top_k", 5 + F.substring("query_id", 4, 7).cast("int") % 96)
    return knn_join_mixed(asked, t.corpus).withColumn("distance", r("distance"))


# Expansion and graph


@query("SELECT query_id, publication_number, neighbor_order::INTEGER AS neighbor_order FROM neighbors")
def citation_neighbors(t: Tables) -> DataFrame:
    neighbors = expand.number_neighbors(expand.citation_neighbors(t.search.found, t.corpus))
    return neighbors.select("query_id", "publication_number", "neighbor_order")


@query(f"SELECT query_id, publication_number, neighbor_order::INTEGER AS neighbor_order FROM ({oracles._neighbors(50)})")
def citation_neighbors_capped(t: Tables) -> DataFrame:
    neighbors = expand.citation_neighbors(t.search.found, t.corpus, max_neighbors=50)
    return neighbors.select("query_id", "publication_number", "neighbor_order")


@query(f"SELECT x.query_id, x.publication_number, {oracles._DISPLAY} FROM expanded x JOIN corpus c USING (publication_number)")
def fetch_neighbors(t: Tables) -> DataFrame:
    neighbors = expand.citation_neighbors(t.search.found, t.corpus)
    return expand.with_display_text(expand.fetch_neighbors(neighbors, t.store)).select(
        "query_id", "publication_number", "title_text", "abstract_text", "primary_assignee", "primary_inventor",
        "filed", "published", "granted",
    )


@query("SELECT query_id, node, is_seed FROM nodes")
def graph_nodes(t: Tables) -> DataFrame:
    return t.search.nodes.select("query_id", "node", "is_seed")


@query("""SELECT l.publication_number, l.rel_no::INTEGER AS rel, l.pos::INTEGER AS pos, l.other, c.publication_number IS NOT NULL AS known
  FROM links l LEFT JOIN corpus c ON c.publication_number = l.other WHERE l.other <> l.publication_number""")
def link_table(t: Tables) -> DataFrame:
    """Every link once, under the document that lists it, marked if it leads out of the corpus."""
    return t.links.select("publication_number", F.inline("links"))


@query("""SELECT l.other, c.publication_number IS NOT NULL AS known, count(DISTINCT l.publication_number) AS n_owners, count(*) AS n_links
  FROM links l LEFT JOIN corpus c ON c.publication_number = l.other WHERE l.other <> l.publication_number GROUP BY ALL""")
def links_by_target(t: Tables) -> DataFrame:
    """Who names a document, those outside the corpus included."""
    turned = links.links_by_target(t.links).groupBy("other", "known")
    return turned.agg(F.countDistinct("publication_number").alias("n_owners"), F.count(F.lit(1)).alias("n_links"))


@query("SELECT query_id, src, dst, edge_type FROM edges")
def graph_edges(t: Tables) -> DataFrame:
    return expand.graph_edges(t.search.nodes, t.corpus, t.links)


@query("""SELECT query_id, count(*) AS n_nodes, (SELECT count(*) FROM edges e WHERE e.query_id = n.query_id) AS n_edges
  FROM nodes n GROUP BY query_id""")
def graph_size(t: Tables) -> DataFrame:
    return expand.graph_size(t.search.nodes, t.search.edges)


@query("SELECT query_id, dst AS node, count(*) AS in_degree FROM edges GROUP BY query_id, dst")
def hub_in_degree(t: Tables) -> DataFrame:
    return expand.in_degree(t.search.edges)


@query("SELECT query_id, src, dst, edge_type FROM result_links")
def result_edges(t: Tables) -> DataFrame:
    return t.search.result_edges.select("query_id", "src", "dst", "edge_type")


@query(f"SELECT query_id, node, {_r('ppr_raw', 9)} AS ppr_raw FROM ppr")
def ppr(t: Tables) -> DataFrame:
    scores = personalized_pagerank(t.search.nodes, t.search.edges)
    return scores.withColumn("ppr_raw", r("ppr_raw", 9))


@query(f"SELECT query_id, node, {_r('r', 9)} AS ppr_raw FROM corpus_pr WHERE err < nn * 1e-6")
def ppr_corpus(t: Tables) -> DataFrame:
    """The whole corpus as one graph, solved by the distributed plan."""
    ids = t.corpus.select("publication_number")
    seed = ids.agg(F.min("publication_number")).scalar()
    nodes = ids.select(
        F.lit("corpus").alias("query_id"), F.col("publication_number").alias("node"), F.lit(1).alias("row_no"),
        (F.col("publication_number") == seed).alias("is_seed"),
    )
    nodes = materialize(nodes)
    edges = materialize(expand.graph_edges(nodes, t.corpus, t.links))
    return personalized_pagerank(nodes, edges, grouped_edges=0).withColumn("ppr_raw", r("ppr_raw", 9))


@query(f"""SELECT query_id, place::INTEGER AS place, node, {_r('ppr_raw', 9)} AS ppr_raw FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr_raw, 12) DESC, node) AS place FROM ppr) WHERE place <= 3""")
def ppr_top3(t: Tables) -> DataFrame:
    return top_scores(t.search.scores).select("query_id", "place", "node", r("ppr_raw", 9).alias("ppr_raw"))


@query(f"SELECT query_id, node, {_r('ppr_score')} AS ppr_score FROM scores")
def minmax(t: Tables) -> DataFrame:
    scored = minmax_normalize(t.search.scores.select("query_id", "node", "ppr_raw"))
    return scored.select("query_id", "node", r("ppr_score").alias("ppr_score"))


_SCORED = ("similarity_pct", "ppr_score", "ppr_pct", "blended_score", "blended_pct")


@query(f"SELECT query_id, publication_number, ppr_available, {', '.join(f'{_r(c)} AS {c}' for c in _SCORED)} FROM scored")
def blend(t: Tables) -> DataFrame:
    results = ranking.exclude_self(ranking.with_similarity(t.search.found))
    return ranking.blend(results, t.search.scores).select(
        "query_id", "publication_number", "ppr_available", *[r(c).alias(c) for c in _SCORED]
    )


def _rank_sql(table: str) -> str:
    return f"SELECT query_id, rank::INTEGER AS rank, publication_number, {_r('score')} AS score FROM {table}"


def _rank(t: Tables, mode: str) -> DataFrame:
    return ranking.rank_results(t.search.scored, mode).select(
        "query_id", "rank", "publication_number", r("score").alias("score")
    )


@query(_rank_sql("ranked"))
def rank_blended(t: Tables) -> DataFrame:
    return _rank(t, "blended")


@query(_rank_sql("ranked_similarity"))
def rank_similarity(t: Tables) -> DataFrame:
    return _rank(t, "similarity")


@query(_rank_sql("ranked_graph"))
def rank_graph(t: Tables) -> DataFrame:
    return _rank(t, "graph")


@query(" UNION ALL ".join(f"{_rank_sql(table)} WHERE {_NUMBER} % 3 = {i}" for i, table in enumerate(("ranked", "ranked_similarity", "ranked_graph"))))
def rank_mixed(t: Tables) -> DataFrame:
    """Every query is ranked in a mode of its own."""
    modes = F.array(F.lit("blended"), F.lit("similarity"), F.lit("graph"))
    mode = F.get(modes, F.substring("query_id", 4, 7).cast("int") % 3)
    return ranking.rank_results(t.search.scored, mode).select("query_id", "rank", "publication_number", r("score").alias("score"))


def _table_sql(table: str, ppr: bool = True) -> str:
    scores = ", ".join(f"{_r(c) if ppr else 'NULL::DOUBLE'} AS {c}" for c in ("ppr_pct", "blended_pct"))
    return f"""SELECT query_id, rank::INTEGER AS rank, publication_number, title_text, primary_assignee, primary_inventor, filed,
      {_r('similarity_pct')} AS similarity_pct, {scores} FROM {table}"""


def _rounded_table(table: DataFrame) -> DataFrame:
    return table.withColumns({c: r(c) for c in ("similarity_pct", "ppr_pct", "blended_pct")})


@query(_table_sql("ranked"))
def result_table(t: Tables) -> DataFrame:
    return _rounded_table(t.search.result_table())


@query(f"""SELECT query_id, place::INTEGER AS rank, publication_number, title_text, primary_assignee, filed, {_r('ppr_pct')} AS ppr_pct
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr_pct, 10) DESC, publication_number) AS place
    FROM expanded_rows WHERE ppr_pct > 0) WHERE place <= 10""")
def structural_top10(t: Tables) -> DataFrame:
    return t.search.structural_top().withColumn("ppr_pct", r("ppr_pct"))


@query(_table_sql("ranked_similarity", ppr=False))
def fallback_rank(t: Tables) -> DataFrame:
    """No query has a ranking: one power step never converges here."""
    none = personalized_pagerank(t.search.nodes, t.search.edges, max_iter=1)
    results = ranking.exclude_self(ranking.with_similarity(t.search.found))
    blended = ranking.blend(results, minmax_normalize(none))
    return _rounded_table(ranking.result_table(t.search.with_corpus(ranking.rank_results(blended))))


# Analytics

_NAMED = "coalesce(name, '') <> ''"


@query(f"SELECT query_id, row_no::INTEGER AS row_no, (pos - 1)::INTEGER AS pos, name FROM "
       f"({oracles._unnested('found', 'assignees', 'name', 'row_no', _NAMED)})")
def unnest_assignees(t: Tables) -> DataFrame:
    return analytics.unnest_names(t.search.results, "assignee_harmonized")


@query(oracles._counted(oracles._unnested("ranked", "assignees", "name", "rank", _NAMED), "name", "WHERE place <= 10"))
def top_assignees(t: Tables) -> DataFrame:
    return t.search.top_names("assignee_harmonized")


@query(oracles._counted(oracles._unnested("ranked", "inventors", "name", "rank", _NAMED), "name", "WHERE place <= 10"))
def top_inventors(t: Tables) -> DataFrame:
    return t.search.top_names("inventor_harmonized")


@query(oracles._counted(oracles._unnested("found100", "assignees", "name", "row_no", _NAMED), "name", "WHERE place <= 10"))
def top_assignees_sql(t: Tables) -> DataFrame:
    """The wider form: 100 results, the query's own row included."""
    return analytics.top_names(t.search100.results, "assignee_harmonized")


@query(oracles._counted(oracles._unnested("found100", "inventors", "name", "row_no", _NAMED), "name", "WHERE place <= 10"))
def top_inventors_sql(t: Tables) -> DataFrame:
    return analytics.top_names(t.search100.results, "inventor_harmonized")


_LETTERS = oracles._counted(
    oracles._unnested("ranked", "cpcs", "upper(substr(code, 1, 1)) AS section", "rank", "regexp_matches(code, '^[A-Za-z]')"),
    "section",
)
_FIRST_CHARS = oracles._counted(
    oracles._unnested("found100", "cpcs", "substr(code, 1, 1) AS section", "row_no", "code IS NOT NULL"), "section"
)


@query(f"SELECT *, section || ' - ' || {oracles._LABELS} AS label FROM ({_LETTERS})")
def cpc_distribution(t: Tables) -> DataFrame:
    return t.search.cpc_distribution()


@query(_FIRST_CHARS)
def cpc_distribution_sql(t: Tables) -> DataFrame:
    return analytics.cpc_distribution(t.search100.results, letters_only=False).drop("label")


@query(oracles._counted(oracles._unnested("found", "terms", "term", "row_no", "term <> ''"), "term", "WHERE place <= 10"))
def top_terms(t: Tables) -> DataFrame:
    return analytics.top_terms(t.search.results)


@query(f"""SELECT query_id, n_results, n_assignees, n_inventors, {_r('avg_similarity_pct')} AS avg_similarity_pct, n_expanded
  FROM kpis""")
def kpi(t: Tables) -> DataFrame:
    return t.search.kpi().withColumn("avg_similarity_pct", r("avg_similarity_pct"))


def _count_sql(rel: str) -> str:
    return f"(SELECT count(*) FROM rel x WHERE x.owner_id = c.vec_id AND x.rel = '{rel}')::INTEGER"


@query(f"""SELECT f.query_id, f.publication_number, c.title_value AS title_text, {_count_sql('cited_by')} AS forward_citation_count,
  {_count_sql('citation')} AS backward_citation_count, {_count_sql('parent')} AS parent_count, {_count_sql('child')} AS child_count,
  {_r('f.distance')} AS distance FROM found f JOIN corpus c USING (publication_number) WHERE f.row_no <= 10""")
def citation_counts(t: Tables) -> DataFrame:
    top10 = t.search.results.where(F.col("row_no") <= 10)
    return analytics.citation_counts(top10).select(
        "query_id", "publication_number", "title_text", "forward_citation_count", "backward_citation_count",
        "parent_count", "child_count", r("distance").alias("distance"),
    )


@query("SELECT query_id, assignee, n, first_rank::INTEGER AS first_rank FROM shared")
def shared_assignees(t: Tables) -> DataFrame:
    return analytics.shared_assignees(t.search.ranked())


# Network view


@query(f"""SELECT query_id, node, kind, label, hover, color, size::INTEGER AS size, shape, {_r('score')} AS score, score_pct,
  tier::INTEGER AS tier FROM shown_nodes""")
def viz_nodes(t: Tables) -> DataFrame:
    return t.search.viz_nodes().withColumn("score", r("score"))


@query(f"SELECT query_id, src, dst, kind, title, {_r('width')} AS width, color, opacity, dashes FROM shown_edges")
def viz_edges(t: Tables) -> DataFrame:
    return t.search.viz_edges().withColumn("width", r("width"))


@query(f"""SELECT query_id, src, dst, kind, title, {_r('width')} AS width, color, opacity, dashes
  FROM ({oracles._shown_edges("WHERE l.other <> a.publication_number AND l.pos <= CASE WHEN l.rel_no < 2 THEN 10 ELSE 5 END")})""")
def viz_edges_capped(t: Tables) -> DataFrame:
    return t.search.viz_edges(caps=network.LINK_CAPS).withColumn("width", r("width"))


@query("SELECT query_id, node FROM shown_nodes WHERE shape = 'triangle' AND true")
def node_filter(t: Tables) -> DataFrame:
    return network.filter_nodes(t.search.viz_nodes(), "shape", ["triangle"])


@query("SELECT query_id, src AS node FROM edges WHERE edge_type IN ('parent', 'child') "
       "UNION SELECT query_id, dst FROM edges WHERE edge_type IN ('parent', 'child')")
def edge_filter(t: Tables) -> DataFrame:
    return network.filter_edges(t.search.edges, "edge_type", ["parent", "child"])


_HOP1 = """SELECT query_id, dst AS node, 1 AS hop FROM edges WHERE src = query_id
  UNION SELECT query_id, src, 1 FROM edges WHERE dst = query_id"""


@query(f"""SELECT n.query_id, n.node, min(h.hop) AS hop FROM nodes n LEFT JOIN (
  SELECT query_id, query_id AS node, 0 AS hop FROM queries
  UNION ALL ({_HOP1})
  UNION ALL SELECT DISTINCT e.query_id, e.dst, 2 FROM edges e JOIN ({_HOP1}) h ON h.query_id = e.query_id AND h.node = e.src
  UNION ALL SELECT DISTINCT e.query_id, e.src, 2 FROM edges e JOIN ({_HOP1}) h ON h.query_id = e.query_id AND h.node = e.dst
  ) h ON h.query_id = n.query_id AND h.node = n.node GROUP BY n.query_id, n.node""")
def khop2(t: Tables) -> DataFrame:
    seeds = t.search.nodes.where("is_seed").select("query_id", "node")
    return network.khop(t.search.nodes, t.search.edges, seeds)


# Text


@query("SELECT query_id, context FROM plain_blocks")
def context_plain(t: Tables) -> DataFrame:
    return contexts.context_plain(t.search.ranked("similarity"))


@query("SELECT query_id, ppr_available, context FROM contexts")
def context_graph(t: Tables) -> DataFrame:
    return t.search.context()


@query("SELECT query_id, substr(sha1(context), 1, 12) AS content_key FROM contexts")
def context_hash(t: Tables) -> DataFrame:
    return t.search.context().select("query_id", text.content_key(F.col("context")).alias("content_key"))


def _prompt_sql(template: str) -> str:
    slots = {
        "{query_id}": "q.publication_number",
        "{title}": "q.title_text",
        "{abstract}": "substr(q.abstract_text, 1, 800)",
        "{results}": "x.context",
    }
    filled = oracles._text(template)
    for slot, value in slots.items():
        filled = filled.replace(slot, f"' || {value} || '")
    return filled


@query(f"""SELECT x.query_id, x.ppr_available, CASE WHEN x.ppr_available THEN {_prompt_sql(contexts.GRAPH_TEMPLATE)}
  ELSE {_prompt_sql(contexts.PLAIN_TEMPLATE)} END AS prompt, substr(sha1(x.context), 1, 12) AS content_key
  FROM contexts x JOIN query_rows q USING (query_id)""")
def prompt(t: Tables) -> DataFrame:
    return t.search.prompt()


@query("""SELECT query_id, publication_number, title_text, coalesce(nullif(primary_assignee, ''), 'N/A') AS assignee,
  coalesce(nullif(primary_inventor, ''), 'N/A') AS inventor, filed, published, granted,
  substr(abstract_text, 1, 600) AS abstract,
  (SELECT string_agg(term, '|' ORDER BY pos) FROM terms x WHERE x.vec_id = query_rows.vec_id AND pos <= 8) AS terms
  FROM query_rows""")
def query_card(t: Tables) -> DataFrame:
    return t.search.query_card().withColumn("terms", F.array_join("terms", "|"))


# Scalar functions over whole tables


@query(f"""SELECT publication_number, {oracles._date('filing_date')} AS filed, {oracles._date('publication_date')} AS published,
  {oracles._date('grant_date')} AS granted, {oracles._date('label')} AS of_label FROM docs""")
def format_date(t: Tables) -> DataFrame:
    return t.source.documents().select(
        "publication_number",
        *[
            text.format_date(F.col(c)).alias(name)
            for c, name in (
                ("filing_date", "filed"), ("publication_date", "published"), ("grant_date", "granted"), ("label", "of_label"),
            )
        ],
    )


@query("""SELECT publication_number, coalesce(title_value, '') AS title_text, coalesce(abstract_value, '') AS abstract_text
  FROM docs""")
def extract_text(t: Tables) -> DataFrame:
    rows = t.research
    return rows.select(
        "publication_number", text.extract_text(rows, "title").alias("title_text"),
        text.extract_text(rows, "abstract").alias("abstract_text"),
    )


@query("SELECT publication_number, primary_assignee, primary_inventor FROM named")
def primary_names(t: Tables) -> DataFrame:
    return t.base.select(
        "publication_number", text.first_name(F.col("assignee_harmonized")).alias("primary_assignee"),
        text.first_name(F.col("inventor_harmonized")).alias("primary_inventor"),
    )


@query(f"""SELECT query_id, publication_number, {oracles._tier('u', 1)}::INTEGER AS tier, {oracles._tier('u', 2)} AS color,
  trunc(u * 100)::INTEGER AS pct FROM (SELECT *, {oracles._unit('ppr_score')} AS u FROM expanded_rows)""")
def score_tier(t: Tables) -> DataFrame:
    score = text.unit_score(F.col("ppr_score"))
    return t.search.expanded.select(
        "query_id", "publication_number", text.score_tier(score).alias("tier"), text.score_color(score).alias("color"),
        text.whole_percent(score).alias("pct"),
    )


@query("""SELECT query_id, publication_number, (CASE WHEN similarity > 0.9 THEN 4 WHEN similarity > 0.8 THEN 3
  WHEN similarity >= 0.6 THEN 2 ELSE 1 END)::INTEGER AS tier FROM (SELECT *, 1 - distance AS similarity FROM topk)""")
def score_tier_legacy(t: Tables) -> DataFrame:
    return ranking.with_similarity(t.search.found).select(
        "query_id", "publication_number", text.score_tier_legacy(F.col("similarity")).alias("tier")
    )


# Updates

_OLD_LIST = "coalesce((SELECT string_agg(other, '|' ORDER BY pos) FROM {table} x WHERE x.owner_id = d.vec_id AND x.rel = '{rel}'), '')"


def _merged_list(rel: str) -> str:
    new, old = _OLD_LIST.format(table="rel", rel=rel), _OLD_LIST.format(table="old_rel", rel=rel)
    return f"CASE WHEN s.publication_number IS NOT NULL THEN {new} ELSE {old} END AS {rel}"


_UPSERTED = f"""SELECT d.publication_number, d.filing_date, d.title_value AS title, d.primary_assignee,
  {', '.join(_merged_list(rel) for rel in ('cited_by', 'citation', 'parent', 'child'))}
  FROM named d LEFT JOIN corpus s ON s.publication_number = d.publication_number
  LEFT JOIN snapshot o ON o.publication_number = d.publication_number
  WHERE s.publication_number IS NOT NULL OR o.publication_number IS NOT NULL"""


@query(_UPSERTED)
def merge_upsert(t: Tables) -> DataFrame:
    """Merged into the snapshot stored by key range: ranges without news keep their files."""
    return t.snapshot_store.merge(t.corpus).read().select(
        "publication_number", "filing_date", F.col("title.value").alias("title"), "primary_assignee",
        *[joined(c, "publication_number") for c in ("cited_by", "citation", "parent", "child")],
    )


@query(_UPSERTED)
def stream_merge(t: Tables) -> DataFrame:
    """The corpus arrives as a file and is merged into the snapshot by the stream; read back."""
    folder = f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    names = CORPUS.fieldNames()
    refresh.publish(t.snapshot.select(names), f"{folder}/versions", 0)
    t.corpus.select(names).write.parquet(f"{folder}/in")
    refresh.finish(refresh.stream_merge(t.spark, f"{folder}/in", f"{folder}/versions", f"{folder}/state"))
    return refresh.read_latest(t.spark, f"{folder}/versions", above=0).select(
        "publication_number", "filing_date", F.col("title.value").alias("title"), "primary_assignee",
        *[joined(c, "publication_number") for c in ("cited_by", "citation", "parent", "child")],
    )


@query(_UPSERTED)
def merge_join(t: Tables) -> DataFrame:
    """The same as one join of two plain tables."""
    return merge.merge(t.snapshot, t.corpus).select(
        "publication_number", "filing_date", F.col("title.value").alias("title"), "primary_assignee",
        *[joined(c, "publication_number") for c in ("cited_by", "citation", "parent", "child")],
    )


@query(_UPSERTED)
def stream_refresh(t: Tables) -> DataFrame:
    """Bibliographic rows arrive as files, are joined with the semantic source, filtered and merged; read back."""
    folder = f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    refresh.publish(t.snapshot, f"{folder}/store", 0, max(1, t.snapshot.count() // 8))
    t.base.write.parquet(f"{folder}/in")
    refresh.finish(
        refresh.stream_refresh(t.spark, f"{folder}/in", materialize(t.research), f"{folder}/store", f"{folder}/state", t.base.schema)
    )
    return refresh.read_latest(t.spark, f"{folder}/store", above=0).select(
        "publication_number", "filing_date", F.col("title.value").alias("title"), "primary_assignee",
        *[joined(c, "publication_number") for c in ("cited_by", "citation", "parent", "child")],
    )


@query("""SELECT CASE WHEN o.publication_number IS NULL THEN 'inserted' WHEN s.publication_number IS NULL THEN 'untouched'
  ELSE 'updated' END AS action, count(*) AS n FROM snapshot o FULL JOIN corpus s USING (publication_number) GROUP BY 1""")
def merge_stats(t: Tables) -> DataFrame:
    return merge.merge_stats(t.snapshot, t.corpus)


@query("SELECT publication_number, 2::BIGINT AS n FROM snapshot JOIN corpus USING (publication_number)")
def merge_dup_check(t: Tables) -> DataFrame:
    """Two extracts appended without care: documents in both occur twice."""
    return merge.merge_dup_check(t.snapshot.unionByName(t.corpus))


_DAY = 86_400_000_000


_STATUS = f"""SELECT job_id, epoch_us(last_time) AS last_run_us, last_state, last_error, last_run_id, epoch_us(success) AS last_success_us,
  days AS days_since, CASE WHEN days <= 60 THEN 'current' WHEN days <= 90 THEN 'aging' ELSE 'stale' END AS freshness,
  CASE days WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE days || ' days ago' END AS refreshed, cooldown AS cooldown_days,
  last_state IN ('PENDING', 'RUNNING') AS in_flight, last_state <> 'SUCCEEDED' AS failed,
  last_state NOT IN ('PENDING', 'RUNNING') AND cooldown = 0 AS can_trigger FROM (
    SELECT *, (now_us - epoch_us(last_time)) // {_DAY} AS days,
      CASE WHEN success IS NULL THEN 0 ELSE greatest(0, CASE WHEN left_us < 0 THEN -1 ELSE left_us // {_DAY}
        + CASE WHEN left_us % {_DAY} >= 1000000 THEN 1 ELSE 0 END END) END::INTEGER AS cooldown FROM (
      SELECT user_id AS job_id, max(ts) AS last_time, arg_max(state, ts) AS last_state, arg_max(event_id, ts) AS last_run_id,
        arg_max(struct_pack(e := error), ts).e AS last_error, max(ts) FILTER (WHERE state = 'SUCCEEDED') AS success,
        epoch_us(TIMESTAMP '2024-02-10') AS now_us,
        7 * {_DAY} - (epoch_us(TIMESTAMP '2024-02-10') - epoch_us(max(ts) FILTER (WHERE state = 'SUCCEEDED'))) AS left_us
      FROM (SELECT *, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'PENDING'
          ELSE 'SUCCEEDED' END AS state, CASE WHEN event_type = 'error' THEN props END AS error FROM events)
      GROUP BY user_id))"""


def _status_columns(table: DataFrame) -> DataFrame:
    return table.select(
        "job_id", F.unix_micros("last_run_time").alias("last_run_us"), "last_state", "last_error", "last_run_id",
        F.unix_micros("last_success_time").alias("last_success_us"), "days_since", "freshness", "refreshed",
        "cooldown_days", "in_flight", "failed", "can_trigger",
    )


@query(_STATUS)
def refresh_status(t: Tables) -> DataFrame:
    return _status_columns(status.refresh_status(t.source.runs(), NOW))


@query(_STATUS)
def status_stream(t: Tables) -> DataFrame:
    """The runs arrive in two parts, by time; the stream keeps what the status needs of each job."""
    folder, runs = _new_path(t, "status"), t.source.runs()
    middle = runs.agg(F.to_timestamp(F.timestamp_seconds(F.avg(F.col("run_time").cast("double")))).alias("m")).scalar()
    for part in (F.col("run_time") < middle, F.col("run_time") >= middle):
        runs.where(part).write.mode("append").parquet(f"{folder}/in")
        refresh.finish(stream_status(t.spark, f"{folder}/in", f"{folder}/states", f"{folder}/state", runs.schema))
    return _status_columns(status.status_of(read_states(t.spark, f"{folder}/states"), NOW))


# Sinks, copies and exports: written to the shared folder and read back


def _new_path(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""SELECT * REPLACE (nullif(title_text, '') AS title_text, nullif(primary_assignee, '') AS primary_assignee,
  nullif(primary_inventor, '') AS primary_inventor) FROM ({_table_sql("ranked")})""")
def csv_sink(t: Tables) -> DataFrame:
    """Empty texts come back as nulls."""
    table, path = _rounded_table(t.search.result_table()), _new_path(t, "csv")
    sinks.write_csv(table, path)
    return t.spark.read.schema(table.schema).csv(path, header=True, escape='"', multiLine=True)


@query("SELECT query_id, context FROM contexts")
def text_sink(t: Tables) -> DataFrame:
    texts, path = t.search.context().select("query_id", "context"), _new_path(t, "texts")
    sinks.write_text(texts, path)
    return t.spark.read.schema(texts.schema).json(path)


@query("SELECT query_id, node AS src, NULL::VARCHAR AS dst, NULL::VARCHAR AS edge_type FROM nodes "
       "UNION ALL SELECT query_id, src, dst, edge_type FROM edges")
def graph_sink(t: Tables) -> DataFrame:
    path = _new_path(t, "graph")
    sinks.write_graph(t.search.nodes.select("query_id", "node"), t.search.edges, path)
    nodes, edges = (t.spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges"))
    none = F.lit(None).cast("string")
    return nodes.select("query_id", F.col("node").alias("src"), none.alias("dst"), none.alias("edge_type")).unionByName(edges)


_STORED = f"SELECT publication_number, filing_date, title_value AS title, {oracles._r('list_sum(vec)')} AS vector_sum FROM corpus"


def _stored(df: DataFrame) -> DataFrame:
    total = F.aggregate("embedding_v1", F.lit(0.0), lambda a, x: a + x)
    return df.select("publication_number", "filing_date", F.col("title.value").alias("title"), r(total).alias("vector_sum"))


@query(_STORED)
def table_copy(t: Tables) -> DataFrame:
    first, second = _new_path(t, "corpus"), _new_path(t, "copy")
    corpora.write_corpus(t.corpus, first)
    corpora.copy_corpus(t.spark, first, second)
    return _stored(t.spark.read.parquet(second))


@query(_STORED)
def table_export(t: Tables) -> DataFrame:
    path = _new_path(t, "export")
    sinks.export_table(t.corpus, path)
    return _stored(t.spark.read.parquet(path))


# Whole pipelines: each starts from the stored corpus and the raw inputs


@query(_table_sql("ranked"))
def search_e2e(t: Tables) -> DataFrame:
    """Through the stored index, with the exact second pass."""
    queries = materialize(resolved_queries(t.source.inputs(), t.corpus))
    return _rounded_table(Search(queries, t.corpus, index=t.index, max_neighbors=t.max_neighbors).result_table())


@query(_table_sql("ranked_similarity", ppr=False))
def search_text_only(t: Tables) -> DataFrame:
    queries = materialize(resolved_queries(t.source.inputs(), t.corpus))
    return _rounded_table(Search(queries, t.corpus, with_graph=False).result_table())


_METRICS = ["n_results", "n_assignees", "n_inventors", "avg_similarity_pct", "n_expanded"]


@query(f"""SELECT query_id, 'assignee' AS kind, place, name AS item, n::DOUBLE AS value FROM (
    {oracles._counted(oracles._unnested("ranked", "assignees", "name", "rank", _NAMED), "name", "WHERE place <= 10")})
  UNION ALL SELECT query_id, 'inventor', place, name, n FROM (
    {oracles._counted(oracles._unnested("ranked", "inventors", "name", "rank", _NAMED), "name", "WHERE place <= 10")})
  UNION ALL SELECT query_id, 'cpc', place, section || ' - ' || {oracles._LABELS}, n FROM ({_LETTERS})
  {' '.join(f"UNION ALL SELECT query_id, 'metric', {i + 1}, '{m}', {_r(m)} FROM kpis" for i, m in enumerate(_METRICS))}""")
def analytics_e2e(t: Tables) -> DataFrame:
    measured = (F.col("kind") == "metric") & (F.col("item") == "avg_similarity_pct")
    return t.search.analytics().withColumn("value", F.when(measured, r("value")).otherwise(F.col("value")))


@query("""SELECT s.query_id, s.node, s.kind, s.size::INTEGER AS size, s.shape, s.tier::INTEGER AS tier,
  coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM shown_nodes s
  LEFT JOIN (SELECT query_id, src AS node, count(*) AS n FROM shown_edges GROUP BY ALL) o USING (query_id, node)
  LEFT JOIN (SELECT query_id, dst AS node, count(*) AS n FROM shown_edges GROUP BY ALL) i USING (query_id, node)""")
def network_e2e(t: Tables) -> DataFrame:
    return t.search.network().select("query_id", "node", "kind", "size", "shape", "tier", "n_out", "n_in")


@query("""SELECT '1 indexed' AS stage, count(*) AS rows, count(*) AS indexed, 100e0 AS coverage_pct FROM snapshot
  UNION ALL SELECT '2 merged', count(*), count(o.publication_number), round(count(o.publication_number) * 100e0 / count(*), 6)
    FROM snapshot o FULL JOIN corpus s USING (publication_number)
  UNION ALL SELECT '3 indexed again', count(*), count(*), 100e0 FROM snapshot o FULL JOIN corpus s USING (publication_number)""")
def lifecycle_e2e(t: Tables) -> DataFrame:
    return lifecycle(t.snapshot, t.corpus).withColumn("coverage_pct", F.round("coverage_pct", 6))


# The names under which the inventory lists these.
for _name, _function in (("resolve_ids", "resolve_inputs"), ("knn_join", "knn_all_queries"), ("minmax_normalize", "minmax"),
                         ("second_level_knn", "second_level")):
    QUERIES[_name] = QUERIES.pop(_function)
    ORACLES[_name] = ORACLES.pop(_function)
