"""Expand results along their links and build the citation graph of every query.

``source`` is a DataFrame with ``publication_number`` and the four link arrays, usually the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearcite.functions.text import extract_text, format_date
from nearcite.operators.links import Membership, link_ids, link_pieces
from nearcite.schema import LINK_COLUMNS, NEIGHBOR_COLUMNS
from nearcite.session import broadcast_small, materialize
from nearcite.sources.corpus import id_position_map
from nearcite.sources.ranges import StoredCorpus

# What a link in each array is called once it is an edge.
EDGE_TYPES = {"citation": "cites", "cited_by": "cited_by", "parent": "parent", "child": "child"}
# Links that point from the other document to the row's own.
_INWARD = ("cited_by", "parent")

NODES_IN_BLOCK = 1 << 22  # nodes of the queries that one task holds
LINKS_IN_BLOCK = 1 << 23  # links that meet them there
TESTED_IN_BLOCK = 1 << 28  # links of those nodes, about, that a block of queries tests
SMALL_BLOCK = 1 << 14  # nodes in one task even if that leaves cores idle
NODES_OF_QUERY = 1 << 18  # a query of more nodes is spread by joins
DOCUMENTS_OF_TASK = 64  # whose texts stand together in a task that hands out neighbours
ROWS_OF_DOCUMENT = 100_000  # neighbours that are one document, in one task
MOST_TASKS = 1 << 14
_EXPANDED = 1 << 62  # above every place of a result: 2**30 rows of 2**32 links have lower ones
_POS_BITS = 28  # an array of so many links would not fit a row; with three bits for the kind, a code is an int


def neighbor_list(source: DataFrame) -> Column:
    """A row's linked ids in reading order, without repeats."""
    return F.array_distinct(
        F.filter(F.concat(*[link_ids(source, c) for c in LINK_COLUMNS]), lambda i: F.coalesce(i, F.lit("")) != "")
    )


def citation_neighbors(results: DataFrame, source: DataFrame | None = None, max_neighbors: int | None = None) -> DataFrame:
    """Linked ids not among the results: ``(query_id, publication_number, first_seen)``.

    ``results`` needs ``(query_id, publication_number, row_no)``; without a ``source`` it must carry
    the arrays itself. ``first_seen`` orders them: rows by ``row_no``, arrays in LINK_COLUMNS order,
    elements by position. All are returned; with ``max_neighbors`` only so many of a query, first seen
    first, with their place as ``neighbor_order``.
    """
    if source is None:
        rows = results.select("query_id", "publication_number", "row_no", neighbor_list(results).alias("ids"))
    else:
        lists = source.select("publication_number", neighbor_list(source).alias("ids"))
        rows = results.select("query_id", "publication_number", "row_no").join(lists, "publication_number", "left")
    # A result opens its own list, which marks it as known. Lists go to their query whole, and are unfolded there.
    own = F.array("publication_number")
    opened = F.concat(own, F.coalesce("ids", F.array().cast("array<string>")))
    seen = rows.repartition("query_id").select("query_id", "row_no", F.posexplode(opened).alias("pos", "publication_number"))
    sighted = F.when(F.col("pos") == 0, -1).otherwise(sequence_key(F.col("row_no"), F.col("pos")))
    fresh = (
        seen.groupBy("query_id", "publication_number")
        .agg(F.min(sighted).alias("first_seen"))
        .where(F.col("first_seen") >= 0)
    )
    if max_neighbors is None:
        return fresh
    return number_neighbors(fresh).where(F.col("neighbor_order") <= max_neighbors)


def number_neighbors(neighbors: DataFrame) -> DataFrame:
    """Adds ``neighbor_order``, the place of a neighbour among those of its query."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("first_seen"))
    return neighbors.withColumn("neighbor_order", order)


def sequence_key(first: Column, second: Column) -> Column:
    """One sortable number for a row number and a place in an array, which is below 2**31 in any engine on the JVM."""
    return F.shiftleft(first.cast("bigint"), 32) + second


def with_display_text(df: DataFrame) -> DataFrame:
    """Add the readable forms of title, abstract and the three dates."""
    return df.select(
        "*",
        extract_text(df, "title").alias("title_text"),
        extract_text(df, "abstract").alias("abstract_text"),
        format_date(F.col("filing_date")).alias("filed"),
        format_date(F.col("publication_date")).alias("published"),
        format_date(F.col("grant_date")).alias("granted"),
    )


def fetch_neighbors(neighbors: DataFrame, corpus: DataFrame | StoredCorpus, columns: list[str] | None = None) -> DataFrame:
    """Corpus metadata of the neighbour ids; ids the corpus lacks drop out. A stored corpus is read where they fall.

    A document comes once for every query that has it. Rows of a document stand together in tasks of few documents, so
    whoever stores them meets few texts at a time and can write each once; a document of very many rows has several tasks.
    """
    columns = columns or NEIGHBOR_COLUMNS
    keys = ["query_id"] + [c for c in neighbors.columns if c not in ("query_id", "publication_number")]
    if not isinstance(corpus, StoredCorpus):
        rows = corpus.select(columns)
        if columns == ["publication_number"]:  # few enough, ids travel to the neighbours, which then stay where they are
            rows = broadcast_small(rows)
        found = neighbors.join(rows, "publication_number")
        return found.select(*keys[:1], *columns, *keys[1:])
    neighbors = materialize(neighbors)  # read three times: for the ids to look up, how often they come, and for the rows
    asked = materialize(neighbors.groupBy("publication_number").agg(F.count(F.lit(1)).alias("n")))
    often = asked.where(F.col("n") > ROWS_OF_DOCUMENT)
    often = broadcast_small(materialize(often.select("publication_number", F.ceil(F.col("n") / ROWS_OF_DOCUMENT).cast("int").alias("_tasks"))))
    tasks = F.coalesce("_tasks", F.lit(1))
    by = ["publication_number", "_task"]
    n = max(int(neighbors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, math.ceil(asked.count() / DOCUMENTS_OF_TASK)))
    asking = neighbors.join(often, "publication_number", "left").withColumn("_task", F.pmod(F.xxhash64("query_id"), tasks).cast("int"))
    rows = corpus.lookup(asked, columns).join(often, "publication_number", "left").withColumn("_task", F.explode(F.sequence(F.lit(0), tasks - 1)))
    found = asking.drop("_tasks").repartition(n, *by).join(rows.drop("_tasks").repartition(n, *by), by)
    return found.select(*keys[:1], *columns, *keys[1:])


def graph_nodes(results: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """Nodes of every query's graph: ``(query_id, node, is_expanded, row_no, is_seed)``.

    Results, expanded rows and the query itself, once each. ``is_expanded`` and ``row_no`` order the rows
    that bring the nodes' links, results first; both are null when only the query id is known.
    """

    def placed(rows: DataFrame, node: Column, is_expanded: bool, number: Column | None) -> DataFrame:
        # One number for both, so that the least is found by hashing; a struct would be sorted on both sides of the shuffle.
        place = F.lit(None) if number is None else number.cast("bigint") + F.lit(_EXPANDED if is_expanded else 0)
        return rows.select("query_id", node.alias("node"), place.cast("bigint").alias("place"))

    rows = placed(results, F.col("publication_number"), False, F.col("row_no"))
    if expanded is not None:
        rows = rows.unionByName(placed(expanded, F.col("publication_number"), True, F.col("first_seen")))
    rows = rows.unionByName(placed(results, F.col("query_id"), False, None))
    first = rows.groupBy("query_id", "node").agg(F.min("place").alias("place"))
    is_expanded = F.col("place") >= _EXPANDED
    return first.select(
        "query_id", "node", is_expanded.alias("is_expanded"), F.when(is_expanded, F.col("place") - F.lit(_EXPANDED)).otherwise(F.col("place")).alias("row_no"),
        (F.col("node") == F.col("query_id")).alias("is_seed"),
    )


def graph_edges(nodes: DataFrame, source: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Directed edges between nodes of the same query: ``(query_id, src, dst, edge_type)``.

    No loops, one edge per ordered pair. When rows disagree on the type of a pair, the link written
    last counts: results before expanded rows, those by ``row_no``, arrays in LINK_COLUMNS order, then
    position.

    Links never become rows that are shuffled to each node: the nodes of a block of queries meet a block of links in one
    task, which looks up the links that leave a node and keeps those that end in one of the same query. Queries of very
    many nodes are spread by joins.
    """
    return _edges(nodes, link_pieces(source) if links is None else links, every=False)


def links_between(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Every link of the rows of a query that ends in a row of it: ``(query_id, src, dst, edge_type)``.

    ``rows`` is ``(query_id, publication_number)``; rows and links that repeat give a link as often. The way of
    ``graph_edges``: no link is shuffled to each row.
    """
    nodes = rows.select("query_id", F.col("publication_number").alias("node"), F.lit(0).cast("bigint").alias("row_no"))
    return _edges(nodes, pieces, every=True)


def _edges(nodes: DataFrame, pieces: DataFrame, every: bool) -> DataFrame:
    """``(query_id, src, dst, edge_type)``: of each ordered pair of nodes the link written last, or every link."""
    nodes = nodes.where(F.col("query_id").isNotNull() & F.col("node").isNotNull())
    sizes = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).collect()[0]
    if most <= NODES_OF_QUERY:
        return _block_edges(nodes, pieces, total, every)
    large = materialize(sizes.where(F.col("n") > NODES_OF_QUERY).select("query_id", "n"))
    rest = total - large.agg(F.sum("n")).collect()[0][0]
    spread = _joined_edges(nodes.join(large, "query_id", "left_semi"), pieces, every)
    return spread.unionByName(_block_edges(nodes.join(large, "query_id", "left_anti"), pieces, rest, every)) if rest else spread


def _after(nodes: DataFrame) -> Column:
    return F.col("is_expanded") if "is_expanded" in nodes.columns else F.lit(False)


def _edge_type(rel: Column) -> Column:
    return F.get(F.array(*[F.lit(EDGE_TYPES[c]) for c in LINK_COLUMNS]), rel).alias("edge_type")


def _inward(rel: Column) -> Column:
    return rel.isin(*[LINK_COLUMNS.index(c) for c in _INWARD])


def _block_edges(nodes: DataFrame, pieces: DataFrame, total: int, every: bool = False) -> DataFrame:
    """Edges of queries whose nodes fit a task.

    Nodes are numbered. Every block of queries holds its nodes, as arrays by query, and meets each block of links, as
    arrays by source; all links of a pair of nodes lie in one block, which decides what was written last.
    """
    numbered = broadcast_small(materialize(id_position_map(nodes.select("node").distinct(), "node")))
    number = lambda name: numbered.select(F.col("node").alias(name), F.col("position").cast("int").alias(f"{name}_no"))
    own, other, inward = F.col("publication_number_no"), F.col("other_no"), _inward(F.col("rel"))
    flat = pieces.select("publication_number", F.inline("links")).join(number("publication_number"), "publication_number").join(number("other"), "other")
    directed = materialize(
        flat.select(
            F.when(inward, other).otherwise(own).alias("src"),
            F.when(inward, own).otherwise(other).alias("dst"),
            F.shiftleft(F.shiftleft(F.when(inward, 1).otherwise(0), 2) + F.col("rel"), _POS_BITS).bitwiseOR(F.col("pos")).cast("int").alias("code"),
        )
    )
    n_links, n_names = directed.count(), numbered.count()
    parallel = nodes.sparkSession.sparkContext.defaultParallelism
    tested = total * n_links / max(n_names, 1)
    least = min(parallel, total // SMALL_BLOCK)
    n_query = max(1, math.ceil(total / NODES_IN_BLOCK), math.ceil(tested / TESTED_IN_BLOCK), least)
    n_link = max(1, math.ceil(n_links / LINKS_IN_BLOCK))
    by_source = materialize(
        directed.groupBy("src", F.pmod(F.xxhash64("src", "dst"), F.lit(n_link)).cast("int").alias("link_block"))
        .agg(F.collect_list("dst").alias("dst"), F.collect_list("code").alias("code"))
    )
    blocks_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = by_source.withColumn("met_block", blocks_of(n_query))
    missing = F.col("row_no").isNull()
    members = nodes.select(
        "query_id", "node", F.coalesce("row_no", F.lit(0)).cast("bigint").alias("row_no"),
        F.when(missing, -2).otherwise(F.coalesce(_after(nodes).cast("int"), F.lit(-1))).cast("tinyint").alias("after"),
    ).join(number("node"), "node")
    left = (
        members.groupBy("query_id")
        .agg(F.collect_list("node_no").alias("node"), F.collect_list("row_no").alias("row_no"), F.collect_list("after").alias("after"))
        .withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int"))
        .withColumn("link_block", blocks_of(n_link))
    )

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        return _edges_of_block(q, c, n_names, every)

    schema = T.StructType(
        [nodes.schema["query_id"], *[T.StructField(name, T.IntegerType()) for name in ("src_no", "dst_no", "rel")]]
    )
    found = left.groupBy("query_block", "link_block").cogroup(right.groupBy("met_block", "link_block")).applyInArrow(meet, schema)
    return found.join(number("src"), "src_no").join(number("dst"), "dst_no").select("query_id", "src", "dst", _edge_type(F.col("rel")))


def _edges_of_block(q: pa.Table, c: pa.Table, n_names: int, every: bool = False) -> pa.Table:
    """``(query_id, src_no, dst_no, rel)`` of all queries of a block over a block of links."""

    def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = table[name].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])

    parts = []
    if q.num_rows and c.num_rows:
        link_to, bounds = flat(c, "dst")
        code = flat(c, "code")[0]
        start, size = np.zeros(n_names, np.int64), np.zeros(n_names, np.int64)
        sources = c["src"].to_numpy()
        start[sources], size[sources] = bounds[:-1], np.diff(bounds)
        (all_nodes, ends), row_nos, afters = flat(q, "node"), flat(q, "row_no")[0], flat(q, "after")[0]
        mark = np.zeros(n_names, np.int32)
        for i in range(q.num_rows):
            own = slice(ends[i], ends[i + 1])
            node, row_no, after = all_nodes[own], row_nos[own], afters[own]
            order = np.lexsort((row_no, after, node))  # a node that comes twice counts where it is written last
            order = order[np.append(node[order][1:] != node[order][:-1], True)]
            times = np.diff(np.searchsorted(np.sort(node), node[order]), append=len(node))
            node, row_no, after = node[order], row_no[order], after[order]
            mark[node] = np.arange(1, len(node) + 1)
            sizes = size[node]
            at = np.arange(sizes.sum()) + np.repeat(start[node] - np.cumsum(sizes) + sizes, sizes)
            dst = mark[link_to[at]]
            kept = np.flatnonzero(dst)
            mark[node] = 0
            src, dst, how = np.repeat(np.arange(len(node)), sizes)[kept], dst[kept] - 1, code[at[kept]]
            owner = np.where(how >> (_POS_BITS + 2), dst, src)
            kept = np.flatnonzero(after[owner] > -2)
            src, dst, how, owner = src[kept], dst[kept], how[kept], owner[kept]
            written = how & ((1 << (_POS_BITS + 2)) - 1)  # rel, then pos
            if every:
                again = np.repeat(np.arange(len(src)), times[owner])
                parts.append((np.full(len(again), i, np.int32), node[src[again]], node[dst[again]], (written[again] >> _POS_BITS).astype(np.int32)))
                continue
            turn = np.lexsort((row_no, after))  # nodes by when their links are written, equal ones together
            same = (row_no[turn][1:] == row_no[turn][:-1]) & (after[turn][1:] == after[turn][:-1])
            place = np.empty(len(node), np.int64)
            place[turn] = np.cumsum(np.append(0, ~same)[: len(node)])
            pair = src.astype(np.int64) * len(node) + dst
            order = np.lexsort(((place[owner] << (_POS_BITS + 2)) | written, pair))
            src, dst, written, pair = src[order], dst[order], written[order], pair[order]
            last = np.append(pair[1:] != pair[:-1], np.ones(min(1, len(pair)), bool))
            parts.append((np.full(int(last.sum()), i, np.int32), node[src[last]], node[dst[last]], (written[last] >> _POS_BITS).astype(np.int32)))
    queries, src, dst, rel = map(np.concatenate, zip(*parts, strict=True)) if parts else [np.empty(0, np.int32)] * 4
    return pa.table({"query_id": q["query_id"].combine_chunks().take(pa.array(queries)), "src_no": src, "dst_no": dst, "rel": rel})


def _joined_edges(nodes: DataFrame, pieces: DataFrame, every: bool = False) -> DataFrame:
    """Edges of queries of any number of nodes, by joins.

    Links are unfolded where their pieces meet a node. A Bloom filter of all nodes drops most of those that cannot end in
    the node set of the query before they are shuffled; a join then keeps those that do.
    """
    rows = nodes.where(F.col("row_no").isNotNull()).select(
        "query_id", F.col("node").alias("publication_number"), _after(nodes).alias("is_expanded"), "row_no"
    )
    members = nodes.select("query_id", F.col("node").alias("other"))
    links = possible_links(rows, pieces, members).join(members, ["query_id", "other"], "left_semi")
    inward = _inward(F.col("rel"))
    own, other = F.col("publication_number"), F.col("other")
    written = links.select(
        "query_id",
        F.when(inward, other).otherwise(own).alias("src"),
        F.when(inward, own).otherwise(other).alias("dst"),
        F.struct("is_expanded", "row_no", "rel", "pos").alias("written"),
    )
    if not every:
        written = written.groupBy("query_id", "src", "dst").agg(F.max("written").alias("written"))
    return written.select("query_id", "src", "dst", _edge_type(F.col("written.rel")))


def possible_links(rows: DataFrame, pieces: DataFrame, members: DataFrame) -> DataFrame:
    """Links of the rows of a query, unfolded, without most of those that end outside ``(query_id, other)``.

    They are unfolded and tested within one generated loop: a test inside the array, before it is unfolded, would be
    interpreted for each element, which takes longer than the join it saves.
    """
    filter_ = Membership(members, ["query_id", "other"])
    links = rows.join(pieces, "publication_number").select(
        "query_id", "publication_number", "is_expanded", "row_no", F.inline("links")
    )
    held = filter_.joined(links).where(filter_.may_hold(F.col("query_id"), F.col("other")))
    return held.select("query_id", "publication_number", "is_expanded", "row_no", "rel", "pos", "other")


def result_edges(edges: DataFrame, results: DataFrame) -> DataFrame:
    """Edges with both ends among the results; a Bloom filter of them drops most others before edges are shuffled."""
    ids = results.select("query_id", F.col("publication_number").alias("node"))
    filter_ = Membership(ids, ["query_id", "node"])
    both = filter_.may_hold(F.col("query_id"), F.col("src")) & filter_.may_hold(F.col("query_id"), F.col("dst"))
    return filter_.joined(edges).where(both).select(edges.columns).join(ids.withColumnRenamed("node", "src"), ["query_id", "src"], "left_semi").join(
        ids.withColumnRenamed("node", "dst"), ["query_id", "dst"], "left_semi"
    ).select(edges.columns)


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(query_id, n_nodes, n_edges)``."""
    both = nodes.select("query_id", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        edges.select("query_id", F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return both.groupBy("query_id").agg(
        F.sum("n").cast("bigint").alias("n_nodes"), F.sum("e").cast("bigint").alias("n_edges")
    )


def in_degree(edges: DataFrame) -> DataFrame:
    """How many edges end in each node: ``(query_id, node, in_degree)``; hubs come out on top."""
    return edges.groupBy("query_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
