"""Personalised PageRank of every query's graph, all teleports going to the query.

Power iteration from a uniform start: a node passes ``alpha`` of its rank to its distinct targets in
equal parts; rank on nodes without targets and the teleport share go to the seed. A query stops when
its total change falls below ``n_nodes * tol`` and has no result if that takes more than ``max_iter``
steps, or if its graph has no edges.

Two plans, chosen per query by size:

* grouped: a graph whose size is within bounds is solved inside one task (its size is limited by the
  caps on results and neighbours, not by the data);
* iterative: any larger graph is spread over the cluster. A step is one join and one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearcite.session import Turns, broadcast_small, materialize
from nearcite.sources.corpus import id_position_map

GROUPED_EDGES = 500_000  # a larger graph (or one with as many nodes) is solved iteratively
NAMES_SENT = 500_000  # distinct ids that travel to all tasks with their numbers
EDGES_PER_SALT = 100_000  # edges of one source that stay in one partition


def personalized_pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float = 1e-6,
    require_convergence: bool = True,
    grouped_edges: int = GROUPED_EDGES,
) -> DataFrame:
    """``(query_id, node, ppr_raw)`` for nodes ``(query_id, node, is_seed)`` and edges ``(query_id, src, dst)``.

    Edges must be distinct per ordered pair and end in known nodes.
    """
    settings = (alpha, max_iter, tol, require_convergence)
    sizes = (
        nodes.select("query_id", F.lit(1).alias("n"), F.lit(0).alias("e"))
        .unionByName(edges.select("query_id", F.lit(0).alias("n"), F.lit(1).alias("e")))
        .groupBy("query_id")
        .agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    )
    large = sizes.where(F.greatest("n", "e") > grouped_edges).select("query_id")
    if large.isEmpty():
        return _grouped(nodes, edges, *settings)
    large = materialize(large)
    small_scores = _grouped(
        nodes.join(large, "query_id", "left_anti"), edges.join(large, "query_id", "left_anti"), *settings
    )
    large_scores = _iterative(
        nodes.join(large, "query_id", "left_semi"), edges.join(large, "query_id", "left_semi"), *settings
    )
    return small_scores.unionByName(large_scores)


def _grouped(
    nodes: DataFrame, edges: DataFrame, alpha: float, max_iter: int, tol: float, require_convergence: bool
) -> DataFrame:
    """Ids are numbered while they can travel to all tasks, and the rows of a query move as lists of numbers."""
    names = materialize(id_position_map(nodes.select("node").distinct(), "node"))
    nodes, edges = nodes.select("query_id", "node", "is_seed"), edges.select("query_id", "src", "dst")
    few = names.count() <= NAMES_SENT
    if few:
        for name in ("node", "src", "dst"):
            number = F.broadcast(names.select(F.col("node").alias(name), F.col("position").cast("int").alias("_no")))
            put = lambda rows, name=name, number=number: rows.join(number, name, "left").drop(name).withColumnRenamed("_no", name)
            nodes, edges = (put(nodes), edges) if name == "node" else (nodes, put(edges))

    def solve(key: tuple, n: pa.Table, e: pa.Table) -> pa.Table:
        flat = lambda table, name: table[name].combine_chunks().flatten()
        ids = flat(n, "node")
        order = pc.sort_indices(ids)  # a fixed order of summation
        ids = ids.take(order)
        seed = flat(n, "is_seed").take(order).to_numpy(zero_copy_only=False).astype(float)
        src = pc.index_in(flat(e, "src"), value_set=ids).to_numpy(zero_copy_only=False)
        dst = pc.index_in(flat(e, "dst"), value_set=ids).to_numpy(zero_copy_only=False)
        rank = _power_iteration(seed, src, dst, alpha, max_iter, tol, require_convergence)
        if rank is None:
            ids, rank = ids.slice(0, 0), np.empty(0)
        return pa.table({"query_id": pa.repeat(key[0], len(ids)), "node": ids, "ppr_raw": pa.array(rank)})

    left = _packed(nodes, "query_id", ["node", "is_seed"]).groupBy("query_id")
    # Both sides may stem from the same rows; a new name keeps their keys apart.
    right = _packed(edges.withColumnRenamed("query_id", "edge_query"), "edge_query", ["src", "dst"]).groupBy("edge_query")
    schema = T.StructType([nodes.schema["query_id"], nodes.schema["node"], T.StructField("ppr_raw", T.DoubleType())])
    scores = left.cogroup(right).applyInArrow(solve, schema)
    if not few:
        return scores
    named = F.broadcast(names.select(F.col("position").cast("int").alias("_no"), "node"))
    return scores.withColumnRenamed("node", "_no").join(named, "_no", "left").select("query_id", "node", "ppr_raw")


def _packed(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns as lists by key, a row a key for every batch of rows that a task reads."""
    schema = T.StructType([rows.schema[key], *[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in columns]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            offsets = pa.array(np.append(starts, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c).take(pa.array(order))) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(order[starts])), *lists], names=[key, *columns])

    return rows.select(key, *columns).mapInArrow(pack, schema)


def _power_iteration(
    seed: np.ndarray,
    src: np.ndarray,
    dst: np.ndarray,
    alpha: float,
    max_iter: int,
    tol: float,
    require_convergence: bool,
) -> np.ndarray | None:
    n = len(seed)
    if not n or not len(src):
        return None
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    targets = np.bincount(src, minlength=n)
    share = alpha / np.maximum(targets, 1)
    ends = targets == 0
    rank = np.full(n, 1.0 / n)
    for _ in range(max_iter):
        last = rank
        passed = np.bincount(dst, weights=(last * share)[src], minlength=n)
        rank = passed + (alpha * last[ends].sum() + (1.0 - alpha)) * seed
        if np.abs(rank - last).sum() < n * tol:
            return rank
    return None if require_convergence else rank


def _iterative(
    nodes: DataFrame, edges: DataFrame, alpha: float, max_iter: int, tol: float, require_convergence: bool
) -> DataFrame:
    """All remaining queries at once; each leaves the loop when it has converged.

    A source with very many targets is salted: its edges lie in several partitions and its rank is
    sent to each. Sums into a popular target combine before the shuffle.
    """
    degrees = edges.groupBy("query_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("targets"))
    salts = F.ceil(F.col("targets") / EDGES_PER_SALT).cast("int")
    per_query = nodes.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max(F.when(F.col("is_seed"), F.col("node"))).alias("seed")
    )
    turns = Turns(nodes.sparkSession)
    state = turns.next(
        nodes.select("query_id", "node", "is_seed")
        .join(degrees, ["query_id", "node"], "left")
        .join(per_query, "query_id")
        .join(edges.select("query_id").distinct(), "query_id", "left_semi")
        .select(
            "query_id",
            "node",
            "is_seed",
            "seed",
            "n_nodes",
            F.coalesce("targets", F.lit(0)).alias("targets"),
            (F.lit(1.0) / F.col("n_nodes")).alias("rank"),
        )
    )
    hot = degrees.where(F.col("targets") > EDGES_PER_SALT).select(
        "query_id", F.col("node").alias("src"), salts.alias("salts")
    )
    by = ["query_id", "src", "salt"]
    # Kept in the layout of the join, so that a step moves ranks but never edges. A lost partition is
    # read again from the written table.
    salted = (
        materialize(
            edges.select("query_id", "src", "dst")
            .join(hot, ["query_id", "src"], "left")
            .withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int"))
            .select(*by, "dst")
        )
        .repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
        .sortWithinPartitions(*by)
        .persist()
    )
    finished: DataFrame | None = None
    for step in range(max_iter):
        sent = state.where(F.col("targets") > 0).select(
            "query_id",
            F.col("node").alias("src"),
            (alpha * F.col("rank") / F.col("targets")).alias("part"),
            F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"),
        )
        arriving = (
            salted.join(sent, by)
            .select("query_id", F.col("dst").alias("node"), "part")
            .unionByName(
                state.where(F.col("targets") == 0).select(
                    "query_id", F.col("seed").alias("node"), (alpha * F.col("rank")).alias("part")
                )
            )
            .groupBy("query_id", "node")
            .agg(F.sum("part").alias("part"))
        )
        stepped = (
            state.join(arriving, ["query_id", "node"], "left")
            .withColumn("last", F.col("rank"))
            .withColumn(
                "rank",
                F.coalesce("part", F.lit(0.0)) + F.when(F.col("is_seed"), 1.0 - alpha).otherwise(0.0),
            )
            .drop("part")
        )
        stepped = turns.next(stepped)
        done = (
            stepped.groupBy("query_id", "n_nodes")
            .agg(F.sum(F.abs(F.col("rank") - F.col("last"))).alias("change"))
            .where(F.col("change") < F.col("n_nodes") * tol)
            .select("query_id")
        )
        last_step = step + 1 == max_iter
        if last_step and not require_convergence:
            settled, state = stepped, stepped.limit(0)
            turns.keep()
        elif done.isEmpty():
            settled, state = None, stepped
        else:
            settled = stepped.join(done, "query_id", "left_semi")
            turns.keep()
            state = turns.next(stepped.join(done, "query_id", "left_anti"))
        if settled is not None:
            part = settled.select("query_id", "node", F.col("rank").alias("ppr_raw"))
            finished = part if finished is None else finished.unionByName(part)
        if settled is not None and state.isEmpty():
            break
        state = state.drop("last")
    salted.unpersist()
    if finished is None:
        return state.select("query_id", "node", F.col("rank").alias("ppr_raw")).limit(0)
    return finished


def minmax_normalize(scores: DataFrame, column: str = "ppr_raw", into: str = "ppr_score") -> DataFrame:
    """Scale ``column`` to 0..1 per query; a query whose scores are all equal gets 1.0 throughout.

    The spans, a row a query, travel to the scores while they are few, so one query of very many nodes stays spread.
    """
    span = scores.groupBy("query_id").agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    scaled = F.when(F.col("_high") == F.col("_low"), 1.0).otherwise(
        (F.col(column) - F.col("_low")) / F.when(F.col("_high") != F.col("_low"), F.col("_high") - F.col("_low"))
    )
    return scores.join(broadcast_small(materialize(span)), "query_id").withColumn(into, scaled).drop("_low", "_high")


def top_scores(scores: DataFrame, n: int = 3, column: str = "ppr_raw") -> DataFrame:
    """The n highest scores per query."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(column, 12).desc(), "node"))
    return scores.withColumn("place", order).where(F.col("place") <= n)
