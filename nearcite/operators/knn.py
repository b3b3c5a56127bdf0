"""k nearest neighbours of every query vector.

No pair of vectors ever becomes a Spark row. Tasks score blocks of queries against blocks of the
corpus with one matrix product and emit only each query's k best; a per-query top-k then merges them.
Three plans produce the blocks:

* scan: few queries travel to all tasks, the corpus is read once and never shuffled;
* stream: beyond the size check a block of queries stays in a task while a large piece of the corpus passes it;
* block: rows of an index meet the queries that visit their lists, both cut into blocks of a bounded number of rows.

Distances are defined to 12 decimals and ties go to the smaller id, so the result depends on neither
the partitioning nor the order in which a matrix product sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("cosine", "euclidean", "dot_product")

SHIPPED_QUERIES = 1024  # at most this many queries travel with the tasks of a scan
SHIPPED_VALUES = 1 << 20  # and at most this many vector entries (8 MB)
QUERY_BLOCK = 16384
CORPUS_BLOCK = 32768
STREAMED_ROWS = 1 << 18  # corpus rows that pass a block of queries in one task, a corpus block at a time
SMALL_TASK = 1 << 26  # pairs that one task measures even if that leaves cores idle
SCAN_CHUNK = 65536
SCORES_IN_MEMORY = 1 << 22  # 32 MB of float64
PAIRS_MEASURED = 1 << 19  # vector entries that are measured again at once
WINNERS_HELD = 1 << 20  # rows that the lists of a block may answer with before only the best are kept
WINNERS_SENT = 1 << 16  # rows of a batch that goes back to Spark
BROADCAST_CELLS = 1 << 16


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 20,
    distance: str = "cosine",
    *,
    query_vector: str = "embedding_v1",
    vector: str = "embedding_v1",
    query_key: str = "query_id",
    key: str = "publication_number",
) -> DataFrame:
    """``(query_id, publication_number, distance)`` of the k nearest corpus rows per query, exact.

    A query that is itself in the corpus finds itself. Query keys must be unique.
    """
    q = with_vector(queries, query_key, query_vector)
    c = with_vector(corpus, key, vector)
    head = q.limit(SHIPPED_QUERIES + 1).toArrow()
    if head.num_rows <= SHIPPED_QUERIES and _entries(head["vec"]) <= SHIPPED_VALUES:
        found = _scan(head, q, c, k, distance)
    else:
        found = stream_search(q, c, k, distance)
    return nearest(found, k)


def knn_join_mixed(queries: DataFrame, corpus: DataFrame, distance: str = "cosine") -> DataFrame:
    """As ``knn_join``, with the number of neighbours in a column ``top_k`` of the queries; null or below 1 gives none."""
    most = queries.agg(F.max("top_k").alias("k")).collect()[0]["k"]
    found = knn_join(queries, corpus, max(most or 1, 1), distance)
    best = Window.partitionBy("query_id").orderBy("distance", "publication_number")
    own = found.withColumn("_n", F.row_number().over(best)).join(queries.select("query_id", "top_k"), "query_id")
    return own.where(F.col("_n") <= F.col("top_k")).drop("_n", "top_k")


def with_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Key and vector only, as doubles; rows without a vector drop out."""
    return df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("vec"))


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k rows of smallest distance per query; Spark limits each task's rows before the shuffle."""
    query_key, key, _ = found.columns
    best = Window.partitionBy(query_key).orderBy("distance", key)
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def stream_search(queries: DataFrame, corpus: DataFrame, k: int, distance: str) -> DataFrame:
    """Candidates among all pairs of ``(key, vec)`` rows: at most k per query and piece of the corpus.

    A task gets a block of queries, then its piece of the corpus in the order of the keys, of which it holds one block
    at a time beside the k best so far. So each query is shuffled once for every piece, each corpus row once for every
    block of queries, and candidates do not grow with the number of corpus blocks.
    """
    query_key, key = queries.columns[0], corpus.columns[0]
    q_blocks, c_pieces = _split(queries, corpus, k)

    def numbered(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.withColumn("piece", numbered(c_pieces)).select(
        (_bucket(query_key, F.lit(q_blocks)) * c_pieces + F.col("piece")).alias("task"), F.lit(0).alias("side"),
        query_key, F.lit(None).cast(corpus.schema[key].dataType).alias(key), "vec",
    )
    right = corpus.withColumn("block", numbered(q_blocks)).select(
        (F.col("block") * c_pieces + _bucket(key, F.lit(c_pieces))).alias("task"), F.lit(1).alias("side"),
        F.lit(None).cast(queries.schema[query_key].dataType).alias(query_key), key, "vec",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q_keys, q_vecs, c_keys, seen = [], None, None, [], 0
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for part in _chunks(batches, CORPUS_BLOCK):
            n = pc.sum(pc.equal(part["side"], 0)).as_py()
            if n or not asked:
                asked.append(part.slice(0, n))
            if n == part.num_rows:
                continue
            if q_keys is None:  # the rows have come to the corpus: these are all queries
                q_keys, q_vecs = _rows(pa.concat_tables(asked), query_key)
            rows = part.slice(n)
            at, hit, dist = top_k_rows(q_vecs, _matrix(rows["vec"]), k, distance)
            best = _first_k(*map(np.concatenate, zip(best, (at, hit + seen, dist), strict=True)), k)
            c_keys.append(rows[key].combine_chunks())
            seen += rows.num_rows
        if len(best[0]):
            at, hit, dist = best
            winners = [q_keys.take(pa.array(at)), pa.concat_arrays(c_keys).take(pa.array(hit)), pa.array(dist)]
            yield from pa.table(winners, names=[query_key, key, "distance"]).to_batches(WINNERS_SENT)

    rows = left.unionByName(right).repartitionById(q_blocks * c_pieces, "task")
    # row order is tie order, and queries come first
    return rows.sortWithinPartitions("side", F.col(key).asc_nulls_last()).drop("task").mapInArrow(
        search, _result_schema(queries, query_key, corpus, key)
    )


def _split(queries: DataFrame, corpus: DataFrame, k: int) -> tuple[int, int]:
    """Blocks of queries and pieces of the corpus: within their bounds, work for all cores, and the least to shuffle."""
    n_queries, n_rows = queries.count(), corpus.count()
    width = corpus.select(F.size("vec")).head()
    width = width[0] if width else 0
    tasks = min(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(n_queries * n_rows / SMALL_TASK))
    blocks, pieces = max(1, math.ceil(n_queries / QUERY_BLOCK)), max(1, math.ceil(n_rows / STREAMED_ROWS))
    choices = [(b, max(pieces, math.ceil(tasks / b))) for b in range(blocks, max(blocks, tasks) + 1)]
    # a candidate, two ids and a distance, takes about as much as three entries of a vector
    return min(choices, key=lambda c: c[0] * n_rows * width + c[1] * n_queries * (width + 3 * k))


def block_search(queries: DataFrame, corpus: DataFrame, k: int, distance: str, *, cells: int) -> DataFrame:
    """Candidates within the lists that queries visit; lists are dealt to cells, which both inputs name.

    Queries are ``(key, vec, cell, lists)`` with the array of those lists of the cell that they visit, so that a vector
    travels once to all lists of a cell; corpus rows are ``(key, vec, cell, list_id)``.

    A cell of any size is cut into blocks on both sides, so a cell that holds most of the corpus, or
    that most queries visit, becomes many tasks. Every block answers with at most k rows per query.
    """
    query_key, key = queries.columns[0], corpus.columns[0]
    blocks = (
        queries.groupBy("cell")
        .agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks"))
        .join(
            corpus.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CORPUS_BLOCK).cast("int").alias("c_blocks")),
            "cell",
        )
    )
    if cells <= BROADCAST_CELLS:
        blocks = F.broadcast(blocks)
    left = (
        queries.join(blocks, "cell")
        .withColumn("qb", _bucket(query_key, F.col("q_blocks")))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
        .select("cell", "qb", "cb", query_key, "vec", "lists")
    )
    right = (
        corpus.join(blocks, "cell")
        .withColumn("cb", _bucket(key, F.col("c_blocks")))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select(F.col("cell").alias("c_cell"), F.col("qb").alias("c_qb"), F.col("cb").alias("c_cb"), key, "vec", "list_id")
    )

    def search(_: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        q_keys, q_vecs = _rows(q, query_key)
        lists = (q["lists"].combine_chunks(), c["list_id"].to_numpy())
        winners = _search_block(q_keys, q_vecs, c[key].combine_chunks(), _matrix(c["vec"]), k, distance, lists)
        return winners.rename_columns([query_key, key, "distance"])

    schema = _result_schema(queries, query_key, corpus, key)
    return (
        left.groupBy("cell", "qb", "cb").cogroup(right.groupBy("c_cell", "c_qb", "c_cb")).applyInArrow(search, schema)
    )


def _scan(head: pa.Table, queries: DataFrame, corpus: DataFrame, k: int, distance: str) -> DataFrame:
    """The queries, already on the driver and small, against every corpus partition in place."""
    query_key, key = queries.columns[0], corpus.columns[0]
    spark = corpus.sparkSession
    shipped = spark.sparkContext.broadcast(_rows(head, query_key)) if head.num_rows else None
    chunk = max(1024, min(SCAN_CHUNK, SCORES_IN_MEMORY // max(1, head.num_rows)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shipped is None:
            return
        q_keys, q_vecs = shipped.value
        best: pa.Table | None = None
        for part in _chunks(batches, chunk):
            found = _search_block(q_keys, q_vecs, part[key].combine_chunks(), _matrix(part["vec"]), k, distance)
            best = found if best is None else _keep_best(pa.concat_tables([best, found]), k)
        if best is not None:
            yield from best.rename_columns([query_key, key, "distance"]).to_batches()

    return corpus.mapInArrow(search, _result_schema(queries, query_key, corpus, key))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _keep_best(found: pa.Table, k: int) -> pa.Table:
    """The k best rows per query of a table that merges several chunks."""
    found = found.sort_by([("query", "ascending"), ("distance", "ascending"), ("key", "ascending")])
    query = found["query"].combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return found.filter(pa.array(place < k))


def _search_block(
    q_keys: pa.Array, q_vecs: np.ndarray, c_keys: pa.Array, c_vecs: np.ndarray, k: int, distance: str,
    lists: tuple[pa.Array, np.ndarray] | None = None,
) -> pa.Table:
    """Winners of one block as ``(query, key, distance)``; keys are sorted first so that row order is tie order.

    ``lists``: those that each query visits and that of each corpus row, if only these pairs are asked for.
    """
    order = pc.sort_indices(c_keys)
    c_vecs = c_vecs[order.to_numpy()]
    if lists is None:
        at, hit, dist = top_k_rows(q_vecs, c_vecs, k, distance)
    else:
        at, hit, dist = _top_k_in_lists(q_vecs, lists[0], c_vecs, lists[1][order.to_numpy()], k, distance)
    return pa.table(
        {
            "query": q_keys.take(pa.array(at)),
            "key": c_keys.take(order.take(pa.array(hit))),
            "distance": pa.array(dist),
        }
    )


def _top_k_in_lists(
    q: np.ndarray, visits: pa.Array, c: np.ndarray, own: np.ndarray, k: int, distance: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``top_k_rows``, each row of q against the rows of c in the lists it visits, one list after the other."""
    visitor = np.repeat(np.arange(len(q)), pc.list_value_length(visits).to_numpy(zero_copy_only=False))
    visited = visits.flatten().to_numpy()
    order = np.argsort(visited, kind="stable")
    visitor, visited = visitor[order], visited[order]
    rows = np.argsort(own, kind="stable")
    ids, first = np.unique(own[rows], return_index=True)
    ends = np.append(first[1:], len(rows))
    low, high = np.searchsorted(visited, ids), np.searchsorted(visited, ids, side="right")
    parts, held = [], 0
    for i in np.flatnonzero(high > low):
        asking, there = visitor[low[i] : high[i]], rows[first[i] : ends[i]]
        at, hit, dist = top_k_rows(q[asking], c[there], k, distance)
        parts.append((asking[at], there[hit], dist))
        held += len(at)
        if held > WINNERS_HELD:
            parts = [_first_k(*map(np.concatenate, zip(*parts, strict=True)), k)]
            held = 0  # counts what has come since
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return _first_k(*map(np.concatenate, zip(*parts, strict=True)), k)


def _first_k(at: np.ndarray, hit: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of rows the k of smallest distance for each first row, ties by the second."""
    order = np.lexsort((hit, dist, at))
    at = at[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    kept = place < k
    return at[kept], hit[order][kept], dist[order][kept]


def top_k_rows(q: np.ndarray, c: np.ndarray, k: int, distance: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q the k nearest rows of c: (row of q, row of c, distance).

    The matrix product only preselects. Whatever could be among the k best, given its rounding error,
    is measured again row by row, which makes equal vectors equally far wherever they stand.
    """
    q_rows, c_rows = np.arange(len(q)), np.arange(len(c))
    if distance == "cosine":
        q, q_rows = _unit(q)
        c, c_rows = _unit(c)
    elif distance not in METRICS:
        raise ValueError(f"unknown distance {distance!r}")
    at, hit, dist = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if len(q) and len(c):
        q_sizes, c_sizes = _norms(q), _norms(c)
        slack = 1e-9 * np.maximum(1.0, (q_sizes + c_sizes.max()) ** 2)
        step = max(1, SCORES_IN_MEMORY // len(c))
        for low in range(0, len(q), step):
            rough = q[low : low + step] @ c.T
            np.negative(rough, out=rough)
            if distance == "euclidean":
                rough *= 2
                rough += c_sizes**2
            if len(c) > k:
                bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack[low : low + step]
                who, near = np.nonzero(rough <= bound[:, None])
            else:
                who, near = np.divmod(np.arange(rough.size), len(c))
            del rough
            some = max(1, PAIRS_MEASURED // max(1, q.shape[1]))
            exact = [_measure(q[low + who[i : i + some]], c[near[i : i + some]], distance) for i in range(0, len(who), some)]
            who, near, exact = _first_k(who, near, np.concatenate(exact), k)
            at.append(q_rows[low + who])
            hit.append(c_rows[near])
            dist.append(exact)
    return np.concatenate(at), np.concatenate(hit), np.concatenate(dist)


def _measure(q: np.ndarray, c: np.ndarray, distance: str) -> np.ndarray:
    if distance == "euclidean":
        value = np.sqrt(((c - q) ** 2).sum(axis=1))
    else:
        value = -(c * q).sum(axis=1)
        if distance == "cosine":
            value = np.maximum(1.0 + value, 0.0)
    return np.round(value, 12) + 0.0


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and their row numbers; a zero vector has no direction and drops out."""
    sizes = _norms(vectors)
    rows = np.flatnonzero(sizes > 0)
    return vectors[rows] / sizes[rows, None], rows


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _rows(table: pa.Table, key: str) -> tuple[pa.Array, np.ndarray]:
    return table[key].combine_chunks(), _matrix(table["vec"])


def _entries(vectors: pa.ChunkedArray) -> int:
    return pc.sum(pc.list_value_length(vectors)).as_py() or 0


def _bucket(key: str, count: Column) -> Column:
    return F.pmod(F.xxhash64(key), count).cast("int")


def _result_schema(queries: DataFrame, query_key: str, corpus: DataFrame, key: str) -> T.StructType:
    return T.StructType(
        [queries.schema[query_key], corpus.schema[key], T.StructField("distance", T.DoubleType())]
    )
