"""IVF search: the corpus is divided into lists around centroids, a query visits the nearest lists.

The index is two tables. ``lists`` holds every vector with its list and its gap to the centroid; ``centroids``
holds one row per list with the widest gap in it. A search is an equi-join on ``list_id``. Only the centroids travel
with the tasks, behind a check of their size.

Gaps obey the triangle inequality, which bounds what a list can hold: angles for cosine distance, Euclidean
distances for the Euclidean one. For dot products vectors get one more entry that makes them all equally long, so
that the largest product is the smallest Euclidean distance.

Centroids have two levels: rows find the nearest of few coarse cells, then the nearest centroid within it, so
neither fitting nor assignment measures every row against every centroid.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearcite.operators.knn import BROADCAST_CELLS, CORPUS_BLOCK, METRICS, block_search, nearest, with_vector
from nearcite.session import materialize

CENTROID_VALUES = 1 << 25  # 256 MB of float64: the most that is sent to tasks
GAPS_IN_MEMORY = 1 << 22  # 32 MB of float64 in a task
ROWS_PER_FILE = 2_000_000
SUM_GROUPS = 64  # groups in which the sums of all tasks are added up
SEEDS_SEEN = 16  # rows a list, about, that its first centroid is drawn from
OVERFULL = 4  # times the usual size, at which a list is split
SMALL_BLOCK = 4096  # rows of lists that are searched in one task even if that leaves cores idle

FACTS = "distance string, length double, longest double, coarse array<array<double>>"

_GAP_MARGIN = 1e-6  # covers rounding of gaps and of the 12-decimal distance, as a share of the longest vector


@dataclass
class IvfIndex:
    lists: DataFrame  # publication_number, vec, list_id, gap
    centroids: DataFrame  # list_id, center, radius
    centers: np.ndarray  # the centroids, row number = list_id
    distance: str = "cosine"
    coarse: np.ndarray | None = None  # centers of the coarse cells; None: one cell
    cell: np.ndarray | None = None  # coarse cell of each list
    length: float = 0.0  # to which vectors are filled up, for dot products
    longest: float = 0.0  # the longest vector in the index, for dot products
    path: str | None = None  # where it is stored
    version: int = 0
    versions: dict[int, int] = field(default_factory=dict)  # of stored lists, where not 0

    @property
    def cells(self) -> np.ndarray:
        return np.zeros(len(self.centers), np.int64) if self.cell is None else self.cell

    @cached_property
    def blocks(self) -> np.ndarray:
        """Block of each list: lists of a coarse cell and of neighbouring ones share blocks of a bounded number of rows.

        What reaches the driver is a number for each centroid. A list beyond the bound has a block to itself.
        """
        sizes = np.zeros(len(self.centers), np.int64)
        for row in self.lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[row["list_id"]] = row["n"]
        most = min(CORPUS_BLOCK, max(SMALL_BLOCK, int(sizes.sum()) // self.lists.sparkSession.sparkContext.defaultParallelism))
        blocks, block, held = np.zeros(len(sizes), np.int64), 0, 0
        for i in np.argsort(self.cells, kind="stable"):
            if held and held + sizes[i] > most:
                block, held = block + 1, 0
            blocks[i], held = block, held + sizes[i]
        return blocks


def list_count_range(rows: int) -> tuple[int, int]:
    """Usual bounds for the number of lists: sqrt(N) to 4 * sqrt(N)."""
    root = max(1.0, math.sqrt(rows))
    return round(root), round(4 * root)


# --- the space in which gaps are measured ----------------------------------------------------------------


def _placed(matrix: np.ndarray, distance: str, length: float, *, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as the space has them, and the numbers of the rows that have a place: zero vectors have no angle."""
    sizes = np.sqrt((matrix * matrix).sum(axis=1))
    if distance == "cosine":
        rows = np.flatnonzero(sizes > 0)
        return matrix[rows] / sizes[rows, None], rows
    rows = np.arange(len(matrix))
    if distance == "dot_product":
        fill = np.zeros(len(matrix)) if query else np.sqrt(np.maximum(length**2 - sizes**2, 0.0))
        matrix = np.column_stack([matrix, fill])
    return matrix, rows


def _gaps(points: np.ndarray, centers: np.ndarray, distance: str) -> np.ndarray:
    if distance == "cosine":
        return np.arccos(np.clip(points @ centers.T, -1.0, 1.0))
    square = (points**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None, :] - 2 * (points @ centers.T)
    return np.sqrt(np.maximum(square, 0.0))


def _reach(distance: np.ndarray, points: np.ndarray, kind: str, longest: float) -> np.ndarray:
    """The gap at which a row of this distance from a query may lie; infinite distances reach everything."""
    if kind == "cosine":
        return np.where(np.isinf(distance), np.inf, np.arccos(np.clip(1.0 - distance, -1.0, 1.0)))
    if kind == "euclidean":
        return distance
    return np.sqrt(np.maximum((points**2).sum(axis=1) + longest**2 + 2 * distance, 0.0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


def _nearest_center(points: np.ndarray, centers: np.ndarray, distance: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest center, the first of equals, and the gap to it; few rows at a time."""
    at, gap = np.empty(len(points), np.int64), np.empty(len(points))
    step = max(1, GAPS_IN_MEMORY // max(1, len(centers)))
    for low in range(0, len(points), step):
        gaps = _gaps(points[low : low + step], centers, distance)
        at[low : low + step] = gaps.argmin(axis=1)
        gap[low : low + step] = gaps[np.arange(len(gaps)), at[low : low + step]]
    return at, gap


def _in_lists(points: np.ndarray, centers: np.ndarray, cells: np.ndarray, coarse: np.ndarray | None, distance: str, own: np.ndarray | None = None):
    """(list, gap) of points: the nearest centroid of their coarse cell, which is the nearest one or given."""
    if own is None:
        own = np.zeros(len(points), np.int64) if coarse is None else _nearest_center(points, coarse, distance)[0]
    at, gap = np.zeros(len(points), np.int64), np.zeros(len(points))
    for cell in np.unique(own):
        rows, lists = np.flatnonzero(own == cell), np.flatnonzero(cells == cell)
        place, gap[rows] = _nearest_center(points[rows], centers[lists], distance)
        at[rows] = lists[place]
    return at, gap


# --- fitting ---------------------------------------------------------------------------------------------


def fit_ivf(
    corpus: DataFrame, num_lists: int | None = None, seed: int = 42, max_iter: int = 8, distance: str = "cosine",
    *, key: str = "publication_number", vector: str = "embedding_v1",
) -> IvfIndex:
    """Cluster all vectors, coarse cells first and lists within them, and assign each row to a list.

    Every step reads all rows; a row is measured against the coarse centers and those of its own cell. Cells get
    lists by their size. What reaches the driver are centers, whose number is checked.
    """
    if distance not in METRICS:
        raise ValueError(f"unknown distance {distance!r}")
    vectors = with_vector(corpus, key, vector)
    if distance == "cosine":
        vectors = vectors.where(F.exists("vec", lambda x: x != 0))
    vectors = materialize(vectors.select(F.col(key).alias("publication_number"), "vec"))
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.max(_length()).alias("longest")).collect()[0]
    num_lists = max(1, min(num_lists or list_count_range(facts["n"])[0], facts["n"]))
    length = float(facts["longest"] or 0.0) if distance == "dot_product" else 0.0
    _check_size(num_lists * ((facts["d"] or 1) + 1))
    if not facts["n"]:
        return _indexed(vectors, IvfIndex(vectors, vectors, np.empty((0, 0)), distance))
    points = vectors.mapInArrow(_placer(distance, length), "vec array<double>")
    coarse = _coarse(points, max(1, round(math.sqrt(num_lists))), seed, distance)
    celled = materialize(_celled(points, coarse, distance))
    sizes = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    centers, cell = _fine(celled, _shares(sizes, num_lists), seed, max_iter, distance)
    return _indexed(vectors, IvfIndex(vectors, vectors, centers, distance, coarse, cell, length, length))


def _length() -> Column:
    return F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))


def _placer(distance: str, length: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points, _ = _placed(_matrix(batch["vec"]), distance, length)
                yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], ["vec"])

    return place


def _coarse(points: DataFrame, k: int, seed: int, distance: str) -> np.ndarray | None:
    if k < 2:
        return None
    measure = "cosine" if distance == "cosine" else "euclidean"
    model = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure=measure).fit(points.select(array_to_vector("vec").alias("features")))
    return _centered(np.array(model.clusterCenters(), dtype=float), distance)


def _centered(centers: np.ndarray, distance: str) -> np.ndarray:
    if distance != "cosine":
        return centers
    return centers / np.maximum(np.sqrt((centers**2).sum(axis=1)), 1e-300)[:, None]


def _celled(points: DataFrame, coarse: np.ndarray | None, distance: str) -> DataFrame:
    if coarse is None:
        return points.withColumn("cell", F.lit(0))
    shipped = points.sparkSession.sparkContext.broadcast(coarse)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = _nearest_center(_matrix(batch["vec"]), shipped.value, distance) if batch.num_rows else (np.empty(0, np.int64), None)
            yield pa.RecordBatch.from_arrays([batch["vec"], pa.array(at.astype(np.int32))], ["vec", "cell"])

    return points.mapInArrow(cell, "vec array<double>, cell int")


def _shares(sizes: dict[int, int], num_lists: int) -> dict[int, int]:
    """Lists of each cell by its size: one at least, no more than it has rows."""
    total = sum(sizes.values())
    shares = {cell: min(n, max(1, num_lists * n // total)) for cell, n in sizes.items()}
    over = sum(shares.values()) - num_lists
    for cell in sorted(sizes, key=lambda c: (-sizes[c], c)) * 2:  # what rounding leaves goes to the largest
        if over < 0 and shares[cell] < sizes[cell]:
            shares[cell], over = shares[cell] + 1, over + 1
        elif over > 0 and shares[cell] > 1:
            shares[cell], over = shares[cell] - 1, over - 1
    return shares


def _fine(celled: DataFrame, shares: dict[int, int], seed: int, max_iter: int, distance: str) -> tuple[np.ndarray, np.ndarray]:
    """(centers, their cells): k-means within every cell at once, sums of each task added up by list."""
    wanted = sum(shares.values())
    share = F.get(F.lit([shares.get(c, 0) for c in range(max(shares) + 1)]), F.col("cell"))
    # first centers: different vectors by the order of their hashes, from so many rows a list that all get some
    drawn = F.xxhash64(F.lit(seed), "vec")
    low = celled.withColumn("draw", drawn).where(
        F.pmod("draw", F.lit(1 << 30)) < F.lit(min(1.0, SEEDS_SEEN * wanted / max(celled.count(), 1)) * (1 << 30))
    )
    different = low.groupBy("cell", "draw").agg(F.any_value("vec").alias("vec"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("draw"))
    rows = different.withColumn("place", place).where(F.col("place") <= share).select("cell", "draw", "vec").collect()
    rows.sort(key=lambda r: (r["cell"], r["draw"]))
    missing = sorted(set(shares) - {r["cell"] for r in rows})
    if missing:  # cells too small for the draw
        rest = celled.where(F.col("cell").isin(missing)).groupBy("cell").agg(F.any_value("vec").alias("vec")).collect()
        rows = sorted([*((r["cell"], r["vec"]) for r in rows), *((r["cell"], r["vec"]) for r in rest)], key=lambda r: r[0])
    else:
        rows = [(r["cell"], r["vec"]) for r in rows]
    cell = np.array([c for c, _ in rows], np.int64)
    centers = _centered(np.array([v for _, v in rows], dtype=float), distance)
    for _ in range(max_iter):
        centers, moved = _step(celled, centers, cell, distance)
        if moved < 1e-4:
            break
    return centers, cell


def _step(celled: DataFrame, centers: np.ndarray, cell: np.ndarray, distance: str) -> tuple[np.ndarray, float]:
    """Every center moved to the mean of its rows, and how far they moved on average."""
    shipped = celled.sparkSession.sparkContext.broadcast((centers, cell))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, cells = shipped.value
        sums, counts = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch["vec"])
            at, _ = _in_lists(points, middle, cells, None, distance, batch["cell"].to_numpy())
            order = np.argsort(at, kind="stable")
            which, first = np.unique(at[order], return_index=True)
            added = np.add.reduceat(points[order], first, axis=0)
            for i, total, n in zip(which.tolist(), added, np.diff(np.append(first, len(at))).tolist(), strict=True):
                sums[i] = sums.get(i, 0.0) + total
                counts[i] = counts.get(i, 0) + n
        ids = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int32()), pa.array([counts[i] for i in ids], pa.int64()), pa.array([sums[i] for i in ids], pa.list_(pa.float64()))],
            ["list_id", "n", "total"],
        )

    def merge(table: pa.Table) -> pa.Table:
        ids, place = np.unique(table["list_id"].to_numpy(), return_inverse=True)
        total = np.zeros((len(ids), centers.shape[1]))
        np.add.at(total, place, _matrix(table["total"].combine_chunks()))
        n = np.bincount(place, table["n"].to_numpy(), len(ids)).astype(np.int64)
        return pa.table({"list_id": pa.array(ids, pa.int32()), "n": pa.array(n), "total": pa.array(list(total), pa.list_(pa.float64()))})

    schema = "list_id int, n bigint, total array<double>"
    parts = celled.mapInArrow(add, schema).withColumn("part", F.pmod("list_id", F.lit(SUM_GROUPS)))
    found = parts.groupBy("part").applyInArrow(lambda t: merge(t.drop_columns(["part"])), schema).toArrow()
    out = centers.copy()
    if found.num_rows:
        ids = found["list_id"].to_numpy()
        out[ids] = _centered(_matrix(found["total"].combine_chunks()) / found["n"].to_numpy()[:, None], distance)
    return out, float(np.sqrt(((out - centers) ** 2).sum(axis=1)).mean())


def index_from_centers(corpus: DataFrame, centers: np.ndarray) -> IvfIndex:
    """A cosine index over given centroids, list numbers in their order, without any clustering."""
    centers = _centered(np.asarray(centers, dtype=float), "cosine")
    vectors = with_vector(corpus, "publication_number", "embedding_v1")
    return _indexed(vectors, IvfIndex(vectors, vectors, centers))


def _indexed(vectors: DataFrame, index: IvfIndex) -> IvfIndex:
    lists = materialize(_assign(vectors, index))
    return replace(index, lists=lists, centroids=materialize(_centroid_table(lists, index)))


def assign_lists(corpus: DataFrame, index: IvfIndex) -> DataFrame:
    """Lists for new or changed rows, without a rebuild: ``(publication_number, vec, list_id, gap)``.

    A row without a vector, or for cosine distance without a direction, has no list and does not appear.
    """
    return _assign(with_vector(corpus, "publication_number", "embedding_v1"), index)


def add_rows(index: IvfIndex, rows: DataFrame) -> IvfIndex:
    """The index, in tables of its own, with the given corpus rows inserted or replaced."""
    kept = index.lists.join(rows.select("publication_number"), "publication_number", "left_anti")
    lists = materialize(kept.unionByName(assign_lists(rows, index)))
    index = replace(index, lists=lists, longest=_longest(index, rows), path=None)
    return replace(index, centroids=materialize(_centroid_table(lists, index)))


def _longest(index: IvfIndex, rows: DataFrame) -> float:
    if index.distance != "dot_product":
        return index.longest
    return max(index.longest, with_vector(rows, "publication_number", "embedding_v1").agg(F.max(_length())).collect()[0][0] or 0.0)


def ivf_coverage(corpus: DataFrame, index: IvfIndex) -> DataFrame:
    """Share of corpus rows that have a list: ``(rows, indexed, coverage_pct)``."""
    listed = index.lists.select("publication_number", F.lit(1).alias("listed"))
    return (
        corpus.select("publication_number")
        .join(listed, "publication_number", "left")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("listed").alias("indexed"))
        .withColumn("coverage_pct", F.try_divide(F.col("indexed") * 100.0, F.col("rows")))
    )


# --- searching -------------------------------------------------------------------------------------------


def ivf_topk(
    queries: DataFrame,
    index: IvfIndex,
    k: int = 20,
    nprobe: int | None = None,
    exact: bool = False,
    *,
    query_vector: str = "embedding_v1",
) -> DataFrame:
    """``(query_id, publication_number, distance)`` by the distance of the index, searching ``nprobe`` lists per query.

    With ``exact`` a second pass visits every further list that could hold a nearer vector: one whose
    centroid is within the gap of the k-th distance found so far plus the list's widest gap. The
    result then equals a full search.
    """
    n_lists = len(index.centers)
    nprobe = min(n_lists, nprobe or max(1, round(math.sqrt(n_lists))))
    q = with_vector(queries, "query_id", query_vector)
    found = _search_lists(materialize(_visit(q, index, nprobe=nprobe)), index, k)
    if not exact or nprobe == n_lists:
        return found
    found = materialize(found)
    everything = F.lit(float("inf"))
    reach = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(everything).alias("reach"))
    bounded = q.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", everything))
    more = _search_lists(materialize(_visit(bounded, index, nprobe=nprobe, beyond=True)), index, k)
    return nearest(found.unionByName(more), k)


def _search_lists(visits: DataFrame, index: IvfIndex, k: int) -> DataFrame:
    """The k nearest within the visited lists.

    The numbers of those lists, at most as many as there are centroids, become a filter on the partition
    column of a stored index: lists that no query visits are not read.
    """
    visited = [row["list_id"] for row in visits.select(F.explode("lists").alias("list_id")).distinct().collect()]
    lists = index.lists
    if len(visited) < len(index.centers):
        lists = lists.where(F.col("list_id").isin(visited))
    numbers = {"list_id": pa.array(range(len(index.centers)), pa.int32()), "cell": pa.array(index.blocks.astype(np.int32))}
    blocks = lists.sparkSession.createDataFrame(pa.table(numbers))
    blocks = F.broadcast(blocks) if len(index.centers) <= BROADCAST_CELLS else blocks
    cells = lists.join(blocks, "list_id").select("publication_number", "vec", "cell", "list_id")
    return nearest(block_search(visits, cells, k, index.distance, cells=int(index.blocks.max(initial=0)) + 1), k)


# --- stored indexes --------------------------------------------------------------------------------------


def write_index(index: IvfIndex, path: str) -> None:
    """Store the index, one folder per list; a large list becomes several files written by several tasks."""
    _write_lists(index.lists, path, 0)
    _write_centroids(replace(index, path=path, version=0, versions={}), index.centroids)


def read_index(spark: SparkSession, path: str, version: int | None = None) -> IvfIndex:
    """The newest version of a stored index, or a given one."""
    version = _index_versions(spark, path)[-1] if version is None else version
    centroids = spark.read.parquet(f"{path}/centroids/version={version:08d}")
    rows = centroids.orderBy("list_id").toArrow().to_pylist()
    facts = spark.read.schema(FACTS).json(f"{path}/facts/version={version:08d}").collect()[0]
    width = len(rows[0]["center"]) if rows else 0
    coarse = np.array([list(c) for c in facts["coarse"] or []], dtype=float) if facts["coarse"] else None
    versions = {r["list_id"]: r["written"] for r in rows}
    lists = spark.read.schema("publication_number string, vec array<double>, gap double, list_id int, written int").parquet(f"{path}/lists")
    # both are partition columns: folders of other versions are not opened
    live = F.concat_ws("-", "list_id", "written").isin([f"{i}-{v}" for i, v in versions.items()])
    return IvfIndex(
        lists.where(live).drop("written"), centroids.select("list_id", "center", "radius"),
        np.array([r["center"] for r in rows], dtype=float).reshape(-1, width), facts["distance"], coarse,
        np.array([r["cell"] for r in rows], np.int64), facts["length"], facts["longest"], path, version, versions,
    )


def update_index(index: IvfIndex, rows: DataFrame) -> IvfIndex:
    """The next version of a stored index, with the given corpus rows inserted or replaced.

    Only lists that gain or lose a row are read and written, into folders of the new version; all others keep their
    files. Lists that have grown to several times the usual size are split around new centroids. The widest gap of
    a rewritten list comes from its rows. The table of centroids names the folders and is written last, so readers
    see the old version or the new one.
    """
    spark, path, version = rows.sparkSession, index.path, index.version + 1
    index = replace(index, longest=_longest(index, rows))
    fresh = materialize(assign_lists(rows, index))
    places = index.lists.select("publication_number", "list_id").join(rows.select("publication_number"), "publication_number", "left_semi")
    touched = {r[0] for r in places.select("list_id").union(fresh.select("list_id")).distinct().collect()}
    kept = index.lists.where(F.col("list_id").isin(list(touched))).join(rows.select("publication_number"), "publication_number", "left_anti")
    changed = materialize(kept.unionByName(fresh))
    sizes = {r["list_id"]: r["n"] for r in changed.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    usual = max(1, index.lists.count() // max(1, len(index.centers)))
    full = {i: math.ceil(n / usual) for i, n in sizes.items() if n > OVERFULL * usual}
    if full:
        index, changed = _split(index, changed, full)
        touched |= set(range(len(index.versions), len(index.centers)))  # the lists that came with the split
    _write_lists(changed, path, version)
    versions = {i: version if i in touched else index.versions.get(i, 0) for i in range(len(index.centers))}
    radii = changed.groupBy("list_id").agg(F.max("gap").alias("radius"))
    old = index.centroids.where(~F.col("list_id").isin(list(touched))).select("list_id", "radius")
    table = _centers_table(spark, index).join(old.unionByName(radii), "list_id", "left")
    _write_centroids(replace(index, version=version, versions=versions), table)
    return read_index(spark, path, version)


def _split(index: IvfIndex, changed: DataFrame, full: dict[int, int]) -> tuple[IvfIndex, DataFrame]:
    """New centroids for overfull lists, in their cells, and all changed rows in the lists they now belong to.

    Each overfull list is a cell of its own while its centers are fitted. Its first center takes its number.
    """
    crowded = changed.where(F.col("list_id").isin(list(full)))
    points = crowded.select("vec", F.col("list_id").alias("cell"))
    shipped = (index.distance, index.length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix, rows = _placed(_matrix(batch["vec"]), *shipped)
                yield pa.RecordBatch.from_arrays([pa.array(list(matrix), pa.list_(pa.float64())), batch["cell"].take(pa.array(rows))], ["vec", "cell"])

    celled = materialize(points.mapInArrow(place, "vec array<double>, cell int"))
    centers, owner = _fine(celled, full, 7, 8, index.distance)
    centers_all, cells_all = [*index.centers], index.cells.tolist()
    for i, center in enumerate(centers):
        if i == 0 or owner[i] != owner[i - 1]:
            centers_all[owner[i]] = center
        else:
            centers_all.append(center)
            cells_all.append(cells_all[owner[i]])
    grown = replace(index, centers=np.array(centers_all), cell=np.array(cells_all, np.int64))
    # rows of split lists go to the nearest center of their own list, so that no other list changes
    numbers = np.array([owner[i] if i == 0 or owner[i] != owner[i - 1] else -1 for i in range(len(owner))])
    numbers[numbers < 0] = len(index.centers) + np.arange((numbers < 0).sum())
    again = _assign(crowded.select("publication_number", "vec", "list_id"), grown, within=(centers, owner, numbers))
    rest = changed.where(~F.col("list_id").isin(list(full)))
    return grown, materialize(rest.unionByName(again.select(*rest.columns)))


def _write_lists(lists: DataFrame, path: str, version: int) -> None:
    sizes = lists.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).cast("int").alias("files"))
    spread = lists.join(sizes, "list_id").withColumn("file", F.pmod(F.xxhash64("publication_number"), F.col("files")))
    spread = spread.repartition("list_id", "file").select("publication_number", "vec", "gap", "list_id", F.lit(version).alias("written"))
    spread.write.partitionBy("list_id", "written").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/lists")


def _write_centroids(index: IvfIndex, centroids: DataFrame) -> None:
    spark, name = centroids.sparkSession, f"version={index.version:08d}"
    written = spark.createDataFrame(
        [(i, int(c), index.versions.get(i, 0)) for i, c in enumerate(index.cells)], "list_id int, cell int, written int"
    )
    table = centroids.select("list_id", "center", "radius").join(written, "list_id")
    facts = [(index.distance, index.length, index.longest, None if index.coarse is None else index.coarse.tolist())]
    spark.createDataFrame(facts, FACTS).coalesce(1).write.mode("overwrite").json(f"{index.path}/facts/{name}")
    table.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/centroids/{name}")


def _index_versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "centroids/version=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _centers_table(spark: SparkSession, index: IvfIndex) -> DataFrame:
    table = pa.table(
        {"list_id": pa.array(range(len(index.centers)), pa.int32()), "center": pa.array(list(index.centers), pa.list_(pa.float64()))}
    )
    return spark.createDataFrame(table)


def _centroid_table(lists: DataFrame, index: IvfIndex) -> DataFrame:
    widest = lists.groupBy("list_id").agg(F.max("gap").alias("radius"))
    return _centers_table(lists.sparkSession, index).join(widest, "list_id", "left")


def _check_size(values: int) -> None:
    if values > CENTROID_VALUES:
        raise ValueError(f"centroids of {values} values are too many to send to every task; use fewer lists")


def _assign(vectors: DataFrame, index: IvfIndex, within: tuple | None = None) -> DataFrame:
    """``(publication_number, vec, list_id, gap)``; ``within``: centers, the lists they split, and their numbers."""
    _check_size(index.centers.size)
    shape = (index.centers, index.cells, index.coarse, index.distance, index.length, within)
    shipped = vectors.sparkSession.sparkContext.broadcast(shape)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, cells, coarse, distance, length, split = shipped.value
        for batch in batches:
            if not batch.num_rows or not len(centers):
                continue
            points, rows = _placed(_matrix(batch["vec"]), distance, length)
            kept = batch.take(pa.array(rows))
            if split is None:
                at, gap = _in_lists(points, centers, cells, coarse, distance)
            else:
                at, gap = _in_lists(points, split[0], split[1], None, distance, kept["list_id"].to_numpy())
                at = split[2][at]
            yield pa.RecordBatch.from_arrays(
                [kept["publication_number"], kept["vec"], pa.array(at.astype(np.int32)), pa.array(gap)],
                names=["publication_number", "vec", "list_id", "gap"],
            )

    schema = T.StructType(
        [
            vectors.schema["publication_number"], vectors.schema["vec"],
            T.StructField("list_id", T.IntegerType()), T.StructField("gap", T.DoubleType()),
        ]
    )
    return vectors.mapInArrow(assign, schema)


def _visit(queries: DataFrame, index: IvfIndex, *, nprobe: int, beyond: bool = False) -> DataFrame:
    """Lists to visit, a row for each block that has some: ``(query_id, vec, cell, lists)``.

    The ``nprobe`` nearest, or with ``beyond`` every other list within the reach of the query.
    """
    _check_size(index.centers.size)
    radii = np.full(len(index.centers), -np.inf)  # an empty list is never in reach
    if beyond:
        for row in index.centroids.where(F.col("radius").isNotNull()).select("list_id", "radius").collect():
            radii[row["list_id"]] = row["radius"]
    shape = (index.centers, radii, index.distance, index.longest, index.blocks)
    shipped = queries.sparkSession.sparkContext.broadcast(shape)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, widest, distance, longest, block = shipped.value
        by_block = np.argsort(block, kind="stable")
        # neither gaps nor the vectors that go out at once grow with the number of lists or blocks
        width = max(len(middle), (int(block.max(initial=0)) + 1) * (middle.shape[1] if middle.ndim == 2 else 1))
        step = max(1, GAPS_IN_MEMORY // max(1, width))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                points, rows = _placed(_matrix(batch["vec"]), distance, 0.0, query=True)
                gaps = _gaps(points, middle, distance)
                order = np.argsort(gaps, axis=1, kind="stable")
                wanted = np.zeros(gaps.shape, dtype=bool)
                np.put_along_axis(wanted, order[:, :nprobe], True, axis=1)
                if beyond:
                    reach = batch["reach"].to_numpy(zero_copy_only=False)[rows]
                    scale = 1.0 if distance == "cosine" else 1.0 + np.sqrt((points**2).sum(axis=1)) + np.sqrt((middle**2).sum(axis=1)).max()
                    furthest = _reach(reach, points, distance, longest) + _GAP_MARGIN * scale
                    wanted = ~wanted & (gaps - widest[None, :] <= furthest[:, None])
                at, place = np.nonzero(wanted[:, by_block])
                lists = by_block[place]
                cell = block[lists]
                first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
                visited = batch.take(pa.array(rows[at[first]]))
                ends = np.append(first, len(lists)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [visited["query_id"], visited["vec"], pa.array(cell[first].astype(np.int32)), listed], names=["query_id", "vec", "cell", "lists"]
                )

    schema = T.StructType(
        [
            queries.schema["query_id"], queries.schema["vec"],
            T.StructField("cell", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType())),
        ]
    )
    return queries.mapInArrow(visit, schema)


def recall(found: DataFrame, expected: DataFrame) -> Column:
    """Share of the expected pairs that were found, as a scalar column."""
    keys = ["query_id", "publication_number"]
    hits = found.select(*keys, F.lit(1).alias("hit"))
    return expected.select(keys).join(hits, keys, "left").agg(F.count("hit") / F.count(F.lit(1))).scalar()
