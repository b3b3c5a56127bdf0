"""A corpus stored by key range: lookups read the ranges they ask for, updates rewrite the ranges they touch.

Borders cut the keys into ranges. A folder holds a partition of rows for every range and version of it, sorted by
key, and for every version of the corpus a range map: one row per range with its border, least and greatest key,
number of rows and the partition that has them. A merge writes new partitions for the ranges in which its source
has keys and a new map that names the old partitions of all others; the map is written last, so readers never see
half a merge, and a merge that is run again writes the same partitions again. Ranges that have grown too large are
cut in the same step. ``vacuum`` deletes partitions that no kept map names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearcite.operators.links import Membership
from nearcite.operators.merge import one_row_per_key
from nearcite.schema import LINK_COLUMNS
from nearcite.session import broadcast_small, materialize

KEY = "publication_number"
ROWS_PER_RANGE = 1_000_000
#: The map is read by the driver, and its borders travel with the tasks.
MOST_RANGES = 1 << 16
PIECE = "piece"


@dataclass
class StoredCorpus:
    """One version of a stored corpus. ``map`` is its range map: range, border, least, greatest, n_rows, piece."""

    spark: SparkSession
    path: str
    version: int

    @cached_property
    def map(self) -> list:
        """Rows of the range map in the order of their borders; at most MOST_RANGES."""
        rows = self.spark.read.parquet(_map_path(self.path, self.version)).collect()
        return sorted(rows, key=lambda row: row["border"])

    @cached_property
    def _rows(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.map[0]["schema"])).add(PIECE, T.StringType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    @property
    def rows_per_range(self) -> int:
        return self.map[0]["rows_per_range"]

    def read(self, ranges: set[int] | None = None) -> DataFrame:
        """The rows of all ranges, or of some: partitions that the map does not name are not opened."""
        pieces = [row["piece"] for row in self.map if ranges is None or row["range"] in ranges]
        return self._rows.where(F.col(PIECE).isin(pieces)).drop(PIECE)

    def range_of(self, key: Column) -> Column:
        """The range in which a key belongs."""
        return F.get(_literal([row["range"] for row in self.map], "array<int>"), position(key, [row["border"] for row in self.map]))

    def lookup(self, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Rows of the ids in the column ``publication_number``, once each; ids that the corpus lacks drop out.

        Only ranges in which an id falls are read, and in them only row groups between the least and the greatest
        id. The number of ranges is what reaches the driver.
        """
        wanted = materialize(ids.select(KEY).where(F.col(KEY).isNotNull()).distinct())
        ends = wanted.agg(F.min(KEY).alias("least"), F.max(KEY).alias("greatest")).collect()[0]
        rows = self.read(self.touched(wanted))
        if ends["least"] is not None:
            rows = rows.where(F.col(KEY).between(ends["least"], ends["greatest"]))
        return rows.select(columns or rows.columns).join(broadcast_small(wanted), KEY, "left_semi")

    def touched(self, keys: DataFrame) -> set[int]:
        """Ranges in which keys fall that could be theirs: those between the least and the greatest key of the range."""
        reach = {row["range"]: (row["least"], row["greatest"]) for row in self.map if row["n_rows"]}
        met = keys.groupBy(self.range_of(F.col(KEY)).alias("range")).agg(F.min(KEY).alias("least"), F.max(KEY).alias("greatest"))
        return {
            row["range"]
            for row in met.collect()
            if row["range"] in reach and row["least"] <= reach[row["range"]][1] and row["greatest"] >= reach[row["range"]][0]
        }

    def best_of_prefix(self, prefixes: DataFrame) -> DataFrame:
        """``(prefix, size, publication_number)``: of the keys that begin with a prefix the shortest, then the least.

        Keys that begin alike stand together: a prefix is an interval of keys and goes to the ranges that it meets,
        which for most is one. A range sorts its keys, finds both ends of every interval and answers with one key.
        """
        borders, numbers = [row["border"] for row in self.map], _literal([row["range"] for row in self.map], "array<int>")
        prefix = F.col("prefix")
        ends = F.sequence(position(prefix, borders), position(F.concat(prefix, F.lit("\U0010ffff")), borders))
        routed = materialize(
            prefixes.select("prefix").where(prefix.isNotNull()).distinct().select("prefix", F.explode(F.transform(ends, lambda p: F.get(numbers, p))).alias("range"))
        )
        met = {row["range"] for row in routed.select("range").distinct().collect()}
        keys = self.read(met).select(self.range_of(F.col(KEY)).alias("key_range"), KEY)

        def search(asked: pa.Table, held: pa.Table) -> pa.Table:
            found = held[KEY].combine_chunks().drop_null()
            found = found.take(pc.sort_indices(found))
            wanted = asked["prefix"].combine_chunks()
            texts = np.array(found.cast(pa.binary()).to_pylist(), dtype=bytes) if len(found) else np.empty(0, "S1")
            raw = [p.encode() for p in wanted.to_pylist()]
            low = np.searchsorted(texts, np.array(raw, dtype=bytes))
            high = np.searchsorted(texts, np.array([p + b"\xff" for p in raw], dtype=bytes))
            at = np.flatnonzero(high > low)
            sizes = pc.utf8_length(found).to_numpy()
            order = np.lexsort((np.arange(len(sizes)), sizes))  # keys by length, then as sorted
            rank = np.empty(len(order) + 1, np.int64)
            rank[order], rank[-1] = np.arange(len(order)), len(order)
            best = order[np.minimum.reduceat(rank, np.column_stack([low[at], high[at]]).ravel())[::2]] if len(at) else at
            return pa.table({"prefix": wanted.take(pa.array(at)), "size": pa.array(sizes[best].astype(np.int32)), KEY: found.take(pa.array(best))})

        groups = routed.groupBy("range").cogroup(keys.groupBy("key_range"))
        answers = groups.applyInArrow(search, f"prefix string, size int, {KEY} string")
        return answers.groupBy("prefix").agg(F.min(F.struct("size", KEY)).alias("best")).select("prefix", "best.*")

    def merge(self, source: DataFrame, update_cols: tuple[str, ...] = LINK_COLUMNS, version: int | None = None) -> StoredCorpus:
        """The next version: new rows whole, known rows with ``update_cols`` of the source, nothing deleted.

        Ranges without a key of the source keep their partitions. In the others stored and new rows meet in their
        range, to which a row moves once, and are sorted there once; a row of a known key comes with its key and
        ``update_cols`` alone. The source is read twice, so it should be stored. Several source rows for one key
        raise an error.
        """
        version = self.version + 1 if version is None else version
        fields = [c for c in self._rows.columns if c != PIECE]
        source = source.select(fields)
        arrived = materialize(one_row_per_key(source.select(KEY), KEY))
        hit = {row["range"] for row in arrived.select(self.range_of(F.col(KEY)).alias("range")).distinct().collect()}
        old = self.read(hit)
        both = old.select(KEY, F.lit(True).alias("known")).unionByName(arrived.select(KEY, F.lit(False).alias("known")))
        keys = materialize(both.groupBy(KEY).agg(F.bool_or("known").alias("known")))
        maps = [row for row in self.map if row["range"] in hit]
        borders = _split(keys, self, maps)
        fresh = Membership(keys.where(~F.col("known")), [KEY])
        whole = F.col(KEY).isNull() | fresh.may_hold(F.col(KEY))  # a known row that it lets pass whole is only larger
        sent = [F.col(c) if c in (KEY, *update_cols) else F.when(whole, F.col(c)).alias(c) for c in fields]
        rows = old.select(*fields, F.lit(False).alias("_new")).unionByName(fresh.joined(source).select(*sent, F.lit(True).alias("_new")))
        kept = [row.asDict() for row in self.map if row["range"] not in hit]
        _write(rows, keys, borders, self.path, version, self.rows_per_range, kept, lambda placed: _upserted(placed, fields, update_cols))
        return StoredCorpus(self.spark, self.path, version)


def _upserted(rows: DataFrame, fields: list[str], update_cols: tuple[str, ...]) -> DataFrame:
    """Of stored and, marked ``_new``, arrived rows in their partitions: what the merged corpus holds. A null key meets none."""
    mates, new = Window.partitionBy(PIECE, KEY), F.col("_new")
    meets = F.col(KEY).isNotNull()
    met = rows.withColumns(
        {
            "_renewed": F.first(F.when(new & meets, F.struct(*update_cols)), ignorenulls=True).over(mates),
            "_known": F.coalesce(F.bool_or(~new & meets).over(mates), F.lit(False)),
        }
    )
    renewed = F.col("_renewed").isNotNull()
    return met.where(~(new & F.col("_known"))).select(
        *[F.when(renewed, F.col("_renewed")[c]).otherwise(F.col(c)).alias(c) if c in update_cols else F.col(c) for c in fields], PIECE
    )


def position(key: Column, borders: list[str]) -> Column:
    """Number of borders not above a key, less one, for sorted borders: two steps of about the root of their number."""
    width = max(1, math.isqrt(len(borders)))
    blocks = [borders[i : i + width] for i in range(0, len(borders), width)]
    heads = _literal([part[0] for part in blocks], "array<string>")
    block = F.greatest(F.size(F.filter(heads, lambda b: b <= key)) - 1, F.lit(0))
    inside = F.get(_literal(blocks, "array<array<string>>"), block)
    return F.coalesce(F.greatest(block * width + F.size(F.filter(inside, lambda b: b <= key)) - 1, F.lit(0)), F.lit(0))


def _literal(values: list, kind: str) -> Column:
    """A constant, folded once, however many values it has."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def create(corpus: DataFrame, path: str, rows_per_range: int = ROWS_PER_RANGE, version: int = 0) -> StoredCorpus:
    """Store a corpus by key range."""
    keys = materialize(corpus.select(KEY))
    borders = _borders(keys, max(1, math.ceil(keys.count() / rows_per_range)))
    pairs = list(enumerate(sorted({"", *borders})))
    _write(corpus, keys, [(border, number) for number, border in pairs], path, version, rows_per_range, [])
    return StoredCorpus(corpus.sparkSession, path, version)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "ranges/version=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def latest(spark: SparkSession, path: str, below: int | None = None) -> StoredCorpus | None:
    """The newest version, or the newest below a number; None when there is none."""
    known = [v for v in versions(spark, path) if below is None or v < below]
    return StoredCorpus(spark, path, known[-1]) if known else None


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the maps of all but the newest versions and the partitions that only those named; returns how many."""
    known = versions(spark, path)
    named = {row["piece"] for v in known[-keep:] for row in StoredCorpus(spark, path, v).map}
    gone = {row["piece"] for v in known[:-keep] for row in StoredCorpus(spark, path, v).map} - named
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for version in known[:-keep]:
        files.delete(jvm.org.apache.hadoop.fs.Path(_map_path(path, version)), True)
    for piece in gone:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/rows/{PIECE}={piece}"), True)
    return len(gone)


def _map_path(path: str, version: int) -> str:
    return f"{path}/ranges/version={version:08d}"


def _borders(keys: DataFrame, n: int) -> list[str]:
    """Least keys of about n ranges of equal size but the first, which begins where the keys do."""
    if n > MOST_RANGES:
        raise ValueError(f"{n} ranges are too many for one map; take more rows per range")
    if n == 1:
        return []
    ranged = keys.repartitionByRange(n, KEY).groupBy(F.spark_partition_id()).agg(F.min(KEY).alias("border"))
    return sorted(row["border"] for row in ranged.collect() if row["border"] is not None)[1:]


def _split(keys: DataFrame, store: StoredCorpus, maps: list) -> list[tuple[str, int]]:
    """(border, range) of the touched ranges, those over twice the usual size cut into more."""
    sizes = {r["range"]: r["n"] for r in keys.groupBy(store.range_of(F.col(KEY)).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()}
    borders = [(row["border"], row["range"]) for row in maps]
    full = [n for n, size in sizes.items() if size > 2 * store.rows_per_range]
    if not full:
        return borders
    crowded = keys.where(store.range_of(F.col(KEY)).isin(full))
    cuts = _borders(crowded, math.ceil(sum(sizes[n] for n in full) / store.rows_per_range))
    known, number = {row["border"] for row in store.map}, max(row["range"] for row in store.map) + 1
    fresh = sorted(set(cuts) - known)
    return sorted([*borders, *((border, number + i) for i, border in enumerate(fresh))])


def _write(
    rows: DataFrame, keys: DataFrame, borders: list[tuple[str, int]], path: str, version: int, rows_per_range: int, kept: list[dict],
    settled: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Partitions of the given ranges, then the map of the whole version. ``settled`` makes the rows of the corpus of those in place."""
    spark = rows.sparkSession
    numbers = _literal([number for _, number in borders], "array<int>")
    found = F.get(numbers, position(F.col(KEY), [border for border, _ in borders]))
    piece = F.format_string("%06d-%08d", found, F.lit(version))
    placed = rows.withColumn(PIECE, piece).repartition(PIECE).sortWithinPartitions(PIECE, KEY)
    if settled is not None:
        placed = settled(placed)
    placed.write.partitionBy(PIECE).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")
    stored = T.StructType([f for f in placed.schema if f.name != PIECE])
    ends = {
        row["range"]: row
        for row in keys.groupBy(found.alias("range")).agg(F.min(KEY).alias("least"), F.max(KEY).alias("greatest"), F.count(F.lit(1)).alias("n")).collect()
    }
    entries = list(kept)
    for border, number in borders:
        at = ends.get(number)
        entries.append(
            {
                "range": number, "border": border, "least": at and at["least"], "greatest": at and at["greatest"],
                "n_rows": at["n"] if at else 0, "piece": f"{number:06d}-{version:08d}", "rows_per_range": rows_per_range, "schema": stored.json(),
            }
        )
    schema = "range int, border string, least string, greatest string, n_rows bigint, piece string, rows_per_range bigint, schema string"
    table = spark.createDataFrame([tuple(e[name] for name in (f.split()[0] for f in schema.split(", "))) for e in entries], schema)
    table.coalesce(1).write.mode("overwrite").parquet(_map_path(path, version))
