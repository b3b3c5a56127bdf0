"""Ranked lexical search: the best documents of each item, with bags of equal words scored once.

A document is reduced to the words that some item asks for. Documents of one such bag and one length weight score
alike for every item, so they form a class: found by hash, verified by the whole bag. Classes are scored, the best
of each item are kept, and only those are expanded to their documents, by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearcite.llm.common import small, stored
from nearcite.llm.tokens import slices

#: Terms are runs of letters A-Z, digits and everything beyond ASCII; A-Z become small.
_IN_TERM = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _IN_TERM else 0x20 for b in range(256))

TOP = 50
#: Terms of the items of one block, about; each block of items is one pass over the documents.
BLOCK_TERMS = 200_000
#: Scores that a task holds at once.
SCORES = 4 << 20
#: Groups by which a frequent class or item is cut before the last of its rows meet.
SALTS = 16


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms_of(t or b""))) for t in batch["_text"].cast(pa.binary()).to_pylist()]
        item = batch["_item"].take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
        yield pa.RecordBatch.from_arrays([item, pa.array([t for f in found for t in f], pa.binary())], ["_item", "_term"])


def _bagger(vocabulary: dict[bytes, int]):
    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                lengths, bags = [], []
                for raw in batch["_text"].cast(pa.binary()).to_pylist():
                    terms = terms_of(raw)
                    lengths.append(len(terms))
                    counts = Counter(map(vocabulary.get, terms))
                    counts.pop(None, None)
                    bags.append(np.array(sorted(counts.items()), "<u4").tobytes())
                n = np.array(lengths, np.int64)
                full = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch["_id"].filter(full), pa.array(n).filter(full), pa.array(bags, pa.binary()).filter(full)], ["_id", "_n", "_bag"]
                )

    return bagged


def _unpacked(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the bag, term, frequency) of every entry of bags of (term, frequency) pairs."""
    raw = bags.to_pylist()
    entries = np.frombuffer(b"".join(raw), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(raw)), [len(b) // 8 for b in raw]), entries[:, 0], entries[:, 1]


def _frequencies(n_terms: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for whole in batches:
            for batch in slices(whole, "_bag"):
                place, term, _ = _unpacked(batch["_bag"])
                np.add.at(total, term, batch["_members"].to_numpy()[place])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["_term", "_df"])

    return counted


def _best(scores: np.ndarray, first: np.ndarray, none: np.ndarray, top: int) -> np.ndarray:
    """Places of the highest scores above 0, equal ones by the first id, rows without an id last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > top:
        least = np.partition(scores[at], len(at) - top)[len(at) - top]
        at = at[scores[at] >= least]
    return at[np.lexsort((first[at], none[at], -scores[at]))][:top]


def _scorer(weights: np.ndarray, starts: np.ndarray, items: np.ndarray, n_items: int, top: int):
    """Best classes of each item among a task's; items[starts[t]:starts[t + 1]] are the items that hold term t."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty((0, 6), np.int64) for _ in range(n_items)]
        step = max(1, SCORES // n_items)
        for whole in batches:
            for part in slices(whole, "_bag"):
                for at in range(0, part.num_rows, step):
                    batch = part.slice(at, step)
                    place, term, tf = _unpacked(batch["_bag"])
                    m = batch["_m"].to_numpy()[place]
                    gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                    many = starts[term + 1] - starts[term]
                    scores = np.zeros(batch.num_rows * n_items, np.int64)
                    for low in _cuts(many, SCORES):
                        part_many = many[low]
                        ends = np.cumsum(part_many)
                        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - part_many, part_many)
                        target = items[np.repeat(starts[term[low]], part_many) + within]
                        np.add.at(scores, np.repeat(place[low] * n_items, part_many) + target, np.repeat(gain[low], part_many))
                    none = np.asarray(batch["_first"].is_null())
                    first = batch["_first"].fill_null(0).to_numpy()
                    rows = np.column_stack([np.zeros(len(first), np.int64), first, none, *(batch[c].to_numpy() for c in ("_hash", "_check", "_m"))])
                    by_item = scores.reshape(batch.num_rows, n_items)
                    for i in range(n_items):
                        hit = _best(by_item[:, i], first, none, top)
                        if len(hit):
                            both = np.concatenate([kept[i], rows[hit]])
                            both[len(kept[i]) :, 0] = by_item[hit, i]
                            kept[i] = both[_best(both[:, 0], both[:, 1], both[:, 2], top)]
        rows = np.concatenate(kept) if n_items else np.empty((0, 6), np.int64)
        item = np.repeat(np.arange(n_items), [len(k) for k in kept])
        first = pa.array(rows[:, 1], mask=rows[:, 2].astype(bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(rows[:, 0]), first, *(pa.array(rows[:, c]) for c in (3, 4, 5))],
            ["_number", "_score", "_first", "_hash", "_check", "_m"],
        )

    return scored


def _cuts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of so many in all at most, one entry at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield slice(at, stop)
        at = stop


def _ranked(rows: DataFrame, keys: list[str], order: list, salt: str, top: int, name: str) -> DataFrame:
    """The first ``top`` rows of each key with their place, in two steps so that a frequent key is cut in parts."""
    parts = Window.partitionBy(*keys, F.expr(f"pmod(xxhash64({salt}), {SALTS})")).orderBy(*order)
    some = rows.withColumn(name, F.row_number().over(parts)).where(F.col(name) <= top).drop(name)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= top)


def _search_block(docs: DataFrame, asked: DataFrame, block: int, kind: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    pairs = [(r["_item"], bytes(r["_term"])) for r in asked.where(F.col("_block") == block).drop("_block").collect()]
    names = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
    number = {name: i for i, name in enumerate(names)}
    terms = sorted({t for _, t in pairs})
    vocabulary = {t: i for i, t in enumerate(terms)}
    holders = np.array(sorted((vocabulary[t], number[i]) for i, t in pairs), np.int64).reshape(-1, 2)
    starts = np.searchsorted(holders[:, 0], np.arange(len(terms) + 1))

    bags = stored(docs.mapInArrow(_bagger(vocabulary), "_id long, _n long, _bag binary"), "bags")
    counts = bags.agg(F.count("*").alias("n"), F.sum("_n").alias("l")).collect()[0]
    n_docs, n_terms = counts["n"], counts["l"] or 0
    weight = F.expr(f"50 + (50 * _n * {n_docs}L) div {max(n_terms, 1)}L")
    held = bags.where("length(_bag) > 0").select("_id", weight.alias("_m"), "_bag")
    held = held.select("*", F.xxhash64("_m", "_bag").alias("_hash"), F.xxhash64("_bag", "_m").alias("_check"))
    identity = ["_hash", "_check", "_m", "_bag"]  # the hash finds a class, the bag itself verifies it
    classes = stored(held.groupBy(*identity).agg(F.min("_id").alias("_first"), F.count("*").alias("_members")), "classes")
    df = classes.select("_bag", "_members").mapInArrow(_frequencies(len(terms)), "_term long, _df long")
    weights = np.zeros(len(terms), np.int64)
    for row in df.groupBy("_term").agg(F.sum("_df").alias("_df")).collect():
        weights[row["_term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["_df"] + 1)))
    best = classes.select("_hash", "_check", "_m", "_bag", "_first").mapInArrow(
        _scorer(weights, starts, holders[:, 1], len(names), top), "_number int, _score long, _first long, _hash long, _check long, _m long"
    )
    by_score = [F.desc("_score"), F.asc_nulls_last("_first")]
    best = stored(_ranked(best, ["_number"], by_score, "_hash", top, "_place").drop("_place"), "best-classes")
    wanted = small(stored(best.select("_hash", "_check", "_m").distinct(), "wanted"))
    members = held.join(wanted, ["_hash", "_check", "_m"], "left_semi")
    members = _ranked(members, identity, [F.asc_nulls_last("_id")], "_id", top, "_place")
    of_class = members.withColumn("_own", F.min("_id").over(Window.partitionBy(*identity))).select("_hash", "_check", "_m", "_own", "_id")
    found = best.join(of_class, (best["_hash"] == of_class["_hash"]) & (best["_check"] == of_class["_check"]) & (best["_m"] == of_class["_m"]) & best["_first"].eqNullSafe(of_class["_own"]))
    found = found.select("_number", "_score", "_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_number").orderBy(F.desc("_score"), F.asc_nulls_last("_id"))))
    names_table = spark.createDataFrame([(i, name) for i, name in enumerate(names)], f"_number int, _item {kind}")
    return ranked.where(F.col("rank") <= top).join(F.broadcast(names_table), "_number").select("_item", "rank", "_id", "_score")


def search(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """_item, rank, _id, _score: the ``top`` documents of each item by score, equal scores by ascending id.

    Items are searched in blocks whose words are few enough for every task, a pass over all documents each; the
    first 50 classes of an item hold its first 50 documents, since each class before another puts at least its
    first document before all of the other's. Scores are 64-bit integers.

    Null and empty texts have no terms and are not counted as documents; items without terms have no rows. Items
    of several rows ask for the terms of all of them. Rows that repeat, with an equal id or not, are documents
    each. Rows without an id come after others of equal score, an item without an id is an item. Very long texts
    are cut into words whole, one at a time. Extra columns are not read. Empty tables give no rows. Ids of
    documents are integers.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    texts = items.select(F.col(f"`{item_id_col}`").alias("_item"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("_text"))
    kind = texts.schema["_item"].dataType.simpleString()
    asked = stored(texts.mapInArrow(_item_terms, f"_item {kind}, _term binary").distinct(), "item-terms")
    blocks = max(1, math.ceil(2 * asked.count() / block_terms))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("_item"), F.lit(blocks)))
    numbers = sorted(r[0] for r in asked.select("_block").distinct().collect())
    found = [_search_block(docs, asked, b, kind, top) for b in numbers] or [
        docs.sparkSession.createDataFrame([], f"_item {kind}, rank int, _id long, _score long")
    ]
    return reduce(lambda a, b: a.unionByName(b), found)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items).select(F.col("_item").alias("item_id"), "rank", F.col("_id").alias("doc_id"), F.col("_score").alias("score"))
