"""What each of several filters removes, in every order of them, alone and together.

Texts that repeat are found behind a counting Bloom sketch. Tasks count cells of the hashes of their texts, the
sketches of all tasks are merged, and a text with a cell that was counted once is unique for certain: it is never
shuffled. Only texts whose cells were all counted twice or more are grouped, whole, for their smallest id. Counts
by the set of filters that a document fails then add up to every figure of the audit.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import stored
from nearcite.llm.tokens import slices

CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"

#: (words, distinct words, code points, capitals A-Z, symbols) of a text -> it fails; bits in this order.
FILTERS: dict[str, Callable[[int, int, int, int, int], bool]] = {
    "A": lambda words, distinct, points, capitals, symbols: words < 200,
    "B": lambda words, distinct, points, capitals, symbols: 100 * distinct < 50 * words,
    "C": lambda words, distinct, points, capitals, symbols: 100 * capitals > 2 * points,
    "D": lambda words, distinct, points, capitals, symbols: symbols > 0,
}
#: The filter of texts that a smaller id has as well.
REPEATED = "E"

CELLS = 1 << 16  # of a slice of the sketch
PROBES = 3
CELLS_PER_TEXT = 8
#: 32 MB of bits. Beyond 33 million texts cells are shared by more of them: fewer are cleared, results stay.
MOST_SLICES = 4096
#: Counted cells that a task holds before it hands them on.
HELD = 1 << 21


def measures(raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()  # bytes are cut at \x20 and \x09-\x0D alone
    size = len(raw)
    return (
        len(words), len(set(words)), len(raw.translate(None, CONTINUATION)), size - len(raw.translate(None, UPPER)),
        size - len(raw.translate(None, SYMBOLS)),
    )


def _masker(filters: dict[str, Callable], keep_text: bool):
    tests = list(filters.values())

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                found = (measures(t) for t in batch["_text"].cast(pa.binary()).to_pylist())
                masks = pa.array([sum(test(*m) << i for i, test in enumerate(tests)) for m in found], pa.int32())
                names = [n for n in batch.schema.names if keep_text or n != "_text"]
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), masks], [*names, "_mask"])

    return masked


def _cells_of(keys: np.ndarray, slices_: np.ndarray) -> np.ndarray:
    """The probed cells of all slices in one line: PROBES for each key."""
    keys = keys.astype(np.uint64)
    probes = [(keys >> np.uint64(16 * i)) & np.uint64(CELLS - 1) for i in range(PROBES)]
    base = slices_.astype(np.uint64) * np.uint64(CELLS)
    return np.concatenate([base + p for p in probes])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sketch: counts up to 2 of the cells that it met, a row for each slice."""
    cells, counts = np.empty(0, np.uint64), np.empty(0, np.uint8)

    def rows() -> pa.RecordBatch:
        owner = (cells // np.uint64(CELLS)).astype(np.int64)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = [*starts[1:].tolist(), len(cells)]
        low = (cells % np.uint64(CELLS)).astype("<u2")
        return pa.RecordBatch.from_arrays(
            [
                pa.array(owner[starts].astype(np.int32)),
                pa.array([low[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary()),
            ],
            ["_slice", "cells", "counts"],
        )

    for batch in batches:
        seen = _cells_of(batch["_probe"].to_numpy().view(np.uint64), batch["_slice"].to_numpy())
        cells, place = np.unique(np.concatenate([cells, seen]), return_inverse=True)
        total = np.bincount(place, np.concatenate([counts, np.ones(len(seen), np.uint8)]), len(cells))
        counts = np.minimum(total, 2).astype(np.uint8)
        if len(cells) >= HELD:
            yield rows()
            cells, counts = np.empty(0, np.uint64), np.empty(0, np.uint8)
    if len(cells):
        yield rows()


def _merged(table: pa.Table) -> pa.Table:
    """The bits of one slice: set where the counts of all tasks add up to 2 or more."""
    total = np.zeros(CELLS, np.uint8)
    for cells, counts in zip(table["cells"].to_pylist(), table["counts"].to_pylist(), strict=True):
        at = np.frombuffer(cells, "<u2")
        total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
    bits = np.packbits(total >= 2, bitorder="little").view("<i8")
    return pa.table({"_slice": table["_slice"][:1], "_bits": pa.array([bits.tolist()], pa.list_(pa.int64()))})


def sketch(keys: DataFrame, n_rows: int) -> tuple[DataFrame, int]:
    """(slice, bits of its cells counted twice or more) of a column _key of 64-bit hashes, and the number of slices."""
    n = min(MOST_SLICES, max(1, math.ceil(n_rows * CELLS_PER_TEXT / CELLS)))
    tasks = keys.select(*_probed(F.col("_key"), n)).mapInArrow(_counted, "_slice int, cells binary, counts binary")
    return stored(tasks.groupBy("_slice").applyInArrow(_merged, "_slice int, _bits array<long>"), "bloom"), n


def _probed(key: Column, n: int) -> tuple[Column, Column]:
    """The slice of a key and the bits that its cells are taken from."""
    return F.pmod(key, F.lit(n)).cast("int").alias("_slice"), F.xxhash64(F.lit(n), key).alias("_probe")


def may_repeat(rows: DataFrame, bits: DataFrame, n: int) -> DataFrame:
    """The rows with _repeats, false where their _key is certainly the only one of its kind."""
    cell = lambda i: f"(shiftrightunsigned(_probe, {16 * i}) & {CELLS - 1})"
    hit = " AND ".join(f"bit_get(_bits[cast({cell(i)} >> 6 AS int)], cast({cell(i)} & 63 AS int)) = 1" for i in range(PROBES))
    probed = rows.select("*", *_probed(F.col("_key"), n))
    return probed.join(F.broadcast(bits), "_slice").select(*rows.columns, F.expr(hit).alias("_repeats"))


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Joined where there is an id, so that rows without one don't meet in one task."""
    none = rows.where("_id IS NULL").select("*", F.lit(False).alias("_good"), F.lit(False).alias("_toxic"))
    some = rows.where("_id IS NOT NULL").join(labels, "_id", "left")
    return some.select(*rows.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("_good", "_toxic")]).unionByName(none)


def _counts_of_repeats(rows: DataFrame, firsts: DataFrame, keys: list[str], bit: int) -> DataFrame:
    """Counts of rows whose texts may repeat; all but those at the first id of their text fail the filter of repeats.

    Rows of one text are added up before they meet its first id, so a text of a third of all rows is one row a
    task.
    """
    kinds = [*keys, "_part", "_mask", "_good", "_toxic"]
    ids = rows.groupBy(*kinds, "_id").agg(F.count("*").alias("n"))
    groups = ids.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min("_id").alias("lowest"), F.min_by("n", "_id").alias("at_lowest"),
        F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("idless"),
    )
    stays = F.col("idless") + F.when(F.col("lowest") == F.col("first"), F.col("at_lowest")).otherwise(0)
    joined = groups.join(firsts.select(*keys, "first"), keys).withColumn("stays", stays)
    kind = ["_part", "_good", "_toxic"]
    return joined.select(*kind, "_mask", F.col("stays").alias("n")).unionByName(
        joined.select(*kind, (F.col("_mask") + bit).alias("_mask"), (F.col("n") - F.col("stays")).alias("n"))
    )


def mask_counts(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    label_id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic",
    filters: dict[str, Callable] = FILTERS, key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """part, mask (bits of the filters failed, the last that of repeated texts), n, good and toxic: documents.

    ``key`` is the hash by which texts are sketched and joined. Texts that share one are grouped as whole texts,
    and those of a key with several texts are joined by text.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(
        F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("_part"),
        key(text).cast("long").alias("_key"), text.alias("_text"),
    )
    kind = docs.schema["_id"].dataType.simpleString()
    given = labels.groupBy(F.col(f"`{label_id_col}`").alias("_id")).agg(
        *[F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False))).alias(a) for c, a in ((good_col, "_good"), (toxic_col, "_toxic"))]
    )
    flags = stored(docs.mapInArrow(_masker(filters, False), f"_id {kind}, _part string, _key long, _mask int"), "flags")
    bits, n_slices = sketch(flags.select("_key"), flags.count())
    rows = _with_labels(may_repeat(flags, bits, n_slices), given)
    texts = may_repeat(docs.select("_id", "_key", "_text"), bits, n_slices).where("_repeats")
    firsts = stored(texts.groupBy("_key", "_text").agg(F.min("_id").alias("first")).drop("_text"), "firsts")
    by_key = firsts.groupBy("_key").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    bit = 1 << len(filters)
    kinds = ["_part", "_good", "_toxic", "_mask"]
    counts = [
        rows.where("NOT _repeats").groupBy(*kinds).agg(F.count("*").alias("n")),
        _counts_of_repeats(rows.where("_repeats"), by_key.where("texts = 1"), ["_key"], bit),
    ]
    shared = by_key.where("texts > 1").select("_key")
    if not shared.isEmpty():
        several = docs.join(stored(shared, "shared"), "_key", "left_semi").select(*docs.columns)
        again = several.mapInArrow(_masker(filters, True), f"_id {kind}, _part string, _key long, _text string, _mask int")
        exact = several.groupBy("_key", "_text").agg(F.min("_id").alias("first"))
        counts.append(_counts_of_repeats(_with_labels(again, given), exact, ["_key", "_text"], bit))
    added = reduce(lambda a, b: a.unionByName(b), counts)
    number = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return stored(
        added.groupBy(F.col("_part").alias("part"), F.col("_mask").alias("mask"))
        .agg(F.sum("n").alias("n"), number("_good").alias("good"), number("_toxic").alias("toxic"))
        .where("n > 0"),
        "mask-counts",
    )


def audit(df: DataFrame, labels: DataFrame, filters: dict[str, Callable] = FILTERS, **columns: str) -> DataFrame:
    """A row for each part, order of the filters and step, with the documents that stay, go or would have gone.

    ``filters`` are tests of a text's measures, applied after one another in every order together with the filter
    of repeated texts, ``E``; ``columns`` are the column names of ``mask_counts``.

    Null texts count as empty; empty texts repeat one another. Null parts are the part ''. Rows of one id and text
    are documents each, and none of them is smaller than the other; a row without an id never repeats a text, nor
    does it make others repeat it. A document that is labelled several times is good (toxic) if any of its labels
    says so; null labels say nothing. Very long texts are measured whole, one at a time. Extra columns are not
    read. An empty table gives no rows.
    """
    letters = "".join(filters) + REPEATED
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "before": sum(1 << letters.index(x) for x in order[:i]), "bit": 1 << letters.index(order[i])}
        for order in permutations(letters)
        for i in range(len(letters))
    ]
    schema = "array<struct<filter_order:string,step:int,before:int,bit:int>>"
    counts = mask_counts(df, labels, filters=filters, **columns)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.inline(F.from_json(F.lit(json.dumps(steps)), schema)))

    def added(value: str, where) -> Column:
        return F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda total, x: total + x[value])

    before, bit = F.col("before"), F.col("bit")
    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    there = lambda x: x["mask"].bitwiseAND(before) == 0
    # of all orders, a failing document falls to each of the filters it fails in equal shares
    share = F.aggregate(
        F.filter("masks", fails), F.lit(0).cast("long"),
        lambda total, x: total + x["n"] * (F.lit(math.factorial(len(letters))) / F.bit_count(x["mask"])).cast("long"),
    )
    return rows.select(
        "part", "filter_order", "step",
        added("n", lambda x: there(x) & ~fails(x)).alias("kept"),
        added("n", lambda x: there(x) & fails(x)).alias("removed"),
        added("n", lambda x: ~there(x) & fails(x)).alias("redundant"),
        added("n", lambda x: x["mask"] == bit).alias("unique_fails"),
        added("good", lambda x: there(x) & fails(x)).alias("good_lost"),
        added("toxic", lambda x: there(x) & fails(x)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)
