"""Near duplicates by an LSH forest: sorted signature orders, prefix neighbours, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import keyed_texts, row_key, small, stored, whole_rows
from nearcite.llm.components import components
from nearcite.llm.tokens import hashed_words, mixed, slices

SHINGLE = 4
TREES = 16
DEPTH = 8
ROOT = 2
BLOCK = 128
#: Members of sets are ordered by the counts of so many leading bits; rows that share one are compared in parts of about SALTED.
CELL_BITS = 18
SALTED = 512
#: MinHash values of which four bits each travel with a row; two values agree in those by chance in one of 16 cases.
VALUES = 256
CHANCE = 1 / 16
#: Estimated similarity from which a pair is confirmed on full sets: 0.8 less four deviations of the estimate.
MARGIN = 0.8 - 4 * ((0.8 + 0.2 * CHANCE) * 0.2 * (1 - CHANCE) / VALUES) ** 0.5 / (1 - CHANCE)


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; fewer words: the whole sequence as one."""
    words, offsets = hashed_words(texts)
    spun = np.zeros(len(words), np.uint64)
    for k in range(n):  # position-dependent, so order counts
        spun[: max(0, len(words) - k)] += mixed(words[k:] + np.uint64(k + 1))
    spun = mixed(spun)
    for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
        size = stop - start
        if size >= n:
            yield np.unique(spun[start : stop - n + 1])
        elif size:
            whole = mixed(words[start:stop] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield mixed(whole.sum(keepdims=True, dtype=np.uint64) + np.uint64(size))
        else:
            yield np.empty(0, np.uint64)


def _class_of(own: np.ndarray) -> bytes:
    """128 bits that stand for a set: two sums of differently mixed members, and the size."""
    one, two = mixed(own).sum(dtype=np.uint64), mixed(own ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return np.array([one, two + np.uint64(len(own))], np.uint64).tobytes()


def _sketch(n: int):
    rng = np.random.default_rng(20240607)
    odd = rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)

    def signature(own: np.ndarray) -> tuple[bytes, bytes]:
        """The values that orders are made of, and four bits of every value."""
        least = np.full(VALUES, 0xFFFFFFFF, np.uint64)
        for i in range(0, len(own), 1024):
            least = np.minimum(least, ((own[i : i + 1024, None] * odd + plus) >> np.uint64(32)).min(axis=0))
        bits = (mixed(least) & np.uint64(15)).astype(np.uint8)
        return least[: TREES * DEPTH].astype(">u4").tobytes(), (bits[::2] << 4 | bits[1::2]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sizes, classes, signatures, low = [], [], [], []
                for own in _sets(part["_text"], n):
                    sizes.append(len(own))
                    classes.append(_class_of(own) if len(own) else None)
                    sig, bits = signature(own) if len(own) else (None, None)
                    signatures.append(sig)
                    low.append(bits)
                made = [pa.array(x, pa.binary()) for x in (classes, signatures, low)]
                yield pa.RecordBatch.from_arrays([part["_key"], pa.array(sizes, pa.int64()), *made], ["_key", "_n", "_c", "_sig", "_low"])

    return run


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = list(_sets(part["_text"], n))
                columns = [pa.array([_class_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_c", "_set"])

    return run


def _cut(keys: np.ndarray, low: int, high: int, depth: int) -> Iterator[tuple[int, int]]:
    """Sorted rows low..high in blocks of BLOCK at most, cut where neighbours share the shortest prefixes.

    Regions that are too large go deeper; neighbouring smaller ones share a block. Rows alike in all values
    are cut into runs that overlap by one row, so that they stay linked.
    """
    if high - low <= BLOCK:
        yield low, high
        return
    if depth == DEPTH:
        for start in range(low, high - 1, BLOCK - 1):
            yield start, min(start + BLOCK, high)
        return
    edges = np.flatnonzero(keys[low + 1 : high, depth] != keys[low : high - 1, depth]) + low + 1
    begin = low
    bounds = [low, *edges.tolist(), high]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > BLOCK:
            if a > begin:
                yield max(begin, low), a
            yield from _cut(keys, a, b, depth + 1)
            begin = b
        elif b - begin > BLOCK:
            yield begin, a
            begin = a
    if high > begin:
        yield begin, high


def _bits(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The four bits of every value, a row for each row."""
    packed = np.frombuffer(b"".join(rows["_low"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return np.concatenate([packed >> 4, packed & 15], axis=1)


def _alike(equal: np.ndarray) -> np.ndarray:
    """Estimated similarity from the share of equal bits."""
    return (equal.mean(axis=1) - CHANCE) / (1 - CHANCE)


def _crowded(keys: np.ndarray, low: int, high: int, depth: int) -> Iterator[tuple[int, int]]:
    """All regions of more than BLOCK sorted rows, at every depth."""
    if high - low <= BLOCK:
        return
    yield low, high
    if depth < DEPTH:
        bounds = [low, *(np.flatnonzero(keys[low + 1 : high, depth] != keys[low : high - 1, depth]) + low + 1).tolist(), high]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield from _crowded(keys, a, b, depth + 1)


def _spokes(rows: pa.Table, low: int, high: int, similarity: float, margin: float) -> tuple[int, np.ndarray]:
    """The row most like what most rows of a region have, and those that may link to it.

    Copies that were edited apart from each other are alike only through what they were copied from; in a
    region of many blocks most would not share one with it.
    """
    part = rows.slice(low, high - low)
    sig = _bits(part)
    usual = np.array([np.bincount(column, minlength=16).argmax() for column in sig.T], np.uint8)
    hub = int((sig == usual).sum(axis=1).argmax())
    size = part["_n"].to_numpy().astype(np.float64)
    label = part["_root"].to_pylist()
    near = (_alike(sig == sig[hub]) >= margin) & (np.minimum(size, size[hub]) >= similarity * np.maximum(size, size[hub]) - 1e-9)
    return low + hub, np.array([low + i for i in np.flatnonzero(near).tolist() if label[i] != label[hub]], np.int64)


def _pairs_of(block: pa.RecordBatch, forest: bool, similarity: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a block whose signatures agree enough, sizes allow it and components differ.

    forest: of those only a spanning forest, most alike first.
    """
    sig = _bits(block)
    size = block["_n"].to_numpy().astype(np.float64)
    label = np.unique(np.array(block["_root"].to_pylist(), object), return_inverse=True)[1]
    i, j = np.triu_indices(block.num_rows, 1)
    fits = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
    i, j = i[fits], j[fits]
    alike = _alike(sig[i] == sig[j])
    near = alike >= margin
    i, j, alike = i[near], j[near], alike[near]
    if not forest:
        return i, j
    root = list(range(block.num_rows))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    taken = []
    for at in np.argsort(-alike, kind="stable").tolist():
        a, b = find(int(i[at])), find(int(j[at]))
        if a != b:
            root[a] = b
            taken.append(at)
    return i[taken], j[taken]


def _candidates(forest: bool, similarity: float, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        schema = pa.schema([("_a", pa.binary()), ("_b", pa.binary())])

        def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            keys = np.frombuffer(b"".join(rows["_order"].to_pylist()), ">u4").reshape(rows.num_rows, DEPTH)
            top = np.column_stack([rows["_t"].to_numpy().astype(np.uint32), keys[:, :ROOT]])
            edges = np.flatnonzero((top[1:] != top[:-1]).any(axis=1)) + 1
            regions = list(zip([0, *edges.tolist()], [*edges.tolist(), rows.num_rows], strict=True))
            spokes = set()
            for a, b in regions:
                for low, high in _crowded(keys, a, b, ROOT):
                    hub, near = _spokes(rows, low, high, similarity, margin)
                    spokes |= {(min(hub, i), max(hub, i)) for i in near.tolist()}
            if spokes:
                c = rows["_c"].to_pylist()
                ends = {(min(c[i], c[j]), max(c[i], c[j])) for i, j in spokes}
                a_, b_ = zip(*sorted(ends), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary())], schema=schema)
            for a, b in regions:
                for low, high in _cut(keys, a, b, ROOT):
                    if high - low > 1:
                        block = rows.slice(low, high - low).combine_chunks().to_batches()[0]
                        i, j = _pairs_of(block, forest, similarity, margin)
                        if len(i):
                            c = np.array(block["_c"].to_pylist(), object)
                            a_, b_ = c[i], c[j]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([min(x) for x in zip(a_, b_, strict=True)], pa.binary()), pa.array([max(x) for x in zip(a_, b_, strict=True)], pa.binary())],
                                schema=schema,
                            )

        for batch in batches:  # regions of the root depth are held until they end, or until many rows are
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 20_000:
                continue
            t, order = held["_t"].to_pylist(), held["_order"].to_pylist()
            last = (t[-1], order[-1][: 4 * ROOT])
            stop = len(t)
            while stop and (t[stop - 1], order[stop - 1][: 4 * ROOT]) == last:
                stop -= 1
            if stop == 0 and len(t) < 200_000:
                continue
            stop = stop or len(t) - BLOCK  # a region over any bound goes in parts that meet in its order
            yield from emit(held.slice(0, stop))
            held = held.slice(stop)
        if held is not None and held.num_rows:
            yield from emit(held)

    return run


def _shared(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch["_set_a"], batch["_set_b"]
            fine = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                one, two = np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                fine[i] = 1000 * both >= round(1000 * similarity) * (len(one) + len(two) - both)
            yield batch.select(["_a", "_b"]).filter(pa.array(fine))

    return run


def _orders(classes: DataFrame, trees: int) -> DataFrame:
    """A row for each class and sorted order: _t, the values of that order, and four bits of every value."""
    cut = F.array(*[F.struct(F.lit(t).alias("_t"), F.substring("_sig", 4 * DEPTH * t + 1, 4 * DEPTH).alias("_order")) for t in range(trees)])
    return classes.withColumn("_x", F.explode(cut)).select("_x._t", "_x._order", "_c", "_n", "_low", "_root")


def _proposed(classes: DataFrame, trees: int, similarity: float, margin: float) -> DataFrame:
    """A spanning forest of likely links, so that few pairs are left for the whole comparison: it may miss any."""
    ordered = _orders(classes, trees)
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = ordered.repartitionByRange(parts, "_t", "_order").sortWithinPartitions("_t", "_order", "_c")
    return ordered.mapInArrow(_candidates(True, similarity, margin), "_a binary, _b binary").distinct()


def _region(t: Column, order: Column) -> Column:
    return F.xxhash64(t, F.substring(order, 1, 4 * ROOT))


def _all_of_small(classes: DataFrame, crowded: DataFrame, similarity: float, margin: float) -> DataFrame:
    """All likely pairs of every region of BLOCK classes at most; regions are keyed, so none is cut."""
    ordered = _orders(classes, TREES).withColumn("_p", _region(F.col("_t"), F.col("_order"))).join(crowded, "_p", "left_anti")
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = ordered.repartition(parts, "_p").sortWithinPartitions("_t", "_order", "_c").drop("_p")
    return ordered.mapInArrow(_candidates(False, similarity, margin), "_a binary, _b binary").distinct()


def _regions(classes: DataFrame) -> DataFrame:
    """_p and _m: the first values of an order that several classes share, and how many do."""
    return _roots_of(classes).groupBy("_p").agg(F.count("*").alias("_m")).where("_m > 1")


def _roots_of(classes: DataFrame) -> DataFrame:
    return classes.select("_c", F.explode(F.array(*[_region(F.lit(t), F.substring("_sig", 4 * DEPTH * t + 1, 4 * DEPTH)) for t in range(TREES)])).alias("_p"))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_cell and _m: how many members of sets fall in each cell of their hashes."""
    for batch in batches:
        members = np.frombuffer(b"".join(batch["_set"].to_pylist()), np.uint64)
        cells, times = np.unique(members >> np.uint64(64 - CELL_BITS), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(times.astype(np.int64))], ["_cell", "_m"])


def _prefixes(tally: np.ndarray, mille: int):
    """_w, _i, _c, _n, _root: the members, rarest cells first, of which two sets similar enough share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, places, rows = [], [], []
            for row, data in enumerate(batch["_set"].to_pylist()):
                own = np.frombuffer(data, np.uint64)
                first = len(own) - -(-mille * len(own) // 1000) + 1
                order = np.lexsort((own, tally[own >> np.uint64(64 - CELL_BITS)]))[:first]
                kept.append(own[order])
                places.append(np.arange(len(order)))
                rows.append(np.full(len(order), row))
            if rows:
                own = pa.array(np.concatenate(rows).astype(np.int64))
                columns = [pa.array(np.concatenate(kept).view(np.int64)), pa.array(np.concatenate(places).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *[batch[c].take(own) for c in ("_c", "_n", "_root")]], ["_w", "_i", "_c", "_n", "_root"])

    return run


def _all_of_crowded(classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Every pair of these classes, of two components, that can be similar enough: an exact join of their sets.

    Members are ordered by how often their cell occurs, rarest first: sets similar enough share one of the
    first |S| - ceil(similarity |S|) + 1 (prefix filter), have fitting sizes, and enough members behind the
    first one they share (positional filter). A member that only one component has is let go. Of the others,
    the rows of all but their largest component are compared to all rows, which are salted by their number.
    """
    mille = round(1000 * similarity)
    counted = sets.select("_set").mapInArrow(_tallied, "_cell int, _m long").groupBy("_cell").agg(F.sum("_m").alias("_m")).toArrow()
    tally = np.zeros(1 << CELL_BITS, np.int64)  # bounded: one number a cell
    tally[counted["_cell"].to_numpy()] = counted["_m"].to_numpy()
    rows = sets.join(classes.select("_c", "_n", "_root"), "_c").select("_c", "_n", "_root", "_set")
    kinds = "_w long, _i long, _c binary, _n long, _root binary"
    index = stored(rows.mapInArrow(_prefixes(tally, mille), kinds), "prefixes")
    main = index.groupBy("_w", "_root").agg(F.count("*").alias("_m")).groupBy("_w").agg(
        F.sum("_m").alias("_all"), F.count("*").alias("_parts"), F.max(F.struct("_m", "_root"))["_root"].alias("_main")
    ).where("_parts > 1").select("_w", "_main", F.ceil(F.col("_all") / SALTED).cast("int").alias("_salts"))
    shared = stored(index.join(main, "_w"), "shared-members")
    y = shared.select("_w", F.pmod(F.xxhash64("_c"), F.col("_salts")).cast("int").alias("_salt"), "_i", "_c", "_n", "_root", "_main")
    x = shared.where("_root != _main").select(
        F.col("_w").alias("_v"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_part"), F.col("_i").alias("_j"), F.col("_c").alias("_d"),
        F.col("_n").alias("_k"), F.col("_root").alias("_other"),
    )
    behind = F.least(F.col("_n") - F.col("_i"), F.col("_k") - F.col("_j"))
    fits = (
        (F.col("_v") == F.col("_w")) & (F.col("_part") == F.col("_salt")) & (F.col("_root") != F.col("_other"))
        & ((F.col("_root") == F.col("_main")) | (F.col("_c") < F.col("_d")))
        & (1000 * F.least("_n", "_k") >= mille * F.greatest("_n", "_k"))
        & ((1000 + mille) * behind >= mille * (F.col("_n") + F.col("_k")))
    )
    return x.join(y, fits).select(F.least("_c", "_d").alias("_a"), F.greatest("_c", "_d").alias("_b")).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = SHINGLE
) -> DataFrame:
    """_key, _n (size of its shingle set), _component (smallest id reachable) of every row; _key as in ``row_key``.

    Texts of equal sets are one class, found by 128-bit hashes of the sets; links are sought between classes.
    Every class stands in 16 sorted orders of its MinHash values. Classes that share the first two values of
    an order are candidates. First a spanning forest of candidates in half the orders is confirmed on the full
    sets; there, regions of more than 128 go deeper until they fit, and are compared to their most usual row.
    Then every candidate pair of all orders that still lies in two components, in regions of up to 128; last,
    the classes of larger regions are joined with each other exactly, by the members of their sets.

    Null and empty texts have an empty set, link with nothing and are their own component. Rows of equal id
    and text count as one document; rows of equal id and other texts are documents of their own, linked only if
    their sets are. Null ids: smallest of the others; null if there is none. An empty table gives no
    rows. Very long texts and any number of copies are whole: sets travel only for candidates.
    """
    margin = MARGIN - (0.8 - similarity)
    texts = keyed_texts(df, id_col, text_col)
    sketches = stored(
        texts.select("_key", "_text").mapInArrow(_sketch(shingle), "_key string, _n long, _c binary, _sig binary, _low binary"), "sketches"
    )
    members = texts.select("_id", "_key").distinct()
    classes = sketches.where("_n > 0").groupBy("_c").agg(F.min("_key").alias("_first"), F.first("_n").alias("_n"), F.first("_sig").alias("_sig"), F.first("_low").alias("_low"))
    classes = stored(classes, "classes")
    regions = stored(_regions(classes), "regions")
    # the others share the first values of no order with another class and have no candidates
    company = classes.join(_roots_of(classes).join(regions, "_p", "left_semi").select("_c").distinct(), "_c", "left_semi")
    company = stored(company, "company").withColumn("_root", F.col("_c"))
    crowded = small(stored(regions.where(F.col("_m") > BLOCK).select("_p"), "crowded"))
    crowd = stored(_roots_of(company).join(crowded, "_p", "left_semi").select("_c").distinct(), "crowd")

    def sets_of(needed: DataFrame) -> DataFrame:
        firsts = stored(company.select("_c", "_first").join(needed, "_c", "left_semi").select(F.col("_first").alias("_key")), "needed")
        chosen = texts.select("_key", "_text").join(small(firsts), "_key", "left_semi").select("_text")
        return stored(chosen.mapInArrow(_set_rows(shingle), "_c binary, _set binary").dropDuplicates(["_c"]), "sets")

    links, tried = None, None
    for step in ("forest", "small", "crowded"):
        if step == "forest":
            proposed = _proposed(company, TREES // 2, similarity, margin)
        elif step == "small":
            proposed = _all_of_small(company, crowded, similarity, margin)
        elif crowd.isEmpty():
            break
        else:
            proposed = _all_of_crowded(company.join(crowd, "_c", "left_semi"), sets_of(crowd), similarity)
        if tried is not None:
            proposed = proposed.join(tried, ["_a", "_b"], "left_anti")
        pairs = stored(proposed, "candidates")
        sets = sets_of(pairs.select(F.col("_a").alias("_c")).union(pairs.select(F.col("_b").alias("_c"))).distinct())
        both = pairs.join(sets.select(F.col("_c").alias("_a"), F.col("_set").alias("_set_a")), "_a")
        both = both.join(sets.select(F.col("_c").alias("_b"), F.col("_set").alias("_set_b")), "_b")
        found = stored(both.mapInArrow(_shared(similarity), "_a binary, _b binary"), "found")
        links, tried = (found, pairs) if links is None else (links.union(found), tried.union(pairs))
        roots = stored(components(links), "roots")
        company = company.drop("_root").join(roots.withColumnRenamed("_node", "_c"), "_c", "left")
        company = company.withColumn("_root", F.coalesce("_root", "_c"))
    # component ids: the smallest id of any row of any class of the component
    rooted = sketches.select("_key", "_n", "_c").join(roots.withColumnRenamed("_node", "_c"), "_c", "left")
    rooted = rooted.distinct().select("_key", "_n", F.coalesce("_root", "_c").alias("_root")).join(members, "_key")
    rooted = stored(rooted, "rooted")
    least = rooted.where("_root IS NOT NULL").groupBy("_root").agg(F.min("_id").alias("_least"))
    out = rooted.join(least, "_root", "left")
    return out.select("_id", "_key", "_n", F.when(F.col("_root").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("_component"))


def unique_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of the smallest id of each component, with their columns as they came."""
    found = near_duplicates(df, id_col, text_col, similarity, shingle)
    kept = found.where(F.col("_id").eqNullSafe(F.col("_component"))).select("_key")
    return whole_rows(df, id_col, text_col).join(kept, "_key", "left_semi").select("_row.*")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = near_duplicates(df, id_col, text_col)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_key"))
    out = rows.join(found.select("_key", "_n", "_component"), "_key")
    return out.select(
        "doc_id", F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("_component")).alias("kept"),
    )
