"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import WORDLESS, keyed_texts, let, small, stored, whole_rows

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles in order; one for the whole of a text of fewer words; none without words.

    Words: lower case, cut at ASCII characters other than letters and digits.
    """
    bare = F.btrim(F.regexp_replace(F.lower(text), WORDLESS, " "))
    hashes = F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, " "), lambda x: F.xxhash64(x)))

    def rolled(h: Column) -> Column:
        shingle = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)])
        return (
            F.when(F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), shingle))
            .when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "))))
            .otherwise(h)
        )

    return let(hashes, rolled)


def _shifted(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(value, bits) if bits else value


def _majority(hashes: Column, lane: int) -> Column:
    """Bits set in more than half of the hashes. Fields of ``lane`` bits count several of them in one sum."""
    lanes, mask = 64 // lane, (1 << lane) - 1
    field = F.lit(sum(1 << lane * i for i in range(lanes)))
    parts = []
    for shift in range(lane):
        counts = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, x: acc + _shifted(x, shift).bitwiseAND(field))
        for at in range(lanes):
            count = _shifted(counts, lane * at).bitwiseAND(F.lit(mask))
            value = 1 << (shift + lane * at)
            parts.append(F.when(2 * count > F.size(hashes), F.lit(value - (1 << 64) if value >= 1 << 63 else value)).otherwise(F.lit(0).cast("bigint")))
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of a multiset: a shingle weighs as often as it occurs.

    Counts of up to 65,535 shingles fit fields of 16 bits, longer lists are counted in fields of 32.
    """
    return F.when(F.size(hashes) < 1 << 16, _majority(hashes, 16)).otherwise(_majority(hashes, 32))


def blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """radius + 1 disjoint (shift, width) blocks of 64 bits: fingerprints within the radius agree on one whole block."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _blocked(frame: DataFrame, radius: int) -> DataFrame:
    cut = [
        F.struct(F.lit(i).alias("_b"), _shifted(F.col("_fp"), shift).bitwiseAND(F.lit((1 << width) - 1)).alias("_v"))
        for i, (shift, width) in enumerate(blocks(radius))
    ]
    return frame.withColumn("_cut", F.explode(F.array(*cut))).select("*", "_cut._b", "_cut._v").drop("_cut")


def _common(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda x, of: F.size(F.filter(of, lambda y: y == x))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(x, a), times(x, b)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _shingled(rows: DataFrame) -> DataFrame:
    """The rows with _sh instead of _text. An outer explode of one array keeps what reads _sh from working it out again."""
    return rows.select("_id", "_key", F.explode_outer(F.array(shingles(F.col("_text")))).alias("_sh"))


def _dense(places: DataFrame, similarity: float) -> DataFrame:
    """_key, _len and _starts: the windows of a text that hold enough shingles of one item.

    A window and an item of w and l shingles that share c have the similarity c / (w + l - c), so c is at least
    s / (1 + s) * (w + l). With places p in order, windows with m of them hold p[i] to p[i + m - 1] for some i.
    """
    held = places.groupBy("_key", "_n", "_content", "_len").agg(F.array_sort(F.collect_set("_at")).alias("_p"))
    held = held.withColumn("_w", F.least("_n", "_len"))
    least = F.greatest(F.ceil(similarity / (1 + similarity) * (F.col("_w") + F.col("_len")) - 1e-6).cast("int"), F.lit(1))
    held = held.withColumn("_m", least).where(F.size("_p") >= F.col("_m"))

    def span(i: Column) -> Column:
        low = F.greatest(F.get("_p", i + F.col("_m") - 1) - F.col("_w") + 1, F.lit(0))
        return F.struct(low.alias("low"), F.least(F.get("_p", i), F.col("_n") - F.col("_w")).alias("high"))

    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size("_p") - F.col("_m")), span), lambda x: x["low"] <= x["high"])
    starts = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["low"], x["high"]))))
    return held.select("_key", "_len", starts.alias("_starts"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """_key, _id, _item, similarity and _start (in words) of the best window of each row and item that reach it.

    The windows of an item are as many words long as the item, and may start anywhere in a text. A window that
    reaches the similarity holds a number of the item's shingles that follows from it (8 of 9 at 0.8), in whatever
    order. One scan finds the places of item shingles, with no shuffle of texts; every window with so many of them
    gets a fingerprint, no other can reach the similarity. Fingerprints of equal-sized windows meet in one of radius
    + 1 blocks, which finds every pair within the radius; then multisets of shingles are compared exactly (weighted
    Jaccard).

    Null or wordless texts and items match nothing; texts shorter than an item are one window; of equally similar
    windows the first counts; rows of equal id and text share a result; an empty table on either side gives no
    rows. Very long texts give one row a place of an item shingle. Extra columns are not read.
    """
    items = keyed_texts(benchmark, item_col, item_text_col).select(F.col("_id").alias("_item"), shingles(F.col("_text")).alias("_item_sh"))
    items = stored(items.distinct(), "benchmark-shingles").where(F.size("_item_sh") > 0)
    items = stored(items.withColumn("_fp", simhash(F.col("_item_sh"))), "benchmark-items")
    sized = items.select("_item", F.xxhash64("_item_sh").alias("_content"), F.size("_item_sh").alias("_len"), F.explode(F.array_distinct("_item_sh")).alias("_hash"))
    anchors = stored(sized.select("_content", "_len", "_hash").distinct(), "benchmark-anchors")
    rows = keyed_texts(docs, id_col, text_col)
    places = _shingled(rows).select("_key", F.size("_sh").alias("_n"), F.posexplode_outer("_sh").alias("_at", "_hash")).join(small(anchors), "_hash")
    windows = _dense(places, similarity)
    windows = stored(windows.select("_key", "_len", F.explode("_starts").alias("_start")).distinct(), "benchmark-windows")
    hit = rows.join(small(stored(windows.select("_key").distinct(), "benchmark-rows")), "_key", "left_semi").dropDuplicates(["_key"])
    cut = stored(_shingled(hit), "benchmark-texts").join(windows, "_key").select(
        "_id", "_key", "_len", "_start", F.expr("slice(_sh, _start + 1, _len)").alias("_win")
    )
    printed = _blocked(stored(cut.withColumn("_fp", simhash(F.col("_win"))), "benchmark-fingerprints"), radius)
    targets = items.select("_item", F.xxhash64("_item_sh").alias("_content"), F.col("_fp").alias("_item_fp"), "_fp", F.size("_item_sh").alias("_len"))
    targets = stored(_blocked(targets, radius).drop("_fp"), "benchmark-blocks")
    near = printed.join(small(targets), ["_len", "_b", "_v"])
    near = near.where(F.bit_count(F.col("_fp").bitwiseXOR(F.col("_item_fp"))) <= radius)
    both = _common(F.col("_win"), F.col("_item_sh"))
    # a pair that meets in several blocks is compared in the first of them alone
    first = F.lit(False)
    for i, (shift, width) in reversed(list(enumerate(blocks(radius)))):
        same = _shifted(F.col("_fp").bitwiseXOR(F.col("_item_fp")), shift).bitwiseAND(F.lit((1 << width) - 1)) == 0
        first = F.when(same, F.col("_b") == i).otherwise(first)
    same_item = items.select(F.col("_item").alias("_of"), F.xxhash64("_item_sh").alias("_content"), "_item_sh")
    pairs = near.where(first).join(same_item, (near["_content"] == same_item["_content"]) & near["_item"].eqNullSafe(same_item["_of"]))
    scored = pairs.withColumn("_common", both)
    score = F.col("_common") / (F.size("_win") + F.size("_item_sh") - F.col("_common"))
    scored = scored.withColumn("_s", score).where(F.col("_s") >= similarity)
    best = F.max(F.struct("_s", (-F.col("_start")).alias("_neg"))).alias("_best")
    return scored.groupBy("_key", "_id", "_item").agg(best).select(
        "_key", "_id", "_item", F.col("_best._s").alias("similarity"), (-F.col("_best._neg")).alias("_start")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows in which no item leaked, with their columns as they came."""
    found = leaks(docs, benchmark, id_col, text_col).select("_key").distinct()
    return whole_rows(docs, id_col, text_col).join(found, "_key", "left_anti").select("_row.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark).select(
        F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"), "similarity", F.col("_start").cast("bigint").alias("start_word")
    )
