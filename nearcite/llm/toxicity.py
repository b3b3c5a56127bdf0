"""Toxicity: a factorization machine over hashed terms, which weighs pairs of terms as well as terms.

A linear score adds what each term says by itself. The machine adds, for every pair of terms that a text holds, the
product of two learned vectors: an insult beside the mention of a group can weigh more than both alone.

Terms are words and their first letters, hashed into a fixed number of buckets. Counts of all labelled training
texts tell which buckets stand in one class more than chance explains; the machine is fitted on those, on Spark,
over all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import stored
from nearcite.llm.ranked_search import terms_of
from nearcite.llm.tokens import slices

BUCKETS = 1 << 18
#: Words count whole and by so many first letters: inflected and compound words share their stems.
STEMS = (4, 5)
#: Standard errors by which a bucket's share of the classes must differ from chance, and texts that must hold it.
LEAST_Z, LEAST_TEXTS = 4.0, 3
#: Inputs of the machine. A gradient step takes as long as texts times inputs, so their number does not grow with the data.
TELLING = 1024
FACTORS, STEPS, STEP_SIZE, REGULARIZATION, SEED = 8, 80, 0.1, 1e-4, 17
#: Most labelled texts that the machine is fitted on, and the files they are kept in.
FIT_ROWS, FIT_FILES = 200_000, 8
#: Words whose buckets a task remembers.
WORDS_KNOWN = 200_000
THRESHOLD = 0.7
HELD_OUT = 1  # of three


def held_out(identity: Column) -> Column:
    """Rows that nothing is learned from; rows without an id have no labels and are not held out."""
    return F.coalesce(F.crc32(identity.cast("string")) % 3 == HELD_OUT, F.lit(False))


def buckets_of(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and its stems."""
    text = word.decode("utf-8", "surrogatepass")
    stems = [xxhash.xxh3_64_intdigest(text[:k].encode("utf-8", "surrogatepass"), seed=k) for k in STEMS if len(text) > k]
    return tuple(h % BUCKETS for h in [xxhash.xxh3_64_intdigest(word), *stems])


def _bucketer(chosen: list[int] | None):
    """Adds _buckets, the distinct buckets of a text (those chosen), in place of _text."""
    wanted = None if chosen is None else frozenset(chosen)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}  # of words met before
        for whole in batches:
            for batch in slices(whole, "_text"):
                found = []
                for raw in batch["_text"].cast(pa.binary()).to_pylist():
                    own: set[int] = set()
                    for word in set(terms_of(raw or b"")):
                        held = known.get(word)
                        if held is None:
                            held = tuple(b for b in buckets_of(word) if wanted is None or b in wanted)
                            if len(known) >= WORDS_KNOWN:
                                known.clear()
                            known[word] = held
                        own.update(held)
                    found.append(sorted(own))
                names = [n for n in batch.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(found, pa.list_(pa.int32()))], [*names, "_buckets"])

    return bucketed


def with_buckets(rows: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """The rows with _buckets instead of _text, their last column."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(_bucketer(chosen), f"{kinds}, _buckets array<int>")


def telling_buckets(rows: DataFrame, n: int, positive: int) -> list[int]:
    """Buckets whose texts' share of label 1 differs most from that of all; rows: _buckets, _y. At most TELLING numbers."""
    counts = rows.select(F.explode("_buckets").alias("_bucket"), "_y").groupBy("_bucket")
    counts = counts.agg(F.count("*").alias("n"), F.sum("_y").alias("y"))
    share = positive / n
    error = F.sqrt(F.col("n") * share * (1 - share))
    z = F.abs(F.col("y") - F.col("n") * share) / error
    telling = counts.where((F.col("n") >= LEAST_TEXTS) & (z >= LEAST_Z)).select("_bucket", z.alias("z"))
    return sorted(r["_bucket"] for r in telling.orderBy(F.desc("z"), "_bucket").limit(TELLING).collect())


def vectorized(rows: DataFrame, chosen: list[int]) -> DataFrame:
    """The rows with _x, the chosen buckets that a text holds; others are left out."""
    model = CountVectorizerModel.from_vocabulary([str(b) for b in chosen], inputCol="_terms", outputCol="_x").setBinary(True)
    return model.transform(rows.withColumn("_terms", F.col("_buckets").cast("array<string>"))).drop("_terms", "_buckets")


def fit(rows: DataFrame, **settings) -> FMClassificationModel:
    """The machine fitted on _x and _y by all tasks together, a gradient of all rows a step."""
    given = {"factorSize": FACTORS, "maxIter": STEPS, "stepSize": STEP_SIZE, "regParam": REGULARIZATION, "seed": SEED} | settings
    return FMClassifier(featuresCol="_x", labelCol="_y", initStd=0.01, **given).fit(rows)


def score(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "toxic", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """_id, held_out, score (0 to 1) and predicted for every row.

    The machine learns from rows that are not held out and have a label, at most ``fit_rows`` of them about,
    chosen by a hash of the id. A row labelled several times has the label that at least half of them give; null
    labels are left out. Without texts of both classes all rows score (ones + 1) / (labels + 2).

    Null and empty texts hold no term and score the constant of the machine. Rows without an id are not learned
    from. Rows that repeat are scored each and learned from each. Very long texts count whole; a term counts once
    a text. Extra columns are not read. An empty table gives no rows.
    """
    identity, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    docs = df.select(identity.alias("_id"), held_out(identity).alias("held_out"), text.alias("_text"))
    given = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{label_id_col}`").alias("_id"))
    given = given.agg((F.avg(F.col(f"`{label_col}`").cast("double")) >= 0.5).cast("double").alias("_y"))
    given = stored(given.where(F.col("_id").isNotNull() & ~held_out(F.col("_id"))), "given-labels")
    share = min(1.0, 0.9 * fit_rows / max(given.count(), 1))
    sample = given.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 31)) < F.lit(share * (1 << 31)))
    train = stored(with_buckets(docs.join(F.broadcast(sample), "_id").select("_y", "_text")), "training-texts")
    counts = train.agg(F.count("*").alias("n"), F.sum("_y").alias("y")).collect()[0]
    n, positive = counts["n"], counts["y"] or 0
    chosen = telling_buckets(train, n, positive) if 0 < positive < n else []
    if not chosen:
        value = F.lit(float((positive + 1) / (n + 2)))
        return docs.select("_id", "held_out", value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
    # the sample is bounded and a text holds few telling buckets: a few files, which every step reads
    machine = fit(stored(vectorized(train, chosen).coalesce(FIT_FILES), "training-vectors"))
    rows = vectorized(with_buckets(docs, chosen), chosen)
    machine.setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
    value = F.get(vector_to_array("_p"), F.lit(1))
    return machine.transform(rows).select("_id", "held_out", value.alias("score"), (value >= threshold).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).withColumnRenamed("_id", "doc_id")
