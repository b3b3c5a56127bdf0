"""Resolve messy publication or application numbers against the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearcite.functions.text import clean_id, id_number, is_formatted_id
from nearcite.session import materialize
from nearcite.sources.ranges import StoredCorpus

# Kind codes tried first, in this order.
KIND_CODES = ("B1", "B2", "A1")

STEPS = ("formatted", "suffix", "prefix", "application")
MODES = {
    "auto": STEPS,
    "publication": ("formatted", "suffix", "prefix"),
    "application": ("application",),
}


def resolve_ids(
    inputs: DataFrame, corpus: DataFrame | StoredCorpus, mode: str = "auto", *, raw: str = "raw", steps: tuple[str, ...] | None = None
) -> DataFrame:
    """Add ``(publication_number, step, found)`` to every input row; misses stay, as nulls.

    Steps in order: an id that is already formatted is taken as it is (``found`` tells whether the
    corpus has it); a bare number is tried with the usual kind codes, then as a prefix (shortest id
    first), then as an application number.

    All steps share one pass over the corpus: inputs and corpus rows both name the lookup keys they
    can meet under, and one equi-join brings them together. Inputs are reduced to distinct numbers
    before it, and the best match is a minimum, so repeated inputs and short prefixes combine early.

    In a corpus stored by key range, ids are looked up in the ranges they fall in and prefixes in those they meet;
    only application numbers read all of it.
    """
    steps = steps or MODES[mode]
    spelled = inputs.withColumn("_cleaned", clean_id(F.col(raw)))
    wanted = spelled.select("_cleaned").where(F.col("_cleaned") != "").distinct()
    matched = _matches(wanted, corpus, steps)
    resolved = spelled.join(matched, "_cleaned", "left")
    taken_as_is = is_formatted_id(F.col("_cleaned")) if "formatted" in steps else F.lit(False)
    return resolved.select(
        *inputs.columns,
        F.coalesce("_match", F.when(taken_as_is, F.col("_cleaned"))).alias("publication_number"),
        F.coalesce("_step", F.when(taken_as_is, F.lit("formatted"))).alias("step"),
        F.col("_match").isNotNull().alias("found"),
    )


def cleaned_inputs(inputs: DataFrame, *, raw: str = "raw") -> DataFrame:
    """How each input reads after cleanup: ``(cleaned, formatted, number)``; null number = rejected."""
    cleaned = clean_id(F.col(raw))
    return inputs.select(
        *inputs.columns,
        cleaned.alias("cleaned"),
        is_formatted_id(cleaned).alias("formatted"),
        id_number(cleaned).alias("number"),
    )


def _matches(wanted: DataFrame, corpus: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    looked_up = wanted.select("_cleaned", F.inline(_wanted_keys(F.col("_cleaned"), steps)))
    if isinstance(corpus, StoredCorpus):
        looked_up = materialize(looked_up)
        offered = _offered_by_ranges(corpus, looked_up.select("key").distinct(), steps)
    else:
        offered = _offered(corpus, steps)
    best = F.min(F.struct("step", "preference", "size", "publication_number"))
    return (
        offered.join(looked_up, "key")
        .groupBy("_cleaned")
        .agg(best.alias("best"))
        .select(
            "_cleaned",
            F.col("best.publication_number").alias("_match"),
            F.element_at(F.array(*map(F.lit, STEPS)), F.col("best.step") + 1).alias("_step"),
        )
    )


def _offered(corpus: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """``(key, size, publication_number)``: the best row of each key.

    It does not depend on who asks, so each key keeps one before the join. A digit that begins most ids is then one
    row rather than most of the corpus.
    """
    is_prefix = F.col("key").startswith("prefix:")
    keyed = corpus.select("publication_number", F.explode(_offered_keys(steps)).alias("key"))
    size = F.when(is_prefix, F.length("publication_number")).otherwise(0)
    best = F.min(F.struct(size.alias("size"), "publication_number")).alias("best")
    return keyed.groupBy("key").agg(best).select("key", "best.*")


def _offered_by_ranges(store: StoredCorpus, keys: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """The same for the keys asked for, a row a key at most."""

    def named(kind: str) -> DataFrame:
        return keys.where(F.col("key").startswith(f"{kind}:")).select(F.substr("key", F.lit(len(kind) + 2)).alias("name"))

    pub, none = F.col("publication_number"), F.lit(0).alias("size")
    ids = store.lookup(named("id").withColumnRenamed("name", "publication_number"), ["publication_number"])
    parts = [ids.select(F.concat(F.lit("id:"), pub).alias("key"), none, pub)]
    if "prefix" in steps:
        prefixes = store.best_of_prefix(named("prefix").withColumnRenamed("name", "prefix"))
        parts.append(prefixes.select(F.concat(F.lit("prefix:"), "prefix").alias("key"), "size", pub))
    if "application" in steps:
        rows = store.read().select(F.concat(F.lit("application:"), "application_number").alias("key"), pub)
        rows = rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min(pub).alias("publication_number"))
        parts.append(rows.select("key", none, "publication_number"))
    return reduce(DataFrame.unionByName, parts)


def _wanted_keys(cleaned: Column, steps: tuple[str, ...]) -> Column:
    """Lookup keys of one cleaned input: structs of (key, step, preference)."""
    number = id_number(cleaned)

    def entry(key: Column, step: str, preference: int = 0) -> Column:
        return F.struct(
            key.alias("key"), F.lit(STEPS.index(step)).alias("step"), F.lit(preference).alias("preference")
        )

    keys = []
    if "formatted" in steps:
        keys.append(entry(F.when(is_formatted_id(cleaned), F.concat(F.lit("id:"), cleaned)), "formatted"))
    if "suffix" in steps:
        keys += [
            entry(F.concat(F.lit("id:US-"), number, F.lit(f"-{kind}")), "suffix", i)
            for i, kind in enumerate(KIND_CODES)
        ]
    if "prefix" in steps:
        keys.append(entry(F.concat(F.lit("prefix:US-"), number), "prefix"))
    if "application" in steps:
        keys.append(entry(F.concat(F.lit("application:"), number), "application"))
    return F.filter(F.array(*keys), lambda k: k["key"].isNotNull())


def _offered_keys(steps: tuple[str, ...]) -> Column:
    """Lookup keys of one corpus row. A number prefix can only end within the digits of the id."""
    pub = F.col("publication_number")
    keys = []
    if "formatted" in steps or "suffix" in steps:
        keys.append(F.array(F.concat(F.lit("id:"), pub)))
    if "prefix" in steps:
        digits = F.regexp_extract(pub, "^US-([0-9]+)", 1)
        keys.append(
            F.when(
                F.length(digits) > 0,
                F.transform(
                    F.sequence(F.lit(1), F.length(digits)),
                    lambda n: F.concat(F.lit("prefix:US-"), F.substring(digits, 1, n)),
                ),
            ).otherwise(F.array().cast("array<string>"))
        )
    if "application" in steps:
        keys.append(F.array(F.concat(F.lit("application:"), F.col("application_number"))))
    return F.array_compact(F.concat(*keys))
