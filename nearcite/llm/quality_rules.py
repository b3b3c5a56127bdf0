"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample.

Native: every measure and rule is a DataFrame expression.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import SPACE, let, stored, words

SAMPLE_ROWS, REPEATS = 2000, 3
WINDOW = 5
RUN = 1000


def _parts(df: DataFrame, text_col: str) -> DataFrame:
    """Rows as struct _row, with the text _t, its words _w and the lines _l that have a word.

    An outer explode of one struct keeps what reads words and lines from cutting the text again.
    """
    out = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t")
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = F.array(F.struct(words(F.col("_t")).alias("w"), lines.alias("l")))
    return out.select("_row", "_t", F.explode_outer(cut).alias("_cut")).select("_row", "_t", F.col("_cut.w").alias("_w"), F.col("_cut.l").alias("_l"))


def measures() -> dict[str, Column]:
    """Measures over _t, _w and _l.

    Windows are compared by 64-bit hashes. Only texts in which some window occurs twice pay for finding
    its places: they are sorted by hash, and the union of intervals is a sum over sorted places.
    """
    return {
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length(F.regexp_replace("_t", SPACE, "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
        "n_repeat_words": let(F.transform("_w", lambda x: F.xxhash64(x)), lambda h: let(_windows(h), _repeated)),
        "n_lines": F.size("_l").cast("bigint"),
    }


def with_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds a struct column ``_m`` of all measures."""
    return _parts(df, text_col).select("_row", "_w", "_l", F.struct(*[c.alias(n) for n, c in measures().items()]).alias("_m"))


def _windows(h: Column) -> Column:
    window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    return F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), window)).otherwise(
        F.array().cast("array<bigint>")
    )


def _repeated(g: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    none = F.lit(0).cast("bigint")

    def places(z: Column) -> Column:
        same = lambda x, k: (x["h"] == F.get(z, k - 1)["h"]) | (x["h"] == F.get(z, k + 1)["h"])
        return F.sort_array(F.filter(F.transform(z, lambda x, k: F.when(same(x, k), x["i"])), lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        step = lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("bigint")
        return F.aggregate(F.transform(p, step), none, lambda a, x: a + x)

    placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(let(placed, lambda z: let(places(z), covered)))


def base_rules(m: dict[str, Column]) -> dict[str, Column]:
    """The rules of the contract, apart because one is cheap."""
    return {"base_words": m["n_words"] < 10, "base_repeats": 100 * m["n_repeat_words"] > 20 * m["n_words"]}


def _different(w: Column) -> Column:
    """Distinct words of every run of so many words, added up: a share of them does not fall as a text grows."""
    runs = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(RUN))
    return F.aggregate(F.transform(runs, lambda i: F.size(F.array_distinct(F.slice(w, i, RUN)))), F.lit(0), lambda a, x: a + x)


def rules(m: dict[str, Column]) -> dict[str, Column]:
    """Rules that reject, over measures: stored ones, or expressions that a rule works out when its turn comes."""
    w, lines = F.col("_w"), F.col("_l")
    share = lambda keep: F.size(F.filter(w, keep))
    return {
        "symbols": 10 * m["n_symbols"] > m["word_chars"],
        "duplicate_lines": (m["n_lines"] >= 4) & (2 * m["n_dup_lines"] > m["n_lines"]),
        "word_length": (m["word_chars"] > 40 * m["n_words"]) | (2 * m["word_chars"] < 3 * m["n_words"]),
        "upper_case": 2 * share(lambda x: x.rlike(r"^[^a-z]*[A-Z]{2}[^a-z]*$")) > m["n_words"],
        "wordless": 2 * share(lambda x: ~x.rlike(r"\p{L}")) > m["n_words"],
        "repeated_words": (m["n_words"] >= 20) & (10 * _different(w) < m["n_words"]),
        "cut_lines": (m["n_lines"] >= 4) & (2 * F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) > m["n_lines"]),
        "bullets": (m["n_lines"] >= 4) & (10 * F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[•*\-]\s"))) > 9 * m["n_lines"]),
    }


def rule_order(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, rejected share, seconds a row) by rejection per cost, from a bounded random sample.

    A rule's cost is that of all it needs, measures included. The rows of the sample are judged several times
    within one job, and what a job without a rule takes is taken off. The order changes how soon a bad row is let
    go, never the verdict, so timings need not repeat.
    """
    table = stored(df.select(F.col(f"`{text_col}`").alias("text")).sample(0.05, seed).limit(sample_rows), "rule-sample")
    sample = stored(_parts(table, "text").drop("_row"), "rule-parts")
    total = max(sample.count(), 1)
    often = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("_again"))

    def timed(rule: Column) -> tuple[int, float]:
        began = time.perf_counter()
        rejected = often.agg(F.count_if(rule).alias("n"), F.max("_again")).collect()[0]["n"]
        return rejected, time.perf_counter() - began

    timed(F.length("_t") < 0)
    idle = timed(F.length("_t") < 0)[1]
    found = []
    every = measures()
    for name, rule in {**base_rules(every), **rules(every)}.items():
        rejected, seconds = timed(rule)
        found.append((name, rejected / total / REPEATS, max(seconds - idle, 1e-6) / total / REPEATS))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0]))


def quality(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows as struct ``_row`` with their measures ``_m``, base_failed, rejected_by and kept.

    Null texts count as empty and fail the base rule; very long texts are measured whole; repeated rows are
    judged one by one; an empty table gives no rows; columns of any name are carried inside ``_row``.
    """
    m = {n: F.col(f"_m.{n}") for n in measures()}
    base = base_rules(m)
    failed = base["base_words"] | base["base_repeats"]
    verdict = F.when(failed, F.lit("base"))
    expressions = rules(m)
    for name, _, _ in rule_order(df, text_col, sample_rows):
        if name in expressions:
            verdict = verdict.when(expressions[name], F.lit(name))
    return with_measures(df, text_col).select("_row", "_m", failed.alias("base_failed"), verdict.alias("rejected_by")).withColumn(
        "kept", F.col("rejected_by").isNull()
    )


def filter_documents(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with their columns as they came.

    The cascade cut short: measures that several rules share are worked out once, all else that a rule needs, such as
    the contract's repeated windows, in its turn, so a row that an early rule rejects never pays for it.
    """
    every = measures()
    shared = {n: c for n, c in every.items() if n != "n_repeat_words"}
    rows = _parts(df, text_col).select("_row", "_w", "_l", F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in shared.items()]))).alias("_m"))
    m = {n: F.col(f"_m.{n}") for n in shared} | {"n_repeat_words": every["n_repeat_words"]}
    expressions = {**base_rules(m), **rules(m)}
    kept = F.when(F.col("_w").isNull(), F.lit(False))
    for name, _, _ in rule_order(df, text_col, sample_rows):
        kept = kept.when(expressions[name], F.lit(False))
    return rows.where(kept.otherwise(F.lit(True))).select("_row.*")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality(slim).select(
        F.col("_row.doc_id"), *[F.col(f"_m.{n}") for n in names], "base_failed", "kept"
    )
