"""Line dedup over overlapping windows of three lines. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import SPACES, keyed_texts, let, stored, whole_rows

WINDOW = 3


def _worded(lines: Column) -> Column:
    """Indexes of the lines that have a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())


def _window_hashes(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(lines, lambda x: F.xxhash64(F.btrim(x, F.lit(SPACES))))

    def windows(h: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        return F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), window)).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(hashes, windows)


def covered_starts(rows: DataFrame) -> DataFrame:
    """_key and the sorted starts of the windows that occurred before: earlier in the text, or in a row of smaller id.

    Windows are counted with a combine before the shuffle; only the windows found twice meet their places.
    """
    places = stored(
        rows.select("_id", "_key", F.posexplode_outer(_window_hashes(F.col("_text"))).alias("_at", "_hash")).where("_hash IS NOT NULL"),
        "line-windows",
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_key", "_at")).alias("_first")
    twice = stored(places.groupBy("_hash").agg(F.count("*").alias("_n"), first).where("_n > 1"), "line-repeats")
    later = places.join(twice, "_hash").where(
        (F.col("_key") != F.col("_first._key")) | (F.col("_at") != F.col("_first._at"))
    )
    return later.groupBy("_key").agg(F.sort_array(F.collect_set("_at")).alias("_starts"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row as struct ``_row``, its text without later occurrences, n_lines and n_removed.

    Lines without a word stand in no window; those between two removed lines go with them. A row keeps its
    first occurrence: the smallest id, null last. Rows equal in id and text are one document: each gets the
    same result. Null texts stay null; texts of fewer than three lines with words stay as they are, and a
    text may become empty. Long texts and any number of lines: the kept lines are slices between the merged
    covered positions, in linear time.
    """
    starts = covered_starts(keyed_texts(df, id_col, text_col))
    joined = whole_rows(df, id_col, text_col).join(starts, "_key", "left").withColumn("_t", F.col(f"_row.`{text_col}`"))
    kept = let(
        F.split("_t", "\n"), lambda lines: let(_worded(lines), lambda worded: _slices(lines, worded, F.col("_starts")))
    )
    changed = let(
        kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), (F.size(F.split("_t", "\n")) - F.size(k)).cast("bigint").alias("n"))
    )
    joined = joined.withColumn("_new", F.when(F.col("_starts").isNotNull(), changed))
    return joined.select(
        "_row",
        F.when(F.col("_new").isNotNull(), F.col("_new.text")).otherwise(F.col("_t")).alias("text"),
        F.coalesce(F.col("_new.n"), F.lit(0).cast("bigint")).alias("n_removed"),
    )


def _slices(lines: Column, worded: Column, starts: Column) -> Column:
    """The lines between the covered intervals: from after window i - 1 to before window i."""
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(worded, F.get(starts, i - 1) + WINDOW - 1) + 1)
    end = lambda i: F.coalesce(F.get(worded, F.get(starts, i)), F.size(lines))
    between = lambda i: F.slice(lines, begin(i) + 1, F.greatest(F.lit(0), end(i) - begin(i)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), between))


def deduped_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with its texts after removal; n_chars, where there is such a column, follows the text."""
    out = dedup_lines(df, id_col, text_col)
    columns = {
        text_col: F.col("text"),
        "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("_row.`n_chars`")) if "n_chars" in df.columns else None,
    }
    return out.select(*[(columns[c] if columns.get(c) is not None else F.col(f"_row.`{c}`")).alias(c) for c in df.columns])


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return dedup_lines(slim).select("_row.doc_id", "text", "n_removed")
