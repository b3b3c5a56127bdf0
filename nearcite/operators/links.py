"""The links of a corpus as tables, and a filter that tells which of them can matter to a batch of queries.

``link_table`` holds every link once, under the document that lists it, in pieces of bounded size and with a mark
on those that lead out of the corpus; ``links_by_target`` turns it round. ``Membership`` is a Bloom filter of keys,
kept as words of 64 bits: a test reads one word. It is applied to links before they are shuffled to the node set of
their query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearcite.schema import LINK_COLUMNS

# Links of a row are handed on in pieces of so many, so that no row of a join grows with one document.
CHUNK = 4096

BITS_PER_KEY = 16
#: 8 MB of words. Beyond 4 million keys more links pass; the join behind the filter decides in any case.
MOST_WORDS = 1 << 20


def link_ids(df: DataFrame, name: str) -> Column:
    """Array of ids of a link column, whether its elements are structs or strings."""
    element = df.schema[name].dataType.elementType
    ids = F.col(name)
    if isinstance(element, T.StructType):
        ids = F.transform(ids, lambda item: item["publication_number"])
    return F.coalesce(ids, F.array().cast("array<string>"))


def link_count(*names: str) -> Column:
    """Length of link arrays together, missing ones counting 0."""
    return sum((F.coalesce(F.greatest(F.size(n), F.lit(0)), F.lit(0)) for n in names), F.lit(0))


def link_array(source: DataFrame) -> Column:
    """All links of a row as structs ``(rel, pos, other)``; rel numbers LINK_COLUMNS from 0, pos starts at 1.

    Loops onto the row itself and empty ids are left out.
    """

    def places(rel: int, name: str) -> Column:
        return F.transform(
            link_ids(source, name),
            lambda other, at: F.struct(F.lit(rel).alias("rel"), (at + 1).alias("pos"), other.alias("other")),
        )

    links = F.concat(*[places(rel, name) for rel, name in enumerate(LINK_COLUMNS)])
    empty = F.array(F.lit(""), F.coalesce("publication_number", F.lit("")))
    return F.filter(links, lambda link: ~F.array_contains(empty, F.coalesce(link["other"], F.lit(""))))


def link_pieces(source: DataFrame) -> DataFrame:
    """``(publication_number, links)``: the links of every document that has some, at most CHUNK a row."""
    shaped = source.where(link_count(*LINK_COLUMNS) > 0).select("publication_number", link_array(source).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all"), F.lit(1)), F.lit(CHUNK))
    pieces = shaped.select("publication_number", "all", F.explode_outer(starts).alias("start"))
    return pieces.select("publication_number", F.slice("all", F.col("start"), F.lit(CHUNK)).alias("links"))


def link_table(corpus: DataFrame) -> DataFrame:
    """``(publication_number, links)`` with links ``(rel, pos, other, known)``; known if the corpus has the other.

    The ids that links name are made distinct before they meet the corpus, and the links of a document come
    together again in pieces, so neither a document of very many links nor one that very many name is one row.
    """
    pieces = link_pieces(corpus).withColumn("piece", F.monotonically_increasing_id())
    flat = pieces.select("publication_number", "piece", F.inline("links"))
    ids = corpus.select(F.col("publication_number").alias("other"), F.lit(True).alias("known"))
    named = flat.select("other").distinct().join(ids, "other")
    marked = flat.join(named, "other", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    links = F.array_sort(F.collect_list(F.struct("rel", "pos", "other", "known")))
    return marked.groupBy("publication_number", "piece").agg(links.alias("links")).drop("piece")


def links_by_target(links: DataFrame) -> DataFrame:
    """The same links under the document they name: ``(other, known, publication_number, rel, pos)``."""
    return links.select("publication_number", F.inline("links")).select("other", "known", "publication_number", "rel", "pos")


class Membership:
    """A Bloom filter of the keys in a table: ``may_hold`` is true for all of them and for few others."""

    def __init__(self, keys: DataFrame, columns: list[str], n: int | None = None):
        n = keys.count() if n is None else n
        self.words = min(MOST_WORDS, 1 << max(0, math.ceil(math.log2(max(n, 1) * BITS_PER_KEY / 64))))
        word, mask = self._place(F.xxhash64(*columns))
        set_words = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
        # one row of at most MOST_WORDS numbers, whatever the keys are
        every = keys.sparkSession.range(self.words).withColumnRenamed("id", "word").join(set_words, "word", "left")
        filled = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
        self.table = every.agg(F.transform(filled, lambda x: x["bits"]).alias("member_bits"))

    def _place(self, key: Column) -> tuple[Column, Column]:
        """The word of a key and the three bits of it that are the key's."""
        places = [F.shiftrightunsigned(key, at).bitwiseAND(F.lit(63)).cast("int") for at in (40, 46, 52)]
        bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), place) for place in places]
        mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])
        return key.bitwiseAND(F.lit(self.words - 1)), mask

    def joined(self, df: DataFrame) -> DataFrame:
        """The rows beside the one row of words, ``member_bits``."""
        return df.withColumn("member_bits", self.table.scalar())

    def may_hold(self, *columns: Column) -> Column:
        """For rows that went through ``joined``."""
        word, mask = self._place(F.xxhash64(*columns))
        return F.get("member_bits", word.cast("int")).bitwiseAND(mask) == mask
