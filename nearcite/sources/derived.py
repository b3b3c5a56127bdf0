"""The library's input tables, derived from a folder of star-schema parquet files.

There is no public extract of a citation corpus at hand, so ``embeddings`` becomes the documents,
``part`` and ``documents`` their titles and abstracts, ``orders`` the links between them and ``events``
the refresh log. Every row of ``embeddings``, ``orders`` and ``events`` takes part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearcite.functions.text import first_name
from nearcite.schema import CORPUS_COLUMNS
from nearcite.session import broadcast_small
from nearcite.sources.corpus import build_corpus

# Links between documents that an older copy of the corpus already knew, by the date of the link.
SNAPSHOT_LINKS_BEFORE = "1999-01-01"
SNAPSHOT_PUBLISHED_BEFORE = 20150101
# Pairs of a number and a short id that travel to the texts; beyond it texts move once more.
NUMBERS_SENT = 2_000_000

_REL_OF_PRIORITY = {
    "1-URGENT": "citation",
    "2-HIGH": "citation",
    "3-MEDIUM": "cited_by",
    "4-NOT SPECIFIED": "parent",
    "5-LOW": "child",
}
_STATE_OF_EVENT = {"error": "FAILED", "click": "RUNNING", "purchase": "PENDING"}


@dataclass
class Derived:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _count(self, name: str) -> Column:
        return self.table(name).select(F.count(F.lit(1)).alias("n")).scalar()

    def documents(self, published_before: int | None = None) -> DataFrame:
        """Flat document rows, one per vector, or those published by a date; all titles and texts that fall on them are used."""
        rows = self._facts(published_before)
        for name, key, text, value in (("part", "p_partkey", "p_name", "title_value"), ("documents", "doc_id", "text", "abstract_value")):
            rows = rows.join(self._joined(name, key, text, value, published_before), "publication_number", "left")
        return rows

    def _facts(self, published_before: int | None = None) -> DataFrame:
        vec = F.col("vec_id")
        year, month, day = vec % 25, 1 + vec % 12, 1 + vec % 28

        def date(first_year: int) -> Column:
            return ((first_year + year) * 10000 + month * 100 + day).cast("int")

        rows = self.table("embeddings").select(
            "vec_id",
            "label",
            "embedding",
            publication_number(vec).alias("publication_number"),
            (14000000 + vec * 3).cast("string").alias("application_number"),
            date(2000).alias("filing_date"),
            date(2002).alias("publication_date"),
            F.when(vec % 10 != 0, date(2004)).alias("grant_date"),
            F.when(vec % 50 == 7, "EP").otherwise("US").alias("country_code"),
        )
        return rows if published_before is None else rows.where(F.col("publication_date") < published_before)

    def _joined(self, name: str, key: str, text: str, value: str, published_before: int | None = None) -> DataFrame:
        """Every text of a table under the documents it falls on, several in the order of their keys.

        Numbers of documents go to the texts, which move once, to the key by which all parts of a document are joined;
        texts of documents that nobody asks for do not move.
        """
        size = F.least(self._count("embeddings"), self._count(name))
        vec = F.col("vec_id")
        falls = self._facts(published_before).where(vec.isNotNull()).select((vec % size).alias("index"), "publication_number")
        rows = self.table(name).select((F.col(key) % size).alias("index"), F.struct(key, text).alias("item"))
        parts = F.transform(F.array_sort(F.collect_list("item")), lambda x: x[text])
        return rows.join(broadcast_small(falls.distinct(), NUMBERS_SENT), "index").groupBy("publication_number").agg(F.array_join(parts, " ").alias(value))

    def links(self, before: str | None = None) -> DataFrame:
        """``(owner_id, rel, pos, other)``: every order links two documents, about one in eleven unknown."""
        order = Window.partitionBy("owner_id", "rel").orderBy("o_orderkey")
        return self._ordered_links(before).select("owner_id", "rel", F.row_number().over(order).alias("pos"), "other")

    def _ordered_links(self, before: str | None) -> DataFrame:
        """The links with the key that orders them."""
        n = self._count("embeddings")
        priority = F.create_map(*[F.lit(x) for pair in _REL_OF_PRIORITY.items() for x in pair])
        orders = self.table("orders")
        if before is not None:
            orders = orders.where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
        return orders.select(
            "o_orderkey",
            (F.col("o_orderkey") % n).alias("owner_id"),
            F.element_at(priority, F.col("o_orderpriority")).alias("rel"),
            publication_number(F.col("o_custkey") * 7 % (n + F.floor(n / 10))).alias("other"),
        )

    def _nested(self, before: str | None, texts: bool = True, published_before: int | None = None) -> DataFrame:
        """Document rows with their lists, with titles, texts and terms or without; all parts are joined by one key."""
        vec, label = F.col("vec_id"), F.col("label")

        def items(count: Column, item) -> Column:
            return F.transform(F.filter(F.array(*[F.lit(i) for i in (1, 2, 3)]), lambda pos: pos <= count), item)

        assignee = lambda pos: F.struct(
            F.when(vec % 17 == 5, "")
            .otherwise(F.concat(F.lit("ASSIGNEE "), label, F.lit("-"), (vec + pos) % 4))
            .alias("name"),
            F.col("country_code").alias("country"),
        )
        inventor = lambda pos: F.struct(
            F.when(vec % 31 != 2, F.concat(F.lit("INVENTOR "), (vec * 13 + pos * 5) % 97)).alias("name"),
            F.col("country_code").alias("country"),
        )
        code = lambda pos: F.struct(
            F.concat(
                F.when(vec % 23 == 3, "9")
                .when(vec % 29 == 1, "h")
                .otherwise(F.substring(F.lit("ABCDEFGHY"), ((label + pos) % 9 + 1).cast("int"), F.lit(1))),
                F.lpad((vec % 99).cast("string"), 2, "0"),
                F.lit("L63/10"),
            ).alias("code")
        )
        documents = (self.documents(published_before) if texts else self._facts(published_before)).withColumns(
            {
                "assignee_harmonized": items(vec % 3, assignee),
                "inventor_harmonized": items(1 + vec % 2, inventor),
                "cpc": items(1 + vec % 2, code),
                "embedding_v1": F.col("embedding").cast("array<double>"),
            }
        )

        def list_of(rel: str) -> Column:
            item = F.when(F.col("rel") == rel, F.struct("o_orderkey", F.col("other").alias("publication_number")))
            return F.transform(
                F.array_sort(F.collect_list(item)), lambda x: F.struct(x["publication_number"].alias("publication_number"))
            ).alias(rel)

        rels = sorted(set(_REL_OF_PRIORITY.values()))
        # The owner comes from the primary key of orders, so lists are of about equal length.
        owned = self._ordered_links(before).withColumn("publication_number", publication_number(F.col("owner_id")))
        lists = owned.groupBy("publication_number").agg(*[list_of(rel) for rel in rels])
        empty = F.array().cast("array<struct<publication_number:string>>")
        rows = documents.join(lists, "publication_number", "left").withColumns({rel: F.coalesce(rel, empty) for rel in rels})
        if not texts:
            return rows
        return rows.join(self._terms(), "publication_number", "left").withColumns(
            {
                "top_terms": F.coalesce("top_terms", F.array().cast("array<struct<value:string>>")),
                "title": F.struct(F.col("title_value").alias("value")),
                "abstract": F.struct(F.col("abstract_value").alias("value")),
            }
        )

    def _terms(self) -> DataFrame:
        parts = self.table("part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("value"))
        wanted = self.table("embeddings").select(
            "vec_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos")
        ).withColumn("part_id", (F.col("vec_id") + F.col("pos")) % self._count("part"))
        listed = F.array_sort(F.collect_list(F.struct("pos", "value")))
        return (
            wanted.join(parts, "part_id")
            .groupBy(publication_number(F.col("vec_id")).alias("publication_number"))
            .agg(F.transform(listed, lambda x: F.struct(x["value"].alias("value"))).alias("top_terms"))
        )

    def base(self, before: str | None = None) -> DataFrame:
        """Bibliographic source rows."""
        return self._nested(before, texts=False).select(
            "publication_number",
            "application_number",
            "filing_date",
            "publication_date",
            "grant_date",
            "assignee_harmonized",
            "inventor_harmonized",
            "citation",
            "parent",
            "child",
            "cpc",
            "country_code",
        )

    def research(self, before: str | None = None) -> DataFrame:
        """Semantic source rows."""
        return self._nested(before).select(
            "publication_number", "title", "abstract", "embedding_v1", "cited_by", "top_terms"
        )

    def corpus(self) -> DataFrame:
        return build_corpus(self.base(), self.research())

    def snapshot(self) -> DataFrame:
        """An older corpus: documents of any country published by then, with the links known then."""
        older = self._nested(SNAPSHOT_LINKS_BEFORE, published_before=SNAPSHOT_PUBLISHED_BEFORE)
        return older.withColumns(
            {
                "primary_assignee": first_name(F.col("assignee_harmonized")),
                "primary_inventor": first_name(F.col("inventor_harmonized")),
            }
        ).select(CORPUS_COLUMNS)

    def inputs(self) -> DataFrame:
        """One id per document as a user might type it: ``(input_id, raw)``."""
        vec = F.col("vec_id")
        number = (8000000 + vec).cast("string")
        kind = vec % 7
        raw = (
            F.when(kind == 0, number)
            .when(kind == 1, F.concat(F.lit("US"), number))
            .when(
                kind == 2,
                F.concat(
                    F.lit(" 8,"), F.substring(number, 2, 3), F.lit(","), F.substring(number, 5, 3), F.lit(" ")
                ),
            )
            .when(kind == 3, (14000000 + vec * 3).cast("string"))
            .when(kind == 4, F.concat(F.lit("us-"), number, F.lit("-b2")))
            .when(kind == 5, F.concat(F.lit("US-"), number))
            .otherwise(F.concat(F.lit("abc"), vec))
        )
        return self.table("embeddings").select(vec.alias("input_id"), raw.alias("raw"))

    def runs(self) -> DataFrame:
        """Run log of refresh jobs: ``(job_id, run_id, run_time, state, error)``."""
        states = F.create_map(*[F.lit(x) for pair in _STATE_OF_EVENT.items() for x in pair])
        state = F.coalesce(F.element_at(states, F.col("event_type")), F.lit("SUCCEEDED"))
        utc = F.expr("cast(convert_timezone('UTC', current_timezone(), ts) AS timestamp)")
        return self.table("events").select(
            F.col("user_id").alias("job_id"),
            F.col("event_id").alias("run_id"),
            utc.alias("run_time"),
            state.alias("state"),
            F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        )


def publication_number(vec_id: Column) -> Column:
    kind = vec_id % 10
    return F.concat(
        F.lit("US-"),
        8000000 + vec_id,
        F.when(kind == 0, "-A1").when(kind == 1, "-B1").when(kind == 9, "-E1").otherwise("-B2"),
    )
