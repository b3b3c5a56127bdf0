"""License scan: exact containment join of text blocks with license templates. Native."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearcite.llm.common import WORDLESS, keyed_texts, let, small, stored, whole_rows

CONTAINMENT = 0.8
#: The phrases and labels of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Customary notices, by label, and the words that name the license and must stand in a block.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at", "license"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License", "license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "redistribution"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
     "the documentation and/or other materials provided with the distribution", "redistributions"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "creative commons sharealike"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "general public"),
    ("gpl", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License", "general public"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
     "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", "general public"),
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
     "so, subject to the following conditions", "permission"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
    ("reserved", "Copyright holder. All rights reserved", "rights reserved"),
]


def template_table(spark: SparkSession, templates: list[tuple] | None = None) -> DataFrame:
    """_tpl, _label, the distinct lower-case words _words of each template, those of its _names, and _size.

    A template is a label, a text and, if some of its words must stand in a block, those. A block is a run of
    _size words: as many more than the template has as it may lack. A fixed, short list.
    """
    rows = [(i, t[0], t[1], t[2] if len(t) > 2 else "") for i, t in enumerate(TEMPLATES if templates is None else templates)]
    table = spark.createDataFrame(rows, "_tpl int, _label string, _text string, _named string")
    words = _bare_words(F.col("_text"))
    return table.select(
        "_tpl", "_label", F.array_distinct(words).alias("_words"), _bare_words(F.col("_named")).alias("_names"), F.size(words).alias("_size")
    ).where(F.size("_words") > 0)


def _bare_words(text: Column) -> Column:
    bare = F.btrim(F.regexp_replace(F.lower(text), WORDLESS, " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _held(texts: DataFrame, vocabulary: list[str], least: int) -> DataFrame:
    """_key and _found: the template words of each text that has enough of them to match any template."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = texts.select("_key", F.array_intersect(known, F.split(F.lower("_text"), WORDLESS)).alias("_found"))
    return found.where(F.size("_found") >= least)


def _best_block(words: Column, template: Column, names: Column, size: Column) -> Column:
    """Most template words in any block of a text that has the names; a best block begins with a template word."""

    def held(block: Column) -> Column:
        named = F.size(F.array_intersect(names, block)) == F.size(names)
        return F.when(named, F.size(block)).otherwise(0)

    def best(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(template, x), i)), lambda i: i.isNotNull())
        return F.array_max(F.transform(places, lambda i: let(F.array_intersect(template, F.slice(w, i + 1, size)), held)))

    return F.coalesce(let(words, best), F.lit(0))


def matches(df: DataFrame, id_col: str, text_col: str, containment: float, templates: list[tuple] | None = None) -> DataFrame:
    """_key, _label, _score: every text with a block whose words contain at least this share of a template's words.

    Blocks are runs of consecutive words, whatever lines they stand on. A text that holds a block holds its words,
    so texts and templates meet by their words first. Those of the templates alone can overlap, so a text is
    reduced to them; one with fewer than any template needs is dropped at once (length filter). Words are ordered
    by the number of texts they stand in, rarest first. With an overlap of a words needed, the first |T| - a + 1
    words of a template and the first |X| - a + 1 of a text must share one (prefix filter), and what follows the
    shared word on both sides must suffice (positional filter). Every block of the pairs left is compared in full.
    """
    spark = df.sparkSession
    table = template_table(spark, templates)
    listed = table.collect()  # the fixed list of templates
    need = {r["_tpl"]: math.ceil(containment * len(r["_words"]) - 1e-9) for r in listed}
    vocabulary = sorted({w for r in listed for w in r["_words"]})
    texts = keyed_texts(df, id_col, text_col)
    held = stored(_held(texts, vocabulary, min(need.values())), "license-words")
    counted = held.select(F.explode("_found").alias("w")).groupBy("w").count().collect()  # one row a template word
    frequency = {r["w"]: r["count"] for r in counted}
    ranked = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    order = F.array(*[F.lit(w) for w in ranked])
    ordered = held.select("_key", F.array_intersect(order, F.col("_found")).alias("_found"))
    prefixes = [
        (r["_tpl"], word, i, len(r["_words"]), need[r["_tpl"]], sorted(r["_words"], key=rank.get))
        for r in listed
        for i, word in enumerate(sorted(r["_words"], key=rank.get)[: len(r["_words"]) - need[r["_tpl"]] + 1])
    ]
    postings = F.broadcast(spark.createDataFrame(prefixes, "_tpl int, _word string, _i int, _len int, _need int, _words array<string>"))
    pairs = ordered.select("_key", "_found", F.posexplode("_found").alias("_j", "_word")).join(postings, "_word")
    pairs = pairs.where(
        (F.size("_found") >= F.col("_need"))
        & (F.col("_j") <= F.size("_found") - F.col("_need"))
        & (1 + F.least(F.col("_len") - F.col("_i") - 1, F.size("_found") - F.col("_j") - 1) >= F.col("_need"))
    )
    pairs = pairs.where(F.size(F.array_intersect("_found", "_words")) >= F.col("_need"))
    pairs = stored(pairs.select("_key", "_tpl").distinct(), "license-pairs")
    hit = texts.join(small(pairs.select("_key").distinct()), "_key", "left_semi").dropDuplicates(["_key"])
    hit = stored(hit.select("_key", _bare_words(F.col("_text")).alias("_w")), "license-texts")
    rule = table.select(
        "_tpl", "_label", F.col("_words").alias("_t"), "_names", F.ceil(F.col("_size") / containment - 1e-9).cast("int").alias("_run"),
        F.ceil(containment * F.size("_words") - 1e-9).cast("int").alias("_need"),
    )
    tried = pairs.join(F.broadcast(rule), "_tpl").join(hit, "_key")
    tried = tried.withColumn("_most", _best_block(F.col("_w"), F.col("_t"), F.col("_names"), F.col("_run")))
    reached = tried.where(F.col("_most") >= F.col("_need"))
    return reached.groupBy("_key", "_label").agg(F.max(F.col("_most") / F.size("_t")).alias("_score"))


def base_places(text: Column) -> Column:
    """Struct of n_words, n_base, first_word, last_word and base_labels of a text.

    Only a text that has a phrase, however its words are set apart, is rebuilt with single blanks and cut at
    the phrases: words before the first and after the last cut give the places.
    """
    gap = WORDLESS
    loose = "(?i)" + "|".join(p.replace(" ", gap) for p in PHRASES)
    exact = "(?i)(?<= )(?:" + "|".join(PHRASES) + ")(?= )"
    edge = lambda x: F.when(x == "", F.lit(1)).otherwise(F.lit(0))
    count = lambda w: F.greatest(F.lit(0), F.size(w) - edge(F.get(w, F.lit(0))) - edge(F.get(w, F.size(w) - 1)))
    n_words = let(F.split(text, gap), count).cast("bigint")
    joined = F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, gap, " ")), F.lit(" "))
    blanks = lambda x: F.length(F.regexp_replace(x, "[^ ]+", "")) - 1

    def places(j: Column) -> Column:
        found = F.regexp_extract_all(j, F.lit(exact), F.lit(0))

        def cut(parts: Column) -> Column:
            n = F.size(parts) - 1
            before = blanks(F.get(parts, F.lit(0)))
            after = blanks(F.get(parts, n))
            phrase = let(found, lambda f: blanks(F.get(f, n - 1)) + 2)
            labels = [F.when(j.rlike(f"(?i)(?<= ){p}(?= )"), F.lit(label)) for p, label in PHRASES.items()]
            return F.struct(
                n.cast("bigint").alias("n_base"),
                F.when(n > 0, before.cast("bigint")).alias("first_word"),
                F.when(n > 0, (blanks(j) - after - phrase).cast("bigint")).alias("last_word"),
                F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("labels"),
            )

        return let(F.split(j, exact), cut)

    none = F.struct(
        F.lit(0).cast("bigint").alias("n_base"), F.lit(None).cast("bigint").alias("first_word"),
        F.lit(None).cast("bigint").alias("last_word"), F.array().cast("array<string>").alias("labels"),
    )
    return F.struct(n_words.alias("n_words"), F.when(text.rlike(loose), let(joined, places)).otherwise(none).alias("base"))


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT,
    templates: list[tuple] | None = None,
) -> DataFrame:
    """Every row as struct ``_row`` with n_words, its base places and labels, all labels and the best containment.

    A block is a run of words of about the template's length; line ends are white space. Null and empty texts have
    no words and no labels; a score is 0 where no block reaches the threshold and no phrase stands (1 where one
    does); of several blocks the best counts; rows of equal id and text share a result; very long texts are searched
    whole; other columns are carried in ``_row``; an empty table gives no rows.
    """
    found = matches(df, id_col, text_col, containment, templates)
    per_row = found.groupBy("_key").agg(F.collect_set("_label").alias("_labels"), F.max("_score").alias("_score"))
    rows = whole_rows(df, id_col, text_col)
    rows = rows.select("_row", "_key", base_places(F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))).alias("_b"))
    both = rows.join(per_row, "_key", "left")
    base = F.col("_b.base.labels")
    labels = F.array_sort(F.array_union(base, F.coalesce(F.col("_labels"), F.array().cast("array<string>"))))
    return both.select(
        "_row", F.col("_b.n_words").alias("n_words"), "_b.base.n_base", "_b.base.first_word", "_b.base.last_word",
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("_score"), F.lit(0.0))).alias("score"),
    )


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return scan(slim).select("_row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


