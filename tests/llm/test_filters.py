"""Quality rules, line dedup, decontamination and license scan against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearcite.llm import decontamination, license_scan, line_dedup, quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BARE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "\n\n", "one", "a b c d e f g h i j k", "x " * 30, "x" * 30_000, "the cat sat on " * 2000,
    "tab\tand\x0bfeed\x0c here\r\nnext line", "é ü ß nbsp 日本   sep", "##### $$$ %%%", "l1 a\nl2 b\nl1 a\n\nl1 a \nl2 b",
    "All rights reserved. CC\tBY cc-by ccby All  Rights\nReserved", "cc by", "x general public license y", "Released under the MIT License",
]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, None, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


@pytest.mark.parametrize("source", ["given", "odd"])
def test_quality_measures(spark, docs, source):
    rows = docs if source == "given" else table(spark, ODD)
    got = {r["doc_id"]: r for r in quality_rules.report(rows).collect()}
    for doc in rows.collect():
        r = got[doc["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == measures(doc["text"])
        assert not (r["base_failed"] and r["kept"])


def test_cascade_order_does_not_change_the_verdict(spark, docs, monkeypatch):
    first = {tuple(r) for r in quality_rules.report(docs).select("doc_id", "kept").collect()}
    order = quality_rules.rule_order(docs)
    every = quality_rules.measures()
    assert {name for name, _, _ in order} == set(quality_rules.rules(every)) | set(quality_rules.base_rules(every))
    monkeypatch.setattr(quality_rules, "rule_order", lambda *a: list(reversed(order)))
    assert {tuple(r) for r in quality_rules.report(docs).select("doc_id", "kept").collect()} == first
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, k in first if k}


def test_clean_labelled_documents_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality_rules.report(docs).join(labels, "doc_id")
    assert judged.where("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
    assert judged.where("quality = 0 AND kept").count() <= 0.1 * judged.where("quality = 0").count()


def without_repeats(rows):
    """(key, text) after removing later windows of three lines with words, in the order of (id, key, place)."""
    seen, out = {}, {}
    places = []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hash(r[1]))):
        lines = (text or "").split("\n")
        worded = [i for i, x in enumerate(lines) if WORD.search(x)]
        for at in range(len(worded) - 2):
            window = tuple(lines[i].strip(" \t\n\x0b\x0c\r") for i in worded[at : at + 3])
            places.append(((doc, text), at, window, worded, lines))
    for key, at, window, _, _ in places:
        seen.setdefault(window, (key, at))
    covered = {}
    for key, at, window, worded, lines in places:
        if seen[window] != (key, at):
            covered.setdefault(key, set()).update(range(worded[at], worded[at + 2] + 1))
    for key in set(rows):
        lines = (key[1] or "").split("\n")
        gone = covered.get(key, set())
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else key[1]
    return out


def test_line_dedup(spark, docs):
    block = "alpha beta\n gamma delta\n\nepsilon zeta"
    texts = [
        f"start here\n{block}\nend", f"other\n{block}\nmore\n{block}", block, "a b\n" * 7, None, "", "x\ny", f"{block}\nunique\nlines\nhere\n{block}",
        "\n".join(f"line {i % 700}" for i in range(5000)),
    ]
    for rows in (table(spark, texts), docs):
        given = [(r["doc_id"], r["text"]) for r in rows.collect()]
        got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.report(rows).collect()}
        for (doc, text), want in without_repeats(given).items():
            assert got[doc][0] == want, doc
            assert got[doc][1] == (0 if want == text else len(text.split("\n")) - (len(want.split("\n")) if want else got[doc][1] * 0 + len(want)))


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    text = "one line\ntwo line\nthree line\nfour line"
    rows = table(spark, [text, text, text, text + "\nfive"], [5, 5, None, 9])
    out = line_dedup.deduped_documents(rows)
    assert out.columns == rows.columns
    got = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in out.collect())
    assert got == [("5", text, len(text)), ("5", text, len(text)), ("9", "five", 4), ("None", "", 0)]


def leak_rows(docs, items, n=5, least=0.8):
    grams = lambda w: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
    found = set()
    for doc, text in docs:
        words = BARE.findall((text or "").lower())
        own = grams(words)
        for item, wanted in items:
            want = Counter(grams(BARE.findall((wanted or "").lower())))
            size = sum(want.values())
            if not size or not own or not set(own) & set(want):
                continue
            for start in range(max(1, len(own) - size + 1)):
                window = Counter(own[start : start + size])
                both = sum((window & want).values())
                if both >= least * (sum(window.values()) + size - both) - 1e-9:
                    found.add((doc, item))
                    break
    return found


def test_leaks(spark):
    item = "How many moles are there in the old barn behind the house when winter comes, asked the careful farmer. Nobody knew! " + " ".join(f"w{i}" for i in range(30))
    words = item.split()
    edited = words[:]
    edited[-1] = "changed"
    texts = [
        f"before {item} after", item, "nothing to see here at all", None, "", item.upper().replace(" ", " *** "), f"x {' '.join(edited)} y",
        " ".join(words[:20]), f"{item} {item}", "how many moles " * 40, "short item", " ".join(f"v{i}" for i in range(3000)) + " " + item,
    ]
    items = [(1, item), (2, "short item"), (3, None), (4, ""), (5, item + " and a longer tail than before"), (6, "a b " * 40)]
    rows = table(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(rows, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leak_rows([(r["doc_id"], r["text"]) for r in rows.collect()], items)
    assert all(r["similarity"] >= 0.8 for r in got)
    kept = decontamination.clean_documents(rows, benchmark)
    assert kept.columns == rows.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {r["doc_id"] for r in got}
    assert decontamination.report(rows, benchmark.limit(0)).count() == 0


def test_an_item_in_another_order_is_found(spark):
    words = [f"w{i}" for i in range(60)]
    swapped = " ".join(words[30:] + words[:30])
    thirds = " ".join(words[40:] + words[20:40] + words[:20])
    other = " ".join(f"v{i}" for i in range(200))
    texts = [f"{other} {swapped} {other}", f"{other} {thirds}", swapped, " ".join(words[:50]), f"{other} {' '.join(words[:45])} {other}", " ".join(words[::-1])]
    items = [(1, " ".join(words)), (2, " ".join(words)), (None, " ".join(words[:40]))]
    rows, benchmark = table(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(rows, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leak_rows(list(enumerate(texts)), items)
    assert {0, 2} <= {r["doc_id"] for r in got}
    assert {r["start_word"] for r in got if r["doc_id"] == 0 and r["item_id"] == 1} == {200}


def test_leaks_without_any_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "small", lambda df: df)
    words = " ".join(f"w{i}" for i in range(30))
    rows = table(spark, [f"a b {words}", "none of it", words, words], ids=[1, 2, 3, 3]).withColumns({"_key": F.lit("x"), "_len": F.lit(0)})
    benchmark = spark.createDataFrame([(7, words, "y")], "item_id long, text string, _hash string")
    assert [tuple(r) for r in decontamination.report(rows, benchmark).orderBy("doc_id").collect()] == [(1, 7, 1.0, 2), (3, 7, 1.0, 0)]
    assert decontamination.clean_documents(rows, benchmark).select("doc_id", "_key").collect() == [(2, "x")]
    assert decontamination.report(rows.limit(0), benchmark).count() == 0


def test_leaks_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, benchmark = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.report(docs, benchmark).collect()}
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()]
    assert got == leak_rows(*pairs) and got


def test_blocks_cover_all_bits_and_find_any_pair_in_the_radius():
    cut = decontamination.blocks(20)
    assert len(cut) == 21 and sum(w for _, w in cut) == 64 and all(a + w == b for (a, w), (b, _) in zip(cut, cut[1:], strict=False))


def test_simhash_is_the_sign_of_weighted_bits(spark):
    values = [[5, -1, 7, 7], [1 << 62, -(1 << 63)], [3], []]
    values.append([1, 2, 2] * 30_000)  # more than a field of 16 bits counts
    rows = spark.createDataFrame([(v,) for v in values], "h array<long>")
    for r in rows.select("h", decontamination.simhash(rows["h"]).alias("s")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in r["h"]) > len(r["h"]))
        assert r["s"] % (1 << 64) == want


@pytest.mark.parametrize("n", [60, 1999, 2000, 2001, 30_000])
def test_junk_of_any_length_is_rejected(spark, n):
    rng = random.Random(n)
    few = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + "xyz"[rng.randrange(1)] for _ in range(n))
    many = " ".join(f"word{rng.randrange(400)}" for _ in range(n))
    verdicts = {r["doc_id"]: (r["rejected_by"], r["kept"]) for r in quality_rules.quality(table(spark, [few, many])).select("_row.doc_id", "rejected_by", "kept").collect()}
    assert not verdicts[0][1] and verdicts[1] == (None, True)
    assert [r["doc_id"] for r in quality_rules.filter_documents(table(spark, [few, many])).collect()] == [1]


def test_the_cascade_keeps_what_the_report_keeps(spark, docs):
    rows = docs.union(table(spark, ODD, range(-len(ODD), 0)))
    kept = sorted(r["doc_id"] for r in quality_rules.report(rows).where("kept").collect())
    assert sorted(r["doc_id"] for r in quality_rules.filter_documents(rows).collect()) == kept


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licensed(text):
    words = BARE.findall((text or "").translate(LOWER))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("source", ["given", "odd"])
def test_license_places(spark, docs, source):
    rows = docs if source == "given" else table(spark, ODD)
    got = {r["doc_id"]: r for r in license_scan.report(rows).collect()}
    for doc in rows.collect():
        r = got[doc["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == licensed(doc["text"]), doc["doc_id"]
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_containment_join_is_exact(spark, docs):
    templates = [("a", "the of and"), ("b", "in the house of the rising sun"), ("c", "zz yy xx ww"), ("d", "erth ing the")]
    rows = docs.union(table(spark, ["rising sun of the house\nzz yy xx", "ZZ, ww; yy!", None, ""], [-1, -2, -3, -4]))
    for threshold in (0.5, 0.8, 1.0):
        found = license_scan.scan(rows, containment=threshold, templates=templates).collect()
        got = {r["_row"]["doc_id"]: set(r["labels"].split(",")) - {""} - set(r["base_labels"].split(",")) for r in found}
        for doc in rows.collect():
            want = set()
            words = BARE.findall((doc["text"] or "").lower())
            for label, text in templates:
                own, run = set(text.split()), -int(-len(text.split()) / threshold // 1)
                if any(len(own & set(words[i : i + run])) >= threshold * len(own) - 1e-9 for i in range(len(words))):
                    want.add(label)
            assert got[doc["doc_id"]] == want


def test_notices_across_lines_and_names(spark):
    bsd = "Redistribution and use in source and binary forms, with or\n# without modification, are permitted provided\n# that the"
    mit = "Permission is hereby granted, free\nof charge, to any\nperson obtaining a copy of\nthis software and"
    share = "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0\nInternational License"
    texts = [
        f"v w x\n{bsd} y", mit, share, "released under the license of its owners", "released under\nthe MIT license", "mit " + "x " * 50 + "released under the license",
        "Licensed under the Apache License, Version 2.0 (the License)", " ".join(f"w{i} the license" for i in range(20_000)) + " " + mit, None, "",
    ]
    got = {r["doc_id"]: r["labels"] for r in license_scan.report(table(spark, texts)).collect()}
    assert got == {0: "bsd", 1: "mit", 2: "cc-by-sa", 3: "", 4: "mit", 5: "", 6: "apache-2.0", 7: "mit", 8: "", 9: ""}


@pytest.mark.parametrize("report", [quality_rules.report, line_dedup.report, license_scan.report])
def test_empty_tables_and_clashing_columns(spark, docs, report):
    assert report(docs.limit(0)).count() == 0
    clash = docs.limit(20).selectExpr("*", "1 AS _key", "2 AS _row", "3 AS _m", "4 AS _id", "5 AS _text", "6 AS kept", "7 AS n_words")
    plain = sorted(map(str, report(docs.limit(20)).collect()))
    assert sorted(map(str, report(clash).collect())) == plain
    assert set(quality_rules.filter_documents(clash).columns) == set(clash.columns)
    assert set(line_dedup.deduped_documents(clash).columns) == set(clash.columns)
