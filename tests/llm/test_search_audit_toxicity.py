"""Ranked search, filter audit and toxicity against plain Python."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from nearcite.llm import filter_audit, ranked_search, toxicity

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "one", "É é Ü ß 日本 a1b2", "x" * 30_000, "the cat sat on " * 2000, "tab\tand\x0bfeed\x0c", "#$%&*|", "A B C D E", "one one"]


def table(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = [None] * len(texts) if sources is None else sources
    rows = [(i, t, None, s, None) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ranked search


def ranked(docs, items, top=50):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = set()
    for item, terms in asked.items():
        scores = []
        for doc, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n_docs) // n_terms
            score = sum(weight[t] * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in terms if t in bag)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out |= {(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def test_search_of_the_given_tables(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert found(ranked_search.report(docs, items)) == ranked(pairs(docs, "doc_id"), pairs(items, "item_id"))


@pytest.mark.parametrize("block_terms", [4, 1000])
@pytest.mark.parametrize("scores", [1, 7, 1 << 20])
def test_search_of_copies_ties_and_odd_rows(spark, monkeypatch, block_terms, scores):
    monkeypatch.setattr(ranked_search, "SCORES", scores)
    rng = random.Random(4)
    texts = [" ".join(rng.choices("apple pear plum fig kiwi lime".split(), k=rng.randint(1, 4))) for _ in range(150)] + ["fig PLUM fig"] * 120 + ODD
    ids = [*rng.sample(range(1000), 270), *[5000 + i for i in range(len(ODD) - 3)], None, None, 7]
    items = [(1, "fig, plum!"), (2, "kiwi kiwi"), (3, None), (4, ""), (5, "no such words"), (None, "lime one"), (1, "apple"), (6, "É 日本 ONE")]
    rows = table(spark, texts, ids).selectExpr("*", "1 AS _id", "2 AS score", "3 AS _bag")
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("_term", F.lit("x"))
    got = ranked_search.search(rows, benchmark, block_terms=block_terms)
    got = got.select(F.col("_item").alias("item_id"), "rank", F.col("_id").alias("doc_id"), F.col("_score").alias("score"))
    assert found(got) == ranked(list(zip(ids, texts, strict=True)), items)


def test_equal_documents_are_scored_once(spark, monkeypatch):
    texts = ["the same words here"] * 400 + ["the same words here, other order here"] * 2
    scored = spark.sparkContext.accumulator(0)
    plain = ranked_search._scorer

    def counting(*args):
        run = plain(*args)

        def counted(batches):
            def seen():
                for batch in batches:
                    scored.add(batch.num_rows)
                    yield batch

            return run(seen())

        return counted

    monkeypatch.setattr(ranked_search, "_scorer", counting)
    items = spark.createDataFrame([(1, "same words")], "item_id long, text string")
    got = found(ranked_search.report(table(spark, texts), items))
    assert got == ranked(list(enumerate(texts)), [(1, "same words")]) and {d for _, _, d, _ in got} == set(range(50))
    assert scored.value == 2


def test_search_of_empty_tables(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ranked_search.report(docs.limit(0), items).count() == 0
    assert ranked_search.report(docs, items.limit(0)).count() == 0
    assert ranked_search.report(table(spark, [None, "", "?"]), items).count() == 0


# filter audit


def audited(docs, labels):
    """docs: (id, text, part). Every order is applied step by step."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))

    def fails(d, text):
        words = WORD.findall(text)
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > first[text],
        }

    rows = [(p or "", d, fails(d, t or "")) for d, t, p in docs]
    out = {}
    for part in {p for p, _, _ in rows}:
        own = [(d, f) for p, d, f in rows if p == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[x]]
                out[part, "".join(order), step] = [
                    len(left) - len(gone), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
                removed_by[x] += len(gone)
                left = [(d, f) for d, f in left if not f[x]]
        for p, order, step in list(out):
            if p == part:
                out[p, order, step].append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(df):
    return {
        (r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
        for r in df.collect()
    }


def audit_table(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(600)]
    long = [" ".join(rng.choices(words, k=rng.randint(150, 400))) for _ in range(20)]
    texts = long + [long[0]] * 30 + [long[1].upper()] * 3 + [long[2] + " 100%"] * 2 + ["same " * 300] * 4 + ODD + ["", None]
    ids = rng.sample(range(10_000), len(texts))
    ids[25], ids[26], ids[30], ids[60] = ids[24], ids[24], None, None
    sources = [rng.choice(["a", "b", "", None]) for _ in texts]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in ids if rng.random() < 0.6] + [(ids[0], 1, 1), (77_777, 1, 1)]
    docs = list(zip(ids, texts, sources, strict=True))
    return docs, labels, table(spark, texts, ids, sources), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_of_all_orders(spark):
    docs, labels, rows, marks = audit_table(spark)
    got = audit_rows(filter_audit.report(rows.selectExpr("*", "1 AS part", "2 AS _mask", "3 AS n"), marks))
    assert len(got) == 600 * 3 and got == audited(docs, labels)


def test_audit_where_different_texts_share_a_hash(spark):
    docs, labels, rows, marks = audit_table(spark)
    counts = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in filter_audit.mask_counts(rows, marks).collect()}
    shared = filter_audit.mask_counts(rows, marks, key=lambda text: F.length(text) % 7)
    assert {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in shared.collect()} == counts


def test_audit_of_the_given_tables(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    marks = [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()]
    assert audit_rows(filter_audit.report(docs, labels)) == audited(plain, marks)
    assert filter_audit.report(docs.limit(0), labels).count() == 0
    none = audit_rows(filter_audit.report(docs, labels.limit(0)))
    assert none == audited(plain, [])


def test_the_sketch_clears_unique_keys_and_no_other(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 500)  # many pieces a task
    rng = random.Random(1)
    once = [rng.getrandbits(64) - (1 << 63) for _ in range(6000)]
    twice = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    hot = [123] * 2000
    keys = spark.createDataFrame([(k,) for k in once + twice * 2 + hot], "_key long").repartition(5)
    bits, n = filter_audit.sketch(keys, keys.count())
    left = Counter(r["_key"] for r in filter_audit.may_repeat(keys, bits, n).where("_repeats").collect())
    assert all(left[k] == 2 for k in twice) and left[123] == 2000
    assert sum(k in left for k in once) < 0.08 * len(once)


# toxicity


def test_held_out_rows_teach_nothing(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    import zlib

    assert len(got) == docs.count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [d for d, r in got.items() if r["held_out"]]
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.report(docs, flipped).collect()}
    assert all(abs(again[d] - r["score"]) < 1e-6 for d, r in got.items())


def test_pairs_of_terms_beyond_what_weights_add(spark):
    """An insult alone and a group alone are harmless in a third of the texts each; both together are toxic."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    insults, groups = ["zorg", "blarg", "snick"], ["martians", "venusians"]
    texts, toxic = [], []
    for i in range(1500):
        kind = i % 4
        own = rng.choices(words, k=20) + ([rng.choice(insults)] if kind in (1, 3) else []) + ([rng.choice(groups)] if kind in (2, 3) else [])
        rng.shuffle(own)
        texts.append(" ".join(own))
        toxic.append(int(kind == 3))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = [r for r in toxicity.report(table(spark, texts), labels).collect() if r["held_out"]]
    right = sum(r["predicted"] == toxic[r["doc_id"]] for r in got)
    assert right > 0.97 * len(got) and len(got) > 300


def test_held_out_accuracy_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.report(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) > 0.8 * len(toxic) and sum(clean) < 0.01 * len(clean)


def test_toxicity_of_odd_rows_and_tables(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    rows = docs.limit(20).union(table(spark, ODD, [None, *range(-1, -len(ODD), -1)])).selectExpr("*", "1 AS _x", "2 AS score", "3 AS _y")
    out = toxicity.report(rows, labels)
    assert out.count() == 20 + len(ODD) and out.where("score IS NULL OR isnan(score) OR held_out IS NULL").count() == 0
    assert {r["score"] for r in toxicity.report(rows, labels.limit(0)).collect()} == {0.5}
    assert toxicity.report(rows.limit(0), labels).count() == 0
    real = spark.read.parquet(f"{SF}/labels.parquet")
    both = table(spark, ODD, range(-len(ODD), 0)).union(docs)
    assert toxicity.report(both, real).where("score IS NULL").count() == 0
