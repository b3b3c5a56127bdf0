"""Link tables and the membership filter."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import as_set
from nearcite.operators import expand, links

RNG = random.Random(3)


def test_link_table_marks_what_leads_out(make_corpus):
    corpus = make_corpus(
        [
            (("a",), {"citation": ["b", "b", "x"], "cited_by": ["a", ""], "parent": ["c"]}),
            (("b",), {"child": ["a"], "citation": None}),
            (("c",), {}),
        ]
    )
    table = links.link_table(corpus)
    flat = as_set(table.select("publication_number", F.inline("links")), "publication_number", "rel", "pos", "other", "known")
    assert flat == {("a", 0, 1, "b", True), ("a", 0, 2, "b", True), ("a", 0, 3, "x", False), ("a", 2, 1, "c", True), ("b", 3, 1, "a", True)}
    turned = as_set(links.links_by_target(table), "other", "known", "publication_number", "rel", "pos")
    assert turned == {(o, k, p, r, at) for p, r, at, o, k in flat}


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_pieces_are_bounded_and_give_the_same_graph(spark, make_corpus, monkeypatch, size):
    monkeypatch.setattr(links, "CHUNK", size)
    ids = [f"n{i}" for i in range(12)]
    corpus = make_corpus([((i,), {c: RNG.choices([*ids, "out"], k=7) for c in ("citation", "cited_by", "parent", "child")}) for i in ids])
    table = links.link_table(corpus)
    assert table.agg(F.max(F.size("links"))).first()[0] <= size
    nodes = spark.createDataFrame(
        [(q, n, k, n == q) for q in ids[:4] for k, n in enumerate({q, *RNG.sample(ids, 6)})],
        "query_id string, node string, row_no bigint, is_seed boolean",
    )
    columns = ("query_id", "src", "dst", "edge_type")
    assert as_set(expand.graph_edges(nodes, corpus, table), *columns) == as_set(expand.graph_edges(nodes, corpus), *columns)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_membership_holds_all_and_little_else(spark, n):
    keys = spark.range(n).select((F.col("id") % 7).cast("string").alias("q"), F.col("id").cast("string").alias("k"))
    member = links.Membership(keys, ["q", "k"])
    test = member.may_hold(F.col("q"), F.col("k"))
    assert member.joined(keys).where(~test).count() == 0
    others = spark.range(20_000).select(F.lit("q").alias("q"), F.col("id").cast("string").alias("k"))
    assert member.joined(others).where(test).count() <= 0.03 * 20_000


def test_a_full_filter_changes_no_result(spark, make_corpus, monkeypatch):
    monkeypatch.setattr(links, "MOST_WORDS", 1)
    ids = [f"n{i}" for i in range(30)]
    corpus = make_corpus([((i,), {"citation": RNG.choices(ids, k=9)}) for i in ids])
    nodes = spark.createDataFrame([("q", n, k, k == 0) for k, n in enumerate(ids[:10])], "query_id string, node string, row_no bigint, is_seed boolean")
    columns = ("query_id", "src", "dst", "edge_type")
    expected = {
        ("q", r["publication_number"], x["publication_number"], "cites")
        for r in corpus.collect() for x in r["citation"]
        if r["publication_number"] in ids[:10] and x["publication_number"] in ids[:10] and x["publication_number"] != r["publication_number"]
    }
    assert as_set(expand.graph_edges(nodes, corpus), *columns) == expected
