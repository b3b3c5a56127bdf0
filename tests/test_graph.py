import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_set
from nearcite.operators import expand, network, pagerank
from nearcite.operators import links as links_module
from nearcite.sources import ranges

RNG = np.random.default_rng(11)


def found(spark, rows):
    return spark.createDataFrame(rows, "query_id string, publication_number string, row_no int")


@pytest.fixture(scope="module")
def small(spark, make_corpus):
    """q, a, b are results in that order; c, d are linked to; x is unknown."""
    corpus = make_corpus(
        [
            (("q",), {"citation": ["a", "c", "c", "x"], "cited_by": ["q", "", "d"]}),
            (("a",), {"citation": ["b", "d"], "parent": ["c"], "cited_by": None}),
            (("b",), {"cited_by": ["a"], "child": ["a"]}),
            (("c",), {"child": ["a"]}),
            (("d",), {}),
        ]
    )
    return corpus, found(spark, [("q", "q", 1), ("q", "a", 2), ("q", "b", 3), ("z", "b", 1)])


def test_neighbors_in_reading_order(small):
    corpus, rows = small
    got = expand.number_neighbors(expand.citation_neighbors(rows, corpus))
    assert as_set(got, "query_id", "publication_number", "neighbor_order") == {
        ("q", "c", 1), ("q", "x", 2), ("q", "d", 3), ("z", "a", 1),
    }
    capped = expand.citation_neighbors(rows, corpus, max_neighbors=2)
    assert as_set(capped, "query_id", "publication_number") == {("q", "c"), ("q", "x"), ("z", "a")}
    own = expand.number_neighbors(expand.citation_neighbors(rows.join(corpus, "publication_number")))
    assert as_set(own, "query_id", "publication_number", "neighbor_order") == as_set(got, "query_id", "publication_number", "neighbor_order")
    assert as_set(expand.fetch_neighbors(got, corpus), "query_id", "publication_number") == {("q", "c"), ("q", "d"), ("z", "a")}


def test_caps_keep_the_first_and_default_to_none(spark, make_corpus):
    ids = [f"n{i:03d}" for i in range(700)]
    corpus = make_corpus([((i,), {"citation": ids if i == "n000" else []}) for i in ids])
    rows = found(spark, [("q", "n000", 1)])
    whole = expand.citation_neighbors(rows, corpus)
    assert whole.count() == 699
    for cap in (1, 4, 9):
        capped = expand.citation_neighbors(rows, corpus, cap)
        assert as_set(capped, "publication_number") == {(i,) for i in ids[1 : cap + 1]}


def test_edges_keep_the_last_write(small, spark):
    corpus, rows = small
    expanded = expand.fetch_neighbors(expand.citation_neighbors(rows, corpus), corpus, ["publication_number"])
    nodes = expand.graph_nodes(rows.where("query_id = 'q'"), expanded.where("query_id = 'q'"))
    assert as_set(nodes, "node", "is_seed") == {("q", True), ("a", False), ("b", False), ("c", False), ("d", False)}
    got = as_set(expand.graph_edges(nodes, corpus), "src", "dst", "edge_type")
    assert got == {
        ("q", "a", "cites"), ("q", "c", "cites"), ("d", "q", "cited_by"), ("a", "d", "cites"),
        ("a", "b", "cited_by"), ("b", "a", "child"), ("c", "a", "child"),
    }
    size = expand.graph_size(nodes, expand.graph_edges(nodes, corpus)).first()
    assert (size["n_nodes"], size["n_edges"]) == (5, 7)


def test_pieces_of_rows_give_the_same_edges(spark, make_corpus, monkeypatch):
    ids = [f"n{i:02d}" for i in range(25)]
    links = {i: {c: list(RNG.choice(ids, 9)) for c in ("citation", "cited_by", "parent", "child")} for i in ids}
    links["n03"]["cited_by"] = ids * 20
    corpus = make_corpus([((i,), links[i]) for i in ids])
    nodes = spark.createDataFrame(
        [(q, n, int(k), n == q) for q in ids[:6] for k, n in enumerate({q, "n03", *RNG.choice(ids, 8, replace=False)})],
        "query_id string, node string, row_no bigint, is_seed boolean",
    )
    whole = as_set(expand.graph_edges(nodes, corpus), "query_id", "src", "dst", "edge_type")
    for size in (40, 7):
        monkeypatch.setattr(links_module, "CHUNK", size)
        assert as_set(expand.graph_edges(nodes, corpus), "query_id", "src", "dst", "edge_type") == whole


def test_a_row_of_many_links_in_a_graph_of_the_whole_corpus(spark, make_corpus):
    ids = [f"n{i:04d}" for i in range(300)]
    corpus = make_corpus([((i,), {"citation": ids * 9 if i == "n0000" else ["n0000"]}) for i in ids])
    nodes = spark.createDataFrame([("all", i, 1, i == "n0000") for i in ids], "query_id string, node string, row_no bigint, is_seed boolean")
    edges = expand.graph_edges(nodes, corpus)
    assert edges.count() == 2 * 299
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "(query_id = query_id)" not in plan


def power(nodes, edges, seed, alpha=0.85, max_iter=100, tol=1e-6):
    out = {n: [d for s, d in edges if s == n] for n in nodes}
    x = {n: 1 / len(nodes) for n in nodes}
    for _ in range(max_iter):
        new = {n: 0.0 for n in nodes}
        for n in nodes:
            for d in out[n]:
                new[d] += alpha * x[n] / len(out[n])
        new[seed] += alpha * sum(x[n] for n in nodes if not out[n]) + 1 - alpha
        change = sum(abs(new[n] - x[n]) for n in nodes)
        x = new
        if change < len(nodes) * tol:
            return x
    return {}


def graphs(spark, cases):
    nodes = [(q, n, n == seed) for q, (ns, _, seed) in cases.items() for n in ns]
    edges = [(q, s, d) for q, (_, es, _) in cases.items() for s, d in es]
    return (
        spark.createDataFrame(nodes, "query_id string, node string, is_seed boolean"),
        spark.createDataFrame(edges, "query_id string, src string, dst string"),
    )


CASES = {
    "pair": (["a", "b"], [("a", "b")], "a"),
    "no edges": (["a", "b"], [], "a"),
    "unreachable": (["a", "b", "c"], [("a", "b"), ("c", "a")], "a"),
    "sink seed": (["a", "b"], [("b", "a")], "a"),
    "ring": (["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")], "a"),
    "random": (
        [f"n{i}" for i in range(12)],
        [(f"n{i}", f"n{j}") for i, j in itertools.permutations(range(12), 2) if (i * 7 + j * 3) % 5 == 0],
        "n0",
    ),
    "hub": (["s"] + [f"h{i}" for i in range(30)], [("s", f"h{i}") for i in range(30)] + [("h1", "s")], "s"),
}


@pytest.mark.parametrize("plan", ["grouped", "mixed"])
def test_pagerank(spark, monkeypatch, plan):
    nodes, edges = graphs(spark, CASES)
    bound = 1_000 if plan == "grouped" else 20
    monkeypatch.setattr(pagerank, "EDGES_PER_SALT", 7)
    got = pagerank.personalized_pagerank(nodes, edges, grouped_edges=bound).collect()
    by_query = {q: {r["node"]: r["ppr_raw"] for r in got if r["query_id"] == q} for q in CASES}
    for q, (ns, es, seed) in CASES.items():
        expected = power(ns, es, seed) if es else {}
        assert by_query[q].keys() == expected.keys(), q
        for n, value in expected.items():
            assert by_query[q][n] == pytest.approx(value, abs=1e-12)
        if expected:
            assert sum(expected.values()) == pytest.approx(1)
    assert by_query["unreachable"]["c"] == pytest.approx(0, abs=1e-3)


def test_pagerank_without_convergence(spark):
    nodes, edges = graphs(spark, {k: CASES[k] for k in ("ring", "random")})
    for bound in (1_000, 0):
        assert pagerank.personalized_pagerank(nodes, edges, max_iter=2, grouped_edges=bound).count() == 0
        kept = pagerank.personalized_pagerank(nodes, edges, max_iter=2, require_convergence=False, grouped_edges=bound)
        assert kept.count() == 15


def test_minmax(spark):
    scores = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "z", 3.0), ("b", "x", 5.0), ("b", "y", 5.0)], "query_id string, node string, ppr_raw double")
    got = as_set(pagerank.minmax_normalize(scores), "query_id", "node", "ppr_score")
    assert got == {("a", "x", 0.0), ("a", "y", 0.5), ("a", "z", 1.0), ("b", "x", 1.0), ("b", "y", 1.0)}
    assert pagerank.minmax_normalize(scores.limit(0)).count() == 0


def test_khop_and_filters(spark):
    nodes = spark.createDataFrame([("q", n) for n in "abcde"], "query_id string, node string")
    edges = spark.createDataFrame([("q", "a", "b", "cites"), ("q", "c", "b", "parent"), ("q", "c", "d", "cites")], "query_id string, src string, dst string, edge_type string")
    seeds = nodes.where("node = 'a'")
    assert as_set(network.khop(nodes, edges, seeds), "node", "hop") == {("a", 0), ("b", 1), ("c", 2), ("d", None), ("e", None)}
    assert as_set(network.filter_edges(edges, "edge_type", ["parent"]), "node") == {("c",), ("b",)}
    shown = nodes.withColumn("size", F.when(F.col("node") == "a", 45).otherwise(14))
    assert as_set(network.filter_nodes(shown, "size", ["45"]), "node") == {("a",)}


def test_view_edges_keep_repeats_and_caps(spark, make_corpus):
    many = [f"m{i}" for i in range(12)]
    corpus = make_corpus([(("q",), {"citation": ["m11", "m11"] + many, "parent": ["m1"]}), *[((m,), {}) for m in many]])
    rows = spark.createDataFrame([("q", p) for p in ["q", *many]], "query_id string, publication_number string")
    results = spark.createDataFrame([("q", "m1", 0.29)], "query_id string, publication_number string, score double")
    whole = [tuple(r) for r in network.viz_edges(results, rows, corpus).select("src", "dst").collect()]
    assert whole.count(("q", "m11")) == 3 and ("q", "m8") in whole
    got = [tuple(r) for r in network.viz_edges(results, rows, corpus, network.LINK_CAPS).select("src", "dst", "kind", "title", "width").collect()]
    assert got.count(("q", "m11", "cites", "Cites", 1.0)) == 2
    assert ("q", "m8", "cites", "Cites", 1.0) not in got and ("q", "m7", "cites", "Cites", 1.0) in got
    assert ("m1", "q", "parent", "Parent", 1.5) in got
    assert ("q", "m1", "similar", "Score: 28%", 1.58) in got


def test_query_missing_from_its_own_list(spark, make_corpus):
    """Equal vectors push the query out; its stand-in is drawn, the query once, and every edge ends in a node."""
    from nearcite.plans.search import Search

    ids = [f"p{i}" for i in range(8)]
    corpus = make_corpus([((i, [1.0, 0.0]), {"citation": ["p1", "p7"]}) for i in ids])
    search = Search(spark.createDataFrame([("p7",)], "query_id string"), corpus, k=3)
    nodes = [(r["node"], r["kind"]) for r in search.viz_nodes().collect()]
    edges = as_set(search.viz_edges(), "src", "dst", "kind", "title")
    assert sorted(nodes) == [("p0", "result"), ("p1", "result"), ("p2", "result"), ("p7", "query")]
    assert ("p7", "p0", "similar", "Score: 0%") in edges
    assert {n for e in edges for n in e[:2]} <= {n for n, _ in nodes}


def test_scaling_does_not_depend_on_how_spans_travel(spark, monkeypatch):
    rows = [(f"q{i % 3}", f"n{i}", float(RNG.normal())) for i in range(60)] + [("even", "a", 0.5), ("even", "b", 0.5)]
    scores = spark.createDataFrame(rows, "query_id string, node string, ppr_raw double")
    plan = pagerank.minmax_normalize(scores)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(pagerank, "broadcast_small", lambda df: df)
    columns = ("query_id", "node", "ppr_score")
    assert as_set(plan, *columns) == as_set(pagerank.minmax_normalize(scores), *columns)


@pytest.mark.parametrize("after", [False, True])
def test_blocks_of_queries_give_the_edges_of_joins(spark, make_corpus, monkeypatch, after):
    ids = [f"n{i:02d}" for i in range(30)]
    corpus = make_corpus([((i,), {c: [*RNG.choice([*ids, "out"], 6), None, ""] for c in ("citation", "cited_by", "parent", "child")}) for i in [*ids, "n01"]])
    rows = [(q, n, None if n == "n07" else int(k), bool(k % 2), n == q) for q in ids[:9] for k, n in enumerate([*RNG.choice(ids, 9, replace=False), "n07", "n03", "lost"])]
    rows += [("n00", None, 1, False, False), (None, "n03", 1, False, False)]
    nodes = spark.createDataFrame(rows, "query_id string, node string, row_no bigint, is_expanded boolean, is_seed boolean")
    nodes = nodes if after else nodes.drop("is_expanded")
    columns = ("query_id", "src", "dst", "edge_type")
    expected = as_set(expand._joined_edges(nodes, links_module.link_pieces(corpus)), *columns)
    assert len(expected) > 100
    for settings in ({"NODES_IN_BLOCK": 20, "LINKS_IN_BLOCK": 50}, {"NODES_OF_QUERY": 11}):
        for name, value in settings.items():
            monkeypatch.setattr(expand, name, value)
        got = expand.graph_edges(nodes, corpus)
        assert as_set(got, *columns) == expected and got.count() == len(expected)


def test_links_are_not_unfolded_for_each_node(small, monkeypatch):
    corpus, rows = small
    monkeypatch.setattr(expand, "possible_links", None)  # the way of queries of very many nodes
    nodes = expand.graph_nodes(rows)
    assert as_set(expand.graph_edges(nodes, corpus), "query_id", "src", "dst", "edge_type") == {
        ("q", "q", "a", "cites"), ("q", "a", "b", "cited_by"), ("q", "b", "a", "child"),
    }


def test_neighbors_of_a_stored_corpus_are_found_once(small, spark, tmp_path):
    corpus, rows = small
    store = ranges.create(corpus, str(tmp_path / "store"), 2)
    tested = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            tested.add(batch.num_rows)
            yield batch

    neighbors = expand.citation_neighbors(rows, corpus)
    neighbors = neighbors.mapInArrow(count, neighbors.schema)
    got = expand.fetch_neighbors(neighbors, store, ["publication_number"])
    assert as_set(got, "query_id", "publication_number") == {("q", "c"), ("q", "d"), ("z", "a")}
    assert tested.value == 4


@pytest.mark.parametrize("settings", [{}, {"NODES_IN_BLOCK": 5, "LINKS_IN_BLOCK": 7, "SMALL_BLOCK": 2}, {"NODES_OF_QUERY": 6}])
def test_links_of_a_view_are_not_shuffled_to_each_row(spark, make_corpus, monkeypatch, settings):
    """Links and rows that repeat are drawn as often, whichever way they meet."""
    ids = [f"n{i}" for i in range(12)]
    names = ("citation", "cited_by", "parent", "child")
    links = {i: {c: [*RNG.choice([*ids, "out"], 5).tolist(), None, ""] for c in names} for i in ids}
    corpus = make_corpus([((i,), links[i]) for i in ids])
    rows = [(q, n) for k, q in enumerate(ids[:3]) for n in [*ids[k : k + 5 + k], "lost", ids[k]]] + [("q", None), (None, "n1")]
    shown = spark.createDataFrame([], "query_id string, publication_number string, score double")
    for name, value in settings.items():
        monkeypatch.setattr(expand, name, value)
    for caps in (None, {"citation": 2, "cited_by": 3, "parent": 1, "child": 4}):
        expected = [
            (q, o, n, kind) if kind in ("cited_by", "parent") else (q, n, o, kind)
            for q, n in rows if q and n in links
            for c, kind in zip(names, ("cites", "cited_by", "parent", "child"))
            for o in links[n][c][: caps[c] if caps else None] if o and o != n and (q, o) in rows
        ]
        got = network.viz_edges(shown, spark.createDataFrame(rows, "query_id string, publication_number string"), corpus, caps)
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString() or "NODES_OF_QUERY" in settings
        assert sorted(map(tuple, got.select("query_id", "src", "dst", "kind").collect())) == sorted(expected) and expected


def test_edges_between_results_are_filtered_before_they_move(spark):
    edges = spark.createDataFrame([("q", f"a{i}", f"a{i * 7 % 400}", "cites") for i in range(400)], "query_id string, src string, dst string, edge_type string")
    results = spark.createDataFrame([("q", f"a{i}") for i in (1, 2, 7, 14)], "query_id string, publication_number string")
    got = expand.result_edges(edges, results)
    assert as_set(got, "src", "dst") == {("a1", "a7"), ("a2", "a14")}
    assert "subquery" in got._jdf.queryExecution().optimizedPlan().toString()


def test_known_neighbors_stay_where_they_are(small):
    corpus, rows = small
    found = expand.fetch_neighbors(expand.citation_neighbors(rows, corpus), corpus.repartition(2), ["publication_number"])
    assert "rightHint=(strategy=broadcast)" in found._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_of_a_stored_corpus_stand_by_document(spark, make_corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(expand, "DOCUMENTS_OF_TASK", 4)
    monkeypatch.setattr(expand, "ROWS_OF_DOCUMENT", 20)
    corpus = make_corpus([((f"d{i:03d}", [1.0]), {"abstract": f"text {i}"}) for i in range(100)])
    store = ranges.create(corpus, str(tmp_path / "corpus"), rows_per_range=30)
    asked = [(f"q{q:03d}", "d001", q) for q in range(90)] + [(f"q{q}", f"d{i:03d}", i) for q in range(4) for i in range(2, 100)] + [("q1", "gone", 7), ("q1", None, 8)]
    neighbors = spark.createDataFrame(asked, "query_id string, publication_number string, first_seen int")
    found = expand.fetch_neighbors(neighbors, store).withColumn("task", F.spark_partition_id())
    rows = found.select("query_id", "publication_number", "first_seen", "abstract.value", "task").collect()
    assert sorted(r[:4] for r in rows) == sorted((q, d, n, f"text {int(d[1:])}") for q, d, n in asked if d and d != "gone")
    texts = {t: len({r[1] for r in rows if r[4] == t}) for t in {r[4] for r in rows}}
    assert max(texts.values()) <= 16 and len(texts) > 8
    assert len({r[4] for r in rows if r[1] == "d001"}) > 1
    orders = {}
    for r in rows:
        orders.setdefault(r[4], []).append(r[1])
    assert all(sum(a != b for a, b in zip(o, o[1:], strict=False)) == len(set(o)) - 1 for o in orders.values())


def test_reach_beyond_the_filters(spark, monkeypatch):
    """Bloom filters only drop what cannot matter: also when they are full."""
    monkeypatch.setattr(links_module, "MOST_WORDS", 1)
    nodes = spark.createDataFrame([("q", n) for n in "abcdef"] + [("z", n) for n in "abc"], "query_id string, node string")
    edges = spark.createDataFrame([("q", "a", "b"), ("q", "c", "b"), ("q", "c", "d"), ("q", "e", "f"), ("z", "b", "a")], "query_id string, src string, dst string")
    seeds = spark.createDataFrame([("q", "a"), ("z", "a")], "query_id string, node string")
    want = {("q", "a", 0), ("q", "b", 1), ("q", "c", 2), ("q", "d", None), ("q", "e", None), ("q", "f", None), ("z", "a", 0), ("z", "b", 1), ("z", "c", None)}
    assert as_set(network.khop(nodes, edges, seeds), "query_id", "node", "hop") == want
    monkeypatch.undo()
    assert as_set(network.khop(nodes, edges, seeds), "query_id", "node", "hop") == want
    plan = network.khop(nodes, edges, seeds)._jdf.queryExecution().analyzed().toString()
    assert "member_bits" in plan


def test_ranks_are_the_same_with_numbers_and_with_ids(spark, monkeypatch):
    nodes = spark.createDataFrame([(q, n, n == "a") for q in ("q", "z") for n in "abcd"] + [("lone", "a", True)], "query_id string, node string, is_seed boolean")
    edges = spark.createDataFrame([("q", "a", "b"), ("q", "b", "c"), ("z", "a", "d"), ("z", "d", "a")], "query_id string, src string, dst string")
    scores = pagerank.personalized_pagerank(nodes, edges)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_no" in plan
    numbered = as_set(scores, "query_id", "node", "ppr_raw")
    monkeypatch.setattr(pagerank, "NAMES_SENT", 2)
    assert as_set(pagerank.personalized_pagerank(nodes, edges), "query_id", "node", "ppr_raw") == numbered
    assert {k for k in numbered if k[0] == "lone"} == set() and len(numbered) == 8


def test_nodes_are_merged_by_hashing(spark):
    results = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "query_id string, publication_number string, row_no int")
    far = (1 << 30) * (1 << 32) - 1
    expanded = spark.createDataFrame([("q", "c", far), ("q", "a", 5), ("q", "q", 9)], "query_id string, publication_number string, first_seen bigint")
    nodes = expand.graph_nodes(results, expanded)
    assert as_set(nodes, "node", "is_expanded", "row_no", "is_seed") == {("a", False, 2, False), ("b", False, 1, False), ("c", True, far, False), ("q", True, 9, True)}
    assert as_set(expand.graph_nodes(results), "node", "is_expanded", "row_no") == {("a", False, 2), ("b", False, 1), ("q", None, None)}
    assert "SortAggregate" not in nodes._jdf.queryExecution().executedPlan().toString()
