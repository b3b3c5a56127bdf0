from conftest import as_set
from nearcite.operators import analytics, context, ranking
from nearcite.plans.search import Search

SCORED = "query_id string, publication_number string, distance double, row_no int, is_query boolean"


def results(spark, rows):
    return ranking.with_similarity(spark.createDataFrame(rows, SCORED))


def test_blend_and_rank(spark):
    rows = results(
        spark,
        [("q", "a", 0.1, 1, False), ("q", "b", 0.3, 2, False), ("q", "c", None, 3, False), ("z", "a", 0.5, 1, False), ("z", "b", 0.2, 2, False)],
    )
    scores = spark.createDataFrame([("q", "b", 0.3, 1.0), ("q", "c", 0.1, 0.25)], "query_id string, node string, ppr_raw double, ppr_score double")
    blended = ranking.blend(rows, scores)
    got = {(r["query_id"], r["publication_number"]): r for r in blended.collect()}
    assert round(got["q", "a"]["blended_score"], 12) == 0.54 and got["q", "a"]["ppr_score"] == 0.0
    assert round(got["q", "b"]["blended_score"], 12) == 0.82
    assert round(got["q", "c"]["blended_score"], 12) == 0.1
    assert got["z", "a"]["ppr_available"] is False and got["z", "a"]["blended_score"] is None and got["z", "a"]["ppr_pct"] is None

    def order(mode):
        return [(r["query_id"], r["publication_number"]) for r in ranking.rank_results(blended, mode).orderBy("query_id", "rank").collect()]

    fallback = [("z", "b"), ("z", "a")]
    assert order("blended") == [("q", "b"), ("q", "a"), ("q", "c"), *fallback]
    assert order("similarity") == [("q", "a"), ("q", "b"), ("q", "c"), *fallback]
    assert order("graph") == [("q", "b"), ("q", "c"), ("q", "a"), *fallback]


def test_structural_top(spark):
    ddl = "query_id string, publication_number string, title_text string, primary_assignee string, filed string, ppr_pct double"
    rows = spark.createDataFrame([("q", "a", "", None, "", 0.0), ("q", "b", "", None, "", 5.0), ("q", "c", "", None, "", 5.0), ("q", "d", "", None, "", 9.0), ("q", "e", "", None, "", None)], ddl)
    assert as_set(ranking.structural_top(rows, 2), "rank", "publication_number") == {(1, "d"), (2, "b")}


def test_counts(spark, make_corpus):
    corpus = make_corpus(
        [
            (("a",), {"assignees": ["N", "N"], "cpc": ["h1", "9x", "A2"], "terms": ["t"]}),
            (("b",), {"assignees": ["", "M"], "cpc": ["A1"], "terms": ["u", "u"], "inventors": ["I"]}),
            (("c",), {"assignees": ["M"], "inventors": ["I"]}),
        ]
    )
    rows = spark.createDataFrame([("q", "c", 1), ("q", "b", 2), ("q", "a", 3)], "query_id string, publication_number string, row_no int")
    shown = rows.join(corpus, "publication_number")
    names = analytics.top_names(shown, "assignee_harmonized")
    assert as_set(names, "place", "name", "n") == {(1, "M", 2), (2, "N", 2)}
    assert as_set(analytics.top_names(shown, "assignee_harmonized", 1), "name") == {("M",)}
    assert as_set(analytics.cpc_distribution(shown), "place", "section", "n", "label") == {
        (1, "A", 2, "A - Human Necessities"), (2, "H", 1, "H - Electricity"),
    }
    assert as_set(analytics.cpc_distribution(shown, letters_only=False), "section", "n") == {("A", 2), ("h", 1), ("9", 1)}
    assert as_set(analytics.top_terms(shown, 1), "term", "n") == {("u", 2)}
    counts = analytics.citation_counts(make_corpus([(("a",), {"citation": ["x", "y"], "parent": None})])).first()
    assert (counts["backward_citation_count"], counts["forward_citation_count"], counts["parent_count"]) == (2, 0, 0)


def test_shared_assignees(spark):
    rows = [("q", i + 1, name) for i, name in enumerate(["X", "N/A", "Y", None, "", "Y", "X", "N/A", "Y", "", "X"])]
    ranked = spark.createDataFrame(rows, "query_id string, rank int, primary_assignee string")
    assert as_set(analytics.shared_assignees(ranked), "assignee", "n", "first_rank") == {("X", 2, 1), ("Y", 3, 3)}


def test_search_in_batches_equals_single_searches(spark, make_corpus):
    ids = [f"p{i}" for i in range(14)]
    corpus = make_corpus(
        [
            ((p, [1.0, i / 3.0, (i * 7 % 5) / 4.0]), {"citation": [ids[(i * 3 + j) % 14] for j in range(3)], "assignees": [f"A{i % 3}"]})
            for i, p in enumerate(ids)
        ]
    ).persist()

    def tables(query_ids):
        queries = spark.createDataFrame([(q,) for q in query_ids], "query_id string")
        search = Search(queries, corpus, k=4)
        found = (search.result_table(), search.prompt(), search.kpi(), search.network())
        return [{tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.collect()} for df in found]

    batch = tables(ids[:3])
    single = [tables([q]) for q in ids[:3]]
    for i, table in enumerate(batch):
        assert table == set().union(*[one[i] for one in single])


def test_context_sections(spark):
    ddl = "query_id string, rank int, publication_number string, title_text string, primary_assignee string, abstract_text string, similarity double, ppr_raw double, blended_score double"
    ranked = spark.createDataFrame(
        [("q", i, f"p{i}", f"T{i}", "ACME" if i in (1, 7) else None, "x" * 600, 0.5, 0.25, 0.4) for i in range(1, 8)]
        + [("z", 1, "p1", "T1", None, "short", 0.5, 0.0, 0.3)],
        ddl,
    )
    edges = spark.createDataFrame([("q", f"p{i}", f"p{j}", "cites") for i in range(1, 6) for j in range(1, 7) if i != j], "query_id string, src string, dst string, edge_type string")
    expanded = spark.createDataFrame(
        [("q", f"e{i}", f"E{i}", float(i)) for i in range(5)], "query_id string, publication_number string, title_text string, ppr_raw double"
    )
    got = {r[0]: r[1] for r in context.context_graph(ranked, edges, expanded).collect()}
    q = got["q"]
    assert q.startswith("Result 1: p1\nTitle: T1\nAssignee: ACME\nAbstract: " + "x" * 500 + "\nText Similarity: 50.00% | Graph Importance (PPR): 0.2500 | Blended: 40.00%\n---\nResult 2: p2")
    assert "Result 6" not in q and q.count("--[cites]-->") == 20
    assert "---\n\nCitation relationships between results:\n  p1 --[cites]--> p2\n" in q
    assert "\n\nShared assignees:\n  ACME: 2 patents\n" in q
    assert q.endswith("via citation network:\n  e4: E4 (PPR: 4.0000)\n  e3: E3 (PPR: 3.0000)\n  e2: E2 (PPR: 2.0000)")
    assert got["z"].endswith("Blended: 30.00%\n---")


def test_scores_outside_the_results_are_dropped_before_they_move(spark):
    rows = spark.createDataFrame([("q", "a5", 0.5), ("z", "a5", 0.25), (None, "a5", 0.5)], "query_id string, publication_number string, similarity double")
    scores = spark.createDataFrame([("q", f"a{i}", i / 500, i / 500) for i in range(500)], "query_id string, node string, ppr_raw double, ppr_score double")
    blended = ranking.blend(rows, scores)
    assert as_set(blended, "query_id", "ppr_available", "ppr_score") == {("q", True, 0.01), ("z", False, None), (None, False, None)}
    assert "subquery" in blended._jdf.queryExecution().optimizedPlan().toString()


def test_texts_meet_only_the_expanded_rows_a_table_shows(spark, make_corpus, monkeypatch):
    ids = [f"p{i}" for i in range(20)]
    twice = [((p, [1.0, i / 3.0]), {"citation": [ids[(i * 3 + j) % 20] for j in range(6)]}) for i, p in enumerate(ids)]
    corpus = make_corpus([*twice, ((ids[5], [1.0, 5 / 3.0]), {"citation": ["p1"]})]).persist()
    search = Search(spark.createDataFrame([("p0",), ("p9",)], "query_id string"), corpus, k=3)
    whole = search.expanded.persist()
    assert whole.groupBy("query_id").count().agg({"count": "min"}).collect()[0][0] > 4
    expected = {tuple(r) for r in ranking.structural_top(whole, 4).collect()}
    met, with_corpus = [], search.with_corpus

    def counted(rows, *columns):
        if "first_seen" in rows.columns:
            assert "ppr_score" in rows.columns
            met.append(rows.groupBy("query_id").count().agg({"count": "max"}).collect()[0][0])
        return with_corpus(rows, *columns)

    monkeypatch.setattr(search, "with_corpus", counted)
    assert {tuple(r) for r in search.structural_top(4).collect()} == expected and met == [4]
    search.prompt().collect()
    assert met == [4, 3]
