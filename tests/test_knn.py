import numpy as np
import pytest
from pyspark.sql import functions as F

from nearcite.operators import ivf, knn
from nearcite.plans.search import Search

RNG = np.random.default_rng(7)


def frame(spark, vectors, key, column="embedding_v1"):
    return spark.createDataFrame([(f"d{i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)], f"{key} string, {column} array<double>")


def brute(queries, corpus, k, distance):
    out = set()
    for qi, q in enumerate(queries):
        found = []
        for ci, c in enumerate(corpus):
            if distance == "euclidean":
                d = float(np.sqrt(((q - c) ** 2).sum()))
            elif distance == "dot_product":
                d = -float((q * c).sum())
            else:
                size = np.sqrt((q * q).sum()) * np.sqrt((c * c).sum())
                if not size:
                    continue
                d = max(0.0, 1.0 - float((q * c).sum()) / size)
            found.append((round(d, 9), f"d{ci:04d}"))
        out |= {(f"d{qi:04d}", pub, d) for d, pub in sorted(found)[:k]}
    return out


def result(df):
    return {(r[0], r[1], round(r[2], 9)) for r in df.collect()}


def vectors_with_copies(n, copies):
    """A third or so of the rows are copies of one vector; one row is zero."""
    base = RNG.normal(size=(n, 8))
    base[:copies] = base[0]
    base[n - 1] = 0.0
    return base


@pytest.mark.parametrize("distance", knn.METRICS)
@pytest.mark.parametrize("plan", ["scan", "chunked scan", "block"])
def test_equals_brute_force(spark, monkeypatch, distance, plan):
    vectors = vectors_with_copies(120, 40)
    queries = vectors[::3]
    if plan == "chunked scan":
        monkeypatch.setattr(knn, "SCAN_CHUNK", 7)
        monkeypatch.setattr(knn, "SCORES_IN_MEMORY", 64)
    if plan == "block":
        monkeypatch.setattr(knn, "SHIPPED_QUERIES", 3)
        monkeypatch.setattr(knn, "QUERY_BLOCK", 11)
        monkeypatch.setattr(knn, "CORPUS_BLOCK", 17)
    corpus = frame(spark, vectors, "publication_number").repartition(5)
    got = knn.knn_join(frame(spark, queries, "query_id"), corpus, 6, distance)
    assert result(got) == brute(queries, vectors, 6, distance)


def test_candidates_do_not_grow_with_corpus_blocks(spark, monkeypatch):
    """A task answers once for all the corpus blocks that pass it; every row still counts."""
    monkeypatch.setattr(knn, "SHIPPED_QUERIES", 3)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 11)
    monkeypatch.setattr(knn, "CORPUS_BLOCK", 17)
    sent, nearest = [], knn.nearest
    monkeypatch.setattr(knn, "nearest", lambda found, k: sent.append(found.count()) or nearest(found, k))
    vectors = vectors_with_copies(120, 40)
    corpus = frame(spark, vectors, "publication_number").repartition(5)
    got = knn.knn_join(frame(spark, vectors[::3], "query_id"), corpus, 6, "euclidean")
    assert result(got) == brute(vectors[::3], vectors, 6, "euclidean")
    assert sent == [40 * 6]


@pytest.mark.parametrize("distance", knn.METRICS)
def test_pieces_of_the_corpus(spark, monkeypatch, distance):
    """More pieces than one, some of them empty, and ties that fall into different pieces and blocks."""
    for name, value in {"SHIPPED_QUERIES": 3, "QUERY_BLOCK": 11, "CORPUS_BLOCK": 4, "STREAMED_ROWS": 7}.items():
        monkeypatch.setattr(knn, name, value)
    vectors = vectors_with_copies(60, 40)
    got = knn.knn_join(frame(spark, vectors[::3], "query_id"), frame(spark, vectors, "publication_number"), 6, distance)
    assert result(got) == brute(vectors[::3], vectors, 6, distance)


def test_null_keys_come_last_among_equals_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHIPPED_QUERIES", 1)
    queries = spark.createDataFrame([("q1", [1.0, 0.0]), (None, [0.0, 1.0])], "query_id string, embedding_v1 array<double>")
    corpus = spark.createDataFrame(
        [(None, [1.0, 0.0]), ("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("c", [0.0, 1.0]), ("d", None)],
        "publication_number string, embedding_v1 array<double>",
    )
    got = sorted(((r[0] or "", r[1] or "") for r in knn.knn_join(queries, corpus, 2).collect()))
    assert got == [("", "c"), ("", "c"), ("q1", "a"), ("q1", "b")]


def test_fewer_rows_than_k_and_no_queries(spark):
    corpus = frame(spark, RNG.normal(size=(3, 8)), "publication_number")
    queries = frame(spark, RNG.normal(size=(2, 8)), "query_id")
    assert knn.knn_join(queries, corpus, 10).count() == 6
    assert knn.knn_join(queries.limit(0), corpus, 10).count() == 0


def test_unknown_distance(spark):
    corpus = frame(spark, RNG.normal(size=(3, 8)), "publication_number")
    with pytest.raises(Exception, match="unknown distance"):
        knn.knn_join(corpus.withColumnRenamed("publication_number", "query_id"), corpus, 1, "manhattan").collect()


@pytest.fixture(scope="module")
def clustered(spark):
    centers = RNG.normal(size=(6, 8)) * 3
    vectors = np.concatenate([c + RNG.normal(size=(40, 8)) for c in centers])
    vectors[:80] = vectors[0]  # one list holds a third of all rows, all alike
    corpus = frame(spark, vectors, "publication_number").persist()
    queries = frame(spark, vectors[::7], "query_id").persist()
    return corpus, queries, brute(vectors[::7], vectors, 10, "cosine"), ivf.fit_ivf(corpus, 8)


def test_all_lists_equal_full_search(clustered, monkeypatch):
    corpus, queries, expected, index = clustered
    monkeypatch.setattr(knn, "CORPUS_BLOCK", 16)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 8)
    assert result(ivf.ivf_topk(queries, index, 10, nprobe=len(index.centers))) == expected


@pytest.mark.parametrize("nprobe", [1, 3])
def test_bounded_search_is_exact(clustered, nprobe):
    corpus, queries, expected, index = clustered
    assert result(ivf.ivf_topk(queries, index, 10, nprobe=nprobe, exact=True)) == expected


def test_recall_grows_with_probes(clustered, spark):
    corpus, queries, expected, index = clustered
    full = spark.createDataFrame([(q, p) for q, p, _ in expected], "query_id string, publication_number string")
    one = ivf.ivf_topk(queries, index, 10, nprobe=1)
    three = ivf.ivf_topk(queries, index, 10, nprobe=3)
    low, high = (spark.range(1).select(ivf.recall(found, full)).first()[0] for found in (one, three))
    assert 0.5 <= low <= high <= 1.0 and high >= 0.9


def test_index_maintenance(clustered, spark, tmp_path):
    corpus, queries, expected, index = clustered
    assert ivf.ivf_coverage(corpus, index).first()["coverage_pct"] == 100.0
    new = frame(spark, RNG.normal(size=(5, 8)), "n").selectExpr("concat('new', n) AS publication_number", "embedding_v1")
    wider = corpus.select("publication_number", "embedding_v1").unionByName(new)
    assert ivf.ivf_coverage(wider, index).first()["indexed"] == 240
    grown = ivf.add_rows(index, new)
    assert ivf.ivf_coverage(wider, grown).first()["coverage_pct"] == 100.0
    assert ivf.add_rows(grown, new).lists.count() == 245
    ivf.write_index(grown, str(tmp_path / "index"))
    stored = ivf.read_index(spark, str(tmp_path / "index"))
    assert np.allclose(stored.centers, grown.centers)
    a = result(ivf.ivf_topk(queries, stored, 10, exact=True))
    assert a == result(knn.knn_join(queries, wider, 10))
    plan = ivf.ivf_topk(queries.limit(1), stored, 10, nprobe=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan
    assert ivf.list_count_range(4_000_000) == (2000, 8000)


def test_query_lost_among_copies(spark, make_corpus):
    """More equal vectors than k: the query is not in its own list and the first row stands in."""
    same = [1.0, 0.0]
    corpus = make_corpus([((f"p{i}", same), {}) for i in range(8)])
    queries = spark.createDataFrame([("p7",)], "query_id string")
    search = Search(queries, corpus, k=3)
    assert [(r.publication_number, r.is_query) for r in search.found.orderBy("row_no").collect()] == [
        ("p0", True), ("p1", False), ("p2", False),
    ]
    assert search.query_card().first()["publication_number"] == "p0"
    assert {r.node for r in search.nodes.collect()} == {"p0", "p1", "p2", "p7"}


# other distances, two levels, upkeep


@pytest.mark.parametrize("distance", ["euclidean", "dot_product"])
@pytest.mark.parametrize("nprobe", [1, 4])
def test_bounded_search_is_exact_for_other_distances(spark, distance, nprobe):
    vectors = vectors_with_copies(240, 80) * RNG.uniform(0.2, 4.0, size=(240, 1))  # of many lengths
    corpus, queries = frame(spark, vectors, "publication_number"), frame(spark, vectors[::9], "query_id")
    index = ivf.fit_ivf(corpus, 12, distance=distance)
    assert result(ivf.ivf_topk(queries, index, 7, nprobe=nprobe, exact=True)) == result(knn.knn_join(queries, corpus, 7, distance))
    longer = vectors[:30] * 5
    new = frame(spark, longer, "n").selectExpr("concat('n', n) AS publication_number", "embedding_v1")
    grown = ivf.add_rows(index, new)
    wider = corpus.unionByName(new)
    assert result(ivf.ivf_topk(queries, grown, 7, nprobe=nprobe, exact=True)) == result(knn.knn_join(queries, wider, 7, distance))


def test_the_second_pass_leaves_lists_out(spark):
    centers = RNG.normal(size=(16, 6)) * 8
    vectors = np.concatenate([c + RNG.normal(size=(30, 6)) for c in centers])
    corpus, queries = frame(spark, vectors, "publication_number"), frame(spark, vectors[::40], "query_id")
    for distance in knn.METRICS:
        index = ivf.fit_ivf(corpus, 16, distance=distance)
        q = knn.with_vector(queries, "query_id", "embedding_v1")
        found = ivf._search_lists(ivf._visit(q, index, nprobe=2), index, 5)
        bounded = q.join(found.groupBy("query_id").agg({"distance": "max"}).withColumnRenamed("max(distance)", "reach"), "query_id")
        more = ivf._visit(bounded, index, nprobe=2, beyond=True).count()
        assert more < 0.6 * queries.count() * (len(index.centers) - 2), distance


def test_very_many_lists_by_two_levels(spark):
    corpus = spark.range(40_000).select(
        F.concat(F.lit("d"), F.lpad("id", 5, "0")).alias("publication_number"), F.array(*[F.randn(i) for i in range(4)]).alias("embedding_v1")
    ).persist()
    index = ivf.fit_ivf(corpus, 30_000, max_iter=1)
    assert 25_000 < len(index.centers) <= 30_000 and len(index.coarse) == 173
    assert index.lists.count() == 40_000
    queries = corpus.where("publication_number < 'd00002'").withColumnRenamed("publication_number", "query_id")
    assert result(ivf.ivf_topk(queries, index, 3, nprobe=30, exact=True)) == result(knn.knn_join(queries, corpus, 3))
    corpus.unpersist()


def _list_files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_updates_rewrite_only_the_lists_they_touch(spark, tmp_path):
    centers = RNG.normal(size=(10, 6)) * 6
    vectors = np.concatenate([c + RNG.normal(size=(30, 6)) for c in centers])
    corpus, queries = frame(spark, vectors, "publication_number"), frame(spark, vectors[::11], "query_id")
    path = tmp_path / "index"
    ivf.write_index(ivf.fit_ivf(corpus, 10), str(path))
    index = ivf.read_index(spark, str(path))
    before = _list_files(path / "lists")
    rows = spark.createDataFrame([("new", vectors[5].tolist()), ("d0007", vectors[8].tolist())], "publication_number string, embedding_v1 array<double>")
    updated = ivf.update_index(index, rows)
    after = _list_files(path / "lists")
    assert all(after[f] == t for f, t in before.items()) and 1 <= len(after) - len(before) <= 3
    wider = corpus.where("publication_number <> 'd0007'").unionByName(rows)
    assert result(ivf.ivf_topk(queries, updated, 6, nprobe=2, exact=True)) == result(knn.knn_join(queries, wider, 6))
    assert result(ivf.ivf_topk(queries, ivf.read_index(spark, str(path), 0), 6, nprobe=2, exact=True)) == brute(vectors[::11], vectors, 6, "cosine")
    radii = {r["list_id"]: r["radius"] for r in updated.centroids.collect()}
    assert all(radii[r["list_id"]] == r["radius"] for r in updated.lists.groupBy("list_id").agg(F.max("gap").alias("radius")).collect())
    assert ivf.update_index(updated, rows).version == 2


@pytest.mark.parametrize("distance", knn.METRICS)
def test_overfull_lists_are_split(spark, tmp_path, distance):
    vectors = RNG.normal(size=(80, 5))
    corpus = frame(spark, vectors, "publication_number")
    ivf.write_index(ivf.fit_ivf(corpus, 8, distance=distance), str(tmp_path / "index"))
    index = ivf.read_index(spark, str(tmp_path / "index"))
    many = vectors[3] + RNG.normal(size=(300, 5)) * 0.2
    new = frame(spark, many, "n").selectExpr("concat('n', n) AS publication_number", "embedding_v1")
    updated = ivf.update_index(index, new)
    assert len(updated.centers) > len(index.centers) + 3
    assert updated.lists.count() == 380 and ivf.ivf_coverage(corpus.unionByName(new), updated).first()["coverage_pct"] == 100.0
    queries = frame(spark, np.concatenate([vectors[:5], many[:5]]), "query_id")
    expected = result(knn.knn_join(queries, corpus.unionByName(new), 6, distance))
    assert result(ivf.ivf_topk(queries, updated, 6, nprobe=2, exact=True)) == expected


def test_an_index_of_nothing(spark):
    empty = frame(spark, np.ones((1, 3)), "publication_number").limit(0)
    for distance in knn.METRICS:
        index = ivf.fit_ivf(empty, distance=distance)
        assert index.lists.count() == 0 and len(index.centers) == 0


def test_a_vector_travels_once_to_a_block_of_lists(spark, monkeypatch):
    vectors = vectors_with_copies(200, 60)
    corpus, queries = frame(spark, vectors, "publication_number"), frame(spark, vectors[::7], "query_id")
    index = ivf.fit_ivf(corpus, 16)
    q = knn.with_vector(queries, "query_id", "embedding_v1")
    assert ivf._visit(q, index, nprobe=len(index.centers)).count() == q.count()
    expected = result(knn.knn_join(queries, corpus, 5))
    monkeypatch.setattr(ivf, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(ivf, "SMALL_BLOCK", 10)
    monkeypatch.setattr(knn, "CORPUS_BLOCK", 16)
    monkeypatch.setattr(knn, "WINNERS_HELD", 5)
    index = ivf.replace(index)
    assert index.blocks.max() > 3
    assert result(ivf.ivf_topk(queries, index, 5, nprobe=2, exact=True)) == expected
