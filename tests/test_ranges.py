"""The corpus stored by key range: lookups and merges against the plain forms, and what they read and write."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import as_set
from nearcite.operators import expand, merge
from nearcite.sources import ranges
from nearcite.sources.corpus import query_vectors

RNG = random.Random(5)


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(f"{path}/rows") for n in names if n.endswith(".parquet")}


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def corpus(make_corpus):
    return make_corpus([((f"US-{i:04d}-B2", [float(i), 1.0]), {"citation": [f"US-{i + 1:04d}-B2"]}) for i in RNG.sample(range(400), 400)])


@pytest.fixture(scope="module")
def store(corpus, tmp_path_factory):
    return ranges.create(corpus, str(tmp_path_factory.mktemp("store") / "corpus"), rows_per_range=25)


def ids(spark, names, column="publication_number"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


@pytest.mark.parametrize("borders", [[""], ["", "b"], ["", "a", "b", "ba", "c", "é", "日"], ["", *(f"{i:03d}" for i in range(200))]])
def test_positions(spark, borders):
    keys = ["", "a", "aa", "b", "b\0", "zz", "é", "日本", "050", "0505", "199x", "\U0010ffff"]
    got = {r["k"]: r["p"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", ranges.position(F.col("k"), borders).alias("p")).collect()}
    assert got == {k: max(sum(b <= k for b in borders) - 1, 0) for k in keys}


def test_stored_rows_and_map(store, corpus):
    assert rows_of(store.read()) == rows_of(corpus)
    assert 12 <= len(store.map) <= 20 and sum(r["n_rows"] for r in store.map) == 400
    for row, after in zip(store.map, store.map[1:], strict=False):
        assert row["border"] <= row["least"] <= row["greatest"] < after["border"]


def test_a_lookup_reads_only_its_ranges(spark, store, corpus):
    wanted = ids(spark, ["US-0003-B2", "US-0003-B2", "US-0399-B2", "US-0004-XX", "none", None])
    found = store.lookup(wanted)
    assert as_set(found, "publication_number") == {("US-0003-B2",), ("US-0399-B2",)} and found.count() == 2
    opened = store.read(store.touched(wanted)).select(F.input_file_name()).distinct().count()
    assert opened == 2 < len(files(store.path)) - 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(publication_number" in plan
    assert rows_of(store.lookup(corpus)) == rows_of(corpus)
    assert store.lookup(ids(spark, [])).count() == 0 and store.lookup(ids(spark, ["", "~"])).count() == 0


def test_lookups_equal_those_of_a_plain_corpus(spark, store, corpus):
    queries = ids(spark, ["US-0007-B2", "US-0101-B2", "gone"], "query_id")
    assert rows_of(query_vectors(queries, store)) == rows_of(query_vectors(queries, corpus))
    neighbors = spark.createDataFrame([("q", "US-0008-B2", 1), ("z", "US-0008-B2", 2), ("z", "gone", 3)], "query_id string, publication_number string, first_seen int")
    assert rows_of(expand.fetch_neighbors(neighbors, store)) == rows_of(expand.fetch_neighbors(neighbors, corpus))


def test_a_merge_leaves_other_ranges_alone(spark, make_corpus, corpus, tmp_path):
    path = str(tmp_path / "corpus")
    store = ranges.create(corpus, path, rows_per_range=25)
    before = files(path)
    source = make_corpus([(("US-0010-B2", [9.0, 9.0]), {"citation": ["x"], "title": "new"}), (("US-0010-C1", [1.0, 2.0]), {})])
    merged = store.merge(source)
    expected = rows_of(merge.merge(corpus, source))
    assert rows_of(merged.read()) == expected
    assert rows_of(store.read()) == rows_of(corpus)  # the version before is still there
    assert before < files(path) and len(files(path) - before) == 1
    again = store.merge(source)  # as after a failure
    assert rows_of(again.read()) == expected and len(files(path) - before) == 1
    assert ranges.versions(spark, path) == [0, 1] and ranges.latest(spark, path, below=1).version == 0
    assert ranges.vacuum(spark, path) == 1
    assert rows_of(ranges.latest(spark, path).read()) == expected and len(files(path)) == len(before)


def test_ranges_that_grow_are_cut(spark, make_corpus, corpus, tmp_path):
    store = ranges.create(corpus, str(tmp_path / "corpus"), rows_per_range=25)
    source = make_corpus([((f"US-{i:04d}-B2", [0.0, 1.0]), {"child": ["c"]}) for i in range(395, 700)])
    merged = store.merge(source)
    assert rows_of(merged.read()) == rows_of(merge.merge(corpus, source))
    assert max(r["n_rows"] for r in merged.map) <= 50 and len(merged.map) > len(store.map) + 5
    assert len({r["range"] for r in merged.map}) == len(merged.map)
    third = merged.merge(make_corpus([(("US-0650-B2", [0.0]), {}), (("A", [0.0]), {}), (("~", [0.0]), {})]))
    assert third.read().count() == merged.read().count() + 2
    assert as_set(third.lookup(ids(spark, ["US-0650-B2", "A", "~"])), "publication_number") == {("US-0650-B2",), ("A",), ("~",)}


def test_a_merge_refuses_repeated_keys_and_takes_an_empty_source(store, make_corpus):
    with pytest.raises(Exception, match="several source rows for key"):
        store.merge(make_corpus([(("US-0001-B2",), {}), (("US-0001-B2",), {})]), version=7)
    assert rows_of(store.merge(make_corpus([]), version=8).read()) == rows_of(store.read())


def test_an_empty_corpus(spark, make_corpus, tmp_path):
    store = ranges.create(make_corpus([]), str(tmp_path / "corpus"))
    assert store.read().count() == 0 and store.lookup(ids(spark, ["a"])).count() == 0
    merged = store.merge(make_corpus([(("a",), {})]))
    assert as_set(merged.read(), "publication_number") == {("a",)}


def test_a_merge_moves_a_row_once(spark, make_corpus, corpus, tmp_path, monkeypatch):
    """Beside the partitions it writes, only keys are stored; texts of known rows stay at home."""
    stored, placed, real = [], [], ranges._upserted
    monkeypatch.setattr(ranges, "materialize", lambda df, keep=ranges.materialize: stored.append(df.columns) or keep(df))
    monkeypatch.setattr(ranges, "_upserted", lambda rows, *a: placed.append(rows) or real(rows, *a))
    store = ranges.create(corpus, str(tmp_path / "corpus"), rows_per_range=25)
    source = make_corpus([((f"US-{i:04d}-B2", [0.0, 1.0]), {"child": ["c"], "citation": None}) for i in range(200, 500)])
    merged = store.merge(source)
    assert rows_of(merged.read()) == rows_of(merge.merge(corpus, source))
    assert stored and all({"title", "abstract", "embedding_v1"}.isdisjoint(columns) for columns in stored)
    sent = placed[0].where(F.col("_new"))
    assert sent.count() == 300 and sent.where("abstract IS NOT NULL").count() < 150
    assert placed[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(piece") == 1


def test_null_and_repeated_keys_of_stored_rows(spark, make_corpus, tmp_path):
    store = ranges.create(make_corpus([(("a", [1.0]), {}), (("a", [2.0]), {}), ((None, [3.0]), {})]), str(tmp_path / "corpus"))
    source = make_corpus([(("a", [9.0]), {"citation": ["x"]}), ((None, [4.0]), {"citation": ["y"]})])
    got = {(r[0], r[1][0], tuple(x[0] for x in r[2])) for r in store.merge(source).read().select("publication_number", "embedding_v1", "citation").collect()}
    assert got == {("a", 1.0, ("x",)), ("a", 2.0, ("x",)), (None, 3.0, ()), (None, 4.0, ("y",))}
