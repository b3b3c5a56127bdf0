from datetime import datetime, timedelta

import pytest

from conftest import as_set, document
from conftest import CORPUS_DDL
from nearcite.operators import merge, status
from nearcite.plans.lifecycle import lifecycle
from nearcite.sources import corpus as corpora
from nearcite.sources import sinks
from nearcite.streaming import refresh
from nearcite.streaming import status as stream


def links(row):
    return {c: [x["publication_number"] for x in row[c] or []] for c in ("citation", "cited_by", "parent", "child")}


@pytest.fixture
def target_and_source(make_corpus):
    target = make_corpus([(("a", [1.0, 0.0]), {"title": "old", "citation": ["x"]}), (("b", [0.0, 1.0]), {"parent": ["y"]})])
    source = make_corpus([(("a", [0.5, 0.5]), {"title": "new", "citation": ["x", "z"], "child": ["w"]}), (("c", [1.0, 1.0]), {})])
    return target, source


def test_merge(target_and_source):
    target, source = target_and_source
    merged = merge.merge(target, source)
    rows = {r["publication_number"]: r for r in merged.collect()}
    assert merged.columns == target.columns and rows.keys() == {"a", "b", "c"}
    assert rows["a"]["title"]["value"] == "old" and rows["a"]["embedding_v1"] == [1.0, 0.0]
    assert links(rows["a"]) == {"citation": ["x", "z"], "cited_by": [], "parent": [], "child": ["w"]}
    assert links(rows["b"])["parent"] == ["y"] and rows["c"]["title"]["value"] == "title c"
    again = {r["publication_number"]: r for r in merge.merge(merged, source).collect()}
    assert again == rows
    assert as_set(merge.merge_stats(target, source), "action", "n") == {("inserted", 1), ("updated", 1), ("untouched", 1)}
    titled = merge.merge(target, source, update_cols=("title",)).where("publication_number = 'a'").first()
    assert titled["title"]["value"] == "new" and links(titled)["citation"] == ["x"]


def test_merge_refuses_repeated_source_keys(target_and_source):
    target, source = target_and_source
    twice = source.unionByName(source)
    assert as_set(merge.merge_dup_check(twice), "publication_number", "n") == {("a", 2), ("c", 2)}
    with pytest.raises(Exception, match="several source rows for key"):
        merge.merge(target, twice).collect()


def test_build(spark):
    base = spark.createDataFrame(
        [
            ("a", "1", 20060101, 1, None, [("N", "US"), ("M", "US")], [], [], [], [], [], "US"),
            ("early", "2", 20051231, 1, None, [], [], [], [], [], [], "US"),
            ("abroad", "3", 20100101, 1, None, [], [], [], [], [], [], "EP"),
            ("bare", "4", 20100101, 1, None, [], [], [], [], [], [], "US"),
            ("alone", "5", 20100101, 1, None, [], [], [], [], [], [], "US"),
        ],
        "publication_number string, application_number string, filing_date int, publication_date int, grant_date int, "
        "assignee_harmonized array<struct<name:string,country:string>>, inventor_harmonized array<struct<name:string,country:string>>, "
        "citation array<struct<publication_number:string>>, parent array<struct<publication_number:string>>, "
        "child array<struct<publication_number:string>>, cpc array<struct<code:string>>, country_code string",
    )
    research = spark.createDataFrame(
        [(p, ("t",), ("x",), None if p == "bare" else [1.0], [], []) for p in ("a", "early", "abroad", "bare")],
        "publication_number string, title struct<value:string>, abstract struct<value:string>, embedding_v1 array<float>, "
        "cited_by array<struct<publication_number:string>>, top_terms array<struct<value:string>>",
    )
    built = corpora.build_corpus(base, research)
    row = built.collect()
    assert [r["publication_number"] for r in row] == ["a"] and len(built.columns) == 18
    assert (row[0]["primary_assignee"], row[0]["primary_inventor"]) == ("N", None)
    assert dict(built.dtypes)["embedding_v1"] == "array<double>"
    assert len(corpora.build_corpus_min(base, research).columns) == 9
    assert corpora.build_corpus(base, research, country="EP").first()["publication_number"] == "abroad"


def test_tables_and_positions(spark, make_corpus, tmp_path):
    corpus = make_corpus([((f"p{i:03d}", [1.0, float(i)]), {}) for i in range(50)]).repartition(3)
    path, copy = str(tmp_path / "corpus"), str(tmp_path / "copy")
    corpora.write_corpus(corpus, path)
    corpora.copy_corpus(spark, path, copy)
    assert sorted(corpora.read_corpus(spark, copy).collect()) == sorted(corpus.collect())
    sinks.export_table(corpus, str(tmp_path / "export"))
    assert spark.read.parquet(str(tmp_path / "export")).count() == 50
    assert as_set(corpora.id_position_map(corpus), "publication_number", "position") == {(f"p{i:03d}", i) for i in range(50)}
    ranges = corpora.file_row_ranges(spark, path).orderBy("file").collect()
    assert sum(r["n_rows"] for r in ranges) == 50
    assert [r["first_row"] for r in ranges] == [sum(x["n_rows"] for x in ranges[:i]) for i in range(len(ranges))]
    assert corpora.scan_probe(corpus).count() == 1


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame(
        [("q", 2, "b", None), ("q", 1, "a", 'say "hi", twice'), ("z", 1, "c", "two\nlines")],
        "query_id string, rank int, publication_number string, title_text string",
    )
    sinks.write_csv(table, str(tmp_path / "csv"), per_query=True)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert as_set(back, "query_id", "rank", "publication_number", "title_text") == {
        ("q", "2", "b", None), ("q", "1", "a", 'say "hi", twice'), ("z", "1", "c", "two\nlines"),
    }
    context = spark.createDataFrame([("q", "one\ntwo"), ("z", "three")], "query_id string, context string")
    sinks.write_text(context, str(tmp_path / "text"), per_query=True)
    texts = spark.read.text(str(tmp_path / "text"), wholetext=True)
    assert as_set(texts, "query_id", "value") == {("q", "one\ntwo\n"), ("z", "three\n")}
    for kind in ("parquet", "json"):
        sinks.write_graph(table, context, str(tmp_path / kind), kind, per_query=True)
        assert spark.read.format(kind).load(str(tmp_path / kind / "nodes")).count() == 3
        assert spark.read.format(kind).load(str(tmp_path / kind / "edges")).count() == 2


def test_stream_merge(spark, make_corpus, tmp_path):
    arriving, folder, checkpoint = (str(tmp_path / n) for n in ("in", "corpus", "checkpoint"))
    refresh.publish(make_corpus([(("a",), {"citation": ["x"]}), (("b",), {})]), folder, 0)

    def arrive(rows):
        make_corpus(rows).coalesce(1).write.mode("append").parquet(arriving)
        refresh.stream_merge(spark, arriving, folder, checkpoint).awaitTermination(120)

    arrive([(("a",), {"citation": ["x", "y"], "title": "later"}), (("c",), {})])
    rows = {r["publication_number"]: r for r in refresh.read_latest(spark, folder).collect()}
    assert rows.keys() == {"a", "b", "c"} and links(rows["a"])["citation"] == ["x", "y"]
    assert rows["a"]["title"]["value"] == "title a"
    assert refresh.versions(spark, folder) == [0, 1]

    arrive([(("c",), {"parent": ["a"]}), (("d",), {})])
    rows = {r["publication_number"]: r for r in refresh.read_latest(spark, folder).collect()}
    assert rows.keys() == {"a", "b", "c", "d"} and links(rows["c"])["parent"] == ["a"]
    refresh.stream_merge(spark, arriving, folder, checkpoint).awaitTermination(120)
    assert refresh.versions(spark, folder) == [0, 1, 2]
    assert refresh.read_latest(spark, folder, below=1).count() == 2


def test_stream_into_an_empty_folder(spark, make_corpus, tmp_path):
    arriving, folder, checkpoint = (str(tmp_path / n) for n in ("in", "corpus", "checkpoint"))
    make_corpus([(("a",), {})]).write.parquet(arriving)
    assert refresh.read_latest(spark, folder) is None
    refresh.stream_merge(spark, arriving, folder, checkpoint).awaitTermination(120)
    assert refresh.read_latest(spark, folder).count() == 1


def test_a_stream_that_fails_gives_no_result(spark, make_corpus, tmp_path):
    arriving, folder, checkpoint = (str(tmp_path / n) for n in ("in", "corpus", "checkpoint"))
    refresh.publish(make_corpus([(("a",), {})]), folder, 0)
    with pytest.raises(RuntimeError, match="no version above 0"):  # the corpus before the stream is not its result
        refresh.read_latest(spark, folder, above=0)
    with pytest.raises(RuntimeError, match="no version above 0"):
        refresh.read_latest(spark, str(tmp_path / "none"), above=0)
    make_corpus([(("c",), {})]).write.parquet(arriving)

    def fails(batch):
        raise ValueError("broken batch")

    with pytest.raises(Exception, match="broken batch"):
        refresh.finish(refresh.stream_merge(spark, arriving, folder, checkpoint, rows_of=fails))
    with pytest.raises(RuntimeError, match="no version above 0"):
        refresh.read_latest(spark, folder, above=0)
    refresh.finish(refresh.stream_merge(spark, arriving, folder, checkpoint))
    assert as_set(refresh.read_latest(spark, folder, above=0), "publication_number") == {("a",), ("c",)}


def test_stream_queries_wait_to_the_end(spark, make_corpus, tmp_path, monkeypatch):
    """A merge that outlasts any given time is waited for: what stood there before it is never returned."""
    import registry

    corpus = make_corpus([(("a",), {"citation": ["x"]}), (("b",), {})])
    tables = registry.Tables(spark, str(tmp_path))
    tables.corpus, tables.snapshot, waits, start = corpus, corpus.where("publication_number = 'a'"), [], refresh.stream_merge

    class Slow:
        def __init__(self, query):
            self.query = query

        def awaitTermination(self, timeout=None):
            waits.append(timeout)
            return False if timeout else self.query.awaitTermination()

    monkeypatch.setattr(refresh, "stream_merge", lambda *a: Slow(start(*a)))
    got = {r["publication_number"] for r in registry.stream_merge(tables).collect()}
    assert got == {"a", "b"} and waits == [None]


def test_a_batch_moves_keys_to_find_newer_rows(spark, make_corpus, tmp_path, monkeypatch):
    arriving, folder, checkpoint = (str(tmp_path / n) for n in ("in", "corpus", "checkpoint"))
    refresh.publish(make_corpus([(("a",), {})]), folder, 0)
    merged, real = [], refresh.ranges.StoredCorpus.merge

    def merge_(store, rows, **how):
        merged.append(rows._jdf.queryExecution().executedPlan().toString())
        return real(store, rows, **how)

    monkeypatch.setattr(refresh.ranges.StoredCorpus, "merge", merge_)
    make_corpus([(("c",), {"citation": ["x"]}), ((None,), {})]).coalesce(1).write.parquet(arriving)
    make_corpus([(("c",), {"citation": ["y"]}), (("d",), {}), ((None,), {})]).coalesce(1).write.mode("append").parquet(arriving)
    refresh.finish(refresh.stream_merge(spark, arriving, folder, checkpoint))
    rows = sorted((str(r["publication_number"]), links(r)["citation"]) for r in refresh.read_latest(spark, folder, above=0).collect())
    assert [k for k, _ in rows] == ["None", "a", "c", "d"] and rows[2][1] in (["x"], ["y"])
    assert "hashpartitioning" not in merged[0] and "Aggregate" not in merged[0]


def test_lifecycle(spark):
    def rows(names):
        return spark.createDataFrame([document(n, [1.0, float(i) - 2, 0.5]) for i, n in names], CORPUS_DDL)

    old, new = rows(list(enumerate("abcdefgh"))), rows(list(enumerate("efghijkl", 4)))
    got = {r["stage"]: (r["rows"], r["indexed"], r["coverage_pct"]) for r in lifecycle(old, new, 2).collect()}
    assert got == {"1 indexed": (8, 8, 100.0), "2 merged": (12, 8, pytest.approx(66.6667, abs=1e-3)), "3 indexed again": (12, 12, 100.0)}


NOW = datetime(2024, 2, 10, 12)


def test_refresh_status(spark):
    def ago(**kw):
        return NOW - timedelta(**kw)

    runs = spark.createDataFrame(
        [
            ("fresh", 1, ago(seconds=1), "SUCCEEDED", None),
            ("six", 1, ago(days=6, hours=23), "SUCCEEDED", None),
            ("seven", 1, ago(days=7), "SUCCEEDED", None),
            ("failed", 1, ago(days=8), "SUCCEEDED", None),
            ("failed", 2, ago(days=1), "FAILED", "boom"),
            ("running", 1, ago(hours=2), "RUNNING", None),
            ("d60", 1, ago(days=60), "FAILED", None),
            ("d61", 1, ago(days=61), "FAILED", None),
            ("d90", 1, ago(days=90, hours=5), "FAILED", None),
            ("d91", 1, ago(days=91), "FAILED", None),
            ("rest", 1, NOW - timedelta(days=5) - timedelta(milliseconds=-400), "SUCCEEDED", None),
        ],
        "job_id string, run_id int, run_time timestamp, state string, error string",
    )
    got = {r["job_id"]: r for r in status.refresh_status(runs, NOW).collect()}
    cooldown = {j: got[j]["cooldown_days"] for j in ("fresh", "six", "seven", "failed", "running", "rest")}
    assert cooldown == {"fresh": 7, "six": 1, "seven": 0, "failed": 0, "running": 0, "rest": 2}
    assert [got[j]["freshness"] for j in ("d60", "d61", "d90", "d91")] == ["current", "aging", "aging", "stale"]
    assert (got["fresh"]["refreshed"], got["failed"]["refreshed"], got["seven"]["refreshed"]) == ("today", "yesterday", "7 days ago")
    assert got["failed"]["can_trigger"] and got["failed"]["last_error"] == "boom" and got["failed"]["last_run_id"] == 2
    assert not got["running"]["can_trigger"] and got["running"]["in_flight"]
    assert not got["six"]["can_trigger"] and got["seven"]["can_trigger"]
    off = status.refresh_status(runs, NOW, configured=False)
    assert off.where("can_trigger").count() == 0


def test_a_stream_of_runs_keeps_the_status(spark, tmp_path):
    def rows(runs):
        return spark.createDataFrame(runs, "job_id string, run_id int, run_time timestamp, state string, error string")

    first = [("a", 1, NOW - timedelta(days=9), "SUCCEEDED", None), ("a", 2, NOW - timedelta(days=3), "FAILED", "x"), ("b", 1, NOW - timedelta(days=70), "FAILED", None)]
    later = [("a", 3, NOW - timedelta(hours=1), "RUNNING", None), ("c", 1, NOW, "SUCCEEDED", None), ("b", 2, NOW - timedelta(days=80), "SUCCEEDED", None)]
    folders = [str(tmp_path / n) for n in ("in", "states", "checkpoint")]
    seen = []
    for part in (first, later, []):
        if part:
            rows(part).coalesce(1).write.mode("append").parquet(folders[0])
            seen += part
        stream.stream_status(spark, *folders, rows(first).schema).awaitTermination(120)
        got = status.status_of(stream.read_states(spark, folders[1]), NOW)
        assert sorted(map(str, got.collect())) == sorted(map(str, status.refresh_status(rows(seen), NOW).collect()))
    assert spark.read.parquet(folders[1]).where("batch = 1").count() == 3
