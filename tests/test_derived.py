from datetime import datetime

from pyspark.sql import functions as F

from nearcite.sources.derived import Derived


def test_parts_of_a_document_meet_by_one_key(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("embeddings", [(i, [1.0, float(i)], i % 2) for i in range(4)], "vec_id bigint, embedding array<float>, label int")
    write("part", [(i, f"p{i}", f"t{i}") for i in range(6)], "p_partkey bigint, p_name string, p_type string")
    write("documents", [(1, "b"), (0, "a"), (2, None)], "doc_id bigint, text string")
    day = datetime(2001, 1, 1)
    orders = [(9, 3, day, "1-URGENT"), (1, 2, day, "1-URGENT"), (5, 1, day, "5-LOW"), (13, None, day, "1-URGENT")]
    write("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string")
    derived = Derived(spark, str(tmp_path))
    rows = {r["vec_id"]: r for r in derived.documents().collect()}
    assert [rows[i]["title_value"] for i in range(4)] == ["p0 p4", "p1 p5", "p2", "p3"]
    assert [rows[i]["abstract_value"] for i in range(4)] == ["a", "b", "", "a"]
    base, research = derived.base(), derived.research()
    cited = {r[0]: [x[0] for x in r["citation"]] for r in base.select("publication_number", "citation").collect()}
    assert cited["US-8000001-B1"] == ["US-8000002-B2", "US-8000001-B1", None]  # 2*7 % 4, 3*7 % 4, by order key
    both = base.join(F.broadcast(research), "publication_number")
    assert both.count() == 4
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert "abstract_value" not in base._jdf.queryExecution().analyzed().toString()  # texts are not joined in vain


def test_a_snapshot_moves_only_its_own_texts(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("embeddings", [(i, [1.0, float(i)], i % 2) for i in range(50)], "vec_id bigint, embedding array<float>, label int")
    write("part", [(i, f"p{i}", f"t{i}") for i in range(60)], "p_partkey bigint, p_name string, p_type string")
    write("documents", [(i, f"text {i}") for i in range(100)], "doc_id bigint, text string")
    write("orders", [(9, 3, datetime(1998, 1, 1), "1-URGENT")], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string")
    derived = Derived(spark, str(tmp_path))
    whole = {r["publication_number"]: (r["title_value"], r["abstract_value"]) for r in derived.documents().where("publication_date < 20150101").collect()}
    older = {r["publication_number"]: (r["title"]["value"], r["abstract"]["value"]) for r in derived.snapshot().collect()}
    assert older == whole and 0 < len(older) < 50
    texts = derived._joined("documents", "doc_id", "text", "abstract_value", 20150101)
    assert texts.count() == len(older)
