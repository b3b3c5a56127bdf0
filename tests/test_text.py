from pyspark.sql import functions as F

from nearcite.functions import text
from nearcite.functions.distance import pair_distance
from nearcite.operators.network import _shown_value


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_format_date(spark):
    got = column(spark, [None, 0, 20240115, 20241399, 2024], "int", text.format_date)
    assert got == ["N/A", "N/A", "2024-01-15", "2024-13-99", "2024"]
    assert column(spark, [float("nan"), 20240115.0], "double", text.format_date) == ["N/A", "2024-01-15"]


def test_extract_text(spark):
    rows = spark.createDataFrame([(1, ("a",), "p"), (2, (None,), None), (3, None, "")], "i int, s struct<value:string>, t string")
    got = rows.orderBy("i").select(text.extract_text(rows, "s"), text.extract_text(rows, "t")).collect()
    assert [tuple(r) for r in got] == [("a", "p"), ("", ""), ("", "")]


def test_clean_id(spark):
    raw = [" 8,410,469 ", "us8410469", "us-8410469-b2", "US-8410469", "", "\t8410469\n", "USUS1", None]
    assert column(spark, raw, "string", text.clean_id) == [
        "8410469", "US8410469", "US-8410469-B2", "US-8410469", "", "8410469", "USUS1", None,
    ]
    number = lambda v: text.id_number(text.clean_id(v))
    assert column(spark, raw, "string", number) == ["8410469", "8410469", None, None, None, "8410469", None, None]


def test_scores(spark):
    tiers = column(spark, [0.95, 0.90, 0.85, 0.80, 0.75, 0.7499], "double", text.score_tier)
    assert tiers == [6, 5, 4, 3, 2, 1]
    whole = lambda v: text.whole_percent(text.unit_score(v))
    assert column(spark, [0.29, 1.3, -0.2, None, float("nan")], "double", whole) == [28, 100, 0, 0, 0]
    assert column(spark, [0.5, 0.6, 0.8, 0.85, 0.9, 0.91], "double", text.score_tier_legacy) == [1, 2, 2, 3, 3, 4]
    assert column(spark, [0.0, 1.0, 0.5], "double", text.node_size) == [14, 66, 40]
    assert column(spark, [None, 1.2, -1.0, 0.5], "double", text.percent) == [None, 100.0, 0.0, 50.0]


def test_sections(spark):
    codes = ["A01", "h02", "9X", "", None]
    assert column(spark, codes, "string", text.cpc_section) == ["A", "H", None, None, None]
    assert column(spark, ["A", "Z"], "string", text.cpc_label) == ["A - Human Necessities", "Z - Z"]


def test_texts(spark):
    assert column(spark, [0.12345, 1.0], "double", text.percent_text) == ["12.35%", "100.00%"]
    assert column(spark, [0.06375], "double", text.fixed4_text) == ["0.0638"]
    assert column(spark, ["abc"], "string", text.content_key) == ["a9993e364706"]
    filled = lambda v: text.fill_template("<{x}> and {y}", {"x": v, "y": F.lit("z")})
    assert column(spark, ["{y}", None], "string", filled) == ["<{y}> and z", "<> and z"]


def test_pair_distance(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    by = {m: [r[0] for r in rows.select(pair_distance(F.col("a"), F.col("b"), m)).collect()] for m in ("cosine", "euclidean", "dot_product")}
    assert by["cosine"] == [0.04, None]
    assert by["euclidean"] == [round(2**0.5, 12), 1.0]
    assert by["dot_product"] == [-24.0, 0.0]


def test_shown_value(spark):
    rows = spark.createDataFrame([(1, 45.0, 1.5, "", True), (2, 0.0, 2.0, "x", False)], "i int, a double, b double, c string, d boolean")
    got = rows.orderBy("i").select(*[_shown_value(rows, c) for c in "abcd"]).collect()
    assert [tuple(r) for r in got] == [("45", "1.5", None, "true"), (None, "2", "x", None)]
