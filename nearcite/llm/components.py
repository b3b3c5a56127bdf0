"""Connected components by alternating stars, for links of any count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """_node and _root, the smallest node reachable, for every node of the links (_a, _b).

    Large star: the larger neighbours of a node are hung on its smallest neighbour; small star: the smaller
    ones too. All groups are minima with a combine before the shuffle. A step ends in a written table; the
    steps end when one changes nothing, after about as many as the logarithm of the longest path.
    """
    edges = stored(_small_star(links.where("_a != _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b"))), "links")
    state = _fingerprint(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), "links")
        now = _fingerprint(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("_b").alias("_node")).distinct().withColumn("_root", F.col("_node"))
    return edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_root")).union(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("_a", "_b")), F.lit(0)).alias("x")).collect()[0]
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    least = both.groupBy("_a").agg(F.min("_b").alias("_m")).select("_a", F.least("_a", "_m").alias("_m"))
    return both.join(least, "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).where("_a != _b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("_a").agg(F.min("_b").alias("_m"))
    inner = edges.join(least, "_a").where("_b != _m").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
    return inner.union(least.select("_a", F.col("_m").alias("_b"))).distinct()
