"""Distances between two array columns of the same row, JVM-side.

For search over many vectors use ``operators.knn``; these serve rows that already hold both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pair_distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    if metric == "cosine":
        scale = norm(a) * norm(b)
        value = F.when(scale > 0, F.greatest(F.lit(1.0) - dot(a, b) / scale, F.lit(0.0)))
    elif metric == "euclidean":
        gap = F.zip_with(a, b, lambda x, y: x - y)
        value = norm(gap)
    elif metric == "dot_product":
        value = -dot(a, b)
    else:
        raise ValueError(f"unknown distance {metric!r}")
    return F.round(value, 12)

