"""Build, index, merge, index again."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearcite.operators.ivf import IvfIndex, fit_ivf, ivf_coverage, read_index, update_index, write_index
from nearcite.operators.merge import merge, merge_actions
from nearcite.session import checkpoint_dir, materialize


def refresh_index(index: IvfIndex, target: DataFrame, source: DataFrame) -> IvfIndex:
    """Lists for the rows a merge inserts; rows already known keep their vectors and lists, and most lists their files."""
    inserted = merge_actions(target, source).where(F.col("action") == "inserted")
    return update_index(index, source.join(inserted, "publication_number", "left_semi"))


def stored_index(corpus: DataFrame, num_lists: int | None = None, distance: str = "cosine", **columns: str) -> IvfIndex:
    """An index fitted on the corpus and stored in a new folder among the session's tables."""
    path = f"{checkpoint_dir(corpus.sparkSession)}/index-{uuid.uuid4().hex}"
    write_index(fit_ivf(corpus, num_lists, distance=distance, **columns), path)
    return read_index(corpus.sparkSession, path)


def lifecycle(target: DataFrame, source: DataFrame, num_lists: int | None = None) -> DataFrame:
    """Index coverage at each stage: ``(stage, rows, indexed, coverage_pct)``."""
    index = stored_index(target, num_lists)
    merged = materialize(merge(target, source))
    stages = {
        "1 indexed": ivf_coverage(target, index),
        "2 merged": ivf_coverage(merged, index),
        "3 indexed again": ivf_coverage(merged, refresh_index(index, target, source)),
    }
    return reduce(
        DataFrame.unionByName,
        [table.select(F.lit(stage).alias("stage"), "rows", "indexed", "coverage_pct") for stage, table in stages.items()],
    )
