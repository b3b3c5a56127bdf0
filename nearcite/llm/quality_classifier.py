"""Document quality: a classifier's evidence with empirical Bayes priors of host and path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearcite.llm.common import row_key, stored

#: Most labelled rows that the document classifier is fitted on; priors use all labels.
FIT_ROWS = 20_000
FEATURES = 9
SMOOTHING = 20.0
ODDS_CAP = 2.0


def _features_of(text: str) -> list[float]:
    """Shares and logarithms that tell prose from junk; all zero for no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    grams = {(words[i], words[i + 1], words[i + 2]) for i in range(n - 2)}
    return [
        1.0,
        min(sum(text.count(c) for c in "#*$%&|<>") / chars, 1.0),
        1 - len(grams) / max(n - 2, 1) if n > 2 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(words[i] == words[i - 1] for i in range(1, n)) / n,
        sum(not any(map(str.isalpha, w)) for w in words) / n,
        min(abs(chars / n - 5.5) / 5.5, 4.0),
        1.0 if n < 10 else 0.0,
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([_features_of(t or "") for t in batch["_text"].to_pylist()], np.float64).reshape(-1, FEATURES)
        features = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FEATURES).cast(pa.list_(pa.float64()))
        columns = [*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "_text"), features]
        yield pa.RecordBatch.from_arrays(columns, [*(n for n in batch.schema.names if n != "_text"), "_x"])


def fit_classifier(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; zeros without rows of both classes.

    The penalty falls on features in units of their deviation; the first is the constant.
    """
    weights = np.zeros(x.shape[1])
    if len(np.unique(y)) < 2:
        return weights
    scale = x.std(axis=0)
    scale[scale < 1e-12] = 1.0
    x = x / scale
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(hessian, x.T @ (y - p) - penalty * weights)
        weights += change
        if np.abs(change).max() < 1e-8:
            break
    return weights / scale


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_priors(labelled: DataFrame, smoothing: float = SMOOTHING) -> tuple[float, float, DataFrame, DataFrame]:
    """(global prior, its strength, host posteriors, path posteriors) from all labels.

    Labels are counted by path, with a combine before the shuffle, and paths summed by host. The strength of
    the global prior is the moment estimate over hosts: the more hosts agree, the more a sparse one shrinks.
    A path shrinks to its host's posterior in the same way with a fixed strength.
    """
    paths = stored(
        labelled.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("_y").alias("_good")), "paths"
    )
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_n"), F.sum("_good").alias("_good"))
    total = hosts.agg(F.sum("_n").alias("n"), F.sum("_good").alias("good")).collect()[0]
    n, good = total["n"] or 0, total["good"] or 0
    mean = (good + 1) / (n + 2)
    moment = hosts.where("_n > 1").agg(
        F.sum(F.col("_n") * F.pow(F.col("_good") / F.col("_n") - mean, 2)).alias("s"), F.sum("_n").alias("n"), F.count("*").alias("k")
    ).collect()[0]
    between = max((moment["s"] or 0.0) / max(moment["n"] or 0, 1) - mean * (1 - mean) * (moment["k"] or 0) / max(moment["n"] or 0, 1), 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    host_rows = hosts.select("_host", ((F.col("_good") + mean * strength) / (F.col("_n") + strength)).alias("_host_prior"))
    path_rows = paths.join(host_rows, "_host").select(
        "_host", "_path", "_host_prior", ((F.col("_good") + F.col("_host_prior") * smoothing) / (F.col("_n") + smoothing)).alias("_path_prior")
    )
    return mean, strength, stored(host_rows, "host-priors"), stored(path_rows, "path-priors")


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """_id, evidence (log odds from the text), host_prior, path_prior, score (probability of good) and kept.

    The classifier is fitted on at most ``fit_rows`` labelled rows, chosen by a hash of id and text; the priors
    on all. The score adds to the evidence what the path's posterior says beyond the global prior, by no more
    than ``ODDS_CAP`` in log odds either way, so a site shifts close calls and cannot condemn a clean text.

    Null and empty texts have no features and fall to the priors less the weight of being short; null hosts
    and paths are values of their own; unseen ones take the prior above them. Rows labelled twice count as
    often as they are labelled; null labels are left out. Without labels all scores are a half and all rows
    are kept. Repeated rows are scored each; an empty table gives no rows.
    """
    identity, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    known = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null"))
    rows = df.select(
        identity.alias("_id"), F.xxhash64(row_key(identity, text)).alias("_k"), known(host_col).alias("_host"), known(path_col).alias("_path"), text.alias("_text")
    )
    kind = rows.schema["_id"].dataType.simpleString()
    features = stored(rows.mapInArrow(_featured, f"_id {kind}, _k long, _host string, _path string, _x array<double>"), "features")
    given = labels.select(F.col(f"`{label_id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_y")).where("_y IS NOT NULL")
    labelled = stored(features.join(given, "_id"), "labelled")
    # a share of the hash range that holds nine tenths of the bound: no task sends more than its part of it
    share = min(1.0, 0.9 * fit_rows / max(labelled.count(), 1))
    chosen = labelled.where(F.pmod("_k", F.lit(1 << 31)) < F.lit(share * (1 << 31)))
    sample = chosen.select("_k", "_x", "_y").limit(fit_rows).toPandas().sort_values(["_k", "_y"])
    x = np.array(sample["_x"].tolist(), np.float64).reshape(-1, FEATURES)
    weights = fit_classifier(x, sample["_y"].to_numpy(np.float64))
    mean, _, hosts, paths = site_priors(labelled.select("_host", "_path", "_y"))
    evidence = F.aggregate(
        F.zip_with("_x", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b
    )
    out = features.join(paths.drop("_host_prior"), ["_host", "_path"], "left").join(hosts, "_host", "left")
    host_prior = F.coalesce(F.col("_host_prior"), F.lit(float(mean)))
    path_prior = F.coalesce(F.col("_path_prior"), host_prior)
    beyond = _logit(path_prior) - _logit(F.lit(float(mean)))
    beyond = F.greatest(F.lit(-ODDS_CAP), F.least(F.lit(ODDS_CAP), beyond))
    out = out.select("_id", evidence.alias("evidence"), host_prior.alias("host_prior"), path_prior.alias("path_prior"), beyond.alias("_beyond"))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.col("_beyond")))))
    return out.select("_id", "evidence", "host_prior", "path_prior", "score", (F.col("score") >= 0.5).alias("kept"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).withColumnRenamed("_id", "doc_id")
