"""Kernel density estimation, and classifiers and scores built on it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.plans.stats import against_all, chunks, matrix, sqdist_rows


def _log_sums(queries: DataFrame, data: DataFrame, h: float, label: str | None) -> DataFrame:
    """(qid[, label], top, total): per cell of the grid, the largest exponent and the sum of exponentials below it."""
    def update(state: dict, x: np.ndarray, batch: dict) -> None:
        rows = matrix(batch["features"])
        labels = batch[label].to_numpy(zero_copy_only=False) if label else np.zeros(len(rows), np.int64)
        for c in np.unique(labels):
            own = rows[labels == c]
            top, total = state.setdefault(c, (np.full(len(x), -np.inf), np.zeros(len(x))))
            for q in chunks(len(x), len(own)):
                z = -sqdist_rows(x[q], own) / (2 * h * h)
                now = np.maximum(top[q], z.max(axis=1))
                total[q] = total[q] * np.exp(top[q] - now) + np.exp(z - now[:, None]).sum(axis=1)
                top[q] = now

    def finish(state: dict, x: np.ndarray) -> tuple:
        at = np.tile(np.arange(len(x)), len(state))
        return at, np.repeat(np.array(list(state)), len(x)), np.concatenate([t for t, _ in state.values()]), np.concatenate([s for _, s in state.values()])

    kind = data.schema[label].dataType.simpleString() if label else "bigint"
    columns = ["features", label] if label else ["features"]
    return against_all(queries, data.select(*columns), update, finish, ["label", "top", "total"], f"label {kind}, top double, total double")


def _constant(h: float, dim: int | None) -> float:
    """-ln(pi h^2) / 2 as the engine's definition has it; with a dimension, the constant that makes the density integrate to 1."""
    return -0.5 * math.log(math.pi * h * h) if dim is None else -0.5 * dim * math.log(2 * math.pi * h * h)


def log_density(queries: DataFrame, data: DataFrame, h: float = 1.0, label: str | None = None, dim: int | None = None) -> DataFrame:
    """(qid[, label], log_density) of queries (qid, features) under a Gaussian kernel on every row of data (features[, label]).

    One scan of data; no pair is a row. Cells' sums are combined with their largest exponents taken off.
    """
    sums = _log_sums(queries, data, h, label)
    keys = ["qid", "label"]
    whole = sums.groupBy(*keys).agg(F.max("top").alias("m"), F.collect_list(F.struct("top", "total")).alias("parts"))
    lse = F.col("m") + F.log(F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["total"] * F.exp(p["top"] - F.col("m"))))
    if label:
        n = data.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
        whole = whole.join(F.broadcast(n), F.col("label") == F.col("_l"))
    else:
        whole = whole.crossJoin(F.broadcast(data.agg(F.count(F.lit(1)).alias("_n"))))
    out = whole.withColumn("log_density", F.lit(_constant(h, dim)) + lse - F.log("_n"))
    return out.select("qid", "label", "log_density") if label else out.select("qid", "log_density")


def classify(queries: DataFrame, data: DataFrame, h: float | None = None, label: str = "label", dim: int | None = None) -> DataFrame:
    """(qid, predicted): the class of the largest density, no priors; the first class in order wins ties. h is max(7, 2.5 * dimension) by default."""
    if h is None:
        h = max(7.0, 2.5 * (dim or len(queries.select("features").first()[0])))
    each = log_density(queries, data, h, label)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("log_density"), "label"))
    return each.withColumn("_p", place).filter("_p = 1").select("qid", F.col("label").alias("predicted"))


def two_class_score(queries: DataFrame, first: DataFrame, second: DataFrame, h: float = 1.0) -> DataFrame:
    """(qid, score): 2 * d1 / max(1e-5, d1 + d2) - 1 for the densities of two sets (the rows of a class, or a codebook that stands for them)."""
    a = log_density(queries, first, h).select("qid", F.exp("log_density").alias("d1"))
    b = log_density(queries, second, h).select("qid", F.exp("log_density").alias("d2"))
    return a.join(b, "qid").select("qid", (2 * F.col("d1") / F.greatest(F.lit(1e-5), F.col("d1") + F.col("d2")) - 1).alias("score"))
