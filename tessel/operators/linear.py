"""Least-squares discriminant: one-hot targets, normal equations from one aggregation, a solve on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.vectors import argmax, dot, literal
from tessel.plans.stats import dimension, fold, matrix


@dataclass(frozen=True)
class LinearModel:
    labels: tuple
    weights: np.ndarray  # dimension x classes


def gram(data: DataFrame, label: str = "label") -> tuple[tuple, np.ndarray, np.ndarray]:
    """(labels in order, X'X, X'Z), Z the one-hot targets by the labels' order."""
    d = dimension(data)
    labels = tuple(r[0] for r in data.select(label).distinct().orderBy(label).collect())
    index = {v: k for k, v in enumerate(labels)}

    def partial(batch: dict) -> dict[int, np.ndarray]:
        x = matrix(batch["features"])
        z = np.eye(len(labels))[[index[v] for v in batch[label].to_pylist()]]
        return {0: np.r_[(x.T @ x).ravel(), (x.T @ z).ravel()]}

    v = fold(data.select("features", label), partial)[0]
    return labels, v[: d * d].reshape(d, d), v[d * d :].reshape(d, len(labels))


def fit(data: DataFrame, l2: float = 1e-5, label: str = "label", subtract: bool = True) -> LinearModel:
    """W = (X'X - l2 I)^-1 X'Z, without an intercept; the engine's definition subtracts the ridge term, subtract=False adds it."""
    labels, xx, xz = gram(data, label)
    return LinearModel(labels, np.linalg.solve(xx + (-l2 if subtract else l2) * np.eye(len(xx)), xz))


def predict(model: LinearModel, data: DataFrame, name: str = "predicted") -> DataFrame:
    """data with the label of the largest response; the first class wins ties."""
    responses = F.array(*[dot(F.col("features"), literal(w)) for w in model.weights.T])
    return data.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in model.labels]), argmax(responses) + 1))
