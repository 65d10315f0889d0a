"""Bayes classifier with one Gaussian for each class."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessel.plans.stats import chunks, dimension, fold, matrix

COVARIANCES = ("full", "diag", "tied", "tied_diag")


@dataclass(frozen=True)
class GaussianModel:
    """labels[c], with mean mu[c], covariance sigma[c] and the log of its share; whitener[c] takes a centred vector to one of unit covariance."""

    covariance: str
    labels: tuple
    log_prior: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray

    @property
    def whiteners(self) -> np.ndarray:
        return np.array([np.linalg.inv(np.linalg.cholesky(s)) for s in self.sigma])

    @property
    def log_dets(self) -> np.ndarray:
        return np.array([np.linalg.slogdet(s)[1] for s in self.sigma])


def moments(data: DataFrame, label: str = "label") -> dict:
    """label -> (n, sums, sums of products): one aggregation."""
    d, labels = dimension(data), [r[0] for r in data.select(label).distinct().orderBy(label).collect()]
    index = {v: k for k, v in enumerate(labels)}

    def partial(batch: dict) -> dict[int, np.ndarray]:
        x, own = matrix(batch["features"]), np.array([index[v] for v in batch[label].to_pylist()])
        return {int(c): np.r_[(own == c).sum(), x[own == c].sum(axis=0), (x[own == c].T @ x[own == c]).ravel()] for c in np.unique(own)}

    sums = fold(data.select("features", label), partial)
    return {labels[c]: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for c, v in sorted(sums.items())}


def fit(data: DataFrame, covariance: str = "full", min_var: float = 1e-5, label: str = "label") -> GaussianModel:
    """Means and sample covariances (n - 1) by class; diag takes variances only, of min_var at least; the tied ones take the covariance of all rows, not pooled within classes, and know no floor."""
    if covariance not in COVARIANCES:
        raise ValueError(f"covariance must be one of {COVARIANCES}")
    found = moments(data, label)
    scatter = lambda n, s, p: (p - np.outer(s, s) / n) / max(1, n - 1)
    n = sum(v[0] for v in found.values())
    if covariance.startswith("tied"):
        whole = scatter(n, sum(v[1] for v in found.values()), sum(v[2] for v in found.values()))
        sigma = [np.diag(np.diag(whole)) if covariance == "tied_diag" else whole] * len(found)
    else:
        sigma = [scatter(*v) for v in found.values()]
        if covariance == "diag":
            sigma = [np.diag(np.maximum(min_var, np.diag(s))) for s in sigma]
    return GaussianModel(covariance, tuple(found), np.array([math.log(v[0]) - math.log(n) for v in found.values()]), np.array([v[1] / v[0] for v in found.values()]), np.array(sigma))


def scores(model: GaussianModel, x: np.ndarray) -> np.ndarray:
    """Rows x classes: the log share plus the log density up to the constant that all classes share. All classes' whitened rows are one product."""
    w = model.whiteners
    c, d = model.mu.shape
    moved = np.einsum("cij,cj->ci", w, model.mu).ravel()
    out = np.empty((len(x), c))
    for part in chunks(len(x), c * d):
        z = x[part] @ w.reshape(c * d, d).T - moved
        out[part] = -0.5 * (z * z).reshape(-1, c, d).sum(axis=2)
    return out + (model.log_prior - 0.5 * (model.log_dets + math.log(2 * math.pi)))


def predict(model: GaussianModel, data: DataFrame, name: str = "predicted") -> DataFrame:
    """data with the label of the largest score; the first class wins ties. One pass of Arrow batches; a null vector raises."""
    columns = [*(c for c in data.columns if c != name), name]
    fields = [f for f in data.schema.fields if f.name != name]
    kind = data.schema["label"].dataType if "label" in data.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(list(model.labels))
        for batch in batches:
            best = scores(model, matrix(batch.column("features"))).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:-1]), labels.take(pa.array(best)).cast(own)], columns)

    label_type = kind if kind is not None else (StringType() if isinstance(model.labels[0], str) else LongType())
    own = to_arrow_type(label_type)
    return data.select(*columns[:-1]).mapInArrow(run, StructType([*fields, StructField(name, label_type)]))
