"""Seeded samples of multivariate normals, one for each class."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.vectors import dot, literal


def normals(spark: SparkSession, n_classes: int = 2, dim: int = 2, n_train: int = 100, n_test: int = 50, between: float = 1.0, within: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """(train, test or None) as (id, label, features): a class's mean is between * normal, its covariance the square of a symmetrised within * normal matrix.

    Draws are made by the executors: an affine image of standard normals that depend on the seed and the row alone.
    """
    rng = np.random.default_rng(seed)
    means = [between * rng.standard_normal(dim) for _ in range(n_classes)]
    roots = []
    for _ in range(n_classes):
        a = within * rng.standard_normal((dim, dim))
        a = (a + a.T) / 2
        roots.append(np.linalg.cholesky(a @ a + 1e-9 * np.eye(dim)))

    def draw(n: int, part: int) -> DataFrame:
        rows = spark.range(n * n_classes).select("id", (F.col("id") / n).cast("int").alias("label"))
        # Box-Muller over hashes: the same rows whatever the partitions
        u = lambda d, k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(part), F.lit(d), F.lit(k), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        z = F.array(*[F.sqrt(-2 * F.log(u(d, 0))) * F.cos(2 * np.pi * u(d, 1)) for d in range(dim)])
        image = F.coalesce(*[F.when(F.col("label") == c, F.array(*[float(means[c][d]) + dot(F.col("_z"), literal(roots[c][d])) for d in range(dim)])) for c in range(n_classes)])
        return rows.withColumn("_z", z).select("id", "label", image.alias("features"))

    return draw(n_train, 0), draw(n_test, 1) if n_test else None
