"""K-means and its family: Lloyd, medoids, codebook doubling, selective splitting, one ordered online pass.

Centres are a small matrix on the driver; a step is one aggregation over (id, features); an assignment is a projection against the
centres as literals. The first centre wins ties. An empty cluster's centre becomes the zero vector unless keep_empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.vectors import argmin, let, literal, sqdist
from tessel.plans.stats import dimension, fold, matrix, sqdist_rows

EPSILON = 1e-4
START_J = 9.9e300
MODALITIES = ("Lloyd", "k-medoids", "online", "LBG", "selective")


@dataclass(frozen=True)
class Clusters:
    """centres (k x d), the mean distortion J, and the steps that were made."""

    centres: np.ndarray
    J: float = START_J
    steps: int = 0


def distances(features: Column, centres: np.ndarray, squared: bool = False) -> Column:
    """An array of the distances to all centres."""
    d2 = F.array(*[sqdist(features, literal(c)) for c in np.asarray(centres)])
    return d2 if squared else F.transform(d2, F.sqrt)


def assign(data: DataFrame, centres: np.ndarray, features: str = "features") -> DataFrame:
    """data with cluster and d2, the squared distance to its centre."""
    out = let(distances(F.col(features), centres, True), lambda d: F.struct(argmin(d).alias("c"), F.array_min(d).alias("d2")))
    return data.withColumn("_a", out).withColumn("cluster", F.col("_a.c")).withColumn("d2", F.col("_a.d2")).drop("_a")


def distortion(data: DataFrame, centres: np.ndarray) -> float:
    """The mean squared distance to the nearest centre."""
    return assign(data, centres).agg(F.avg("d2")).first()[0]


@dataclass(frozen=True)
class Step:
    """What one pass finds of the rows as the centres deal them out."""

    counts: np.ndarray
    means: np.ndarray
    J: float
    changes: int


def step(data: DataFrame, centres: np.ndarray, before: np.ndarray | None = None) -> Step:
    """Counts, means and distortion by nearest centre, and how many rows had another one with the centres before: one aggregation."""
    k, d = centres.shape

    def partial(batch: dict) -> dict[int, np.ndarray]:
        x = matrix(batch["features"])
        d2 = sqdist_rows(x, centres)
        own = d2.argmin(axis=1)
        changed = np.zeros(len(x)) if before is None else (sqdist_rows(x, before).argmin(axis=1) != own).astype(float)
        out = {}
        for c in np.unique(own):
            m = own == c
            out[int(c)] = np.r_[m.sum(), x[m].sum(axis=0), d2[m, c].sum(), changed[m].sum()]
        return out

    sums = fold(data.select("features"), partial)
    counts, means, total, changes = np.zeros(k), np.zeros((k, d)), 0.0, 0
    for c, v in sums.items():
        counts[c], means[c] = v[0], v[1 : 1 + d] / v[0]
        total += v[1 + d]
        changes += int(v[2 + d])
    return Step(counts, means, total / max(1.0, counts.sum()), changes)


def improvement(old: float, new: float) -> float:
    return abs(old - new) / (abs(new) + 1e-4)


def lloyd(data: DataFrame, centres: np.ndarray, max_iter: int = 1000, epsilon: float = EPSILON, keep_empty: bool = False, medoids: bool = False) -> Clusters:
    """Steps until nothing changes, the distortion improves by epsilon or less, or max_iter are made."""
    centres = np.asarray(centres, float)
    now = step(data, centres)
    old, made, changes = START_J, 0, 1
    while made < max_iter and changes > 0 and improvement(old, now.J) > epsilon:
        fresh = medoid_centres(data, centres, now) if medoids else now.means
        if keep_empty:
            fresh = np.where(now.counts[:, None] > 0, fresh, centres)
        old = now.J
        now = step(data, fresh, centres)
        centres, changes, made = fresh, now.changes, made + 1
    return Clusters(centres, now.J, made)


def medoid_centres(data: DataFrame, centres: np.ndarray, now: Step | None = None) -> np.ndarray:
    """For each cluster the row with the least sum of squared distances to the others: the row nearest to the mean, the least id at ties. Linear in the rows."""
    now = now or step(data, centres)
    to_mean = F.array(*[sqdist(F.col("features"), literal(m)) for m in now.means])
    near = assign(data, centres).withColumn("_m", F.get(to_mean, F.col("cluster")))
    out = np.zeros_like(now.means)
    for r in near.groupBy("cluster").agg(F.min_by("features", F.struct("_m", "id")).alias("x")).collect():
        out[r["cluster"]] = r["x"]
    return out


def random_centres(data: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k rows by seeded hash of their ids."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    return np.array([r[0] for r in data.orderBy(order, "id").limit(k).select("features").collect()], float)


def farthest_first(data: DataFrame, k: int, first: str = "mean", seed: int = 0) -> np.ndarray:
    """Each next centre is the row farthest from all centres so far, the least id at ties. first: "mean", or "random", which is replaced at the end by the row farthest from all."""
    if first == "mean":
        start = step(data, np.zeros((1, dimension(data)))).means[0]
    elif first == "random":
        start = random_centres(data, 1, seed)[0]
    else:
        raise ValueError("first must be mean or random")
    centres = [start]
    while len(centres) < k:
        centres.append(_farthest(data, centres))
    if first == "random":
        centres[0] = _farthest(data, centres)
    return np.array(centres)


def _farthest(data: DataFrame, centres: Sequence[np.ndarray]) -> np.ndarray:
    d2 = F.array_min(distances(F.col("features"), np.array(centres), True))
    return np.array(data.agg(F.max_by("features", F.struct(d2, -F.col("id")))).first()[0], float)


def codebook(data: DataFrame, k: int, max_iter: int = 1000, epsilon: float = EPSILON) -> Clusters:
    """Doubles the centres around themselves, by the data's deviation, which halves each time, with Lloyd's steps after each doubling; ends at the first power of two of k or more."""
    whole = data.select(F.posexplode("features").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("d").collect()
    out, spread = Clusters(np.array([[r["m"] for r in whole]])), np.array([r["s"] for r in whole])
    while len(out.centres) < k:
        doubled = np.stack([out.centres + spread, out.centres - spread], axis=1).reshape(-1, len(spread))
        out = lloyd(data, doubled, max_iter, epsilon)
        spread = spread / 2
    return out


def selective_splitting(data: DataFrame, k: int, max_iter: int = 1000, epsilon: float = EPSILON, seed: int = 0) -> Clusters:
    """Splits the most populated cluster in two until there are k, then makes Lloyd's steps over all. Only centres found so far take part."""
    two = lambda part: lloyd(part, farthest_first(part, 2, "random", seed), max_iter, epsilon).centres
    centres = two(data)
    while len(centres) < k:
        c = int(np.argmax(step(data, centres).counts))
        halves = two(assign(data, centres).filter(F.col("cluster") == c).select("id", "features"))
        centres = np.vstack([centres[:c], halves[:1], centres[c + 1 :], halves[1:]])
    return lloyd(data, centres, max_iter, epsilon)


def online(data: DataFrame, k: int) -> Clusters:
    """One pass in the order of ids: the first k rows are the centres, each later row moves its nearest centre to the running mean of its rows.

    The order is the definition, so the pass is one task; rows reach it sorted, batch by batch, and it keeps the centres only.
    """
    d = dimension(data)
    found = data.select("id", "features").repartitionByRange(1, "id").sortWithinPartitions("id").mapInArrow(online_pass(k, d), "c int, n bigint, center array<double>").orderBy("c").collect()
    if len(found) < k:
        raise ValueError(f"fewer than {k} rows")
    centres = np.array([r["center"] for r in found])
    return Clusters(centres, distortion(data, centres), 1)


def online_pass(k: int, d: int, start: tuple[np.ndarray, np.ndarray] | None = None):
    """A function over Arrow batches in order, for mapInArrow: the centres after them, as (c, n, center)."""
    import pyarrow as pa

    def run(batches):
        centres, counts = (start[0].copy(), start[1].copy()) if start else (np.zeros((0, d)), np.zeros(0, np.int64))
        for batch in batches:
            for x in matrix(batch.column("features")):
                if not np.isfinite(x).all():
                    raise ValueError("a component is not a finite number")
                if len(centres) < k:
                    centres, counts = np.vstack([centres, x]), np.append(counts, 1)
                    continue
                diff = centres - x
                c = int((diff * diff).sum(axis=1).argmin())
                counts[c] += 1
                centres[c] += (x - centres[c]) / counts[c]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(counts, pa.int64()), pa.array(centres.tolist(), pa.list_(pa.float64()))], ["c", "n", "center"])

    return run


def drop_empty(data: DataFrame, clusters: Clusters) -> Clusters:
    """Without the centres that no row is nearest to."""
    return replace(clusters, centres=clusters.centres[step(data, clusters.centres).counts > 0])


def fit(data: DataFrame, k: int, modality: str = "Lloyd", init: str = "random", max_iter: int = 1000, epsilon: float = EPSILON, seed: int = 0) -> Clusters:
    """Clusters data (id, features). init: random, mean-first or maximin (farthest first from a random row); the last three modalities need none."""
    if modality not in MODALITIES:
        raise ValueError(f"modality must be one of {MODALITIES}")
    if modality == "online":
        return online(data, k)
    if modality == "LBG":
        return codebook(data, k, max_iter, epsilon)
    if modality == "selective":
        return selective_splitting(data, k, max_iter, epsilon, seed)
    starts = {"random": lambda: random_centres(data, k, seed), "mean-first": lambda: farthest_first(data, k, "mean"), "maximin": lambda: farthest_first(data, k, "random", seed)}
    if init not in starts:
        raise ValueError(f"init must be one of {tuple(starts)}")
    return lloyd(data, starts[init](), max_iter, epsilon, medoids=modality == "k-medoids")


def between_within(assigned: DataFrame) -> tuple[float, float]:
    """(Calinski-Harabasz, Davies-Bouldin) of rows (features, cluster), from two aggregations."""
    def partial(batch: dict) -> dict[int, np.ndarray]:
        x, own = matrix(batch["features"]), batch["cluster"].to_numpy()
        return {int(c): np.r_[(own == c).sum(), (x[own == c] ** 2).sum(), x[own == c].sum(axis=0)] for c in np.unique(own)}

    rows = assigned.select("features", "cluster")
    sums = fold(rows, partial)
    names = sorted(sums)
    n, means = np.array([sums[c][0] for c in names]), np.array([sums[c][2:] / sums[c][0] for c in names])
    mean = (n[:, None] * means).sum(axis=0) / n.sum()
    between = (n * ((means - mean) ** 2).sum(axis=1)).sum()
    within = sum(sums[c][1] - sums[c][0] * (m**2).sum() for c, m in zip(names, means))
    at = {c: k for k, c in enumerate(names)}

    def spread(batch: dict) -> dict[int, np.ndarray]:
        x, own = matrix(batch["features"]), batch["cluster"].to_numpy()
        far = np.sqrt(((x - means[[at[int(c)] for c in own]]) ** 2).sum(axis=1))
        return {int(c): np.array([far[own == c].sum()]) for c in np.unique(own)}

    s = fold(rows, spread)
    radii, k = np.array([s[c][0] for c in names]) / n, len(names)
    apart = np.sqrt(sqdist_rows(means, means))
    worst = [max((radii[i] + radii[j]) / apart[i, j] for j in range(k) if j != i) for i in range(k)]
    return (between / (k - 1)) / (within / (n.sum() - k)), sum(worst) / k




def silhouette(assigned: DataFrame) -> float:
    """The mean silhouette of rows (features, cluster) by squared distances, which sums by cluster give exactly, so that no pairs are made: one aggregation, one projection.

    A cluster's only row counts as 0; with fewer than two clusters the result is NaN.
    """
    rows = assigned.select("features", "cluster")

    def partial(batch: dict) -> dict[int, np.ndarray]:
        x, own = matrix(batch["features"]), batch["cluster"].to_numpy()
        return {int(c): np.r_[(own == c).sum(), (x[own == c] ** 2).sum(), x[own == c].sum(axis=0)] for c in np.unique(own)}

    sums = fold(rows, partial)
    if len(sums) < 2:
        return float("nan")
    names = sorted(sums)
    n, means = np.array([sums[c][0] for c in names]), np.array([sums[c][2:] / sums[c][0] for c in names])
    spread = np.array([sums[c][1] / sums[c][0] for c in names]) - (means**2).sum(axis=1)

    def scores(batch: dict) -> dict[int, np.ndarray]:
        x, own = matrix(batch["features"]), np.searchsorted(names, batch["cluster"].to_numpy())
        at = np.arange(len(x))
        d = sqdist_rows(x, means) + np.maximum(0.0, spread)
        a = d[at, own] * n[own] / np.maximum(1.0, n[own] - 1)
        d[at, own] = np.inf
        b = d.min(axis=1)
        top = np.maximum(a, b)
        s = np.where((n[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
        return {0: np.array([s.sum(), len(s)])}

    total, count = fold(rows, scores)[0]
    return total / count
