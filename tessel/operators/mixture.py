"""Gaussian mixtures by expectation-maximisation: five covariance structures, growth by splitting, criteria, and classifiers of mixtures.

A model is a frozen record on the driver. One iteration is one aggregation of its sufficient statistics over (features): per
component the sum of posteriors, of weighted rows and of weighted products, the number of rows whose best component it is, and the
log-likelihood. Scoring is a projection for diagonal structures and a vectorised pass for the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessel.functions.vectors import argmax, let, literal, logsumexp, softmax, total
from tessel.plans.stats import dimension, fold, matrix
from tessel.plans.training_log import TrainingLog

DIAGONAL = ("spherical", "diagonal", "tied_diagonal")
COVARIANCES = (*DIAGONAL, "tied", "full")
LOG_2PI = math.log(2 * math.pi)


@dataclass(frozen=True)
class Mixture:
    """priors (C), mu (C x D), sigma (C x D x D). derive() gives one whose covariances obey the structure."""

    covariance: str
    priors: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    min_var: float = 1e-5
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))  # rows by best component, as the last iteration saw them

    def __post_init__(self) -> None:
        if self.covariance not in COVARIANCES:
            raise ValueError(f"covariance must be one of {COVARIANCES}")
        c, d = self.mu.shape
        if self.priors.shape != (c,) or self.sigma.shape != (c, d, d):
            raise ValueError("priors, means and covariances do not fit together")

    @property
    def n_components(self) -> int:
        return len(self.priors)

    @property
    def dim(self) -> int:
        return self.mu.shape[1]

    @property
    def log_dets(self) -> np.ndarray:
        if self.covariance in DIAGONAL:
            return np.log(np.diagonal(self.sigma, axis1=1, axis2=2)).sum(axis=1)
        return np.array([2 * np.log(np.diag(np.linalg.cholesky(s))).sum() for s in self.sigma])

    def mahalanobis(self, x: np.ndarray) -> np.ndarray:
        """Rows x components."""
        if self.covariance in DIAGONAL:
            inv = 1 / np.diagonal(self.sigma, axis1=1, axis2=2)
            return np.stack([((x - m) ** 2 * v).sum(axis=1) for m, v in zip(self.mu, inv)], axis=1)
        return np.stack([(np.linalg.solve(np.linalg.cholesky(s), (x - m).T) ** 2).sum(axis=0) for m, s in zip(self.mu, self.sigma)], axis=1)

    def log_densities(self, x: np.ndarray, with_priors: bool = True) -> np.ndarray:
        out = -0.5 * (self.mahalanobis(x) + self.log_dets + self.dim * LOG_2PI)
        with np.errstate(divide="ignore"):
            return out + np.log(self.priors) if with_priors else out

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x components, log-likelihood of each row)."""
        z = self.log_densities(x)
        top = z.max(axis=1, keepdims=True)
        e = np.exp(z - top)
        s = e.sum(axis=1, keepdims=True)
        return e / s, (top + np.log(s))[:, 0]

    def log_density_columns(self, features: Column, with_priors: bool = True) -> Column:
        """An array of the components' log densities as a column, for diagonal and other structures alike: x is whitened by literals."""
        out = []
        for c in range(self.n_components):
            centred = F.zip_with(features, literal(self.mu[c]), lambda v, m: v - m)
            if self.covariance in DIAGONAL:
                maha = total(F.zip_with(centred, literal(1 / np.diag(self.sigma[c])), lambda v, w: v * v * w))
            else:
                maha = _quadratic(centred, np.linalg.inv(np.linalg.cholesky(self.sigma[c])))
            constant = -0.5 * (self.log_dets[c] + self.dim * LOG_2PI) + (math.log(self.priors[c]) if with_priors else 0.0)
            out.append(F.lit(float(constant)) - 0.5 * maha)
        return F.array(*out)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, float(self.priors[c]), self.mu[c].tolist(), self.sigma[c].tolist()) for c in range(self.n_components)]
        return spark.createDataFrame(rows, "c int, prior double, mu array<double>, sigma array<array<double>>")

    @staticmethod
    def from_df(df: DataFrame, covariance: str, min_var: float = 1e-5) -> Mixture:
        rows = df.orderBy("c").collect()
        return Mixture(covariance, np.array([r["prior"] for r in rows]), np.array([r["mu"] for r in rows]), np.array([r["sigma"] for r in rows]), min_var)


def _quadratic(centred: Column, root: np.ndarray) -> Column:
    rows = F.array(*[literal(r) for r in root])
    z = F.transform(rows, lambda r: total(F.zip_with(r, centred, lambda a, b: a * b)))
    return total(F.transform(z, lambda v: v * v))


def derive(m: Mixture) -> Mixture:
    """Covariances as the structure has them: spherical ones are the identity, tied ones the plain mean over components, diagonal ones have no other entries."""
    sigma = m.sigma
    if m.covariance == "spherical":
        sigma = np.repeat(np.eye(m.dim)[None], m.n_components, axis=0)
    elif m.covariance.startswith("tied"):
        sigma = np.repeat(sigma.mean(axis=0)[None], m.n_components, axis=0)
    if m.covariance in DIAGONAL:
        sigma = np.array([np.diag(np.diag(s)) for s in sigma])
    return replace(m, sigma=sigma)


def blank(c: int, dim: int, covariance: str = "diagonal", min_var: float = 1e-5) -> Mixture:
    return Mixture(covariance, np.full(c, 1 / c), np.zeros((c, dim)), np.repeat(np.eye(dim)[None], c, axis=0), min_var)


def from_centroids(centres: np.ndarray, covariance: str = "diagonal", min_var: float = 1e-5) -> Mixture:
    centres = np.atleast_2d(np.asarray(centres, float))
    return replace(blank(len(centres), centres.shape[1], covariance, min_var), mu=centres)


def from_samples(data: DataFrame, c: int, covariance: str = "diagonal", min_var: float = 1e-5, seed: int = 0) -> Mixture:
    """Means are c rows by seeded hash of their values."""
    rows = data.select("features").orderBy(F.xxhash64(F.lit(seed), "features")).limit(c).collect()
    return from_centroids(np.array([r[0] for r in rows]), covariance, min_var)


@dataclass(frozen=True)
class Statistics:
    """Sums over rows, by component: hard counts, posteriors, weighted rows, weighted products; and the log-likelihood of all."""

    hard: np.ndarray
    r: np.ndarray
    rx: np.ndarray
    rxx: np.ndarray
    loglik: float

    @property
    def n(self) -> float:
        return float(self.hard.sum())

    def __add__(self, other: Statistics) -> Statistics:
        return Statistics(self.hard + other.hard, self.r + other.r, self.rx + other.rx, self.rxx + other.rxx, self.loglik + other.loglik)


def accumulate(m: Mixture, x: np.ndarray) -> Statistics:
    """The statistics of some rows."""
    r, ll = m.posteriors(x)
    hard = np.bincount(r.argmax(axis=1), minlength=m.n_components).astype(float)
    if m.covariance in DIAGONAL:
        rxx = np.array([np.diag(v) for v in r.T @ (x * x)])
    else:
        rxx = np.array([(x * w[:, None]).T @ x for w in r.T])
    return Statistics(hard, r.sum(axis=0), r.T @ x, rxx, float(ll.sum()))


def _packed(s: Statistics) -> np.ndarray:
    return np.r_[s.hard, s.r, s.rx.ravel(), s.rxx.ravel(), s.loglik]


def _unpacked(v: np.ndarray, c: int, d: int) -> Statistics:
    return Statistics(v[:c], v[c : 2 * c], v[2 * c : 2 * c + c * d].reshape(c, d), v[2 * c + c * d : -1].reshape(c, d, d), float(v[-1]))


def statistics(m: Mixture, data: DataFrame) -> Statistics:
    """The statistics of all rows of data (features): one job."""
    return _unpacked(fold(data.select("features"), lambda b: {0: _packed(accumulate(m, matrix(b["features"])))})[0], m.n_components, m.dim)


def statistics_by_class(models: Sequence[Mixture], data: DataFrame, index: str) -> list[Statistics]:
    """The statistics of each class under its own model, of all classes in one job; index is the class's place, an int column."""
    def partial(batch: dict) -> dict[int, np.ndarray]:
        x, own = matrix(batch["features"]), batch[index].to_numpy()
        return {int(k): _packed(accumulate(models[int(k)], x[own == k])) for k in np.unique(own)}

    sums = fold(data.select("features", index), partial)
    return [_unpacked(sums[k], m.n_components, m.dim) for k, m in enumerate(models)]


def maximise(m: Mixture, s: Statistics) -> Mixture:
    """The model that the statistics ask for. Components without any weight must be purged before."""
    priors = s.r / s.n
    if (priors < 1e-200).any() or abs(priors.sum() - 1) > 1e-5:
        raise ValueError(f"priors do not make a distribution: {priors}")
    mu = s.rx / s.r[:, None]
    sigma = s.rxx / s.r[:, None, None] - np.einsum("ci,cj->cij", mu, mu)
    for c in range(m.n_components):
        np.fill_diagonal(sigma[c], np.maximum(m.min_var, np.diag(sigma[c])))
    return derive(replace(m, priors=priors, mu=mu, sigma=sigma, counts=s.hard))


def em_step(m: Mixture, data: DataFrame) -> tuple[Mixture, float]:
    """(the next model, the mean log-likelihood of a row under m)."""
    s = statistics(m, data)
    return maximise(m, s), s.loglik / max(1.0, s.n)


@dataclass(frozen=True)
class Trace:
    n_components: int
    iteration: int
    log_likelihood: float
    delta: float
    aic: float
    bic: float


def parameters(m: Mixture) -> int:
    """Free parameters as the criteria count them: C priors, and D * D entries for a whole covariance."""
    c, d = m.n_components, m.dim
    return {"spherical": c * (d + 1), "tied_diagonal": c * (d + 1) + d, "diagonal": c * (2 * d + 1), "tied": c * (d + 1) + d * d, "full": c * (d + 1 + d * d)}[m.covariance]


def criteria(m: Mixture, loglik: float, n: float) -> tuple[float, float]:
    """(AIC, BIC) of a log-likelihood over n rows."""
    k = parameters(m)
    return 2 * k - 2 * loglik, k * math.log(max(1.0, n)) - 2 * loglik


def fit(m: Mixture, data: DataFrame, epsilon: float = 1e-5, max_iterations: int = 200, patience: int = 10, start: float | None = None,
        log: Callable[[Trace, Mixture, int, float | None], None] | None = None, first: int = 0, calm: int = 0) -> tuple[Mixture, list[Trace]]:
    """Iterations until patience of them, not necessarily in a row, change the mean log-likelihood by less than epsilon of it.

    log: gets each iteration's figures, the model after it, how many were calm so far, and the log-likelihood that the next one is compared with; first, calm and start: where to go on from these.
    """
    trace, old = [], start
    for i in range(first, max_iterations):
        if calm >= patience:
            break
        s = statistics(m, data)
        mean = s.loglik / max(1.0, s.n)
        delta = 1.0 if old is None else abs((mean - old) / mean) if mean else 0.0
        trace.append(Trace(m.n_components, i, mean, delta, *criteria(m, s.loglik, s.n)))
        alive = s.hard > 0 if (s.r <= 0).any() else np.ones(m.n_components, bool)
        if alive.all():
            m, old = maximise(m, s), mean
            calm += delta < epsilon
        else:
            m = purge(replace(m, counts=s.hard))
        if log:
            log(trace[-1], m, calm, old)
    return m, trace


def purge(m: Mixture, renormalise: bool = True) -> Mixture:
    """Without the components that are no row's best."""
    keep = m.counts > 0
    if keep.all() or not keep.any():
        return m
    priors = m.priors[keep]
    return replace(m, priors=priors / priors.sum() if renormalise else priors, mu=m.mu[keep], sigma=m.sigma[keep], counts=m.counts[keep])


def drop_duplicates(m: Mixture, apart: float = 1e-4) -> Mixture:
    """Of components whose means are nearly equal (relative squared distance under apart), the first stays."""
    keep: list[int] = []
    for c in range(m.n_components):
        if all(((m.mu[c] - m.mu[k]) ** 2).sum() / max(1e-300, (m.mu[k] ** 2).sum()) >= apart for k in keep):
            keep.append(c)
    priors = m.priors[keep]
    return replace(m, priors=priors / priors.sum(), mu=m.mu[keep], sigma=m.sigma[keep], counts=m.counts[keep] if len(m.counts) else m.counts)


def split_component(m: Mixture, c: int) -> Mixture:
    """Two halves of component c: the minus side in its place, the plus side last. Diagonal structures move by a deviation, others by a unit leading eigenvector whose largest entry is positive."""
    if m.covariance in DIAGONAL:
        offset = np.sqrt(np.diag(m.sigma[c]))
    else:
        offset = np.linalg.eigh(m.sigma[c])[1][:, -1]
        offset = offset * np.sign(offset[np.abs(offset).argmax()])
    priors, mu = np.append(m.priors, m.priors[c] / 2), np.vstack([m.mu, m.mu[c] + offset])
    priors[c] /= 2
    mu[c] = m.mu[c] - offset
    return replace(m, priors=priors, mu=mu, sigma=np.concatenate([m.sigma, m.sigma[c : c + 1]]), counts=np.zeros(len(priors)))


def to_split(m: Mixture, force: bool = False) -> list[int]:
    """Which components a growth step splits: all of fewer than four; else, by rank of rows and of log-determinant (largest first, the higher index at ties), those that stand in the first half of both."""
    c = m.n_components
    if force or c < 4:
        return list(range(c))
    counts = m.counts if len(m.counts) == c else np.zeros(c)
    rank = lambda values: sorted(range(c), key=lambda i: (values[i], i), reverse=True)
    by_count, dets = rank(counts), m.log_dets
    by_det = rank(dets)
    if m.covariance in ("spherical", "tied", "tied_diagonal"):
        return by_count[:1]
    if abs(counts[by_count[0]] - counts[by_count[-1]]) < 1e-3:
        out = by_det[:1]
        for k in range(1, c // 2):
            if dets[by_det[k - 1]] - dets[by_det[k]] > dets[by_det[k]] - dets[by_det[k + 1]]:
                break
            out.append(by_det[k])
        return out
    for reach in range(c // 2 + 1, c + 1):
        if both := sorted(set(by_count[:reach]) & set(by_det[:reach])):
            return both
    return by_count[:1]


def split(m: Mixture, force: bool = False) -> Mixture:
    out = m
    for c in to_split(m, force):
        out = split_component(out, c)
    return derive(out)


def to_state(m: Mixture) -> dict:
    """A model as what JSON holds, every number whole."""
    return {"covariance": m.covariance, "priors": m.priors.tolist(), "mu": m.mu.tolist(), "sigma": m.sigma.tolist(), "min_var": m.min_var, "counts": np.asarray(m.counts).tolist()}


def from_state(x: dict) -> Mixture:
    return derive(Mixture(x["covariance"], np.array(x["priors"]), np.array(x["mu"]), np.array(x["sigma"]), x["min_var"], counts=np.array(x["counts"])))


def grow(data: DataFrame, max_components: int, covariance: str = "diagonal", epsilon: float = 1e-5, max_iterations: int = 200, min_var: float = 1e-5,
         reset: bool = True, record: Callable[[Mixture], None] | None = None, log: TrainingLog | None = None) -> tuple[dict[int, Mixture], list[Trace]]:
    """From one component on: fit, purge, record, split, until there are more than max_components. reset: whether each size starts anew from no log-likelihood.

    Returns the models by size and the trace; the input is kept in memory meanwhile where it fits. log: gets a row for each iteration and each size that is done; a run
    whose rows it holds already, of the same data and arguments, goes on after the last of them and returns what it would have returned at once.
    """
    rows = data.select("features").persist()
    models: dict[int, Mixture] = {}
    trace: list[Trace] = []
    m, done, first, calm, old = None, False, 0, 0, None
    for event, figures, state in log.events() if log else ():
        m, done = from_state(state["model"]), event == "size"
        if done:
            models[m.n_components] = m
        else:
            trace.append(Trace(int(figures["n_components"]), int(figures["iteration"]), *(figures[k] for k in ("log_likelihood", "delta", "aic", "bic"))))
            first, calm, old = trace[-1].iteration + 1, state["calm"], state["old"]

    def note(t: Trace, now: Mixture, calm: int, old: float | None) -> None:
        log.append("iteration", asdict(t), {"model": to_state(now), "calm": int(calm), "old": old})

    try:
        m = blank(1, dimension(rows), covariance, min_var) if m is None else m
        while m.n_components <= max_components:
            if not done:
                last = old if first else None if reset or not trace else trace[-1].log_likelihood
                m, made = fit(m, rows, epsilon, max_iterations, start=last, log=note if log else None, first=first, calm=calm)
                trace += made
                m = purge(m)
                models[m.n_components] = m
                if log:
                    log.append("size", {"n_components": m.n_components}, {"model": to_state(m)})
                if record:
                    record(m)
            done, first, calm = False, 0, 0
            larger = split(m)
            if larger.n_components in models:
                larger = split(m, force=True)
            m = larger
        return models, trace
    finally:
        rows.unpersist()


def score(m: Mixture, data: DataFrame) -> DataFrame:
    """data with log_likelihood, posteriors and component (the first best one): a projection."""
    z = m.log_density_columns(F.col("features"))
    out = let(z, lambda v: F.struct(logsumexp(v).alias("log_likelihood"), softmax(v).alias("posteriors"), argmax(v).alias("component")))
    return data.withColumn("_s", out).select(*data.columns, "_s.*")


@dataclass(frozen=True)
class MixtureClassifier:
    """A mixture for each class, in the order of labels."""

    labels: tuple
    models: tuple[Mixture, ...]
    log_priors: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Rows x classes, without priors."""
        return np.stack([m.posteriors(x)[1] for m in self.models], axis=1)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = self.log_densities(x) + self.log_priors
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(1e-200, self.posteriors(x)))

    def predict(self, data: DataFrame, name: str = "predicted") -> DataFrame:
        """data with the label of the largest posterior, the first at ties."""
        place = StructType([*data.schema.fields, StructField(name, IntegerType())])
        columns = data.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = self.posteriors(matrix(batch.column("features"))).argmax(axis=1) if batch.num_rows else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(best, pa.int32())], [*columns, name])

        return data.mapInArrow(run, place).withColumn(name, F.element_at(F.array(*[F.lit(v) for v in self.labels]), F.col(name) + 1))


def fit_classifier(data: DataFrame, n_components: int, covariance: str = "diagonal", label: str = "label", max_iter: int = 100, epsilon: float = 1e-5, use_priors: bool = True,
                   min_var: float = 1e-5, seed: int = 0) -> MixtureClassifier:
    """min(n_components, max(1, rows // 20)) components a class, means from rows by seeded hash, of their id where there is one; all classes are trained in one job for each iteration."""
    sizes = data.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()
    labels = tuple(r["l"] for r in sizes)
    index = F.coalesce(*[F.when(F.col(label) == v, F.lit(k)) for k, v in enumerate(labels)])
    rows = data.select("features", index.cast("bigint").alias("k")).persist()
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256) if "id" in data.columns else F.xxhash64(F.lit(seed), "features")
    try:
        first = F.row_number().over(Window.partitionBy("k").orderBy("_key"))
        picked = data.select("features", index.alias("k"), key.alias("_key")).withColumn("_first", first).filter(F.col("_first") <= n_components).orderBy("k", "_first").collect()
        means = [[p["features"] for p in picked if p["k"] == k][: max(1, r["n"] // 20)] for k, r in enumerate(sizes)]
        models = [from_centroids(np.array(m), covariance, min_var) for m in means]
        scale = _variances(rows, len(labels))
        models = [derive(replace(m, sigma=np.repeat(np.diag(np.maximum(min_var, v))[None], m.n_components, axis=0))) for m, v in zip(models, scale)]
        old = -1e300
        for _ in range(max_iter):
            stats = statistics_by_class(models, rows, "k")
            models = [maximise(m, s) if (s.r > 0).all() else purge(replace(m, counts=s.hard)) for m, s in zip(models, stats)]
            now = sum(s.loglik for s in stats) / sum(s.n for s in stats)
            if abs((now - old) / now) < epsilon:
                break
            old = now
    finally:
        rows.unpersist()
    n = np.array([r["n"] for r in sizes], float)
    return MixtureClassifier(labels, tuple(models), np.log(n) - math.log(n.sum()) if use_priors else np.full(len(n), -math.log(len(n))))


def _variances(rows: DataFrame, classes: int) -> list[np.ndarray]:
    def partial(batch: dict) -> dict[int, np.ndarray]:
        x, own = matrix(batch["features"]), batch["k"].to_numpy()
        return {int(c): np.r_[(own == c).sum(), x[own == c].sum(axis=0), (x[own == c] ** 2).sum(axis=0)] for c in np.unique(own)}

    sums, out = fold(rows, partial), []
    for k in range(classes):
        d = (len(sums[k]) - 1) // 2
        n, s, q = sums[k][0], sums[k][1 : 1 + d], sums[k][1 + d :]
        out.append(q / n - (s / n) ** 2)
    return out
