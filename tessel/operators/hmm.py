"""Hidden Markov models over discrete symbols or vectors: likelihood, posteriors, best path, and training.

Sequences are rows (seq_id, t, symbol) or (seq_id, t, features), of any length. Short ones are gathered into an array each and take the recursions together, padded, a step
for all of a batch at once. Where a sequence is longer than a chunk, all are cut in chunks: a chunk's steps are a product of transitions and emissions in the semiring of
(log-sum, +), or (max, +) for the best path, which is associative, so chunks make their products apart; a scan over a sequence's products tells each chunk what enters it and what leaves it, and chunks then
take the recursions apart. Models are small frozen records. Training sums statistics in tasks, by sequence where a weight is a sequence's, and a groupBy sums the tasks'.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.vectors import literal, logsumexp
from tessel.operators import cluster
from tessel.operators import mixture as mx
from tessel.plans.stats import dimension, fold, matrix
from tessel.plans.tables import running_sum, written

# The floors of probabilities and of their logs.
ZERO_PROB, LOG_ZERO, MIN_PROB = 1e-300, -1e30, 1e-50


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(np.asarray(p, float) + ZERO_PROB)


def _lse(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(z - top).sum(axis=axis))


@dataclass(frozen=True)
class Hmm:
    """initial (S), transitions (S x S), and either emissions (S x K) for symbols or a mixture for each state.

    left_to_right: the first and last state emit nothing; paths enter by the first and may end in any emitting one.
    terminal: whether paths must end in the last emitting state.
    """

    initial: np.ndarray
    transitions: np.ndarray
    emissions: np.ndarray | None = None
    mixtures: tuple[mx.Mixture, ...] = ()
    left_to_right: bool = False
    terminal: bool = False
    name: str = "hmm"
    state_names: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if (self.emissions is None) == (not self.mixtures):
            raise ValueError("a model has emissions of symbols or mixtures, one of them")

    @property
    def emitting(self) -> Hmm:
        """The emitting states alone, with what enters them as the initial distribution."""
        if not self.left_to_right:
            return self
        inner = slice(1, len(self.transitions) - 1)
        n = len(self.transitions) - 2
        initial = self.transitions[0, inner]
        return replace(self, initial=initial / initial.sum(), transitions=self.transitions[inner, inner], emissions=None if self.emissions is None else self.emissions[inner] if len(self.emissions) > n else self.emissions,
                       mixtures=self.mixtures[inner] if len(self.mixtures) > n else self.mixtures, left_to_right=False)

    def log_emissions(self, observed: np.ndarray) -> np.ndarray:
        """Times x states."""
        if self.emissions is not None:
            return _log(self.emissions).T[np.asarray(observed, int)]
        return np.stack([np.maximum(m.posteriors(observed)[1], math.log(MIN_PROB)) for m in self.mixtures], axis=1)


def uniform_transitions(n: int, left_to_right: bool = False, terminal: bool = False) -> np.ndarray:
    """Left to right: in by the first state, a half to stay and a half to go on; terminal: upper triangular; else all alike."""
    a = np.zeros((n, n))
    if left_to_right:
        a[0, 1] = 1.0
        for i in range(1, n - 1):
            a[i, i] = a[i, i + 1] = 0.5
        return a
    for i in range(n):
        a[i, (i if terminal else 0) :] = 1.0
    return a / a.sum(axis=1, keepdims=True)


def normalise_transitions(counts: np.ndarray, left_to_right: bool = False) -> np.ndarray:
    """Rows sum to 1; entries under MIN_PROB are nothing; a row without counts is as at the start."""
    start, out = uniform_transitions(len(counts), left_to_right), np.array(counts, float)
    for i, row in enumerate(out):
        if row.sum() <= 0:
            out[i] = start[i]
            continue
        row /= row.sum()
        row[row < MIN_PROB] = 0.0
        row /= row.sum()
    return out


def normalise_emissions(weights: np.ndarray) -> np.ndarray:
    """Rows sum to 1 after symbols without weight got a tenth of the least positive one; a row without any is uniform."""
    out = np.array(weights, float)
    for row in out:
        if (row > 0).any():
            row[row <= 0] = 0.1 * row[row > 0].min()
        else:
            row[:] = 1.0
        row /= row.sum()
    return out


def discrete(n_states: int, n_symbols: int, left_to_right: bool = False, terminal: bool = False, seed: int = 0, identity: bool = False) -> Hmm:
    """A start: uniform transitions and seeded random emissions. identity: state s all but surely emits symbol s."""
    b = np.random.default_rng(seed).random((n_states, n_symbols))
    if identity and n_states == n_symbols:
        b += 10_000 * np.eye(n_states)
    p = np.ones(n_states)
    if terminal and n_states > 1:
        p[-1] = 0.0
    return Hmm(p / p.sum(), uniform_transitions(n_states, left_to_right, terminal), b / b.sum(axis=1, keepdims=True), left_to_right=left_to_right, terminal=terminal)


def continuous(centres: np.ndarray, left_to_right: bool = False, terminal: bool = False, covariance: str = "diagonal", min_var: float = 1e-5) -> Hmm:
    """A start with one component around a centre for each emitting state."""
    n = len(centres) + 2 * left_to_right
    mixtures = tuple(mx.from_centroids(c, covariance, min_var) for c in centres)
    return Hmm(np.full(n, 1 / n), uniform_transitions(n, left_to_right, terminal), None, mixtures, left_to_right, terminal)


def from_samples(sequences: DataFrame, n_states: int, components: int = 1, seed: int = 0, **more) -> Hmm:
    """A continuous start: each state's components are around rows of sequences (seq_id, t, features) by seeded hash, other rows for each state."""
    h = continuous(np.zeros((n_states, dimension(sequences))), **more)
    return replace(h, mixtures=tuple(mx.from_samples(sequences, components, m.covariance, m.min_var, seed + k) for k, m in enumerate(h.mixtures)))


def from_kmeans(sequences: DataFrame, n_states: int, **more) -> Hmm:
    """A continuous start: state k is around centre k of all rows of sequences (seq_id, t, features), clustered from centres far from the mean and each other."""
    rows = sequences.select(F.xxhash64("seq_id", "t").alias("id"), "features")
    return continuous(cluster.fit(rows, n_states, init="mean-first").centres, **more)


def start(modality: str, *args, **more) -> Hmm:
    """discrete() or continuous() by name; there is no other kind, semi-continuous ones least of all."""
    kinds = {"discrete": discrete, "continuous": continuous}
    if modality.lower() not in kinds:
        raise ValueError(f"modality must be one of {tuple(kinds)}")
    return kinds[modality.lower()](*args, **more)


# --- one sequence -----------------------------------------------------------------------------------------------------


def forward(h: Hmm, log_b: np.ndarray) -> tuple[np.ndarray, float]:
    """(log alpha, log-likelihood) of a model of emitting states."""
    a, alpha = _log(h.transitions), np.empty_like(log_b)
    alpha[0] = _log(h.initial) + log_b[0]
    for t in range(1, len(log_b)):
        alpha[t] = _lse(alpha[t - 1][:, None] + a, 0) + log_b[t]
    return alpha, float(_lse(alpha[-1], 0))


def backward(h: Hmm, log_b: np.ndarray, final: np.ndarray | None = None, terminal: Sequence[int] | None = None) -> np.ndarray:
    """log beta. final: the states' probabilities at the end; terminal: the only states, by number, that a path may end in; else all may."""
    a, beta = _log(h.transitions), np.empty_like(log_b)
    beta[-1] = 0.0 if final is None else _log(final)
    if final is None and terminal is not None:
        beta[-1] = LOG_ZERO
        beta[-1, list(terminal)] = 0.0
    for t in range(len(log_b) - 2, -1, -1):
        beta[t] = _lse(a + log_b[t + 1] + beta[t + 1], 1)
    return beta


def best_path(h: Hmm, log_b: np.ndarray) -> tuple[float, np.ndarray]:
    """(score, states); the first state wins ties; with terminal the path ends in the last state."""
    a, score = _log(h.transitions), _log(h.initial) + log_b[0]
    came = np.zeros(log_b.shape, int)
    for t in range(1, len(log_b)):
        z = score[:, None] + a
        came[t] = z.argmax(axis=0)
        score = z.max(axis=0) + log_b[t]
    path = np.empty(len(log_b), int)
    path[-1] = len(score) - 1 if h.terminal else score.argmax()
    for t in range(len(log_b) - 1, 0, -1):
        path[t - 1] = came[t][path[t]]
    return float(score[path[-1]]), path


# --- tables of sequences ----------------------------------------------------------------------------------------------


def gathered(sequences: DataFrame, value: str) -> DataFrame:
    """(seq_id, observed): each sequence's values by t."""
    both = F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v"))))
    return sequences.groupBy("seq_id").agg(F.transform(both, lambda s: s["v"]).alias("observed"))


def _value(h: Hmm) -> str:
    return "symbol" if h.emissions is not None else "features"


#: Steps of a chunk, at least; a chunk has CHUNK_STATES steps for each number of its product, so products are a small share of the data. Numbers that a padded part holds.
CHUNK, CHUNK_STATES, CELLS = 4_096, 64, 1_000_000


def chunked(h: Hmm, sequences: DataFrame) -> tuple[DataFrame, bool]:
    """(seq_id, c, observed): the sequences' values by t, whole with c = 0 if none has more steps than a chunk, else all of them cut into chunks, which c orders; and whether they are cut."""
    value, size = _value(h), max(CHUNK, CHUNK_STATES * len(h.transitions) ** 2)
    if not sequences.groupBy("seq_id").count().filter(F.col("count") > size).head(1):
        return gathered(sequences, value).select("seq_id", F.lit(0).cast("bigint").alias("c"), "observed"), False
    placed = running_sum(sequences.select("seq_id", "t", F.col(value).alias("_v"), F.lit(1).alias("_one")), ["seq_id", "t", "_v"], "_one", "_n")
    both = F.array_sort(F.collect_list(F.struct("t", F.col("_v").alias("v"))))
    cut = placed.groupBy("seq_id", F.floor((F.col("_n") - 1) / F.lit(size)).alias("c")).agg(F.transform(both, lambda s: s["v"]).alias("observed"))
    return written(cut, "chunks"), True


@dataclass(frozen=True)
class _Part:
    """Some arrays of a batch, longest first, padded: rows are their numbers in the batch, seen their values, log_b their emissions (rows x places x states)."""

    rows: np.ndarray
    sizes: np.ndarray
    seen: np.ndarray
    log_b: np.ndarray

    @property
    def live(self) -> np.ndarray:
        """By place, how many of the rows have it."""
        return np.searchsorted(-self.sizes, -np.arange(self.log_b.shape[1]), side="left")

    @property
    def there(self) -> np.ndarray:
        return np.arange(self.log_b.shape[1]) < self.sizes[:, None]


def _parts(m: Hmm, observed: pa.Array) -> Iterator[_Part]:
    flat = observed.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(int) if m.emissions is not None else matrix(flat)
    sizes = np.array([len(x) for x in observed], np.int64) if observed.null_count else np.diff(observed.offsets.to_numpy())
    log_b, starts, order = m.log_emissions(values), np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    order, at = order[sizes[order] > 0], 0
    while at < len(order):
        most = int(sizes[order[at]])
        rows = order[at : at + max(1, CELLS // (most * log_b.shape[1]))]
        at += len(rows)
        place = np.arange(most)
        there = place < sizes[rows][:, None]
        where = np.where(there, starts[rows][:, None] + place, 0)
        yield _Part(rows, sizes[rows], values[where], np.where(there[..., None], log_b[where], 0.0))


def _along(a: np.ndarray, start: np.ndarray, part: _Part, plus: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """What a chunk makes of each of several starts (rows x starts x states), at its end: the product of its steps, applied."""
    now, live = start + part.log_b[:, None, 0], part.live
    for t in range(1, part.log_b.shape[1]):
        k = live[t]
        now[:k] = plus(now[:k, :, :, None] + a, 2) + part.log_b[:k, None, t]
    return now


def _forward(a: np.ndarray, start: np.ndarray, part: _Part) -> np.ndarray:
    """log alpha of all rows; start is what enters each, its first emission not yet added."""
    alpha, live = np.zeros(part.log_b.shape), part.live
    now = alpha[:, 0] = start + part.log_b[:, 0]
    for t in range(1, alpha.shape[1]):
        k = live[t]
        now = alpha[:k, t] = _lse(now[:k, :, None] + a, 1) + part.log_b[:k, t]
    return alpha


def _backward(a: np.ndarray, leave: np.ndarray, part: _Part) -> np.ndarray:
    """log beta of all rows; leave is that of each row's last place."""
    beta, live = np.zeros(part.log_b.shape), part.live
    beta[np.arange(len(beta)), part.sizes - 1] = leave
    for t in range(beta.shape[1] - 2, -1, -1):
        k = live[t + 1]
        beta[:k, t] = _lse(a + (part.log_b[:k, t + 1] + beta[:k, t + 1])[:, None], 2)
    return beta


def _best(a: np.ndarray, start: np.ndarray, part: _Part) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the states at each row's end, and where the best way into each state at each place came from, the first state at ties. The first place came from nowhere in the chunk: -1."""
    came, live = np.full(part.log_b.shape, -1, np.int32), part.live
    score = start + part.log_b[:, 0]
    for t in range(1, came.shape[1]):
        k = live[t]
        z = score[:k, :, None] + a
        came[:k, t] = z.argmax(axis=1)
        score[:k] = z.max(axis=1) + part.log_b[:k, t]
    return score, came


def _traced(came: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states at all places of rows that end in ends."""
    path = np.zeros(came.shape[:2], np.int32)
    rows = np.arange(len(came))
    path[rows, sizes - 1] = ends
    for t in range(came.shape[1] - 1, 0, -1):
        k = rows[sizes > t]
        path[k, t - 1] = came[k, t, path[k, t]]
    return path


def _last(m: Hmm, ends: Sequence[int] | None) -> np.ndarray:
    out = np.zeros(len(m.transitions))
    if ends is not None:
        out[:] = LOG_ZERO
        out[list(ends)] = 0.0
    return out


def _top(z: np.ndarray, axis: int) -> np.ndarray:
    return z.max(axis=axis)


def _scanned(m: Hmm, chunks: DataFrame, last: np.ndarray, best: bool) -> DataFrame:
    """(seq_id, c, start, leave, z, final, ended): of each chunk what enters it, what follows its end and the log alpha there, of its sequence the log-likelihood, or the best score, and whether the chunk is its last.

    Chunks give the products of their steps; those of one sequence, a number for each CHUNK_STATES steps at most, meet in one task.
    """
    kind, a, s = chunks.schema["seq_id"].dataType.simpleString(), _log(m.transitions), len(m.transitions)
    plus = _top if best else _lse

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([_log(m.initial)[None], a])
        for batch in batches:
            out: list = [None] * batch.num_rows
            for part in _parts(m, batch.column("observed")):
                made = _along(a, np.repeat(starts[None], len(part.rows), axis=0), part, plus)
                for i, row in enumerate(part.rows.tolist()):
                    out[row] = made[i].ravel().tolist()
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), batch.column("c"), pa.array(out, pa.list_(pa.float64()))], ["seq_id", "c", "product"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                both = batch.column("both")[i].values
                c, made = both.field("c"), np.stack([np.asarray(p.values).reshape(s + 1, s) for p in both.field("product")])
                n = len(c)
                end, start, leave = np.empty((n, s)), np.empty((n, s)), np.empty((n, s))
                for k in range(n):
                    start[k] = _log(m.initial) if k == 0 else plus(end[k - 1][:, None] + a, 0)
                    end[k] = made[k, 0] if k == 0 else plus(end[k - 1][:, None] + made[k, 1:], 0)
                leave[-1] = last
                for k in range(n - 2, -1, -1):
                    leave[k] = plus(made[k + 1, 1:] + leave[k + 1], 1)
                z = float(plus(end[-1] + last, 0))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("seq_id")[i].as_py()] * n, batch.column("seq_id").type), c, pa.array(start.tolist()), pa.array(leave.tolist()), pa.array([z] * n), pa.array(np.arange(n) == n - 1), pa.array(end.tolist())],
                                                 ["seq_id", "c", "start", "leave", "z", "final", "ended"])

    made = chunks.mapInArrow(products, f"seq_id {kind}, c bigint, product array<double>")
    per = made.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("c", "product"))).alias("both"))
    return per.mapInArrow(scan, f"seq_id {kind}, c bigint, start array<double>, leave array<double>, z double, final boolean, ended array<double>")


def _entered(batch: pa.RecordBatch, name: str, default: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return matrix(batch.column(name))[rows] if name in batch.schema.names else np.repeat(default[None], len(rows), axis=0)


def _with_scan(m: Hmm, chunks: DataFrame, cut: bool, last: np.ndarray, best: bool = False) -> DataFrame:
    """chunks with what enters and leaves them, if sequences are cut."""
    return chunks.join(written(_scanned(m, chunks, last, best), "scan"), ["seq_id", "c"]) if cut else chunks


def log_likelihoods(h: Hmm, sequences: DataFrame, ends: Sequence[int] | None = None) -> DataFrame:
    """(seq_id, log_likelihood). ends: the only emitting states, by number, that a path may end in; by default all may."""
    m = h.emitting
    last, kind = _last(m, ends), sequences.schema["seq_id"].dataType.simpleString()
    chunks, cut = chunked(m, sequences)
    if cut:
        return _scanned(m, chunks, last, False).filter("final").select("seq_id", F.col("z").alias("log_likelihood"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, start = _log(m.transitions), _log(m.initial)
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for part in _parts(m, batch.column("observed")):
                z[part.rows] = _lse(_along(a, np.repeat(start[None, None], len(part.rows), axis=0), part, _lse)[:, 0] + last, 1)
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(z)], ["seq_id", "log_likelihood"])

    return chunks.mapInArrow(run, f"seq_id {kind}, log_likelihood double")


def posteriors(h: Hmm, sequences: DataFrame, ends: Sequence[int] | None = None) -> DataFrame:
    """(seq_id, t, gamma): the states' probabilities at each place, counted from 0 in the order of t. ends: as in log_likelihoods."""
    m = h.emitting
    last, kind = _last(m, ends), sequences.schema["seq_id"].dataType.simpleString()
    chunks, cut = chunked(m, sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _log(m.transitions)
        for batch in batches:
            ids, c = batch.column("seq_id"), batch.column("c")
            for part in _parts(m, batch.column("observed")):
                alpha = _forward(a, _entered(batch, "start", _log(m.initial), part.rows), part)
                beta = _backward(a, _entered(batch, "leave", last, part.rows), part)
                gamma = alpha + beta
                gamma = np.exp(gamma - _lse(gamma, 2)[..., None])[part.there]
                rows = pa.array(np.repeat(part.rows, part.sizes))
                place = np.broadcast_to(np.arange(part.log_b.shape[1]), part.there.shape)[part.there]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(gamma) + 1) * gamma.shape[1], pa.int32()), pa.array(gamma.ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(rows), c.take(rows), pa.array(place, pa.int64()), lists], ["seq_id", "c", "place", "gamma"])

    out = _with_scan(m, chunks, cut, last).mapInArrow(run, f"seq_id {kind}, c bigint, place bigint, gamma array<double>")
    return _numbered(out, chunks, cut).select("seq_id", F.col("t").cast("int").alias("t"), "gamma")


def _numbered(out: DataFrame, chunks: DataFrame, cut: bool) -> DataFrame:
    """Rows (seq_id, c, place, ...) with t, the place in the sequence. The places of a chunk follow those of the chunks before it, of which a sequence has few."""
    if not cut:
        return out.withColumn("t", F.col("place"))
    before = F.sum("n").over(Window.partitionBy("seq_id").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    starts = chunks.select("seq_id", "c", F.size("observed").cast("bigint").alias("n")).select("seq_id", "c", F.coalesce(before, F.lit(0)).alias("_before"))
    return out.join(starts, ["seq_id", "c"]).withColumn("t", F.col("place") + F.col("_before"))


def best_states(h: Hmm, sequences: DataFrame) -> DataFrame:
    """(seq_id, t, state, score): the best path, a row a place, counted from 0, and its score. The first state wins ties; with terminal, paths end in the last state.

    Where sequences are cut: a first pass has the scores at all chunks' ends, a second one where in the chunk before the best way to each of a chunk's end states comes from, a third one the states.
    """
    m = h.emitting
    a, kind, s = _log(m.transitions), sequences.schema["seq_id"].dataType.simpleString(), len(m.transitions)
    last = _last(m, (s - 1,) if h.terminal else None)
    chunks, cut = chunked(m, sequences)
    held = _with_scan(m, chunks, cut, last, best=True)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each end state of a chunk the state at its first place."""
        for batch in batches:
            out: list = [None] * batch.num_rows
            scores: list = [None] * batch.num_rows
            for part in _parts(m, batch.column("observed")):
                score, came = _best(a, _entered(batch, "start", _log(m.initial), part.rows), part)
                first = np.stack([_traced(came, part.sizes, np.full(len(came), j))[:, 0] for j in range(s)], axis=1)
                for i, row in enumerate(part.rows.tolist()):
                    out[row], scores[row] = first[i].tolist(), score[i].tolist()
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), batch.column("c"), pa.array(out, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float64()))], ["seq_id", "c", "first", "scores"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The end state of each chunk: the best at the last one, then from chunk to chunk."""
        for batch in batches:
            for i in range(batch.num_rows):
                both = batch.column("both")[i].values
                c = both.field("c")
                first, score = (np.stack([np.asarray(x.values) for x in both.field(n)]) for n in ("first", "scores"))
                n = len(c)
                end = np.zeros(n, np.int32)
                end[-1] = (score[-1] + last).argmax()
                for k in range(n - 1, 0, -1):
                    end[k - 1] = (score[k - 1] + a[:, first[k][end[k]]]).argmax()
                best = float(score[-1][end[-1]])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("seq_id")[i].as_py()] * n, batch.column("seq_id").type), c, pa.array(end), pa.array([best] * n)], ["seq_id", "c", "end", "score"])

    if cut:
        per = held.mapInArrow(back, f"seq_id {kind}, c bigint, first array<int>, scores array<double>").groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("c", "first", "scores"))).alias("both"))
        held = held.drop("z").join(written(per.mapInArrow(link, f"seq_id {kind}, c bigint, end int, score double"), "ends"), ["seq_id", "c"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(m, batch.column("observed")):
                score, came = _best(a, _entered(batch, "start", _log(m.initial), part.rows), part)
                if "end" in batch.schema.names:
                    end, best = batch.column("end").to_numpy()[part.rows], batch.column("score").to_numpy()[part.rows]
                else:
                    end = (score + last).argmax(axis=1)
                    best = score[np.arange(len(score)), end]
                path, rows = _traced(came, part.sizes, end)[part.there], np.repeat(part.rows, part.sizes)
                place = np.broadcast_to(np.arange(part.log_b.shape[1]), part.there.shape)[part.there]
                yield pa.RecordBatch.from_arrays([batch.column("seq_id").take(pa.array(rows)), batch.column("c").take(pa.array(rows)), pa.array(place, pa.int64()), pa.array(path), pa.array(np.repeat(best, part.sizes))], ["seq_id", "c", "place", "state", "score"])

    out = held.mapInArrow(states, f"seq_id {kind}, c bigint, place bigint, state int, score double")
    return _numbered(out, chunks, cut).select("seq_id", F.col("t").cast("int").alias("t"), "state", "score")


def viterbi(h: Hmm, sequences: DataFrame) -> DataFrame:
    """(seq_id, score, path) of each sequence, the path as one array; best_states() gives it as rows."""
    both = F.array_sort(F.collect_list(F.struct("t", "state")))
    return best_states(h, sequences).groupBy("seq_id").agg(F.first("score").alias("score"), F.transform(both, lambda x: x["state"]).alias("path"))


def forward_column(h: Hmm, symbols: Column) -> Column:
    """The log-likelihood of an array of symbols as a column, without Python: the lattice is folded over the array."""
    m = h.emitting
    a = F.array(*[literal(col) for col in _log(m.transitions).T])
    b = F.array(*[literal(row) for row in _log(m.emissions).T])
    start = F.zip_with(literal(_log(m.initial)), F.get(b, F.get(symbols, 0)), lambda x, y: x + y)
    move = lambda alpha, s: F.zip_with(F.transform(a, lambda col: logsumexp(F.zip_with(alpha, col, lambda x, y: x + y))), F.get(b, s), lambda x, y: x + y)
    return logsumexp(F.aggregate(F.slice(symbols, 2, F.greatest(F.size(symbols) - 1, F.lit(0))), start, move))


def transition_counts(sequences: DataFrame) -> DataFrame:
    """(i, j, n, p): observed moves from symbol to next symbol and their shares by i. The moves are counted natively within each sequence's array."""
    arrays = gathered(sequences, "symbol").select("observed")
    moves = F.zip_with(F.slice("observed", 1, F.size("observed") - 1), F.slice("observed", 2, F.size("observed") - 1), lambda x, y: F.struct(x.alias("i"), y.alias("j")))
    counts = arrays.filter(F.size("observed") > 1).select(F.explode(moves).alias("m")).groupBy("m.i", "m.j").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.col("i").alias("_i")).agg(F.sum("n").alias("_n"))
    return counts.join(F.broadcast(totals), F.col("i") == F.col("_i")).select("i", "j", "n", (F.col("n") / F.col("_n")).alias("p"))


# --- training ---------------------------------------------------------------------------------------------------------


def _statistics(m: Hmm, batch: pa.RecordBatch, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """Of each row of a batch its number, its sums as logs (the initial states, moves, and states by place but the last and in all, then by symbol), mixtures' packed sums, and the log-likelihood."""
    s, a = len(m.transitions), _log(m.transitions)
    with np.errstate(divide="ignore"):
        for part in _parts(m, batch.column("observed")):
            start, leave = _entered(batch, "start", _log(m.initial), part.rows), _entered(batch, "leave", last, part.rows)
            alpha, beta = _forward(a, start, part), _backward(a, leave, part)
            z = _lse(alpha[:, 0] + beta[:, 0], 1)
            gamma = np.where(part.there[..., None], alpha + beta - z[:, None, None], -np.inf)
            moves = np.full((len(z), s, s), -np.inf)
            for t in range(alpha.shape[1] - 1):
                k = part.live[t + 1]
                xi = alpha[:k, t, :, None] + a + (part.log_b[:k, t + 1] + beta[:k, t + 1])[:, None, :] - z[:k, None, None]
                moves[:k] = np.logaddexp(moves[:k], xi)
            inner = np.where((np.arange(gamma.shape[1]) < part.sizes[:, None] - 1)[..., None], gamma, -np.inf)
            for i, row in enumerate(part.rows.tolist()):
                n = part.sizes[i]
                logs = [gamma[i, 0], moves[i].ravel(), np.logaddexp.reduce(inner[i], axis=0), np.logaddexp.reduce(gamma[i], axis=0)]
                packed = []
                if m.emissions is not None:
                    weight = np.full(m.emissions.shape, -np.inf)
                    for k in np.unique(part.seen[i, :n]).tolist():
                        weight[:, k] = np.logaddexp.reduce(gamma[i, :n][part.seen[i, :n] == k], axis=0)
                    logs.append(weight.ravel())
                else:
                    x = part.seen[i, :n]
                    for j, mix in enumerate(m.mixtures):
                        within = mix.log_densities(x)
                        r = np.exp(within - _lse(within, 1)[:, None] + gamma[i, :n, j, None])
                        packed += [r.sum(axis=0), (r.T @ x).ravel(), np.array([(x * w[:, None]).T @ x for w in r.T]).ravel()]
                yield row, np.concatenate(logs), np.concatenate(packed) if packed else np.zeros(0), float(z[i])


def _weighed(m: Hmm, logs: np.ndarray, pooled: bool) -> np.ndarray:
    """A sequence's sums from their logs: initial, moves and emissions, each a count, or if not pooled the share of it in the sequence."""
    s = len(m.transitions)
    first, moves, inner, every, by_symbol = logs[:s], logs[s : s + s * s].reshape(s, s), logs[s + s * s : 2 * s + s * s], logs[2 * s + s * s : 3 * s + s * s], logs[3 * s + s * s :]
    over = lambda x, total: np.exp(x - (0.0 if pooled else np.where(np.isfinite(total), total, 0.0)[:, None]))
    return np.concatenate([np.exp(first), over(moves, inner).ravel(), over(by_symbol.reshape(s, -1), every).ravel()])


def _whole_sequences(m: Hmm, held: DataFrame, last: np.ndarray, pooled: bool) -> DataFrame:
    """(v): of sequences that are cut the sums of each, from its chunks'. A move from chunk to chunk counts with the chunk it enters."""
    s, a = len(m.transitions), _log(m.transitions)
    kind = held.schema["seq_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, c = batch.column("seq_id"), batch.column("c")
            start, z, final = matrix(batch.column("start")) if batch.num_rows else None, batch.column("z"), batch.column("final")
            for row, logs, packed, _ in _statistics(m, batch, last):
                own = logs.copy()
                if not final[row].as_py():  # the last place of the chunk is not the sequence's
                    own[s + s * s : 2 * s + s * s] = logs[2 * s + s * s : 3 * s + s * s]
                yield pa.RecordBatch.from_arrays([ids.slice(row, 1), c.slice(row, 1), pa.array([own.tolist()]), pa.array([packed.tolist()], pa.list_(pa.float64())), pa.array([start[row].tolist()]), z.slice(row, 1)], ["seq_id", "c", "logs", "packed", "start", "z"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                both = batch.column("both")[i].values
                logs, packed, entry = (np.stack([np.asarray(x.values) for x in both.field(n)]) for n in ("logs", "packed", "entry"))
                z = both.field("z")[0].as_py()
                sums = np.logaddexp.reduce(logs, axis=0)
                sums[:s] = logs[0, :s]
                moves = sums[s : s + s * s].reshape(s, s)
                for k in range(1, len(logs)):
                    # the states at the end of the chunk before, and from there those at the first place of this one
                    into = entry[k][:, None] + a
                    into = into - _lse(into, 0) + logs[k, :s]
                    moves[:] = np.logaddexp(moves, into)
                v = np.concatenate([_weighed(m, sums, pooled), packed.sum(axis=0), [z, 1.0]])
                yield pa.RecordBatch.from_arrays([pa.array([v.tolist()])], ["v"])

    parts = held.mapInArrow(each, f"seq_id {kind}, c bigint, logs array<double>, packed array<double>, start array<double>, z double")
    ends = held.select("seq_id", (F.col("c") + 1).alias("c"), "ended")
    joined = parts.join(ends, ["seq_id", "c"], "left").withColumn("entry", F.coalesce("ended", F.col("start")))
    return joined.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("c", "logs", "packed", "entry", "z"))).alias("both")).mapInArrow(merge, "v array<double>")


def sums(h: Hmm, sequences: DataFrame, pooling: str = "per_sequence", ends: Sequence[int] | None = None) -> np.ndarray | None:
    """All sequences' sums, flat: initial, moves, emissions (or mixtures' packed statistics), log-likelihood, number of sequences. None without sequences.

    pooling: "per_sequence" gives each sequence the same weight (ratios are taken within it and summed), "standard" each observation. ends: the only emitting states that a path may end in; by default all may.
    """
    if pooling not in ("per_sequence", "standard"):
        raise ValueError("pooling must be per_sequence or standard")
    m = h.emitting
    pooled, last = pooling == "standard", _last(m, ends)
    chunks, cut = chunked(m, sequences)

    def partial(batch: dict) -> dict[int, np.ndarray]:
        out = None
        for _, logs, packed, z in _statistics(m, pa.RecordBatch.from_arrays(list(batch.values()), list(batch)), last):
            v = np.concatenate([_weighed(m, logs, pooled), packed, [z, 1.0]])
            out = v if out is None else out + v
        return {0: out} if out is not None else {}

    if cut:
        return fold(_whole_sequences(m, _with_scan(m, chunks, cut, last), last, pooled), lambda batch: {0: matrix(batch["v"]).sum(axis=0)})[0]
    return fold(chunks.select("observed"), partial).get(0)


def emission_sums(m: Hmm, v: np.ndarray) -> list[np.ndarray]:
    """The part of sums() that each emitting state has."""
    s = len(m.transitions)
    rest = v[s + s * s : -2]
    if m.emissions is not None:
        return list(rest.reshape(m.emissions.shape))
    sizes = [x.mu.shape[0] * (1 + x.mu.shape[1] + x.mu.shape[1] ** 2) for x in m.mixtures]
    return np.split(rest, np.cumsum(sizes)[:-1])


def next_mixture(x: mx.Mixture, own: np.ndarray) -> mx.Mixture:
    """A state's mixture after its sums; it stays as it is where a component saw nothing."""
    c, d = x.mu.shape
    r, rx, rxx = own[:c], own[c : c + c * d].reshape(c, d), own[c + c * d :].reshape(c, d, d)
    return mx.maximise(x, mx.Statistics(np.full(c, r.sum() / c), r, rx, rxx, 0.0)) if (r > 0).all() else x


def next_transitions(h: Hmm, moves: np.ndarray) -> np.ndarray:
    """A model's transitions after the sums of moves between its emitting states."""
    if not h.left_to_right:
        return normalise_transitions(moves)
    s = len(moves)
    whole = np.zeros((s + 2, s + 2))
    whole[0, 1], whole[1:-1, 1:-1] = 1.0, moves
    whole[-2, -1] = max(1e-3, moves[-1].sum() * 0.5)
    return normalise_transitions(whole, True)


def train_step(h: Hmm, sequences: DataFrame, pooling: str = "per_sequence", ends: Sequence[int] | None = None) -> tuple[Hmm, float]:
    """(the next model, the sum of log-likelihoods under h): one Baum-Welch iteration over all sequences; pooling and ends as in sums()."""
    m, v = h.emitting, sums(h, sequences, pooling, ends)
    if v is None:
        raise ValueError("no sequences")
    s = len(m.transitions)
    own = emission_sums(m, v)
    if m.emissions is not None:
        fresh = replace(m, emissions=normalise_emissions(np.array(own)))
    else:
        fresh = replace(m, mixtures=tuple(next_mixture(x, o) for x, o in zip(m.mixtures, own)))
    moves = next_transitions(h, v[s : s + s * s].reshape(s, s))
    if h.left_to_right:
        return replace(fresh, initial=h.initial, transitions=moves, left_to_right=True), float(v[-2])
    initial = np.maximum(0.0, v[:s])
    return replace(fresh, initial=initial / initial.sum(), transitions=moves), float(v[-2])


def train(h: Hmm, sequences: DataFrame, iterations: int = 10, pooling: str = "per_sequence", ends: Sequence[int] | None = None) -> tuple[Hmm, list[float]]:
    trace: list[float] = []
    for _ in range(iterations):
        h, z = train_step(h, sequences, pooling, ends)
        trace.append(z)
    return h, trace


def split_mixtures(h: Hmm, force: bool = False) -> Hmm:
    """Every state's mixture grown by its split."""
    return replace(h, mixtures=tuple(mx.split(m, force) for m in h.mixtures))


# --- chains that share states -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class State:
    """What a named state emits: chances of symbols, or a mixture. prior: its chance at the start of a chain. index: its number among all states, if it has one."""

    prior: float
    emissions: np.ndarray | None = None
    mixture: mx.Mixture | None = None
    index: int | None = None


@dataclass(frozen=True)
class Chain:
    """The names of a chain's emitting states, in order, and of its transitions. initial: its own chances at the start; without, those of its states' priors, which are all that files hold."""

    states: tuple[str, ...]
    transitions: str
    initial: np.ndarray | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Registry:
    """States, transitions and chains by name. Chains that name the same state, or the same transitions, share them."""

    states: dict[str, State]
    transitions: dict[str, np.ndarray]
    chains: dict[str, Chain]
    left_to_right: bool = False
    terminal: bool = False

    def __post_init__(self) -> None:
        for name, chain in self.chains.items():
            if not chain.states:
                raise ValueError(f"{name}: a chain has states")
            if lost := sorted({*chain.states} - self.states.keys()):
                raise ValueError(f"{name}: no states {lost}")
            if chain.transitions not in self.transitions:
                raise ValueError(f"{name}: no transitions {chain.transitions}")
            if len(self.transitions[chain.transitions]) != len(chain.states) + 2 * self.left_to_right:
                raise ValueError(f"{name}: {len(chain.states)} states and {len(self.transitions[chain.transitions])} in its transitions")

    def model(self, name: str) -> Hmm:
        """The chain of a name as a model of its own."""
        chain = self.chains[name]
        own = [self.states[s] for s in chain.states]
        a = self.transitions[chain.transitions]
        priors = np.array([s.prior for s in own])
        initial = chain.initial
        if initial is None:
            initial = priors / priors.sum() if len(priors) == len(a) and priors.sum() > 0 else np.full(len(a), 1 / len(a))
        if all(s.mixture is not None for s in own):
            return Hmm(initial, a, None, tuple(s.mixture for s in own), self.left_to_right, self.terminal, name, chain.states)
        return Hmm(initial, a, np.array([s.emissions for s in own]), (), self.left_to_right, self.terminal, name, chain.states)

    def ordered(self) -> list[str]:
        """The states' names in order; chains and transitions order by name too."""
        return sorted(self.states)

    def indexed(self) -> Registry:
        """With a number for each state, by the order of names."""
        return replace(self, states={s: replace(self.states[s], index=k) for k, s in enumerate(self.ordered())})


def registry(*models: Hmm) -> Registry:
    """Models by their names; states and transitions that have the same name must be the same."""
    states: dict[str, State] = {}
    transitions: dict[str, np.ndarray] = {}
    chains = {}
    for h in models:
        n = len(h.emissions) if h.emissions is not None else len(h.mixtures)
        names = h.state_names or tuple(f"{h.name}-{k}" for k in range(n))
        for k, name in enumerate(names):
            state = State(float(h.initial[min(k, len(h.initial) - 1)]), None if h.emissions is None else h.emissions[k], h.mixtures[k] if h.mixtures else None)
            held = states.setdefault(name, state)
            if (held.emissions is None) != (state.emissions is None) or held.emissions is not None and not np.array_equal(held.emissions, state.emissions) or held.mixture is not None and not np.array_equal(held.mixture.mu, state.mixture.mu):
                raise ValueError(f"two states are named {name}")
        if not np.array_equal(transitions.setdefault(h.name, h.transitions), h.transitions):
            raise ValueError(f"two sets of transitions are named {h.name}")
        chains[h.name] = Chain(names, h.name, h.initial)
    return Registry(states, transitions, chains, any(h.left_to_right for h in models), any(h.terminal for h in models))


def train_shared(r: Registry, sequences: DataFrame, pooling: str = "standard") -> tuple[Registry, dict[str, float]]:
    """(the next registry, log-likelihoods by chain): one Baum-Welch iteration over sequences (chain, seq_id, t, symbol or features), each trained by the chain it names.

    Sums are keyed by what they belong to: a state's emissions are those of every place in every chain that names it, transitions those of every chain that names them. A chain without sequences adds nothing;
    a state, or transitions, that no sequence reaches stay as they are. One aggregation for each chain.
    """
    emitted: dict[str, np.ndarray] = {}
    moved: dict[str, np.ndarray] = {}
    first: dict[str, list[float]] = {}
    chains, scores = dict(r.chains), {}
    for name in sorted(r.chains):
        h, chain = r.model(name), r.chains[name]
        v = sums(h, sequences.filter(F.col("chain") == name), pooling)
        if v is None:
            continue
        scores[name], s = float(v[-2]), len(h.emitting.transitions)
        if not h.left_to_right:
            chains[name] = replace(chain, initial=np.maximum(0.0, v[:s]) / np.maximum(0.0, v[:s]).sum())
        for state, own, start in zip(chain.states, emission_sums(h.emitting, v), v[:s]):
            emitted[state] = emitted.get(state, 0.0) + own
            first.setdefault(state, []).append(max(0.0, float(start)) / max(v[:s].sum(), MIN_PROB))
        moved[chain.transitions] = moved.get(chain.transitions, 0.0) + v[s : s + s * s].reshape(s, s)
    states = dict(r.states)
    for name, own in emitted.items():
        old = states[name]
        prior = old.prior if r.left_to_right else float(np.mean(first[name]))
        states[name] = replace(old, prior=prior, emissions=None if old.emissions is None else normalise_emissions(own[None])[0], mixture=None if old.mixture is None else next_mixture(old.mixture, own))
    shape = lambda name, moves: next_transitions(r.model(next(c for c in r.chains if r.chains[c].transitions == name)), moves)
    return replace(r, chains=chains, states=states, transitions={**r.transitions, **{name: shape(name, moves) for name, moves in moved.items()}}), scores
