"""Feed-forward networks: training by gradients, pretraining by contrastive divergence, tied autoencoders, prediction as a pass over batches.

A network is a frozen list of layers on the driver. Two ways to train: synchronous, where every batch of an epoch is the rows of one
hash class and its gradient is one aggregation over the table (nothing but sums reaches the driver); and sequential, the classical
order of small batches, over rows that a caller hands over as arrays and that must fit the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessel.functions.activations import ALPHA_TANH, activate, activate_rows, slope_rows
from tessel.functions.vectors import dot, literal
from tessel.plans.stats import fold, matrix
from tessel.plans.tables import dealt

MOMENTUM_FROM, HALF_FROM = 5, 2
PROB_FLOOR = 1e-15
MIN_SIGMA = 0.1


@dataclass(frozen=True)
class Layer:
    """weights (out x in), biases, the share of units that stay in training, a learning rate of its own or one for each unit, noise, and normalisers of the net input."""

    kind: str
    weights: np.ndarray
    bias: np.ndarray
    input_bias: np.ndarray
    input_kind: str = "linear"
    keep: float = 1.0
    learning_rate: float | np.ndarray | None = None
    noise: float = 0.0
    mean: np.ndarray | None = None
    sigma: np.ndarray | None = None
    frozen: bool = False

    @property
    def n_in(self) -> int:
        return self.weights.shape[1]

    @property
    def n_out(self) -> int:
        return self.weights.shape[0]

    def net(self, x: np.ndarray, scale: float = 1.0) -> np.ndarray:
        z = scale * (x @ self.weights.T) + self.bias
        return z if self.mean is None else (z - self.mean) / self.sigma

    def net_back(self, h: np.ndarray) -> np.ndarray:
        return h @ self.weights + self.input_bias


@dataclass(frozen=True)
class Settings:
    learning_rate: float = 0.1
    momentum: float = 0.9
    l2: float = 0.0
    max_norm: float = 0.0
    max_iter: int = 100
    min_iter: int = 10
    batch_size: int = 100
    add_noise: bool = False
    batch_normalisation: bool = False
    scale: float = 1.0
    seed: int = 0


@dataclass(frozen=True)
class Network:
    layers: tuple[Layer, ...]
    settings: Settings = field(default_factory=Settings)
    name: str = "network"

    def output(self, x: np.ndarray) -> np.ndarray:
        """Inference on rows: what training dropped scales the input of the next layer."""
        keep = 1.0
        for layer in self.layers:
            x = activate_rows(layer.kind, layer.net(x, keep))
            keep = layer.keep
        return x

    def output_column(self, features: Column) -> Column:
        """The same as a column; for small networks."""
        keep = 1.0
        for layer in self.layers:
            z = F.array(*[F.lit(float(keep)) * dot(features, literal(w)) + float(b) for w, b in zip(layer.weights, layer.bias)])
            if layer.mean is not None:
                z = F.array(*[(F.get(z, i) - float(m)) / float(s) for i, (m, s) in enumerate(zip(layer.mean, layer.sigma))])
            features, keep = activate(layer.kind, z), layer.keep
        return features

    def topology(self) -> list[tuple[int, str, int, int, float]]:
        return [(k, x.kind, x.n_in, x.n_out, x.keep) for k, x in enumerate(self.layers)]


def layer(n_in: int, n_out: int, kind: str, rng: np.random.Generator, scale: float = 1.0, **more) -> Layer:
    """Weights uniform within scale * sqrt(6 / (in + out)), no biases."""
    if not (1 <= n_in <= 10_000 and 1 <= n_out <= 10_000):
        raise ValueError("a layer has 1 to 10000 units on either side")
    a = scale * math.sqrt(6 / (n_in + n_out))
    return Layer(kind, rng.uniform(-a, a, (n_out, n_in)), np.zeros(n_out), np.zeros(n_in), **more)


def network(sizes: Sequence[int], kinds: Sequence[str], settings: Settings | None = None, keep: Sequence[float] | None = None, name: str = "network") -> Network:
    """sizes: inputs and then each layer's units; kinds and keep: of each layer."""
    settings = settings or Settings()
    rng = np.random.default_rng(settings.seed)
    inputs = ("linear", *kinds)
    out = [layer(a, b, kind, rng, settings.scale, input_kind=inputs[k], keep=keep[k] if keep else 1.0) for k, (a, b, kind) in enumerate(zip(sizes, sizes[1:], kinds))]
    return Network(tuple(out), settings, name)


def add_layer(net: Network, kind: str, size: int, noise: float = 0.0, learning_rate: float | None = None) -> Network:
    rng = np.random.default_rng([net.settings.seed, len(net.layers)])
    last = net.layers[-1]
    return replace(net, layers=(*net.layers, layer(last.n_out, size, kind, rng, net.settings.scale, input_kind=last.kind, noise=noise, learning_rate=learning_rate)))


def freeze(net: Network, layers: Sequence[int], frozen: bool = True) -> Network:
    return replace(net, layers=tuple(replace(x, frozen=frozen) if k in layers else x for k, x in enumerate(net.layers)))


def targets(labels: np.ndarray, n: int, kind: str) -> np.ndarray:
    """One-hot rows: 0 and 1, or -alpha and alpha for tanh; rows that are wide already stay."""
    labels = np.asarray(labels)
    if labels.ndim == 2:
        return labels.astype(float)
    if kind not in ("softmax", "multinomial", "sigmoid", "binary", "linear", "ReLU", "tanh"):
        raise ValueError(f"no targets for {kind}")
    hot = np.eye(n)[labels.astype(int)]
    return hot * 2 * ALPHA_TANH - ALPHA_TANH if kind == "tanh" else hot


def add_noise(x: np.ndarray, kind: str, sigma: float, rng: np.random.Generator) -> np.ndarray:
    """Linear inputs get Gaussian noise, binary ones are flipped with probability sigma."""
    if sigma <= 0:
        return x
    if kind in ("sigmoid", "binary"):
        return np.where(rng.random(x.shape) < sigma, 1 - x, x)
    return x + sigma * rng.standard_normal(x.shape)


# --- gradients --------------------------------------------------------------------------------------------------------


def gradients(net: Network, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None, drop: bool = True) -> tuple[list[tuple[np.ndarray, ...]], float]:
    """([(dW, db, dmean, dsigma) of each layer], the sum of squared errors over outputs); rng: for dropped units and noise, none without; drop: whether units are dropped at all, noise or not."""
    nets, acts, masks = [], [x if rng is None else add_noise(x, net.layers[0].input_kind, net.layers[0].noise if net.settings.add_noise else 0.0, rng)], []
    for k, l in enumerate(net.layers):
        z = l.net(acts[-1])
        if rng is not None and l.noise > 0 and k:
            z = z + l.noise * rng.standard_normal(z.shape)
        a = activate_rows(l.kind, z)
        mask = None if rng is None or l.keep >= 1 or not drop else (rng.random(a.shape) < l.keep).astype(float)
        nets.append(z)
        masks.append(mask)
        acts.append(a if mask is None else a * mask)
    error = acts[-1] - y
    loss = float((error**2).sum() / y.shape[1])
    out: list[tuple[np.ndarray, ...]] = []
    for k in range(len(net.layers) - 1, -1, -1):
        l = net.layers[k]
        if masks[k] is not None:
            error = error * masks[k]
        delta = error * slope_rows(l.kind, activate_rows(l.kind, nets[k]), nets[k])
        through = delta if l.mean is None else delta / l.sigma
        none = np.zeros(l.n_out)
        out.append((through.T @ acts[k], through.sum(axis=0), none if l.mean is None else -through.sum(axis=0), none if l.mean is None else -(through * nets[k]).sum(axis=0)))
        error = through @ l.weights
    return out[::-1], loss


def schedule(iteration: int) -> float:
    """The factor on learning rates of an epoch: near 1 at first, a hundredth at last."""
    return 0.01 + (1 + math.exp(-6.0)) / (1 + math.exp(0.02 * (iteration - 300)))


def momentum_at(iteration: int, momentum: float) -> float:
    return 0.0 if iteration < HALF_FROM else momentum / 2 if iteration < MOMENTUM_FROM else momentum


def cap_norms(weights: np.ndarray, most: float) -> np.ndarray:
    """Rows whose norm exceeds most are scaled to it; 0 means no cap."""
    if most <= 0:
        return weights
    n = np.linalg.norm(weights, axis=1, keepdims=True)
    return weights * np.minimum(1.0, most / np.maximum(n, 1e-300))


def unit_rates(l: Layer, s: Settings, factor: float = 1.0) -> np.ndarray:
    """A rate for each unit of a layer: its own, else the layer's, else the network's, times a factor."""
    return np.broadcast_to(np.asarray(s.learning_rate if l.learning_rate is None else l.learning_rate, float), l.n_out) * factor


def update(net: Network, grads: Sequence[tuple[np.ndarray, ...]], deltas: Sequence[tuple[np.ndarray, ...]], n: int, factor: float, momentum: float) -> tuple[Network, list[tuple[np.ndarray, ...]]]:
    """One descent step over the sum of gradients of n rows; biases move at twice the rate."""
    s, layers, moved = net.settings, [], []
    for l, g, d in zip(net.layers, grads, deltas):
        if l.frozen:
            layers.append(l)
            moved.append(d)
            continue
        rate = unit_rates(l, s, factor / max(1, n))
        rates = (rate[:, None], 2 * rate, rate, rate)
        step = tuple(momentum * old - r * new for old, r, new in zip(d, rates, g))
        fresh = replace(l, weights=cap_norms((1 - s.l2) * l.weights + step[0], s.max_norm), bias=l.bias + step[1])
        if s.batch_normalisation and l.mean is not None:
            fresh = replace(fresh, mean=l.mean + step[2], sigma=np.maximum(MIN_SIGMA, l.sigma + step[3]))
        layers.append(fresh)
        moved.append(step)
    return replace(net, layers=tuple(layers)), moved


def no_deltas(net: Network) -> list[tuple[np.ndarray, ...]]:
    return [(np.zeros_like(l.weights), np.zeros(l.n_out), np.zeros(l.n_out), np.zeros(l.n_out)) for l in net.layers]


def normalised(net: Network) -> Network:
    """With normalisers at rest on every layer."""
    return replace(net, layers=tuple(replace(l, mean=np.zeros(l.n_out), sigma=np.ones(l.n_out)) if l.mean is None else l for l in net.layers))


# --- training over tables ---------------------------------------------------------------------------------------------


def _unflat(v: np.ndarray, shapes: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        n = math.prod(shape)
        out.append(v[at : at + n].reshape(shape))
        at += n
    return out


def gradient_job(net: Network, data: DataFrame, target: str = "label", seed: tuple[int, ...] | None = None) -> tuple[list[tuple[np.ndarray, ...]], float, int]:
    """(gradients, loss, rows) summed over all rows (features, target) of data: one aggregation. seed: for dropped units, by task batch."""
    last, shapes = net.layers[-1], [a.shape for l in net.layers for a in (l.weights, l.bias, l.bias, l.bias)]

    def partial(batch: dict) -> dict[int, np.ndarray]:
        x = matrix(batch["features"])
        y = targets(matrix(batch[target]) if pa.types.is_list(batch[target].type) else batch[target].to_numpy(), last.n_out, last.kind)
        rng = None if seed is None else np.random.default_rng([*seed, len(x), int(abs(x.sum()) * 1e6) % (1 << 31)])
        grads, loss = gradients(net, x, y, rng)
        return {0: np.concatenate([*[a.ravel() for g in grads for a in g], [loss, len(x)]])}

    sums = fold(data.select("features", target), partial)
    if not sums:
        return [tuple(np.zeros(s) for s in shapes[4 * k : 4 * k + 4]) for k in range(len(net.layers))], 0.0, 0
    v = sums[0]
    flat = _unflat(v[:-2], shapes)
    return [tuple(flat[4 * k : 4 * k + 4]) for k in range(len(net.layers))], float(v[-2]), int(v[-1])


@dataclass(frozen=True)
class Epoch:
    iteration: int
    train_error: float
    dev_error: float | None = None
    dev_entropy: float | None = None
    dev_error_rate: float | None = None


def evaluate(net: Network, data: DataFrame, target: str = "label") -> tuple[float, float | None, float | None]:
    """(mean squared error, cross-entropy of softmax outputs, error rate in percent of labels) over data."""
    last = net.layers[-1]

    def partial(batch: dict) -> dict[int, np.ndarray]:
        x = matrix(batch["features"])
        wide = pa.types.is_list(batch[target].type)
        y = targets(matrix(batch[target]) if wide else batch[target].to_numpy(), last.n_out, last.kind)
        out = net.output(x)
        entropy = -(y * np.log(np.clip(out, PROB_FLOOR, 1 - PROB_FLOOR))).sum() if last.kind in ("softmax", "multinomial") else 0.0
        return {0: np.array([((out - y) ** 2).sum() / y.shape[1], entropy, (out.argmax(axis=1) == y.argmax(axis=1)).sum(), len(x)])}

    error, entropy, hits, n = fold(data.select("features", target), partial)[0]
    return error / n, entropy / n if last.kind in ("softmax", "multinomial") else None, 100 - 100 * hits / n


#: Slots of rows that make a batch.
SLOTS = 4


def slot_of(seed: int, batches: int) -> Column:
    """The slot of a row by the first 32 bits of a seeded hash of its id."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256), 1, 8), 16, 10)
    return F.pmod(bits.cast("bigint"), F.lit(SLOTS * batches)).cast("int")


def batches_of(seed: int, epoch: int, batches: int) -> list[list[int]]:
    """The slots of each batch of an epoch."""
    return np.random.default_rng([seed, epoch]).permutation(SLOTS * batches).reshape(batches, SLOTS).tolist()


def fit(net: Network, data: DataFrame, dev: DataFrame | None = None, target: str = "label", batches: int = 8, max_iter: int | None = None, tolerance: float = 1e-4) -> tuple[Network, list[Epoch]]:
    """Synchronous training on data (id, features, target): each step is one aggregation over a batch.

    Rows are dealt to SLOTS slots a batch by a hash of id and written once, a folder for each slot; an epoch shuffles the slots and takes SLOTS of them for a batch, so each step reads
    its own folders and an epoch reads the table once, in other batches than the last one. Keeps the best network by the dev error (by the training error without dev);
    stops after min_iter epochs when it improves by tolerance or less.
    """
    s, deltas, trace = net.settings, no_deltas(net), []
    best, best_error = net, math.inf
    held = dealt(data.select("features", target, slot_of(s.seed, batches).alias("slot")), "slot", "batches")
    for it in range(s.max_iter if max_iter is None else max_iter):
        loss = rows = 0.0
        for b, slots in enumerate(batches_of(s.seed, it, batches)):
            grads, one, n = gradient_job(net, held.filter(F.col("slot").isin(slots)), target, (s.seed, it, b))
            if n:
                net, deltas = update(net, grads, deltas, n, schedule(it), momentum_at(it, s.momentum))
            loss, rows = loss + one, rows + n
        now = Epoch(it, loss / max(1.0, rows), *(evaluate(net, dev, target) if dev is not None else ()))
        trace.append(now)
        error = now.train_error if now.dev_error is None else now.dev_error
        gain = best_error - error
        if error < best_error:
            best, best_error = net, error
        if it + 1 >= s.min_iter and gain <= tolerance:
            break
    return best, trace


def fit_rows(net: Network, x: np.ndarray, y: np.ndarray, dev: tuple[np.ndarray, np.ndarray] | None = None, max_iter: int | None = None, tolerance: float = 1e-4) -> tuple[Network, list[Epoch]]:
    """Sequential training on arrays: small batches in an order shuffled for each epoch."""
    s, deltas, trace, last = net.settings, no_deltas(net), [], net.layers[-1]
    y = targets(y, last.n_out, last.kind)
    best, best_error = net, math.inf
    for it in range(s.max_iter if max_iter is None else max_iter):
        rng = np.random.default_rng([s.seed, it])
        order, loss = rng.permutation(len(x)), 0.0
        for a in range(0, len(x), s.batch_size):
            rows = order[a : a + s.batch_size]
            grads, one = gradients(net, x[rows], y[rows], rng)
            net, deltas = update(net, grads, deltas, len(rows), schedule(it), momentum_at(it, s.momentum))
            loss += one
        dx, dy = (x, y) if dev is None else (dev[0], targets(dev[1], last.n_out, last.kind))
        out = net.output(dx)
        error = float(((out - dy) ** 2).sum() / dy.shape[1] / len(dx))
        trace.append(Epoch(it, loss / len(x), error, None, float(100 - 100 * (out.argmax(axis=1) == dy.argmax(axis=1)).mean())))
        gain = best_error - error
        if error < best_error:
            best, best_error = net, error
        if it + 1 >= s.min_iter and gain <= tolerance:
            break
    return best, trace


def predict(net: Network, data: DataFrame, name: str = "predicted", classes: bool = True) -> DataFrame:
    """data with the index of the largest output (the first at ties), or with all outputs."""
    columns = data.columns
    schema = StructType([*data.schema.fields, StructField(name, IntegerType() if classes else ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = net.output(matrix(batch.column("features"))) if batch.num_rows else np.zeros((0, 1))
            made = pa.array(out.argmax(axis=1), pa.int32()) if classes else pa.array(out.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], made], [*columns, name])

    return data.mapInArrow(run, schema)


# --- pretraining ------------------------------------------------------------------------------------------------------


def divergence(l: Layer, v: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One step of contrastive divergence over rows: sums of increments of the weights, the output and the input biases, and of squared reconstruction errors."""
    up = activate_rows(l.kind, l.net(v))
    sampled = (rng.random(up.shape) < up).astype(float) if rng is not None and l.kind == "binary" else up
    back = activate_rows(l.input_kind, l.net_back(sampled))
    again = activate_rows(l.kind, l.net(back))
    return up.T @ v - again.T @ back, (up - again).sum(axis=0), (v - back).sum(axis=0), float(((v - back) ** 2).sum() / v.shape[1])


def free_energy(l: Layer, v: np.ndarray) -> np.ndarray:
    """Of each row under a layer with binary hidden units: -a'v - sum(ln(1 + exp(net input)))."""
    return -(v @ l.input_bias) - np.logaddexp(0.0, l.net(v)).sum(axis=1)


def pretrain(net: Network, data: DataFrame, from_layer: int = 0, to_layer: int | None = None, epochs: int = 10) -> tuple[Network, list[tuple[int, int, float]]]:
    """Layer by layer, each on the outputs of those below: contrastive divergence with one aggregation for each epoch. The trace holds (layer, epoch, error)."""
    trace, s = [], net.settings
    for k in range(from_layer, len(net.layers) if to_layer is None else to_layer):
        below, l = Network(net.layers[:k], s), net.layers[k]
        steps = (np.zeros_like(l.weights), np.zeros(l.n_out), np.zeros(l.n_in))
        for it in range(epochs):
            l = net.layers[k]

            def partial(batch: dict, l: Layer = l, below: Network = below, it: int = it, k: int = k) -> dict[int, np.ndarray]:
                x = matrix(batch["features"])
                v = below.output(x) if below.layers else x
                dw, db, da, e = divergence(l, v, np.random.default_rng([s.seed, k, it, len(x)]))
                return {0: np.concatenate([dw.ravel(), db, da, [e, len(x)]])}

            sums = fold(data.select("features"), partial)[0]
            dw, db, da = _unflat(sums[:-2], (l.weights.shape, l.bias.shape, l.input_bias.shape))
            rate = unit_rates(l, s, schedule(it) / sums[-1])
            steps = tuple(momentum_at(it, s.momentum) * old + r * new for old, r, new in zip(steps, (rate[:, None], rate, rate.mean()), (dw, db, da)))
            l = replace(l, weights=cap_norms((1 - s.l2) * l.weights + steps[0], s.max_norm), bias=l.bias + steps[1], input_bias=l.input_bias + steps[2])
            net = replace(net, layers=(*net.layers[:k], l, *net.layers[k + 1 :]))
            trace.append((k, it, float(sums[-2] / sums[-1])))
    return net, trace


def mirrored(net: Network, layers: int | None = None) -> Network:
    """The autoencoder of the first layers: their transposed weights lead back to the input."""
    own = net.layers[: layers or len(net.layers)]
    back = [Layer(l.input_kind, l.weights.T, l.input_bias, l.bias, l.kind) for l in own[::-1]]
    return Network((*own, *back), net.settings, f"{net.name}-mirrored")


def reconstruct(net: Network, data: DataFrame, name: str = "reconstructed", layers: int | None = None) -> DataFrame:
    """data with what the first layers make of features and their mirror leads back to."""
    return predict(mirrored(net, layers), data, name, classes=False)


def finetune(net: Network, data: DataFrame, epochs: int = 10, layers: int | None = None) -> tuple[Network, list[float]]:
    """Trains the first layers as an autoencoder with tied weights: a layer and its mirror share the sum of their gradients. The trace holds the mean squared error of each epoch."""
    n, trace, deltas = layers or len(net.layers), [], None
    rows = data.select("features", F.col("features").alias("target"))
    for it in range(epochs):
        both = mirrored(net, n)
        grads, loss, count = gradient_job(both, rows, "target")
        tied = [(grads[k][0] + grads[2 * n - 1 - k][0].T, grads[k][1], grads[2 * n - 1 - k][1]) for k in range(n)]
        if deltas is None:
            deltas = [tuple(np.zeros_like(a) for a in g) for g in tied]
        s, m, fresh = net.settings, momentum_at(it, net.settings.momentum), []
        for k, (l, g) in enumerate(zip(net.layers, tied)):
            rate = unit_rates(l, s, schedule(it) / count)
            deltas[k] = tuple(m * d - r * x for d, r, x in zip(deltas[k], (rate[:, None], 2 * rate, 2 * rate.mean()), g))
            fresh.append(replace(l, weights=cap_norms((1 - s.l2) * l.weights + deltas[k][0], s.max_norm), bias=l.bias + deltas[k][1], input_bias=l.input_bias + deltas[k][2]))
        net = replace(net, layers=(*fresh, *net.layers[n:]))
        trace.append(loss / count)
    return net, trace


def optimal_rates(net: Network, x: np.ndarray, y: np.ndarray, alpha: float = 1e-3, gamma: float = 1e-3, iterations: int = 200) -> Network:
    """A learning rate for each unit from the largest curvature along its weights: a power iteration with differences of gradients along vectors; it stops when no unit's norm changes by a tenth. x and y: a sample of rows."""
    y = targets(y, net.layers[-1].n_out, net.layers[-1].kind)
    rng = np.random.default_rng(net.settings.seed)
    psi = [rng.standard_normal(l.weights.shape) for l in net.layers]
    norms = [np.ones(l.n_out) for l in net.layers]
    base = [g[0] / len(x) for g in gradients(net, x, y)[0]]
    for it in range(iterations):
        unit = [p / np.maximum(1e-300, n)[:, None] for p, n in zip(psi, norms)]
        moved = replace(net, layers=tuple(replace(l, weights=l.weights + alpha * u) for l, u in zip(net.layers, unit)))
        there = [g[0] / len(x) for g in gradients(moved, x, y)[0]]
        psi = [(1 - gamma) * p + gamma * (t - b) / alpha if it else (t - b) / alpha for p, t, b in zip(psi, there, base)]
        fresh = [np.linalg.norm(p, axis=1) for p in psi]
        calm = all((np.abs(a - b) < 0.1 * np.maximum(1e-300, b)).all() for a, b in zip(fresh, norms))
        norms = fresh
        if it and calm:
            break
    return replace(net, layers=tuple(replace(l, learning_rate=net.settings.learning_rate / np.maximum(1e-12, n)) for l, n in zip(net.layers, norms)))


# --- columns ----------------------------------------------------------------------------------------------------------


def error_rate(predicted: Column, label: Column) -> Column:
    """An aggregate: percent of rows whose prediction is not their label."""
    return 100 - 100 * F.avg((predicted == label).cast("double"))


def cross_entropy(target: Column, outputs: Column) -> Column:
    """An aggregate: the mean of -sum(t * ln(clipped p))."""
    clipped = F.transform(outputs, lambda p: F.log(F.greatest(F.lit(PROB_FLOOR), F.least(F.lit(1 - PROB_FLOOR), p))))
    return F.avg(-dot(target, clipped))
