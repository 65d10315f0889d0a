"""Operators against plain numpy versions and invariants."""

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.functions import activations, vectors
from tessel.operators import cluster, density, features, gaussian, hmm, linear, mixture, neighbours, neural, smoothing
from tessel.plans import stats

RNG = np.random.default_rng(0)


@pytest.fixture(scope="module")
def blobs(spark):
    x = np.concatenate([RNG.normal(m, 0.7, (60, 2)) for m in ((0, 0), (5, 5), (0, 6))])
    y = np.repeat([0, 1, 2], 60)
    df = spark.createDataFrame([(i, [float(a) for a in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, features array<double>, label int").repartition(3).cache()
    df.count()
    return df, x, y


def test_vector_columns(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0],), ([0.5, 0.5, 0.1],)], "x array<double>")
    c = F.col("x")
    for r, x in zip(df.select(vectors.norm(c), vectors.logsumexp(c), vectors.softmax(c), vectors.argmax(c), vectors.argmin(c), vectors.sqdist(c, vectors.literal([1, 1, 1]))).collect(), ([1, -2, 3], [0.5, 0.5, 0.1])):
        x = np.array(x, float)
        e = np.exp(x - x.max())
        assert np.allclose([r[0], r[1], r[5]], [np.linalg.norm(x), np.log(np.exp(x).sum()), ((x - 1) ** 2).sum()])
        assert np.allclose(r[2], e / e.sum()) and r[3] == x.argmax() and r[4] == x.argmin()


@pytest.mark.parametrize("kind", activations.TYPES)
def test_activations_agree_and_slopes_are_derivatives(spark, kind):
    x = np.array([[0.3, -1.2, 2.0], [50.0, -50.0, 0.1]])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    got = np.array([r[0] for r in df.select(activations.activate(kind, F.col("x"))).collect()])
    assert np.allclose(got, activations.activate_rows(kind, x))
    if kind in ("sigmoid", "tanh", "ReLU", "linear"):
        z, h = x[:1], 1e-6
        num = (activations.activate_rows(kind, z + h) - activations.activate_rows(kind, z - h)) / (2 * h)
        assert np.allclose(num, activations.slope_rows(kind, activations.activate_rows(kind, z), z), atol=1e-5)
    with pytest.raises(ValueError):
        activations.activate("none", F.col("x"))


def test_kmeans_family(blobs):
    df, x, _ = blobs
    first = cluster.farthest_first(df, 3)
    assert np.allclose(first[0], x.mean(axis=0))
    out = cluster.lloyd(df, first, epsilon=0.0)
    c, old = first, None
    for _ in range(50):
        own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        if old is not None and (own == old).all():
            break
        c, old = np.array([x[own == k].mean(0) for k in range(3)]), own
    assert np.allclose(out.centres, c) and abs(out.J - ((x - c[own]) ** 2).sum(1).mean()) < 1e-9
    for modality in cluster.MODALITIES:
        fitted = cluster.fit(df, 4, modality, init="maximin", max_iter=20)
        assert fitted.centres.shape == (4, 2) and np.isfinite(fitted.centres).all()
    med = cluster.medoid_centres(df, c)
    for k in range(3):
        own_rows = x[own == k]
        best = own_rows[((own_rows[:, None] - own_rows[None]) ** 2).sum(-1).sum(1).argmin()]
        assert np.allclose(med[k], best)
    far = np.vstack([c, [[1e6, 1e6]]])
    assert len(cluster.drop_empty(df, cluster.Clusters(far)).centres) == 3
    with pytest.raises(ValueError):
        cluster.fit(df, 3, "none")


def test_partitions_do_not_matter(blobs):
    df, _, _ = blobs
    a, b = (cluster.step(d, np.array([[0.0, 0.0], [4.0, 4.0]])) for d in (df, df.repartition(7)))
    assert (a.counts == b.counts).all() and np.allclose(a.means, b.means)


@pytest.mark.parametrize("covariance", mixture.COVARIANCES)
def test_mixture_statistics_and_growth(blobs, covariance):
    df, x, _ = blobs
    m = mixture.derive(mixture.Mixture(covariance, np.array([0.3, 0.7]), np.array([[0.0, 1.0], [4.0, 5.0]]), np.array([np.eye(2), [[2.0, 0.3], [0.3, 1.0]]])))
    z = np.array([[math.log(p) - 0.5 * ((r - u) @ np.linalg.inv(s) @ (r - u) + math.log(np.linalg.det(s)) + 2 * math.log(2 * math.pi)) for p, u, s in zip(m.priors, m.mu, m.sigma)] for r in x])
    assert np.allclose(m.log_densities(x), z)
    got = np.array([[*r["posteriors"], r["log_likelihood"], r["component"]] for r in mixture.score(m, df).orderBy("id").collect()])
    p, ll = m.posteriors(x)
    assert np.allclose(got[:, :2], p) and np.allclose(got[:, 2], ll) and (got[:, 3] == z.argmax(1)).all() and np.allclose(p.sum(1), 1)
    s = mixture.statistics(m, df)
    assert np.allclose(s.rx, p.T @ x) and s.n == len(x)
    models, trace = mixture.grow(df, 3, covariance, epsilon=1e-3, max_iterations=8)
    assert 1 in models and max(models) <= 3
    if covariance in ("diagonal", "full"):
        for c in {t.n_components for t in trace}:
            l = [t.log_likelihood for t in trace if t.n_components == c]
            assert all(b >= a - 1e-9 for a, b in zip(l, l[1:]))


def test_split_purge_duplicates():
    m = mixture.Mixture("full", np.array([0.5, 0.5]), np.array([[0.0, 0.0], [3.0, 0.0]]), np.array([np.diag([1.0, 4.0]), np.eye(2)]), counts=np.array([5.0, 0.0]))
    two = mixture.split_component(m, 0)
    assert np.allclose(two.mu[0], [0, -1]) and np.allclose(two.mu[2], [0, 1]) and np.allclose(two.priors, [0.25, 0.5, 0.25])
    assert mixture.purge(m).n_components == 1 and np.allclose(mixture.purge(m).priors, [1.0])
    assert mixture.drop_duplicates(mixture.from_centroids(np.array([[1.0, 1.0], [1.0, 1.0], [2.0, 1.0]]))).n_components == 2
    assert mixture.to_split(mixture.from_centroids(np.arange(8.0).reshape(4, 2)))


def test_classifiers(blobs):
    df, x, y = blobs
    for covariance in gaussian.COVARIANCES:
        out = gaussian.predict(gaussian.fit(df, covariance), df)
        assert out.filter("predicted = label").count() > 0.9 * len(x)
    g = gaussian.fit(df)
    assert np.allclose(g.sigma[1], np.cov(x[y == 1].T)) and np.allclose(g.mu[2], x[y == 2].mean(0))
    w = linear.fit(df, l2=0.5).weights
    assert np.allclose(w, np.linalg.solve(x.T @ x - 0.5 * np.eye(2), x.T @ np.eye(3)[y]))
    c = mixture.fit_classifier(df, 2, max_iter=10)
    assert c.predict(df).filter("predicted = label").count() > 0.95 * len(x)
    assert np.allclose(c.posteriors(x).sum(1), 1)


def test_density(blobs):
    df, x, y = blobs
    q = df.select(F.col("id").alias("qid"), "features")
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    h = 0.8
    want = -0.5 * math.log(math.pi * h * h) + np.log(np.exp(-d2 / (2 * h * h)).sum(1)) - math.log(len(x))
    got = {r.qid: r.log_density for r in density.log_density(q, df, h).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)
    pred = {r.qid: r.predicted for r in density.classify(q, df, 1.0).collect()}
    assert np.mean([pred[i] == y[i] for i in range(len(x))]) > 0.95


def test_neighbours(blobs):
    df, x, y = blobs
    q = df.select(F.col("id").alias("qid"), "features")
    got = {(r.qid, r.rank): r.id for r in neighbours.nearest(q, df, 4).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(len(x)):
        assert [got[i, k] for k in range(1, 5)] == sorted(range(len(x)), key=lambda j: (d2[i, j], j))[:4]
    assert neighbours.classify(q, df, 3).join(df, F.col("qid") == F.col("id")).filter("predicted = label").count() > 0.95 * len(x)
    tree = {r.node: r for r in neighbours.ball_tree(df, 20).collect()}
    assert tree[1].n == len(x) and all(tree[2 * n].n == t.n // 2 and tree[2 * n + 1].n == t.n - t.n // 2 for n, t in tree.items() if not t.leaf)
    assert all(t.n < 20 for t in tree.values() if t.leaf)


@pytest.mark.parametrize("kind", ["near", "copies", "far", "tiny", "large", "odd"])
def test_best_rows_are_exact(kind):
    """What single precision excludes is never among the best: near ties, copies, outliers, offsets, sizes out of its range, nan and infinity."""
    rng = np.random.default_rng(15)
    x, rows = rng.normal(size=(150, 5)), rng.normal(size=(900, 5))
    if kind == "near":
        rows = x[rng.integers(0, 150, 900)] + rng.normal(size=(900, 5)) * 1e-9 + 1e6
        x = x + 1e6
    if kind == "copies":
        rows = np.r_[rows[:300], np.repeat(x[:2], 300, axis=0)]
    if kind == "far":
        rows[::50] *= 1e25
        x[::40] *= 1e22
    if kind in ("tiny", "large"):
        x, rows = (a * {"tiny": 1e-150, "large": 1e150}[kind] for a in (x, rows))
    if kind == "odd":
        rows[::30, 1], rows[7, 2], x[3, 0], x[5, 1], x[6, 4] = np.nan, np.inf, np.nan, np.inf, -np.inf
    ids = rng.permutation(900) - 400
    best = neighbours._Best(x, 4)
    for a in range(0, 900, 130):
        best.offer(rows[a : a + 130], ids[a : a + 130])
    with np.errstate(all="ignore"):
        d = stats.sqdist_rows(x, rows)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :4]
    q, i, d2 = best.found()
    assert np.array_equal(q, np.repeat(np.arange(150), 4)) and np.array_equal(i, ids[order].ravel()) and np.array_equal(d2, np.take_along_axis(d, order, 1).ravel(), equal_nan=True)


def test_few_pairs_are_measured(monkeypatch):
    """Of 400 x 4,000 pairs, half of them with copies of one row, only a small part is measured beyond the products."""
    rng = np.random.default_rng(16)
    x, rows = rng.normal(size=(400, 32)), rng.normal(size=(4000, 32))
    x[::2] = rows[::2] = x[0]
    measured, take = [], neighbours._Best._take
    monkeypatch.setattr(neighbours._Best, "_take", lambda self, q, *rest: measured.append(len(q)) or take(self, q, *rest))
    best = neighbours._Best(x, 5)
    for a in range(0, 4000, 1000):
        best.offer(rows[a : a + 1000], np.arange(a, a + 1000))
    assert sum(measured) < 0.05 * 400 * 4000 and best.i[0].tolist() == [0, 2, 4, 6, 8]


def test_a_grid_of_queries_and_rows(spark, blobs, monkeypatch):
    """Many columns and lines give what one cell gives, from one scan of the rows and no collected query."""
    from tessel.plans import stats

    df, x, _ = blobs
    q = df.select(F.col("id").alias("qid"), "features")
    whole = sorted(tuple(r) for r in neighbours.nearest(q, df, 3).collect())
    dense = {r.qid: r.log_density for r in density.log_density(q, df, 1.0).collect()}
    monkeypatch.setattr(stats, "QUERY_BLOCK", 40)
    monkeypatch.setattr(stats, "MOST_TASKS", 5)
    plan = neighbours.nearest(q, df, 3)
    assert sorted(tuple(r) for r in plan.collect()) == whole
    got = {r.qid: r.log_density for r in density.log_density(q, df, 1.0).collect()}
    assert got.keys() == dense.keys() and all(abs(got[k] - dense[k]) < 1e-9 for k in got)
    assert neighbours.nearest(q.limit(0), df, 3).count() == 0 and neighbours.nearest(q, df.limit(0), 3).count() == 0


def test_a_tree_above_subtrees(spark, monkeypatch):
    """Upper levels from a sample: nodes hold all rows of their leaves, with exact centres and radii; equal rows are dealt to both sides."""
    rng = np.random.default_rng(12)
    x = np.r_[rng.normal(size=(700, 3)), np.repeat([[1.0, 2.0, 3.0]], 500, axis=0)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)
    monkeypatch.setattr(neighbours, "SUBTREE", 200)
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    tree = neighbours.grow(df, 25)
    leaf = {r.id: r.leaf for r in tree.rows.collect()}
    nodes = {r.node: r for r in tree.nodes.collect()}
    assert sorted(leaf) == list(range(len(x))) and set(leaf.values()) == {n for n, t in nodes.items() if t.leaf}
    for n, t in nodes.items():
        own = [i for i, at in leaf.items() if at >> (at.bit_length() - n.bit_length()) == n and at.bit_length() >= n.bit_length()]
        assert t.n == len(own) and np.allclose(t.center, x[own].mean(axis=0)) and np.isclose(t.radius2, ((x[own] - np.array(t.center)) ** 2).sum(axis=1).max())
        assert t.leaf == (len(own) < 25) and t.depth == n.bit_length() - 1 and t.parent == (n >> 1 or None)
    assert max(t.n for t in nodes.values() if t.depth == 3) < 300


def test_a_tree_above_subtrees_is_that_of_one_task(spark, monkeypatch):
    """Levels above the subtrees split all rows where one task splits them: equal rows, negative ids and rows of one place included, whether few or many rows settle a half."""
    rng = np.random.default_rng(14)
    x = np.r_[rng.normal(size=(400, 2)), np.repeat([[1.0, 2.0], [-3.0, 0.5]], [300, 60], axis=0), np.c_[np.arange(240.0) % 4, np.zeros(240)]]
    df = spark.createDataFrame([(3 * i - 700, [float(v) for v in r]) for i, r in enumerate(rng.permutation(x))], "id long, features array<double>").repartition(3)

    def grown(least):
        tree = neighbours.grow(df, least)
        nodes = sorted((r.node, r.depth, r.n, r.leaf, [round(c, 9) for c in r.center], round(r.radius2, 9)) for r in tree.nodes.collect())
        return nodes, sorted((r.id, r.leaf) for r in tree.rows.collect())

    want, large = grown(20), grown(400)
    for subtree, sample in ((130, 65_536), (130, 100), (130, 0)):
        monkeypatch.setattr(neighbours, "SUBTREE", subtree)
        monkeypatch.setattr(neighbours, "SAMPLE", sample)
        assert grown(20) == want
    assert grown(400) == large  # leaves of more rows than a subtree has


def test_search_by_leaves(spark, monkeypatch):
    """On clustered rows what nearest() finds, ties included, from less than a third of the pairs."""
    rng = np.random.default_rng(13)
    x = np.r_[np.repeat(rng.normal(size=(12, 4)) * 20, 60, axis=0) + rng.normal(size=(720, 4)), np.repeat([[1.0, 2.0, 3.0, 4.0]], 80, axis=0)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)
    q = df.filter("id % 3 = 0").select(F.col("id").alias("qid"), "features").union(spark.createDataFrame([(-1, [500.0, 0.0, 0.0, 0.0])], "qid long, features array<double>"))
    want = sorted(tuple(r) for r in neighbours.nearest(q, df, 7).collect())
    for leaf_queries in (4096, 10):
        monkeypatch.setattr(neighbours, "LEAF_QUERIES", leaf_queries)
        out = neighbours.search(q, neighbours.grow(df), 7)
        assert sorted(tuple(r) for r in out.found.collect()) == want
        assert out.of == len(x) * q.count() and out.pairs < out.of / 3
    # more neighbours than a leaf holds, and than there are rows
    few = df.filter("id < 9")
    got = neighbours.search(q, neighbours.grow(few, 3), 20).found
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in neighbours.nearest(q, few, 20).collect())


def test_search_writes_no_pairs(spark, monkeypatch):
    """Where no ball is out of reach, what search() writes grows with the rows, not with queries times leaves; a vector with nan hides no others. Several columns of queries give what one gives."""
    x = np.random.default_rng(17).normal(size=(500, 16))
    x[40, 3] = np.nan
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)
    q = df.select(F.col("id").alias("qid"), "features")
    want = sorted(map(str, neighbours.nearest(q, df, 6).collect()))
    sizes, kept = [], neighbours.written

    def written(rows, name):
        out = kept(rows, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "written", written)
    for block in (131_072, 120):
        monkeypatch.setattr(stats, "QUERY_BLOCK", block)
        out = neighbours.search(q, neighbours.grow(df, 12), 6)
        assert sorted(map(str, out.found.collect())) == want
        assert out.pairs > 0.8 * out.of and max(sizes) < 2 * len(x)


def test_encoders(spark):
    df = spark.createDataFrame([(1, 0.5, "b", 3), (2, 99.0, "a", None), (3, float("nan"), None, 7), (4, -1e9, "zz", 1)], "id long, x double, s string, n int")
    rbf = [r[0] for r in df.filter("id <> 3").orderBy("id").select(features.rbf_range(F.col("x"), (0.0, 1.0), 4)).collect()]
    assert np.allclose([sum(r) for r in rbf], 1)
    hot = [r[0] for r in df.orderBy("id").select(features.category_bits(F.col("s"), ["a", "b"])).collect()]
    assert hot == [[0, 1], [1, 0], [0, 0], [0, 0]]
    fuzzy = [r[0] for r in df.filter("n is not null").orderBy("id").select(features.percentile_bits(F.col("n"), [1.0, 2.0, 4.0, 4.0])).collect()]
    assert np.allclose(fuzzy, [[0, 0.5, 0.5], [0, 0, 1], [1, 0, 0]])
    metas = features.refine(df, [features.Meta("x", features.STANDARD), features.Meta("s", features.CATEGORICAL, values=("a", "b")), features.Meta("n", features.PERCENTILES_ACCUM, num_intervals=5)])
    assert all(len(r.features) == 1 + 2 + len(metas[2].values) for r in features.encode(df, metas).collect())
    with pytest.raises(ValueError):
        features.refine(df, [features.Meta("x", "none")])


def test_smoothing(spark):
    y = RNG.normal(size=40)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "signal_id long, idx int, y double")
    got = [r.y for r in smoothing.smooth(df, 15, 10.0, 0.4).orderBy("t").collect()]
    a, b = np.linspace(0, 10, 40), np.linspace(0, 10, 15)
    w = np.exp(-0.5 * ((a[None] - b[:, None]) / 0.4) ** 2)
    assert np.allclose(got, (w @ y) / w.sum(1))


def paths(t, s):
    return np.array(np.meshgrid(*[range(s)] * t, indexing="ij")).reshape(t, -1).T


def _long_sequences(spark):
    rng = np.random.default_rng(21)
    sizes = {1: 1, 2: 2, 3: 7, 4: 150, 5: 1000, 6: 64}
    data = {k: (rng.integers(0, 3, n), rng.normal(size=(n, 2))) for k, n in sizes.items()}
    rows = [(k, 3 * t + 5, int(o[t]), [float(v) for v in x[t]]) for k, (o, x) in data.items() for t in range(len(o))]
    return data, spark.createDataFrame(rows, "seq_id long, t long, symbol int, features array<double>").repartition(5)


def test_chunks_of_long_sequences(spark, monkeypatch):
    """Cut in many chunks, sequences have the likelihoods, posteriors, paths and statistics that the recursions over each whole one give."""
    data, df = _long_sequences(spark)
    moves = np.array([[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.1, 0.1, 0.8]])
    models = [hmm.Hmm(np.array([0.5, 0.3, 0.2]), moves, np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]])), hmm.continuous(np.array([[0.0, 1.0], [1.0, -1.0]])), hmm.discrete(5, 3, left_to_right=True, seed=2)]
    for h in models:
        m, whole = h.emitting, {}
        for size in (10**6, 60):
            monkeypatch.setattr(hmm, "CHUNK", size)
            monkeypatch.setattr(hmm, "CHUNK_STATES", 0)
            assert hmm.chunked(m, df)[1] == (size == 60)
            z = {r.seq_id: r.log_likelihood for r in hmm.log_likelihoods(h, df).collect()}
            gamma, path = {k: {} for k in data}, {k: {} for k in data}
            for r in hmm.posteriors(h, df).collect():
                gamma[r.seq_id][r.t] = r.gamma
            for r in hmm.best_states(h, df).collect():
                path[r.seq_id][r.t] = r.state, r.score
            for k, (o, x) in data.items():
                b = m.log_emissions(o if h.emissions is not None else x)
                alpha, total = hmm.forward(m, b)
                score, states = hmm.best_path(m, b)
                assert np.isclose(z[k], total) and np.allclose([gamma[k][t] for t in range(len(b))], np.exp(alpha + hmm.backward(m, b) - total))
                assert [path[k][t][0] for t in range(len(b))] == states.tolist() and all(np.isclose(v[1], score) for v in path[k].values())
            for pooling in ("standard", "per_sequence"):
                fresh, total = hmm.train_step(h, df, pooling)
                got = np.concatenate([fresh.initial, fresh.transitions.ravel(), fresh.emissions.ravel() if h.emissions is not None else np.concatenate([np.r_[x.mu.ravel(), x.sigma.ravel()] for x in fresh.mixtures]), [total]])
                assert np.allclose(got, whole.setdefault(pooling, got), rtol=1e-8, atol=1e-10)


def test_paths_that_must_end_in_given_states(spark):
    """The mask of final states in likelihoods, posteriors and training, against all paths."""
    data, df = _long_sequences(spark)
    m = hmm.Hmm(np.array([0.5, 0.5]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[0.7, 0.2, 0.1], [0.2, 0.2, 0.6]]))
    short, o = df.filter("seq_id = 3"), data[3][0]
    paths = np.array(np.meshgrid(*[[0, 1]] * len(o))).reshape(len(o), -1).T
    paths = paths[paths[:, -1] == 1]
    p = np.array([m.initial[s[0]] * m.emissions[s[0], o[0]] * np.prod([m.transitions[s[t - 1], s[t]] * m.emissions[s[t], o[t]] for t in range(1, len(o))]) for s in paths])
    assert np.isclose(hmm.log_likelihoods(m, short, ends=[1]).first().log_likelihood, math.log(p.sum()))
    gamma = np.array([r.gamma for r in hmm.posteriors(m, short, ends=[1]).orderBy("t").collect()])
    assert np.allclose(gamma[:, 1], [p[paths[:, t] == 1].sum() / p.sum() for t in range(len(o))])
    fresh, total = hmm.train_step(m, short, "standard", ends=[1])
    assert np.isclose(total, math.log(p.sum())) and np.allclose(fresh.initial, [p[paths[:, 0] == 0].sum() / p.sum(), p[paths[:, 0] == 1].sum() / p.sum()])


def test_hmm_against_all_paths(spark):
    m = hmm.Hmm(np.array([0.5, 0.3, 0.2]), np.array([[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.1, 0.1, 0.8]]), np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]]))
    o = np.array([0, 1, 1, 2, 0])
    p = paths(5, 3)
    joint = m.initial[p[:, 0]] * m.emissions[p[:, 0], o[0]]
    for t in range(1, 5):
        joint = joint * m.transitions[p[:, t - 1], p[:, t]] * m.emissions[p[:, t], o[t]]
    df = spark.createDataFrame([(9, t, int(s)) for t, s in enumerate(o)], "seq_id long, t int, symbol int")
    assert abs(hmm.log_likelihoods(m, df).first().log_likelihood - math.log(joint.sum())) < 1e-9
    best = hmm.viterbi(m, df).first()
    assert best.path == p[joint.argmax()].tolist() and abs(best.score - math.log(joint.max())) < 1e-9
    gamma = np.array([r.gamma for r in hmm.posteriors(m, df).orderBy("t").collect()])
    assert np.allclose(gamma, [[joint[p[:, t] == s].sum() / joint.sum() for s in range(3)] for t in range(5)])
    alpha, z = hmm.forward(m, m.log_emissions(o))
    assert np.allclose(np.log(np.exp(alpha + hmm.backward(m, m.log_emissions(o))).sum(1)), z)


def test_hmm_training(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, int(rng.integers(0, 4)), [float(rng.normal(3 * (t % 2)))]) for s in range(12) for t in range(15)]
    df = spark.createDataFrame(rows, "seq_id long, t int, symbol int, features array<double>")
    for start in (hmm.discrete(3, 4, seed=1), hmm.continuous(np.array([[0.5], [2.0]]))):
        m, trace = hmm.train(start, df, 5, "standard")
        assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:])) and np.allclose(m.transitions.sum(1), 1)
    m, _ = hmm.train(hmm.discrete(3, 4, seed=1), df, 2)
    assert np.allclose(m.emissions.sum(1), 1)
    lr = hmm.discrete(5, 4, left_to_right=True, seed=2)
    m, trace = hmm.train(lr, df, 2, "standard")
    assert np.isfinite(trace).all() and np.allclose(m.transitions[1:-1].sum(1), 1)
    with pytest.raises(ValueError):
        hmm.Hmm(np.ones(1), np.ones((1, 1)))


def test_network_gradients_and_training(spark, blobs):
    df, x, y = blobs
    net = neural.network((2, 5, 3), ("tanh", "softmax"), neural.Settings(learning_rate=0.3, min_iter=2, seed=3))
    grads, _ = neural.gradients(net, x, np.eye(3)[y])
    w, h = net.layers[0].weights, 1e-6
    from dataclasses import replace

    def loss(v):
        other = replace(net, layers=(replace(net.layers[0], weights=v), net.layers[1]))
        return -(np.eye(3)[y] * np.log(other.output(x))).sum()

    bump = np.zeros_like(w)
    bump[1, 0] = h
    assert abs((loss(w + bump) - loss(w - bump)) / (2 * h) - grads[0][0][1, 0]) < 1e-4
    job, _, n = neural.gradient_job(net, df)
    assert n == len(x) and np.allclose(job[0][0], grads[0][0])
    fitted, trace = neural.fit(net, df, batches=2, max_iter=12)
    assert trace[-1].train_error < trace[0].train_error
    local, _ = neural.fit_rows(net, x, y, max_iter=30)
    assert (local.output(x).argmax(1) == y).mean() > 0.9
    assert neural.predict(local, df).filter("predicted = label").count() > 0.9 * len(x)
    _, errors = neural.pretrain(neural.network((2, 4), ("sigmoid",)), df, epochs=2)
    _, mse = neural.finetune(neural.network((2, 2), ("linear",), neural.Settings(learning_rate=0.01)), df, epochs=4)
    assert mse[-1] < mse[0] and len(errors) == 2
    rated = neural.optimal_rates(net, x, y)
    assert all(l.learning_rate.shape == (l.n_out,) and (l.learning_rate > 0).all() for l in rated.layers)
    grads = [(np.ones_like(l.weights), np.ones(l.n_out), np.zeros(l.n_out), np.zeros(l.n_out)) for l in rated.layers]
    stepped, _ = neural.update(rated, grads, neural.no_deltas(rated), 1, 1.0, 0.0)
    for before, after in zip(rated.layers, stepped.layers):
        np.testing.assert_allclose(before.weights - after.weights, np.repeat(before.learning_rate[:, None], before.n_in, axis=1))
    l = neural.Layer("binary", np.array([[1.0, -2.0]]), np.array([0.5]), np.array([0.1, 0.2]))
    np.testing.assert_allclose(neural.free_energy(l, np.array([[1.0, 1.0]])), [-0.3 - np.log1p(np.exp(-0.5))])


def test_explore_lists_every_value(spark):
    from tessel.operators import features

    data = spark.range(100_001).selectExpr("concat('v', lpad(id, 6, '0')) AS c")
    (meta,) = features.explore(data)
    assert len(meta.values) == meta.num_intervals == 100_001 and meta.values[-1] == "v100000"


@pytest.mark.parametrize("stop", [1, 4, 6, 9])
def test_growth_resumes_from_its_log(spark, blobs, tmp_path, stop):
    """A driver that is lost after any row of the log loses at most the iteration under way: the run that goes on ends as one that was never stopped."""
    from tessel.plans.training_log import TrainingLog

    df, *_ = blobs
    more = {"epsilon": 1e-3, "max_iterations": 3}
    whole, trace = mixture.grow(df, 4, **more)

    class Lost(Exception):
        pass

    class Stopped(TrainingLog):
        def append(self, *row):
            super().append(*row)
            if self.step == stop:
                raise Lost

    path = str(tmp_path / "log")
    with pytest.raises(Lost):
        mixture.grow(df, 4, **more, log=Stopped(spark, path, "a"))
    models, again = mixture.grow(df, 4, **more, log=TrainingLog(spark, path, "a"))
    assert [(t.n_components, t.iteration) for t in again] == [(t.n_components, t.iteration) for t in trace] and np.allclose([t.log_likelihood for t in again], [t.log_likelihood for t in trace])
    assert models.keys() == whole.keys() and all(np.allclose(models[k].mu, whole[k].mu) and np.allclose(models[k].priors, whole[k].priors) for k in whole)
    log = TrainingLog(spark, path, "a")
    assert log.rows().count() == len(trace) + len(whole) == log.step and TrainingLog(spark, path, "other").step == 0
    finished, same = mixture.grow(df, 4, **more, log=log)
    assert finished.keys() == whole.keys() and len(same) == len(trace) and log.step == len(trace) + len(whole)
    shown = log.table().filter("event = 'iteration'").selectExpr("figures['aic'] AS aic").count()
    assert shown == len(trace)


def test_many_distinct_values_are_placed_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(float(i * i % 501), f"c{i % 37}") for i in range(2000)], "x double, c string").repartition(5)
    both = []
    for plain in (features.PLAIN, 10):
        monkeypatch.setattr(features, "PLAIN", plain)
        grid = sorted(tuple(r) for r in features.quantile_grid(df, "x", 12).collect())
        both.append((grid, sorted(r.value for r in features.mass_cut(features.category_masses(df, "c"), 0.6).collect())))
    assert both[0] == both[1] and len(both[0][0]) > 8


def test_units_stay_where_none_is_to_be_dropped():
    rng = np.random.default_rng(51)
    x, y = rng.normal(size=(40, 3)), np.eye(2)[rng.integers(0, 2, 40)]
    net = neural.network((3, 8, 2), ("tanh", "softmax"), keep=(0.5, 1.0))
    kept, dropped, plain = (neural.gradients(net, x, y, *a) for a in ((np.random.default_rng(1), False), (np.random.default_rng(1),), ()))
    assert np.allclose(kept[0][0][0], plain[0][0][0]) and not np.allclose(dropped[0][0][0], plain[0][0][0])


def test_batches_are_read_once_and_trained_on(spark):
    """Training over a table is the same steps over the same batches in numpy; an epoch's batches are all rows once, dealt anew each time."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, features array<double>, label int").repartition(5)
    net = neural.network((4, 6, 2), ("tanh", "softmax"), neural.Settings(learning_rate=0.3, min_iter=4, seed=3))
    fitted, trace = neural.fit(net, df, batches=3, max_iter=4)
    slots = {r.id: r.slot for r in df.select("id", neural.slot_of(3, 3).alias("slot")).collect()}
    now, deltas, best, least, epochs = net, neural.no_deltas(net), None, np.inf, []
    for it in range(4):
        loss = 0.0
        epochs.append([sorted(i for i in slots if slots[i] in own) for own in neural.batches_of(3, it, 3)])
        for rows in epochs[-1]:
            grads, one = neural.gradients(now, x[rows], neural.targets(y[rows], 2, "softmax"))
            now, deltas = neural.update(now, grads, deltas, len(rows), neural.schedule(it), neural.momentum_at(it, net.settings.momentum))
            loss += one
        assert sorted(i for rows in epochs[-1] for i in rows) == list(range(300)) and np.isclose(trace[it].train_error, loss / 300)
        best, least = (now, loss) if loss < least else (best, least)
    assert epochs[0] != epochs[1] and np.allclose(fitted.layers[0].weights, best.layers[0].weights) and np.allclose(fitted.layers[1].bias, best.layers[1].bias)
    plan = df.select("features", "label", neural.slot_of(3, 3).alias("slot"))
    from tessel.plans.tables import dealt

    held = dealt(plan, "slot", "batches")
    reads = [held.filter(F.col("slot").isin(own)) for own in neural.batches_of(3, 0, 3)]
    files = lambda rows: rows.select("_metadata.file_path").distinct().count()
    assert sum(map(files, reads)) == files(held) == len(held.inputFiles()) and all("PartitionFilters: [slot" in r._jdf.queryExecution().toString() for r in reads)


def test_chains_that_share_states_train_them_together(spark):
    """A state in two chains gets one emission from the sums of both; equal to the sums of a plain forward-backward."""
    rng = np.random.default_rng(41)
    b = rng.random((3, 3)) + 0.2
    b /= b.sum(axis=1, keepdims=True)
    one = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), b[[0, 1]], name="one", state_names=("shared", "own-1"))
    two = hmm.Hmm(np.array([0.5, 0.5]), np.array([[0.5, 0.5], [0.2, 0.8]]), b[[2, 0]], name="two", state_names=("own-2", "shared"))
    r = hmm.registry(one, two)
    data = {(c, k): rng.integers(0, 3, n) for k, (c, n) in enumerate([("one", 9), ("one", 30), ("two", 14), ("two", 5)])}
    df = spark.createDataFrame([(c, k, t, int(v)) for (c, k), o in data.items() for t, v in enumerate(o)], "chain string, seq_id long, t long, symbol int").repartition(3)
    fresh, scores = hmm.train_shared(r, df)
    seen, moves, total = {s: np.zeros(3) for s in r.states}, {"one": np.zeros((2, 2)), "two": np.zeros((2, 2))}, {"one": 0.0, "two": 0.0}
    for (c, _), o in data.items():
        m = {"one": one, "two": two}[c]
        log_b = m.log_emissions(o)
        alpha, z = hmm.forward(m, log_b)
        beta = hmm.backward(m, log_b)
        gamma = np.exp(alpha + beta - z)
        total[c] += z
        for j, s in enumerate(m.state_names):
            np.add.at(seen[s], o, gamma[:, j])
        for t in range(len(o) - 1):
            moves[c] += np.exp(alpha[t][:, None] + np.log(m.transitions) + log_b[t + 1] + beta[t + 1] - z)
    assert all(np.isclose(scores[c], total[c]) for c in total)
    for s in r.states:
        assert np.allclose(fresh.states[s].emissions, hmm.normalise_emissions(seen[s][None])[0])
    for c in moves:
        assert np.allclose(fresh.transitions[c], hmm.normalise_transitions(moves[c]))
    assert np.array_equal(fresh.model("one").emissions[0], fresh.model("two").emissions[1])
    idle, _ = hmm.train_shared(r, df.filter("chain = 'one'"))
    assert np.array_equal(idle.states["own-2"].emissions, r.states["own-2"].emissions) and np.array_equal(idle.transitions["two"], two.transitions)
    assert r.ordered() == ["own-1", "own-2", "shared"] and [r.indexed().states[s].index for s in r.ordered()] == [0, 1, 2]
    for broken in ({"states": {}}, {"transitions": {}}, {"chains": {"x": hmm.Chain((), "one")}}):
        with pytest.raises(ValueError):
            replace(r, **broken)
    with pytest.raises(ValueError):
        hmm.registry(one, replace(two, name="three", emissions=b[[1, 1]]))


def test_a_dictionary_encodes_as_a_list_does(spark, monkeypatch):
    """Sparse entries through a joined dictionary are the places of the dense encoding; hot, missing, excluded and unknown values included."""
    from tessel.operators import features

    rows = [(i, "hot" if i % 3 else f"v{i % 50:02d}", float(i), "a" if i % 2 else None) for i in range(600)] + [(600, None, 1.0, "b"), (601, "skip", 2.0, "a"), (601, "skip", 2.0, "a")]
    df = spark.createDataFrame(rows, "id long, c string, x double, d string").repartition(4)
    monkeypatch.setattr(features, "PARTS", 4)
    listed, x, d = (features.explore(df)[k] for k in (1, 2, 3))
    (many,) = features.explore(df, ["c"], inline=5)
    assert isinstance(many.values, features.Dictionary) and list(many.values) == list(listed.values) and many.num_intervals == len(many.values)
    (scaled,) = features.refine(df, [replace(x, type=features.STANDARD)])
    for excluded in ((), ("skip",)):
        metas = [scaled, replace(listed, excluded=excluded), d]
        dense = {}
        for r in features.encode(df, metas).collect():
            dense.setdefault(r.id, []).append(r.features)
        out, n = features.encode_sparse(df, [scaled, replace(many, excluded=excluded), d])
        assert out.columns == [*df.columns, "features"]
        got = {}
        for r in out.collect():
            w = [0.0] * n
            for e in r.features:
                w[e["i"]] = e["w"]
            got.setdefault(r.id, []).append(w)
        assert got == dense
    with pytest.raises(ValueError):
        features.encode(df, [many])
    with pytest.raises(IndexError):
        many.values[10**6]


@pytest.mark.parametrize("rows", [[[1.0, 2.0, 3.0, 4.0], None], [[1.0], [2.0, 3.0, 4.0]], [None, None], [[], [1.0]]])
def test_matrix_refuses_null_and_uneven_vectors(rows):
    with pytest.raises(ValueError):
        stats.matrix(pa.array(rows, pa.list_(pa.float64())))


def test_matrix_of_slices_and_chunks():
    whole = pa.array([[1.0, 2.0], [3.0, None], [5.0, 6.0]], pa.list_(pa.float64()))
    assert stats.matrix(whole.slice(1)).tolist()[1] == [5.0, 6.0] and np.isnan(stats.matrix(whole)[1, 1])
    assert stats.matrix(pa.chunked_array([whole, whole.slice(2)])).shape == (4, 2) and stats.matrix(whole.slice(3)).shape == (0, 0)


def test_running_sum_equals_a_plain_one(spark):
    from tessel.plans.tables import running_sum

    values = [(int(i), int(x), None if i % 17 == 0 else 1) for i, x in enumerate(np.random.default_rng(3).integers(0, 50, 500))]
    df = spark.createDataFrame(values, "id long, x long, n long").repartition(7)
    found = {r.id: r.upto for r in running_sum(df, ["x", "id"], "n", "upto").collect()}
    total = 0
    for i, _, n in sorted(values, key=lambda v: (v[1], v[0])):
        total += n or 0
        assert (found[i] or 0) == total
    assert running_sum(df.filter("id < 0"), ["x", "id"], "n", "upto").count() == 0


def test_silhouette_equals_the_pairwise_one(spark):
    from tessel.operators import cluster

    x = np.random.default_rng(5).normal(size=(60, 2))
    own = np.r_[np.arange(59) % 3, 3]
    df = spark.createDataFrame([(a.tolist(), int(c)) for a, c in zip(x, own)], "features array<double>, cluster int")
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    plain = []
    for i, c in enumerate(own):
        a = d2[i, own == c].sum() / max(1, (own == c).sum() - 1)
        b = min(d2[i, own == k].mean() for k in range(4) if k != c)
        plain.append((b - a) / max(a, b) if (own == c).sum() > 1 else 0.0)
    assert cluster.silhouette(df) == pytest.approx(np.mean(plain))
    assert np.isnan(cluster.silhouette(df.filter("cluster = 0")))


def test_hmm_starts_and_ends(spark):
    from tessel.operators import hmm

    df = spark.createDataFrame([(k % 4, k, [float(k % 2) * 10 + k / 100]) for k in range(40)], "seq_id int, t int, features array<double>")
    means = sorted(float(m.mu[0, 0]) for m in hmm.from_kmeans(df, 2).mixtures)
    np.testing.assert_allclose(means, [0.19, 10.2], atol=1e-6)
    seen = {r.features[0] for r in df.collect()}
    picked = hmm.from_samples(df, 3, 2, seed=1)
    assert len(picked.mixtures) == 3 and all(float(v) in seen for m in picked.mixtures for v in m.mu.ravel())
    with pytest.raises(ValueError):
        hmm.start("semi-continuous", 2, 3)
    h = hmm.start("discrete", 3, 2, seed=2)
    b = h.log_emissions(np.array([0, 1, 1]))
    only = hmm.backward(h, b, terminal=[2])
    assert only[-1].tolist() == [hmm.LOG_ZERO, hmm.LOG_ZERO, 0.0]
    np.testing.assert_allclose(np.exp(only[-2]), h.transitions[:, 2] * h.emissions[2, 1])
