"""Queries over clusters, mixtures, neighbours, sequences and networks, and their SQL; iterations are unrolled or recursive there."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import vectors as v
from tessel.operators import cluster, hmm, mixture, neighbours, neural
from tessel.plans.feature_queries import entries, r
from tessel.plans.tables import dropped_at_exit, shared_dir, table
from tessel.plans.training_log import TrainingLog
from tessel.sources import synthetic, text

# --- clusters over customers, in the plane of balance and nation ------------------------------------------------------

CENTRES = ((-0.5, 5.0), (2.0, 20.0), (5.0, 5.0), (8.0, 18.0))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), v.vector(F.col("c_acctbal") / 1000, "c_nationkey").alias("features"))


def _centres(spark: SparkSession, c: np.ndarray) -> DataFrame:
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, x double, y double").select("cluster", r("x").alias("x"), r("y").alias("y"))


def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.assign(_points(spark, sf), np.array(CENTRES)).select("id", "cluster", r("d2").alias("d2"))


def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    """One assignment and update, all in the plan: the new centres, counts and summed squared distances."""
    assigned = cluster.assign(_points(spark, sf), np.array(CENTRES))
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.get("features", 0))).alias("x"), r(F.avg(F.get("features", 1))).alias("y"), r(F.avg("d2")).alias("distortion"))


def kmeans_lloyd_3(spark: SparkSession, sf: str) -> DataFrame:
    return _centres(spark, cluster.lloyd(_points(spark, sf), np.array(CENTRES), max_iter=3, epsilon=0.0).centres)


def kmeans_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    out = cluster.fit(_points(spark, sf), 6, init="maximin")
    rows = spark.createDataFrame([(k, *map(float, c), float(out.J), out.steps) for k, c in enumerate(out.centres)], "cluster int, x double, y double, j double, steps int")
    return rows.select("cluster", *[r(n).alias(n) for n in ("x", "y", "j")], "steps")


def kmeans_lloyd_mean_first(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 30 steps from centres that are farthest from the mean and each other; they end where no row changes its cluster."""
    return _centres(spark, cluster.fit(_points(spark, sf), 6, init="mean-first", max_iter=30, epsilon=0.0).centres)


def kmeans_maximin_init(spark: SparkSession, sf: str) -> DataFrame:
    return _centres(spark, cluster.farthest_first(_points(spark, sf), 4))


def kmedoids_step(spark: SparkSession, sf: str) -> DataFrame:
    return _centres(spark, cluster.medoid_centres(_points(spark, sf), np.array(CENTRES)))


def lbg_codebook(spark: SparkSession, sf: str) -> DataFrame:
    return _centres(spark, cluster.codebook(_points(spark, sf), 4, max_iter=1, epsilon=0.0).centres)


def selective_split(spark: SparkSession, sf: str) -> DataFrame:
    return _centres(spark, cluster.selective_splitting(_points(spark, sf), 5).centres)


def online_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), v.vector("value").alias("features"))
    out = cluster.online(events, 2)
    return spark.createDataFrame([(k, float(c[0])) for k, c in enumerate(out.centres)], "cluster int, x double").select("cluster", r("x").alias("x"))


def cluster_scores(spark: SparkSession, sf: str) -> DataFrame:
    ch, db = cluster.between_within(cluster.assign(_points(spark, sf), np.array(CENTRES)))
    return spark.createDataFrame([(float(ch), float(db))], "ch double, db double").select(r("ch", 4).alias("ch"), r("db").alias("db"))


def cluster_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    score = cluster.silhouette(cluster.assign(_points(spark, sf), np.array(CENTRES)))
    return spark.createDataFrame([(float(score),)], "silhouette double").select(r("silhouette").alias("silhouette"))


# --- mixtures over line items -----------------------------------------------------------------------------------------

START = {"priors": (0.4, 0.6), "mu": ((1.5, 2.0), (3.5, 6.0)), "var": (1.0, 4.0)}


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(v.vector(F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000).alias("features"))


def _start(covariance: str = "diagonal") -> mixture.Mixture:
    sigma = np.array([np.diag(START["var"])] * 2)
    return mixture.derive(mixture.Mixture(covariance, np.array(START["priors"]), np.array(START["mu"]), sigma))


def gmm_score(spark: SparkSession, sf: str) -> DataFrame:
    """Log densities, posteriors and components of each customer under a fixed mixture."""
    scored = mixture.score(_start(), _points(spark, sf).withColumn("features", F.array(F.get("features", 0), F.get("features", 1) / 4)))
    return scored.select("id", r("log_likelihood").alias("log_likelihood"), r(F.get("posteriors", 0)).alias("p0"), "component")


def gmm_estep_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = mixture.statistics(_start(), _lines(spark, sf))
    rows = [(c, int(s.hard[c]), float(s.r[c] / s.n), *map(float, s.rx[c] / s.n), float(s.rxx[c][0, 0] / s.n), float(s.rxx[c][1, 1] / s.n), s.loglik / s.n) for c in range(2)]
    names = ["r", "rx", "ry", "rxx", "ryy", "loglik"]
    return spark.createDataFrame(rows, "c int, n_hard bigint, " + ", ".join(f"{n} double" for n in names)).select("c", "n_hard", *[r(n).alias(n) for n in names])


def _em(covariance: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        m, data = _start(covariance), _lines(spark, sf)
        for _ in range(2):
            m, loglik = mixture.em_step(m, data)
        return _mixture_rows(spark, m, loglik)

    return query


def _mixture_rows(spark: SparkSession, m: mixture.Mixture, loglik: float) -> DataFrame:
    rows = [(c, float(m.priors[c]), *map(float, m.mu[c]), float(m.sigma[c][0, 0]), float(m.sigma[c][0, 1]), float(m.sigma[c][1, 1]), float(loglik)) for c in range(m.n_components)]
    names = ["prior", "m0", "m1", "s00", "s01", "s11", "loglik"]
    return spark.createDataFrame(rows, "c int, " + ", ".join(f"{n} double" for n in names)).select("c", *[r(n, 5).alias(n) for n in names])


def gmm_aic_bic(spark: SparkSession, sf: str) -> DataFrame:
    s = mixture.statistics(_start(), _lines(spark, sf))
    aic, bic = mixture.criteria(_start(), s.loglik, s.n)
    return spark.createDataFrame([(aic / s.n, bic / s.n)], "aic double, bic double").select(r("aic").alias("aic"), r("bic").alias("bic"))


def gmm_split(spark: SparkSession, sf: str) -> DataFrame:
    m, loglik = mixture.em_step(_start(), _lines(spark, sf))
    return _mixture_rows(spark, mixture.split(m), loglik)


def gmm_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Growth to four components on all line items: the trace of the iterations."""
    return _traced(spark, mixture.grow(_lines(spark, sf), 4, epsilon=1e-4, max_iterations=12)[1])


def gmm_growth_log(spark: SparkSession, sf: str) -> DataFrame:
    """The same run in two halves, the second of which goes on from the log of the first: the trace as the log has it."""
    log = f"{shared_dir(spark)}/tessel-log-{uuid.uuid4().hex}"
    dropped_at_exit(spark, log)
    mixture.grow(_lines(spark, sf), 2, epsilon=1e-4, max_iterations=12, log=TrainingLog(spark, log, "growth"))
    mixture.grow(_lines(spark, sf), 4, epsilon=1e-4, max_iterations=12, log=TrainingLog(spark, log, "growth"))
    figures = lambda n: F.col("figures")[n].alias(n)
    rows = TrainingLog(spark, log, "growth").rows().filter("event = 'iteration'").select(*[figures(n) for n in ("n_components", "iteration", "log_likelihood", "delta", "aic", "bic")])
    return rows.select(F.col("n_components").cast("int").alias("n_components"), F.col("iteration").cast("int").alias("iteration"), *[r(n).alias(n) for n in ("log_likelihood", "delta")], *[r(n, 2).alias(n) for n in ("aic", "bic")])


def _traced(spark: SparkSession, trace: list[mixture.Trace]) -> DataFrame:
    rows = spark.createDataFrame([(t.n_components, t.iteration, float(t.log_likelihood), float(t.delta), float(t.aic), float(t.bic)) for t in trace], "n_components int, iteration int, log_likelihood double, delta double, aic double, bic double")
    return rows.select("n_components", "iteration", *[r(n).alias(n) for n in ("log_likelihood", "delta")], *[r(n, 2).alias(n) for n in ("aic", "bic")])


def gmm_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Class mixtures on the embeddings: confusion counts."""
    data = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    model = mixture.fit_classifier(data, 2, max_iter=5)
    return model.predict(data.select("label", "features")).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


# --- neighbours over embeddings ---------------------------------------------------------------------------------------


def _embedded(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(name), "label", F.col("embedding").cast("array<double>").alias("features"))


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest(_embedded(spark, sf, "qid"), _embedded(spark, sf, "id"), 5)
    return near.select("qid", "rank", "id", r("d2").alias("d2"))


def knn_classify(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.classify(_embedded(spark, sf, "qid"), _embedded(spark, sf, "id"), 5)


def ball_tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    tree = neighbours.ball_tree(_points(spark, sf))
    return tree.select("node", "parent", "depth", "n", r(F.get("center", 0)).alias("x"), r(F.get("center", 1)).alias("y"), r("radius2").alias("radius2"), "leaf")


def ball_tree_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of each embedding by the leaves of a ball tree: what knn_topk gives."""
    tree = neighbours.grow(_embedded(spark, sf, "id").select("id", "features"))
    return neighbours.search(_embedded(spark, sf, "qid").select("qid", "features"), tree, 5).found.select("qid", "rank", "id", r("d2").alias("d2"))


def ball_tree_search_points(spark: SparkSession, sf: str) -> DataFrame:
    """The same over customers in the plane, where most leaves are out of reach."""
    points = _points(spark, sf)
    return neighbours.search(points.withColumnRenamed("id", "qid"), neighbours.grow(points), 5).found.select("qid", "rank", "id", r("d2").alias("d2"))


# --- sequences of events ----------------------------------------------------------------------------------------------

KINDS = ("click", "error", "purchase", "signup", "view")
INITIAL, MOVES = (0.6, 0.4), ((0.7, 0.3), (0.2, 0.8))
EMITS = ((0.5, 0.1, 0.1, 0.1, 0.2), (0.1, 0.3, 0.2, 0.1, 0.3))


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    symbol = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")) - 1
    return table(spark, sf, "events").select(F.col("user_id").alias("seq_id"), place.alias("t"), symbol.cast("int").alias("symbol"), v.vector("value").alias("features"))


def _model() -> hmm.Hmm:
    return hmm.Hmm(np.array(INITIAL), np.array(MOVES), np.array(EMITS))


def hmm_transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.transition_counts(_symbols(spark, sf)).select("i", "j", "n", r("p").alias("p"))


def hmm_forward_loglik(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.log_likelihoods(_model(), _symbols(spark, sf)).select("seq_id", r("log_likelihood").alias("log_likelihood"))


def hmm_forward_native(spark: SparkSession, sf: str) -> DataFrame:
    """The same without Python: the lattice folded over each array."""
    arrays = hmm.gathered(_symbols(spark, sf), "symbol")
    return arrays.select("seq_id", r(hmm.forward_column(_model(), F.col("observed"))).alias("log_likelihood"))


def hmm_viterbi_score(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.viterbi(_model(), _symbols(spark, sf)).select("seq_id", r("score").alias("score"))


def hmm_viterbi_path(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.best_states(_model(), _symbols(spark, sf)).select("seq_id", "t", "state")


def hmm_posteriors(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.posteriors(_model(), _symbols(spark, sf)).select("seq_id", "t", r(F.get("gamma", 0)).alias("g0"))


def hmm_baum_welch(spark: SparkSession, sf: str) -> DataFrame:
    m, trace = hmm.train(_model(), _symbols(spark, sf), 2)
    rows = [("a", i, j, float(x)) for i, row in enumerate(m.transitions) for j, x in enumerate(row)] + [("b", i, k, float(x)) for i, row in enumerate(m.emissions) for k, x in enumerate(row)]
    rows += [("p", i, 0, float(x)) for i, x in enumerate(m.initial)] + [("loglik", i, 0, float(x)) for i, x in enumerate(trace)]
    return spark.createDataFrame(rows, "kind string, i int, j int, value double").withColumn("value", r("value", 4))


def hmm_baum_welch_continuous(spark: SparkSession, sf: str) -> DataFrame:
    m, trace = hmm.train(hmm.continuous(np.array([[20.0], [80.0]])), _symbols(spark, sf), 2, "standard")
    rows = [(i, float(x.mu[0, 0]), float(x.sigma[0, 0, 0]), float(trace[-1])) for i, x in enumerate(m.mixtures)]
    return spark.createDataFrame(rows, "state int, mean double, variance double, loglik double").select("state", *[r(n, 4).alias(n) for n in ("mean", "variance", "loglik")])


# --- networks over embeddings -----------------------------------------------------------------------------------------


def _fixed_network() -> neural.Network:
    w = lambda o, i, s, scale: np.array([[math.sin(s + 7 * a + 3 * b) * scale for b in range(i)] for a in range(o)])
    return neural.Network((neural.Layer("tanh", w(3, 64, 1, 2), np.array([0.1, 0.2, 0.3]), np.zeros(64)), neural.Layer("softmax", w(2, 3, 2, 0.25), np.array([0.05, -0.05]), np.zeros(3))))


def mlp_forward(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return entries(table(spark, sf, "embeddings").select("vec_id", _fixed_network().output_column(x).alias("y")), "vec_id", F.col("y"))


def mlp_predict(spark: SparkSession, sf: str) -> DataFrame:
    data = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return neural.predict(_fixed_network(), data).select("vec_id", "predicted")


def mlp_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings through the network and back through its mirror."""
    data = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return entries(neural.reconstruct(_fixed_network(), data), "vec_id", F.col("reconstructed"))


def _learnt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def _untrained() -> neural.Network:
    return neural.network((64, 16, 10), ("tanh", "softmax"), neural.Settings(learning_rate=0.5, min_iter=3))


def mlp_fit(spark: SparkSession, sf: str) -> DataFrame:
    _, trace = neural.fit(_untrained(), _learnt(spark, sf), batches=2, max_iter=3)
    return spark.createDataFrame([(e.iteration, float(e.train_error)) for e in trace], "epoch int, error double").select("epoch", r("error").alias("error"))


def rbm_cd1(spark: SparkSession, sf: str) -> DataFrame:
    net = neural.network((64, 16, 8), ("sigmoid", "sigmoid"))
    _, trace = neural.pretrain(net, _learnt(spark, sf), epochs=2)
    return spark.createDataFrame([(k, e, float(x)) for k, e, x in trace], "layer int, epoch int, error double")


def autoencoder(spark: SparkSession, sf: str) -> DataFrame:
    net = neural.network((64, 16), ("tanh",), neural.Settings(learning_rate=0.2))
    _, trace = neural.finetune(net, _learnt(spark, sf), epochs=3)
    return spark.createDataFrame([(e, float(x)) for e, x in enumerate(trace)], "epoch int, error double")


# --- sources ----------------------------------------------------------------------------------------------------------


def synthetic_normals(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = synthetic.normals(spark, 3, 2, 200, 0, between=15.0, within=2.0, seed=4)
    return entries(train, "id", F.col("features"))


def hashed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in blocks of 100 rows: how many each has, and which."""
    blocked = text.blocks(_points(spark, sf), 100)
    return blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.max_by("id", "place").alias("last"), r(F.sum(F.get("features", 0)), 4).alias("x"))


_ALL = (
    kmeans_assign, kmeans_step, kmeans_lloyd_3, kmeans_lloyd, kmeans_lloyd_mean_first, kmeans_maximin_init, kmedoids_step, lbg_codebook, selective_split, online_kmeans, cluster_scores, cluster_silhouette, gmm_score, gmm_estep_stats, gmm_aic_bic, gmm_split,
    gmm_growth, gmm_growth_log, gmm_classifier, knn_topk, knn_classify, ball_tree_nodes, ball_tree_search, ball_tree_search_points, hmm_transition_counts, hmm_forward_loglik, hmm_forward_native, hmm_viterbi_score, hmm_viterbi_path, hmm_posteriors, hmm_baum_welch,
    hmm_baum_welch_continuous, mlp_forward, mlp_predict, mlp_reconstruct, mlp_fit, rbm_cd1, autoencoder, synthetic_normals, hashed_blocks)
QUERIES = {f.__name__: f for f in _ALL} | {f"gmm_em_2_{c}": _em(c) for c in mixture.COVARIANCES}

# --- SQL --------------------------------------------------------------------------------------------------------------

_POINTS = "d AS MATERIALIZED (SELECT c_custkey AS id, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)"
_FIXED = "c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in enumerate(CENTRES)) + ") AS t(k, cx, cy))"


def _nearest(centres: str) -> str:
    return f"SELECT id, x, y, k, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, k) AS p FROM (SELECT id, x, y, k, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM d, {centres})) WHERE p = 1"


def _step(centres: str) -> str:
    return f"SELECT c.k, coalesce(avg(n.x), 0) AS cx, coalesce(avg(n.y), 0) AS cy FROM {centres} AS c LEFT JOIN ({_nearest(centres)}) AS n ON n.k = c.k GROUP BY c.k"


def _unrolled(start: str, steps: int, first: int = 0) -> str:
    parts = [start]
    for i in range(first, first + steps):
        parts.append(f"c{i + 1} AS MATERIALIZED ({_step(f'c{i}')})")
    return ", ".join(parts)


def _near_of(points: str, centres: str) -> str:
    return f"SELECT id, x, y, k, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, k) AS p FROM (SELECT id, x, y, k, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM {points}, {centres})) WHERE p = 1"


def _to_the_end(name: str, points: str, start: str, steps: int = 32) -> list[str]:
    """Lloyd's steps from start over points, up to steps of them, and in name the centres (k, cx, cy, j, steps) after the first one that changes no row's cluster or improves the distortion too little."""
    parts, ends, shown = [f"{name}a0 AS MATERIALIZED ({_near_of(points, start)})"], [], []
    for i in range(1, steps + 1):
        before = f"{name}c{i - 1}" if i > 1 else start
        parts += [
            f"{name}c{i} AS MATERIALIZED (SELECT c.k, coalesce(avg(n.x), 0) AS cx, coalesce(avg(n.y), 0) AS cy FROM {before} AS c LEFT JOIN {name}a{i - 1} AS n ON n.k = c.k GROUP BY c.k)",
            f"{name}a{i} AS MATERIALIZED ({_near_of(points, f'{name}c{i}')})",
        ]
        ends.append(f"SELECT {i} AS i, avg(n.d2) AS j, avg(o.d2) AS old, count(*) FILTER (WHERE n.k <> o.k) AS changed FROM {name}a{i} AS n JOIN {name}a{i - 1} AS o ON o.id = n.id")
        shown.append(f"SELECT {i} AS i, k, cx, cy FROM {name}c{i}")
    parts.append(f"{name}e AS MATERIALIZED ({' UNION ALL '.join(ends)})")
    parts.append(f"{name}l AS MATERIALIZED (SELECT i, j FROM {name}e WHERE changed = 0 OR abs(old - j) / (abs(j) + 1e-4) <= 1e-4 ORDER BY i LIMIT 1)")
    parts.append(f"{name} AS MATERIALIZED (SELECT k, cx, cy, j, l.i AS steps FROM ({' UNION ALL '.join(shown)}) AS s JOIN {name}l AS l ON l.i = s.i)")
    return parts


def _from_a_row(name: str, points: str, k: int) -> list[str]:
    """In name k centres, each farthest from those before, from the row of the least hash, which the row farthest from all replaces at the end."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT 0 AS k, arg_min(x, sha256('0:' || id)) AS cx, arg_min(y, sha256('0:' || id)) AS cy FROM {points})"]
    far = lambda of: f"(SELECT x, y FROM ({_near_of(points, of)}) ORDER BY d2 DESC, id LIMIT 1)"
    for i in range(1, k):
        parts.append(f"{name}{i} AS MATERIALIZED (SELECT * FROM {name}{i - 1} UNION ALL SELECT {i}, x, y FROM {far(f'{name}{i - 1}')})")
    parts.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}{k - 1} WHERE k > 0 UNION ALL SELECT 0, x, y FROM {far(f'{name}{k - 1}')})")
    return parts


def _selective(k: int) -> str:
    """The most populated cluster splits in two until there are k; then Lloyd's steps over all."""
    parts = [*_from_a_row("f1", "d", 2), *_to_the_end("h1", "d", "f1"), "z1 AS MATERIALIZED (SELECT k, cx, cy FROM h1)"]
    for m in range(2, k):
        parts += [
            f"w{m} AS MATERIALIZED ({_near_of('d', f'z{m - 1}')})", f"b{m} AS MATERIALIZED (SELECT k AS b FROM w{m} GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)", f"p{m} AS MATERIALIZED (SELECT id, x, y FROM w{m} JOIN b{m} ON k = b)",
            *_from_a_row(f"f{m}", f"p{m}", 2), *_to_the_end(f"h{m}", f"p{m}", f"f{m}"),
            f"z{m} AS MATERIALIZED (SELECT z.k, CASE WHEN z.k = b THEN h.cx ELSE z.cx END AS cx, CASE WHEN z.k = b THEN h.cy ELSE z.cy END AS cy FROM z{m - 1} AS z, b{m}, h{m} AS h WHERE h.k = 0 UNION ALL SELECT {m}, cx, cy FROM h{m} WHERE k = 1)",
        ]
    return f"WITH {_POINTS}, {', '.join([*parts, *_to_the_end('o', 'd', f'z{k - 1}')])} {_SHOW} o"


def _ball_tree(levels: int) -> str:
    """The nodes of a tree of up to so many levels, each level from the rows of the one above."""
    parts = ["least AS (SELECT greatest(2, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS least FROM d)", "t0 AS MATERIALIZED (SELECT id, x, y, 1::BIGINT AS node FROM d)"]
    farthest = lambda of, origin, i: f"SELECT node, x AS ox, y AS oy FROM (SELECT t.node, t.x, t.y, row_number() OVER (PARTITION BY t.node ORDER BY (t.x - o.ox) * (t.x - o.ox) + (t.y - o.oy) * (t.y - o.oy) DESC, t.id) AS p FROM {of} AS t JOIN {origin} AS o ON o.node = t.node) WHERE p = 1"
    for i in range(levels):
        parts += [
            f"n{i} AS MATERIALIZED (SELECT node, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM t{i} GROUP BY node)",
            f"g{i} AS MATERIALIZED (SELECT n.node, {i} AS depth, any_value(n.n) AS n, any_value(cx) AS cx, any_value(cy) AS cy, max((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS radius2 FROM n{i} AS n JOIN t{i} AS t ON t.node = n.node GROUP BY n.node)",
            f"s{i} AS MATERIALIZED (SELECT t.*, n.n FROM t{i} AS t JOIN n{i} AS n ON n.node = t.node WHERE n.n >= (SELECT least FROM least))",
            f"a{i} AS MATERIALIZED (SELECT node, arg_min(x, id) AS ox, arg_min(y, id) AS oy FROM s{i} GROUP BY node)",
            f"b{i} AS MATERIALIZED ({farthest(f's{i}', f'a{i}', i)})",
            f"e{i} AS MATERIALIZED ({farthest(f's{i}', f'b{i}', i)})",
            f"t{i + 1} AS MATERIALIZED (SELECT id, x, y, 2 * node + CASE WHEN p > n // 2 THEN 1 ELSE 0 END AS node FROM (SELECT s.id, s.x, s.y, s.node, s.n, row_number() OVER (PARTITION BY s.node ORDER BY s.x * (b.ox - e.ox) + s.y * (b.oy - e.oy), s.id) AS p FROM s{i} AS s JOIN b{i} AS b ON b.node = s.node JOIN e{i} AS e ON e.node = s.node))",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(levels))
    return f"WITH {_POINTS}, {', '.join(parts)} SELECT node, CASE WHEN node > 1 THEN node // 2 END AS parent, CAST(depth AS INTEGER) AS depth, n, round(cx, 6) AS x, round(cy, 6) AS y, round(radius2, 6) AS radius2, n < (SELECT least FROM least) AS leaf FROM ({every})"


_SHOW = "SELECT CAST(k AS INTEGER) AS cluster, round(cx, 6) + 0.0::DOUBLE AS x, round(cy, 6) + 0.0::DOUBLE AS y FROM "


def _maximin(k: int) -> str:
    parts = ["c0 AS MATERIALIZED (SELECT 0 AS k, avg(x) AS cx, avg(y) AS cy FROM d)"]
    for i in range(1, k):
        parts.append(f"c{i} AS MATERIALIZED (SELECT * FROM c{i - 1} UNION ALL SELECT {i}, x, y FROM (SELECT x, y FROM ({_nearest(f'c{i - 1}')}) ORDER BY d2 DESC, id LIMIT 1))")
    return ", ".join(parts)


def _lbg() -> str:
    out, spread = "s AS (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM d), b0 AS (SELECT 0 AS k, avg(x) AS cx, avg(y) AS cy FROM d)", 1.0
    for i in range(2):
        out += f", e{i} AS MATERIALIZED (SELECT 2 * k AS k, cx + {spread} * sx AS cx, cy + {spread} * sy AS cy FROM b{i}, s UNION ALL SELECT 2 * k + 1, cx - {spread} * sx, cy - {spread} * sy FROM b{i}, s)"
        out += f", b{i + 1} AS MATERIALIZED ({_step(f'e{i}')})"
        spread /= 2
    return out


_SHOWN = ", ".join(f"round({n}, 5) + 0.0::DOUBLE AS {n}" for n in ("prior", "m0", "m1", "s00", "s01", "s11", "loglik"))
_ROWS = "d AS MATERIALIZED (SELECT row_number() OVER () AS i, l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem)"
_MODEL = "m0 AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {START['priors'][c]}::DOUBLE, {START['mu'][c][0]}::DOUBLE, {START['mu'][c][1]}::DOUBLE, {{v0}}::DOUBLE, 0.0::DOUBLE, {{v1}}::DOUBLE)" for c in range(2)) + ") AS t(c, prior, m0, m1, s00, s01, s11))"


def _densities(model: str, rows: str = "d") -> str:
    return f"""SELECT i, x, y, c, ln(prior) - 0.5 * ((s11 * (x - m0) * (x - m0) - 2 * s01 * (x - m0) * (y - m1) + s00 * (y - m1) * (y - m1)) / (s00 * s11 - s01 * s01) + ln(s00 * s11 - s01 * s01) + 2 * ln(2 * pi())) AS z FROM {rows}, {model}"""


def _responses(model: str, rows: str = "d") -> str:
    return f"SELECT i, x, y, c, z, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY i) AS r, top + ln(sum(exp(z - top)) OVER (PARTITION BY i)) AS ll, row_number() OVER (PARTITION BY i ORDER BY z DESC, c) AS p FROM (SELECT *, max(z) OVER (PARTITION BY i) AS top FROM ({_densities(model, rows)}))"


def _em_parts(k: int, covariance: str) -> list[str]:
    """An iteration from the model m<k> to m<k + 1>, which holds the mean log-likelihood under m<k> and the number of rows."""
    stats = f"SELECT c, sum(r) AS r, sum(r * x) / sum(r) AS a, sum(r * y) / sum(r) AS b, sum(r * x * x) / sum(r) AS xx, sum(r * x * y) / sum(r) AS xy, sum(r * y * y) / sum(r) AS yy, sum(ll) / count(*) AS loglik, count(*) AS n FROM r{k} GROUP BY c"
    own = f"SELECT c, r / n AS prior, a AS m0, b AS m1, greatest(1e-5, xx - a * a) AS s00, xy - a * b AS s01, greatest(1e-5, yy - b * b) AS s11, loglik, n FROM ({stats})"
    shape = {"diagonal": "s00, 0.0::DOUBLE AS s01, s11", "full": "s00, s01, s11", "spherical": "1.0::DOUBLE AS s00, 0.0::DOUBLE AS s01, 1.0::DOUBLE AS s11", "tied": "avg(s00) OVER () AS s00, avg(s01) OVER () AS s01, avg(s11) OVER () AS s11",
             "tied_diagonal": "avg(s00) OVER () AS s00, 0.0::DOUBLE AS s01, avg(s11) OVER () AS s11"}[covariance]
    return [f"r{k} AS MATERIALIZED ({_responses(f'm{k}')})", f"m{k + 1} AS MATERIALIZED (SELECT c, prior, m0, m1, {shape}, loglik, n FROM ({own}))"]


def _split_part(k: int, size: int) -> str:
    """Every one of size diagonal components of m<k> in two, a deviation apart on either side, as m<k + 1>."""
    half = lambda c, sign: f"SELECT {c} AS c, prior / 2 AS prior, m0 {sign} sqrt(s00) AS m0, m1 {sign} sqrt(s11) AS m1, s00, s01, s11, loglik, n FROM m{k}"
    return f"m{k + 1} AS MATERIALIZED ({half('c', '-')} UNION ALL {half(f'c + {size}', '+')})"


def _growth_sql(sizes: tuple[int, ...], iterations: int) -> str:
    """Growth from one component, iterations for each size, unrolled; fits to data on which no size ends earlier and no component dies."""
    parts, trace, k = [_ROWS, "m0 AS (SELECT 0 AS c, 1.0::DOUBLE AS prior, 0.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, 1.0::DOUBLE AS s00, 0.0::DOUBLE AS s01, 1.0::DOUBLE AS s11)"], [], 0
    for size in sizes:
        if size > 1:
            parts.append(_split_part(k, size // 2))
            k += 1
        for i in range(iterations):
            parts += _em_parts(k, "diagonal")
            k += 1
            trace.append(f"SELECT {size} AS n_components, {i} AS iteration, loglik, n FROM m{k} WHERE c = 0")
    delta = "coalesce(abs((loglik - lag(loglik) OVER (PARTITION BY n_components ORDER BY iteration)) / loglik), 1.0)"
    return f"""WITH {', '.join(parts)}, t AS ({' UNION ALL '.join(trace)}) SELECT n_components, iteration, round(loglik, 6) + 0.0::DOUBLE AS log_likelihood, round({delta}, 6) + 0.0::DOUBLE AS delta,
round(10 * n_components - 2 * n * loglik, 2) + 0.0::DOUBLE AS aic, round(5 * n_components * ln(n) - 2 * n * loglik, 2) + 0.0::DOUBLE AS bic FROM t"""


def _classifier_sql(iterations: int) -> str:
    """Two diagonal components a class over embeddings, iterations unrolled; fits to classes of 40 rows or more in which no component dies and no iteration is the last by its gain."""
    dims = "range(1, 65)"
    density = lambda x: f"ln(prior) - 0.5 * list_sum(list_transform({dims}, lambda i: ({x}[i] - m[i]) * ({x}[i] - m[i]) / s[i] + ln(s[i]) + ln(2 * pi())))"
    spread = "list(greatest(1e-5, q - m * m) ORDER BY i)"
    parts = [
        "e AS MATERIALIZED (SELECT vec_id AS id, label AS k, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
        "u AS MATERIALIZED (SELECT id, k, x, unnest(range(1, 65)) AS i FROM e)",
        f"w AS MATERIALIZED (SELECT k, {spread} AS s FROM (SELECT k, i, avg(x[i]) AS m, avg(x[i] * x[i]) AS q FROM u GROUP BY k, i) GROUP BY k)",
        "m0 AS MATERIALIZED (SELECT p.k, c, 0.5::DOUBLE AS prior, x AS m, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sha256('0:' || id)) AS c FROM e) AS p JOIN w ON w.k = p.k WHERE c <= 2)",
    ]
    for t in range(iterations):
        parts += [
            f"z{t} AS MATERIALIZED (SELECT e.id, e.k, e.x, c, {density('e.x')} AS z FROM e JOIN m{t} AS m ON m.k = e.k)",
            f"r{t} AS MATERIALIZED (SELECT k, c, x, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY id) AS r FROM (SELECT *, max(z) OVER (PARTITION BY id) AS top FROM z{t}))",
            f"n{t} AS MATERIALIZED (SELECT k, c, sum(r) / (sum(sum(r)) OVER (PARTITION BY k)) AS prior FROM r{t} GROUP BY k, c)",
            f"m{t + 1} AS MATERIALIZED (SELECT a.k, a.c, any_value(n.prior) AS prior, list(m ORDER BY i) AS m, {spread} AS s FROM (SELECT k, c, i, sum(r * x[i]) / sum(r) AS m, sum(r * x[i] * x[i]) / sum(r) AS q FROM (SELECT *, unnest(range(1, 65)) AS i FROM r{t}) GROUP BY k, c, i) AS a JOIN n{t} AS n ON n.k = a.k AND n.c = a.c GROUP BY a.k, a.c)",
        ]
    return f"""WITH {', '.join(parts)}, p AS (SELECT k, ln(count(*)) - ln(sum(count(*)) OVER ()) AS prior FROM e GROUP BY k),
g AS (SELECT id, label, k, max(z) + ln(sum(exp(z - top))) AS z FROM (SELECT *, max(z) OVER (PARTITION BY id, k) AS top FROM (SELECT e.id, e.k AS label, m.k, {density('e.x')} AS z FROM e, m{iterations} AS m)) GROUP BY id, label, k),
b AS (SELECT id, label, g.k, row_number() OVER (PARTITION BY id ORDER BY z + p.prior DESC, g.k) AS place FROM g JOIN p ON p.k = g.k)
SELECT label, k AS predicted, count(*) AS n FROM b WHERE place = 1 GROUP BY label, k"""


def _network_sql(epochs: int, batches: int) -> str:
    """Descent of the untrained network over batches of embeddings, steps unrolled: weights and the last steps are rows (k, j, w, d) by layer, biases those with j = 0."""
    net = _untrained()
    s = net.settings
    rows = lambda l: ", ".join(f"({k}, {j}, {w!r}::DOUBLE, 0.0::DOUBLE)" for k, ws in enumerate(l.weights.tolist(), 1) for j, w in enumerate([0.0, *ws]))
    parts = [f"l1s0 AS MATERIALIZED (SELECT * FROM (VALUES {rows(net.layers[0])}) AS t(k, j, w, d))", f"l2s0 AS MATERIALIZED (SELECT * FROM (VALUES {rows(net.layers[1])}) AS t(k, j, w, d))",
             f"e AS MATERIALIZED (SELECT vec_id, label, list_prepend(1.0::DOUBLE, CAST(embedding AS DOUBLE[])) AS x, ('0x' || substr(sha256('{s.seed}:' || vec_id), 1, 8))::BIGINT % {neural.SLOTS * batches} AS slot FROM embeddings)"]
    shown, t = [], 0
    table_of = lambda layer, t: f"(SELECT list(w ORDER BY k) FROM (SELECT k, list(w ORDER BY j) AS w FROM l{layer}s{t} GROUP BY k))"
    for it in range(epochs):
        losses = []
        for slots in neural.batches_of(s.seed, it, batches):
            m, rate = neural.momentum_at(it, s.momentum), s.learning_rate * neural.schedule(it)
            parts += [
                f"h{t} AS MATERIALIZED (SELECT label, x, list_prepend(1.0::DOUBLE, list_transform({table_of(1, t)}, lambda w: 1.7159 * tanh(2.0::DOUBLE / 3 * list_dot_product(w, x)))) AS h FROM e WHERE slot IN ({', '.join(map(str, slots))}))",
                f"z{t} AS MATERIALIZED (SELECT *, list_transform({table_of(2, t)}, lambda w: list_dot_product(w, h)) AS z FROM h{t})",
                f"p{t} AS MATERIALIZED (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS p FROM z{t})",
                f"o{t} AS MATERIALIZED (SELECT label, x, h, list_transform(p, lambda v, i: v / list_sum(p) - CASE WHEN label = i - 1 THEN 1 ELSE 0 END) AS g FROM p{t})",
                f"b{t} AS MATERIALIZED (SELECT x, h, g, list_transform(range(2, 18), lambda j: 2.0::DOUBLE / 3 * (1.7159 - h[j] * h[j] / 1.7159) * list_dot_product(g, c.w[j])) AS f FROM o{t}, (SELECT list(w ORDER BY j) AS w FROM (SELECT j + 1 AS j, list(w ORDER BY k) AS w FROM l2s{t} GROUP BY j)) AS c)",
                f"n{t} AS MATERIALIZED (SELECT count(*) AS n, sum(list_sum(list_transform(g, lambda v: v * v))) / 10 AS loss FROM b{t})",
            ]
            for layer, error, below in ((1, "f", "x"), (2, "g", "h")):
                # a bias moves at twice the rate
                parts += [
                    f"g{layer}s{t} AS MATERIALIZED (SELECT k, j, {m} * any_value(l.d) - {rate!r}::DOUBLE / any_value(n) * (CASE WHEN j = 0 THEN 2 ELSE 1 END) * sum({error}[k] * {below}[j + 1]) AS d FROM l{layer}s{t} AS l, b{t}, n{t} GROUP BY k, j)",
                    f"l{layer}s{t + 1} AS MATERIALIZED (SELECT l.k, l.j, l.w + g.d AS w, g.d FROM l{layer}s{t} AS l JOIN g{layer}s{t} AS g ON g.k = l.k AND g.j = l.j)",
                ]
            losses.append(f"SELECT n, loss FROM n{t}")
            t += 1
        shown.append(f"SELECT {it} AS epoch, round(sum(loss) / sum(n), 6) AS error FROM ({' UNION ALL '.join(losses)})")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(shown)}"


def _em_sql(covariance: str) -> str:
    v0, v1 = (1.0, 1.0) if covariance == "spherical" else START["var"]
    parts = [_ROWS, _MODEL.format(v0=v0, v1=v1)]
    parts += [p for k in range(2) for p in _em_parts(k, covariance)]
    return f"WITH {', '.join(parts)} SELECT CAST(c AS INTEGER) AS c, {_SHOWN} FROM m2"


_DIAGONAL = _MODEL.format(v0=START["var"][0], v1=START["var"][1])
_STATS = f"WITH {_ROWS}, {_DIAGONAL}, r AS ({_responses('m0')})"
_NEAR = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT qid, id, label, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM (
  SELECT a.vec_id AS qid, b.vec_id AS id, b.label, list_sum(list_transform(range(1, 65), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) AS d2 FROM e AS a, e AS b))"""
_SEQ = """q AS MATERIALIZED (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS o FROM events)"""
_LOG = lambda p: f"ln({p} + 1e-300)"
_B = [f"CASE o {' '.join(f'WHEN {k} THEN {_LOG(p)}' for k, p in enumerate(row))} END" for row in EMITS]
_SEQ_B = f"{_SEQ}, b AS MATERIALIZED (SELECT seq_id, t, {_B[0]} AS b0, {_B[1]} AS b1 FROM q)"
_ADD = lambda x, y: f"(greatest({x}, {y}) + ln(1 + exp(-abs(({x}) - ({y})))))"
_A = [[_LOG(p) for p in row] for row in MOVES]
_FORWARD = f"""f AS (SELECT seq_id, t, {_LOG(INITIAL[0])} + b0 AS a0, {_LOG(INITIAL[1])} + b1 AS a1 FROM b WHERE t = 0
UNION ALL SELECT b.seq_id, b.t, {_ADD(f'a0 + {_A[0][0]}', f'a1 + {_A[1][0]}')} + b0, {_ADD(f'a0 + {_A[0][1]}', f'a1 + {_A[1][1]}')} + b1 FROM f JOIN b ON b.seq_id = f.seq_id AND b.t = f.t + 1)"""
_LAST = "SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY t DESC) AS back FROM "
_LOGLIK = f"WITH RECURSIVE {_SEQ_B}, {_FORWARD} SELECT seq_id, round({_ADD('a0', 'a1')}, 6) AS log_likelihood FROM ({_LAST} f) WHERE back = 1"
_BEST = f"""v AS (SELECT seq_id, t, {_LOG(INITIAL[0])} + b0 AS a0, {_LOG(INITIAL[1])} + b1 AS a1, 0 AS p0, 0 AS p1 FROM b WHERE t = 0
UNION ALL SELECT b.seq_id, b.t, greatest(a0 + {_A[0][0]}, a1 + {_A[1][0]}) + b0, greatest(a0 + {_A[0][1]}, a1 + {_A[1][1]}) + b1, CASE WHEN a1 + {_A[1][0]} > a0 + {_A[0][0]} THEN 1 ELSE 0 END, CASE WHEN a1 + {_A[1][1]} > a0 + {_A[0][1]} THEN 1 ELSE 0 END
FROM v JOIN b ON b.seq_id = v.seq_id AND b.t = v.t + 1)"""



def _baum_welch_parts(k: int, emission: str, carried: str, pooled: bool) -> list[str]:
    """An iteration from the row of parameters p<k> to p<k + 1> over q (seq_id, t, len, o, x). emission: a state's log density by its number; carried: what p<k + 1> has of emissions, from x<k> and m<k>."""
    logs = ", ".join(f"{_LOG(n)} AS l{n}" for n in ("i0", "i1", "a00", "a01", "a10", "a11"))
    move = lambda i, j: f"sum(exp(a{i} + la{i}{j} + t{j} - z)) AS m{i}{j}"
    share = lambda i, j: f"sum(m{i}{j}{'' if pooled else f' / g{i}'}) AS m{i}{j}"
    gamma = [f"exp(a{i} + h{i} - z)" for i in (0, 1)]
    pairs = [(i, j) for i in (0, 1) for j in (0, 1)]
    return [
        f"b{k} AS MATERIALIZED (SELECT seq_id, t, len, o, x, {emission.format(i=0)} AS b0, {emission.format(i=1)} AS b1, {logs} FROM q, p{k})",
        f"""f{k} AS (SELECT seq_id, t, li0 + b0 AS a0, li1 + b1 AS a1 FROM b{k} WHERE t = 0
UNION ALL SELECT b.seq_id, b.t, {_ADD('a0 + la00', 'a1 + la10')} + b0, {_ADD('a0 + la01', 'a1 + la11')} + b1 FROM f{k} AS f JOIN b{k} AS b ON b.seq_id = f.seq_id AND b.t = f.t + 1)""",
        f"""h{k} AS (SELECT seq_id, t, 0.0::DOUBLE AS h0, 0.0::DOUBLE AS h1 FROM b{k} WHERE t = len - 1
UNION ALL SELECT b.seq_id, b.t - 1, {_ADD('la00 + b0 + h0', 'la01 + b1 + h1')}, {_ADD('la10 + b0 + h0', 'la11 + b1 + h1')} FROM h{k} AS h JOIN b{k} AS b ON b.seq_id = h.seq_id AND b.t = h.t WHERE b.t > 0)""",
        f"""x{k} AS MATERIALIZED (SELECT b.*, a0, a1, h0, h1, {_ADD('a0 + h0', 'a1 + h1')} AS z, lead(b0 + h0) OVER w AS t0, lead(b1 + h1) OVER w AS t1
FROM b{k} AS b JOIN f{k} AS f ON f.seq_id = b.seq_id AND f.t = b.t JOIN h{k} AS h ON h.seq_id = b.seq_id AND h.t = b.t WINDOW w AS (PARTITION BY b.seq_id ORDER BY b.t))""",
        f"m{k} AS MATERIALIZED (SELECT seq_id, {', '.join(move(i, j) for i, j in pairs)}, {', '.join(f'sum({g}) FILTER (WHERE t < len - 1) AS g{i}, sum({g}) AS w{i}' for i, g in enumerate(gamma))} FROM x{k} GROUP BY seq_id)",
        f"""p{k + 1} AS MATERIALIZED (SELECT s0 / (s0 + s1) AS i0, s1 / (s0 + s1) AS i1, {', '.join(f'm{i}{j} / (m{i}0 + m{i}1) AS a{i}{j}' for i, j in pairs)}, loglik, {carried.format(k=k)}
FROM (SELECT {', '.join(share(i, j) for i, j in pairs)} FROM m{k}), (SELECT sum({gamma[0]}) AS s0, sum({gamma[1]}) AS s1, sum(z) AS loglik FROM x{k} WHERE t = 0))""",
    ]


def _baum_welch_sql() -> str:
    """Two iterations for symbols, a sequence weighing as much as any other."""
    lists = [f"[{', '.join(f'{p}::DOUBLE' for p in row)}] AS e{i}" for i, row in enumerate(EMITS)]
    start = f"p0 AS (SELECT {INITIAL[0]} AS i0, {INITIAL[1]} AS i1, {', '.join(f'{p} AS a{i}{j}' for i, row in enumerate(MOVES) for j, p in enumerate(row))}, {', '.join(lists)})"
    seen = ", ".join(f"(SELECT list(y / s ORDER BY o) FROM (SELECT o, y, sum(y) OVER () AS s FROM (SELECT o, sum(exp(a{i} + h{i} - z) / w{i}) AS y FROM x{{k}} AS x JOIN m{{k}} AS m ON m.seq_id = x.seq_id GROUP BY o))) AS e{i}" for i in (0, 1))
    parts = [_BAUM_WELCH_ROWS, start, *[p for k in range(2) for p in _baum_welch_parts(k, "ln(e{i}[o + 1] + 1e-300)", seen, False)]]
    rows = [f"SELECT 'a', {i}, {j}, a{i}{j} FROM p2" for i in (0, 1) for j in (0, 1)] + [f"SELECT 'p', {i}, 0, i{i} FROM p2" for i in (0, 1)] + [f"SELECT 'loglik', {i}, 0, loglik FROM p{i + 1}" for i in (0, 1)]
    rows += [f"SELECT 'b', {i}, {j}, e{i}[{j + 1}] FROM p2" for i in (0, 1) for j in range(len(KINDS))]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT kind, i, j, round(v, 4) + 0.0::DOUBLE AS value FROM ({' UNION ALL '.join(rows)}) AS r(kind, i, j, v)"


def _baum_welch_continuous_sql() -> str:
    """Two iterations for numbers, a Gaussian for each of two states, an observation weighing as much as any other."""
    start = "p0 AS (SELECT 0.5 AS i0, 0.5 AS i1, 0.5 AS a00, 0.5 AS a01, 0.5 AS a10, 0.5 AS a11, 20.0::DOUBLE AS u0, 80.0::DOUBLE AS u1, 1.0::DOUBLE AS v0, 1.0::DOUBLE AS v1)"
    mean = lambda i, of: f"(SELECT sum(exp(a{i} + h{i} - z) * {of}) / sum(exp(a{i} + h{i} - z)) FROM x{{k}})"
    carried = ", ".join(f"{mean(i, 'x')} AS u{i}, greatest(1e-5, {mean(i, 'x * x')} - {mean(i, 'x')} * {mean(i, 'x')}) AS v{i}" for i in (0, 1))
    emission = "greatest(-0.5 * ((x - u{i}) * (x - u{i}) / v{i} + ln(v{i}) + ln(2 * pi())), ln(1e-50))"
    parts = [_BAUM_WELCH_ROWS, start, *[p for k in range(2) for p in _baum_welch_parts(k, emission, carried, True)]]
    return f"WITH RECURSIVE {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {i} AS state, round(u{i}, 4) + 0.0::DOUBLE AS mean, round(v{i}, 4) + 0.0::DOUBLE AS variance, round(loglik, 4) + 0.0::DOUBLE AS loglik FROM p2" for i in (0, 1))


_BAUM_WELCH_ROWS = _SEQ.replace("FROM events", ", count(*) OVER (PARTITION BY user_id) AS len, value AS x FROM events")

SQL = {
    "kmeans_assign": f"WITH {_POINTS}, {_FIXED} SELECT id, CAST(k AS INTEGER) AS cluster, round(d2, 6) AS d2 FROM ({_nearest('c0')})",
    "kmeans_step": f"WITH {_POINTS}, {_FIXED} SELECT CAST(k AS INTEGER) AS cluster, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS x, round(avg(y), 6) + 0.0::DOUBLE AS y, round(avg(d2), 6) + 0.0::DOUBLE AS distortion FROM ({_nearest('c0')}) GROUP BY k",
    "kmeans_lloyd_3": f"WITH {_POINTS}, {_unrolled(_FIXED, 3)} {_SHOW} c3",
    "kmeans_lloyd": f"WITH {_POINTS}, {', '.join([*_from_a_row('f', 'd', 6), *_to_the_end('o', 'd', 'f')])} SELECT CAST(k AS INTEGER) AS cluster, round(cx, 6) + 0.0::DOUBLE AS x, round(cy, 6) + 0.0::DOUBLE AS y, round(j, 6) AS j, CAST(steps AS INTEGER) AS steps FROM o",
    "selective_split": _selective(5),
    "kmeans_lloyd_mean_first": f"WITH {_POINTS}, {_unrolled(_maximin(6), 30, 5)} {_SHOW} c35",
    "kmeans_maximin_init": f"WITH {_POINTS}, {_maximin(4)} {_SHOW} c3",
    "kmedoids_step": f"WITH {_POINTS}, {_FIXED}, n AS ({_nearest('c0')}), m AS (SELECT *, avg(x) OVER (PARTITION BY k) AS ax, avg(y) OVER (PARTITION BY k) AS ay FROM n), p AS (SELECT k, x AS cx, y AS cy, row_number() OVER (PARTITION BY k ORDER BY (x - ax) * (x - ax) + (y - ay) * (y - ay), id) AS p FROM m) {_SHOW} p WHERE p = 1",
    "lbg_codebook": f"WITH {_POINTS}, {_lbg()} {_SHOW} b2",
    "online_kmeans": """WITH RECURSIVE s AS MATERIALIZED (SELECT value AS x, row_number() OVER (ORDER BY event_id) AS i FROM events),
w AS (SELECT 2 AS i, (SELECT x FROM s WHERE i = 1) AS c0, (SELECT x FROM s WHERE i = 2) AS c1, 1 AS n0, 1 AS n1
UNION ALL SELECT s.i, CASE WHEN abs(x - c0) <= abs(x - c1) THEN c0 + (x - c0) / (n0 + 1) ELSE c0 END, CASE WHEN abs(x - c0) <= abs(x - c1) THEN c1 ELSE c1 + (x - c1) / (n1 + 1) END,
n0 + CASE WHEN abs(x - c0) <= abs(x - c1) THEN 1 ELSE 0 END, n1 + CASE WHEN abs(x - c0) <= abs(x - c1) THEN 0 ELSE 1 END FROM w JOIN s ON s.i = w.i + 1)
SELECT 0 AS cluster, round(c0, 6) AS x FROM w WHERE i = (SELECT max(i) FROM s) UNION ALL SELECT 1, round(c1, 6) FROM w WHERE i = (SELECT max(i) FROM s)""",
    "cluster_scores": f"""WITH {_POINTS}, {_FIXED}, n AS ({_nearest('c0')}), g AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS n FROM n), m AS (SELECT k, avg(x) AS ax, avg(y) AS ay, count(*) AS n FROM n GROUP BY k),
b AS (SELECT sum(m.n * ((ax - gx) * (ax - gx) + (ay - gy) * (ay - gy))) AS b, count(*) AS k, any_value(g.n) AS n FROM m, g),
w AS (SELECT m.k, avg(sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay))) AS s, sum((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS w, any_value(ax) AS ax, any_value(ay) AS ay FROM n JOIN m ON m.k = n.k GROUP BY m.k),
r AS (SELECT a.k, max((a.s + c.s) / sqrt((a.ax - c.ax) * (a.ax - c.ax) + (a.ay - c.ay) * (a.ay - c.ay))) AS r FROM w AS a JOIN w AS c ON a.k <> c.k GROUP BY a.k)
SELECT round((b / (k - 1)) / ((SELECT sum(w) FROM w) / (n - k)), 4) AS ch, round((SELECT avg(r) FROM r), 6) AS db FROM b""",
    "cluster_silhouette": f"""WITH {_POINTS}, {_FIXED}, n AS MATERIALIZED ({_nearest('c0')}),
p AS (SELECT a.id, a.k = b.k AS own, sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS s, count(*) AS m FROM n AS a, n AS b GROUP BY a.id, a.k, b.k),
g AS (SELECT id, max(s / greatest(m - 1, 1)) FILTER (WHERE own) AS a, max(m) FILTER (WHERE own) AS m, min(s / m) FILTER (WHERE NOT own) AS b FROM p GROUP BY id)
SELECT round(avg(CASE WHEN m > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM g""",
    "gmm_score": f"WITH d AS (SELECT c_custkey AS i, c_acctbal / 1000 AS x, c_nationkey / 4 AS y FROM customer), {_DIAGONAL}, r AS ({_responses('m0')}) SELECT i AS id, round(max(ll), 6) AS log_likelihood, round(max(r) FILTER (WHERE c = 0), 6) AS p0, CAST(max(c) FILTER (WHERE p = 1) AS INTEGER) AS component FROM r GROUP BY i",
    "gmm_estep_stats": f"{_STATS}, n AS (SELECT count(DISTINCT i) AS n FROM r) SELECT CAST(c AS INTEGER) AS c, count(*) FILTER (WHERE p = 1) AS n_hard, round(sum(r) / any_value(n), 6) AS r, round(sum(r * x) / any_value(n), 6) AS rx, round(sum(r * y) / any_value(n), 6) AS ry, round(sum(r * x * x) / any_value(n), 6) AS rxx, round(sum(r * y * y) / any_value(n), 6) AS ryy, round(sum(ll) / any_value(n), 6) AS loglik FROM r, n GROUP BY c",
    "gmm_aic_bic": f"{_STATS} SELECT round((20 - 2 * sum(ll)) / count(*), 6) AS aic, round((10 * ln(count(*)) - 2 * sum(ll)) / count(*), 6) AS bic FROM r WHERE c = 0",
    "gmm_split": f"WITH {_ROWS}, {_DIAGONAL}, {', '.join(_em_parts(0, 'diagonal'))}, {_split_part(1, 2)} SELECT CAST(c AS INTEGER) AS c, {_SHOWN} FROM m2",
    "gmm_classifier": _classifier_sql(5),
    "mlp_fit": _network_sql(3, 2),
    "gmm_growth": _growth_sql((1, 2, 4), 12),
    "gmm_growth_log": _growth_sql((1, 2, 4), 12),
    "knn_topk": f"WITH {_NEAR} SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(d2, 6) AS d2 FROM n WHERE rank <= 5",
    "hashed_blocks": f"WITH {_POINTS}, o AS (SELECT *, row_number() OVER (ORDER BY sha256('0:' || id), id) - 1 AS n FROM d) SELECT n // 100 AS block, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, arg_max(id, n) AS last, round(sum(x), 4) + 0.0::DOUBLE AS x FROM o GROUP BY n // 100",
    "ball_tree_nodes": _ball_tree(12),
    "ball_tree_search": f"WITH {_NEAR} SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(d2, 6) AS d2 FROM n WHERE rank <= 5",
    "ball_tree_search_points": f"WITH {_POINTS} SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM (SELECT a.id AS qid, b.id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM d AS a, d AS b)) WHERE rank <= 5",
    "knn_classify": f"WITH {_NEAR} SELECT qid, label AS predicted FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, label) AS p FROM n WHERE rank <= 5 GROUP BY qid, label) WHERE p = 1",
    "hmm_transition_counts": f"WITH {_SEQ}, m AS (SELECT o AS i, lead(o) OVER (PARTITION BY seq_id ORDER BY t) AS j FROM q) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY i)), 6) AS p FROM m WHERE j IS NOT NULL GROUP BY i, j",
    "hmm_forward_loglik": _LOGLIK,
    "hmm_forward_native": _LOGLIK,
    "hmm_viterbi_score": f"WITH RECURSIVE {_SEQ_B}, {_BEST} SELECT seq_id, round(greatest(a0, a1), 6) AS score FROM ({_LAST} v) WHERE back = 1",
    "hmm_viterbi_path": f"""WITH RECURSIVE {_SEQ_B}, {_BEST}, l AS MATERIALIZED ({_LAST} v), w AS (SELECT seq_id, t, CASE WHEN a1 > a0 THEN 1 ELSE 0 END AS state FROM l WHERE back = 1
UNION ALL SELECT l.seq_id, l.t - 1, CASE WHEN w.state = 0 THEN p0 ELSE p1 END FROM w JOIN l ON l.seq_id = w.seq_id AND l.t = w.t WHERE l.t > 0) SELECT seq_id, CAST(t AS INTEGER) AS t, state FROM w""",
    "hmm_posteriors": f"""WITH RECURSIVE {_SEQ_B}, {_FORWARD}, l AS MATERIALIZED ({_LAST} f), g AS (SELECT seq_id, t, 0.0::DOUBLE AS h0, 0.0::DOUBLE AS h1 FROM l WHERE back = 1
UNION ALL SELECT b.seq_id, b.t - 1, {_ADD(f'{_A[0][0]} + b0 + h0', f'{_A[0][1]} + b1 + h1')}, {_ADD(f'{_A[1][0]} + b0 + h0', f'{_A[1][1]} + b1 + h1')} FROM g JOIN b ON b.seq_id = g.seq_id AND b.t = g.t WHERE b.t > 0)
SELECT g.seq_id, CAST(g.t AS INTEGER) AS t, round(1 / (1 + exp((a1 + h1) - (a0 + h0))), 6) AS g0 FROM g JOIN l ON l.seq_id = g.seq_id AND l.t = g.t""",
    "mlp_forward": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
h AS (SELECT vec_id, list_transform([0, 1, 2], lambda a: 1.7159 * tanh(2.0::DOUBLE / 3 * (list_sum(list_transform(range(64), lambda b: sin(1 + 7 * a + 3 * b) * 2 * x[b + 1])) + 0.1 * (a + 1)))) AS h FROM e),
z AS (SELECT vec_id, list_transform([0, 1], lambda a: list_sum(list_transform([0, 1, 2], lambda b: sin(2 + 7 * a + 3 * b) / 4 * h[b + 1])) + 0.05 - 0.1 * a) AS z FROM h)
SELECT vec_id, 0 AS i, round(1 / (1 + exp(z[2] - z[1])), 6) AS w FROM z UNION ALL SELECT vec_id, 1, round(1 / (1 + exp(z[1] - z[2])), 6) FROM z""",
}
SQL["mlp_predict"] = SQL["mlp_forward"].split("SELECT vec_id, 0 AS i")[0] + "SELECT vec_id, CASE WHEN z[2] > z[1] THEN 1 ELSE 0 END AS predicted FROM z"
SQL["mlp_reconstruct"] = SQL["mlp_forward"].split("SELECT vec_id, 0 AS i")[0] + """, y AS (SELECT vec_id, 1 / (1 + exp(z[2] - z[1])) AS a, 1 / (1 + exp(z[1] - z[2])) AS b FROM z),
m AS (SELECT vec_id, list_transform([0, 1, 2], lambda k: sin(2 + 3 * k) / 4 * a + sin(9 + 3 * k) / 4 * b) AS h FROM y)
SELECT vec_id, CAST(j AS INTEGER) AS i, round(list_sum(list_transform([0, 1, 2], lambda k: sin(1 + 7 * k + 3 * j) * 2 * h[k + 1])), 6) + 0.0::DOUBLE AS w FROM m, range(64) AS t(j)"""
SQL |= {"hmm_baum_welch": _baum_welch_sql(), "hmm_baum_welch_continuous": _baum_welch_continuous_sql()}
SQL |= {f"gmm_em_2_{c}": _em_sql(c) for c in mixture.COVARIANCES}
