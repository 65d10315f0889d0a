import hashlib
import math

import numpy as np

from tessel.llm import centroids as c


def plain(rows, k, rounds, dim, seed=2):
    """rows (vec_id, vector): {index: (cluster, distance)} and the centroids, in whole numbers of Python."""
    ok = lambda x: x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)
    held = {i: [math.floor(256 * max(-(2.0**18), min(2.0**18, v))) for v in x] for i, (_, x) in enumerate(rows) if ok(x)}
    start = sorted((i for i in held if rows[i][0] is not None), key=lambda i: (hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest(), held[i]))[:k]
    centres = [held[i] for i in start]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: {i: min((d2(x, m), j) for j, m in enumerate(centres)) for i, x in held.items()}
    for _ in range(rounds):
        own = near()
        for j in range(len(centres)):
            if mine := [held[i] for i in held if own[i][1] == j]:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return {i: (j, d) for i, (d, j) in near().items()}, centres


def rows_of(n=260, dim=6):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12, dim))[rng.integers(0, 12, n)] + 0.05 * rng.standard_normal((n, dim))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[0], rows[0], (900, None), (901, []), (902, [0.0] * (dim - 1)), (903, [float("nan")] * dim), (904, [None] + [1.0] * (dim - 1)), (905, [float("inf")] * dim)]
    return rows + [(906, [0.0] * dim), (907, [0.0] * dim), (908, [1e300] * dim), (909, [-1e300] + [0.5] * (dim - 1)), (None, [0.25] * dim)]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<double>, cells string, row int").repartition(3)


def test_equals_brute_force(spark):
    rows = rows_of()
    found, centres, _ = c.cluster(frame(spark, rows), k=8, rounds=3, dim=6)
    want, plain_centres = plain(rows, 8, 3, 6)
    key = lambda r: (r[0] is None, *r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=key) == sorted(((rows[i][0], *v) for i, v in want.items()), key=key)
    assert centres.tolist() == plain_centres


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (400, 5))
    x[:50] = x[0]
    cuts = np.sort(np.concatenate([x.min(axis=0)[:, None], np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="nearest").T, x.max(axis=0)[:, None]], axis=1), axis=1).astype(np.int64)
    centres = rng.integers(-400, 400, (7, 5))
    low, high = c.intervals(c.cells_of(x, cuts), c.lookup(cuts, centres))
    d = c.distances(x, centres)
    assert (low <= d).all() and (d <= high).all() and (d == ((x[:, None] - centres[None]) ** 2).sum(axis=2)).all()


def test_few_vectors_are_fetched_where_clusters_are_apart(spark):
    """After the first round, which fetches all, intervals tell nearly all vectors of clusters far from each other."""
    rng = np.random.default_rng(5)
    x = np.repeat(10 * rng.standard_normal((8, 16)), 50, axis=0) + 0.1 * rng.standard_normal((400, 16))
    _, _, rounds = c.cluster(frame(spark, [(i, r.tolist()) for i, r in enumerate(x)]), k=8, rounds=4, dim=16)
    assert rounds[0].moved == 400 and rounds[-1].moved < 40 and rounds[-1].fetched < 200


def test_few_and_none(spark):
    rows = [(5, [0.5, 0.25]), (6, [0.5, 0.25])]
    found, centres, _ = c.cluster(frame(spark, rows), k=40, dim=2)
    assert sorted(tuple(r) for r in found.collect()) == [(5, 0, 0), (6, 0, 0)] and len(centres) == 2
    found, centres, rounds = c.cluster(frame(spark, rows).limit(0), dim=2)
    assert found.count() == 0 and len(centres) == 0 and not rounds


def test_query_on_an_empty_table(spark, tmp_path):
    frame(spark, rows_of()).limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = c.op13_centroid_clustering(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
