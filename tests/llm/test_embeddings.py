import numpy as np
import pyarrow as pa

from tessel.llm import embedding_dedup as e
from tests.llm import brute


def exact(rows):
    ok = lambda x: x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)
    use = [i for i, (_, x, label) in enumerate(rows) if label is not None and ok(x)]
    unit = {i: np.array(rows[i][1], "f8") / np.linalg.norm(np.array(rows[i][1], "f8")) for i in use}
    pairs = [(i, j) for k, i in enumerate(use) for j in use[k + 1 :] if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    links = [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    return links, brute.components(len(rows), pairs)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 50)
    monkeypatch.setattr(e, "PIVOT", 20)
    rng = np.random.default_rng(2)
    rows = [[float(v) for v in x] for x in rng.standard_normal((700, 16))]
    labels = [int(v) for v in rng.integers(0, 3, 700)]
    for size, noise in [(2, 0.1)] * 30 + [(5, 0.3), (130, 0.06), (20, 0.25)]:
        base = rng.standard_normal(16)
        base /= np.linalg.norm(base)
        label = int(rng.integers(0, 3))
        for _ in range(size):
            rows.append([float(v) for v in np.float32(base + noise * rng.standard_normal(16) / 4)])
            labels.append(label)
    rows += [rows[0], rows[0], None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1e308] * 16, [1.0] * 8, [2.0] * 8]
    labels += [labels[0], labels[0], 1, 1, 1, 1, 1, 1, 1, 1]
    rows += [rows[1]]
    labels += [None]
    data = [(i, x, label) for i, (x, label) in enumerate(zip(rows, labels))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in e.near_duplicates(df).collect()}
    links, comp = exact(data)
    wrong = [i for i in range(len(data)) if got[i] != (links[i], comp[i])]
    assert len(got) == len(data) and not wrong, [(i, got[i], links[i], comp[i]) for i in wrong[:10]]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, cell string")
    assert e.near_duplicates(df).count() == 0


def bridged(rng, n, d=32):
    """Two groups of n copies at a cosine of 0.999 or so within; one link, at 0.934, joins them: between the first of each."""
    a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
    at = lambda degrees: np.cos(np.radians(degrees)) * a + np.sin(np.radians(degrees)) * b
    copies = lambda centre: centre + 0.02 * rng.standard_normal((n - 1, d)) / np.sqrt(d)
    return np.r_[[at(8.5)], copies(at(0)), [at(29.4)], copies(at(38))]


def outcome(spark, x):
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
    return {r.vec_id: (r.n_links, r.component_id) for r in e.near_duplicates(df).collect()}


def test_a_link_between_full_groups(spark):
    got = outcome(spark, bridged(np.random.default_rng(5), 300))
    assert {c for _, c in got.values()} == {0}
    assert got[0][0] == got[300][0] == 300 and got[1][0] == got[301][0] == 299


def test_a_hot_group_hides_no_link(spark):
    """A group of 1,500 copies beside it, which holds nearly all pairs, and no sample that could miss the one link."""
    rng = np.random.default_rng(6)
    x = np.r_[bridged(rng, 100), rng.standard_normal(32) + 0.02 * rng.standard_normal((1500, 32))]
    got = outcome(spark, x)
    assert {got[i][1] for i in range(200)} == {0} and {got[i] for i in range(200, 1700)} == {(1499, 200)}


def nodes_of(spark, x):
    rows = [(i, 1, (np.array(v) / np.linalg.norm(v)).tobytes()) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "rep long, cell long, vec binary").repartition(3)


def test_no_links_end_after_the_descent(spark):
    """Where nothing is linked, an audit says so and the descent ends."""
    parts, audits = e.descend(nodes_of(spark, np.random.default_rng(7).standard_normal((400, 32))), 0.93)
    assert len(audits) == 1 and audits[0].linked == 0 and audits[0].recall is None and 0 < audits[0].asked < 300
    assert parts.filter("rep <> part").count() == 0


def test_audits_that_fail_lead_on(spark, monkeypatch):
    """A descent whose orders compare nothing lives by what audits find: each that fails joins components, and the next asks others."""
    monkeypatch.setattr(e, "AUDIT", 4)
    monkeypatch.setattr(e, "_ordered", lambda nodes, seed, threshold: spark.createDataFrame([], e._EDGE))
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((120, 32))
    x = np.repeat(centres, 3, axis=0) + 0.02 * rng.standard_normal((360, 32))
    parts, audits = e.descend(nodes_of(spark, x), 0.93)
    got = {r.rep: r.part for r in parts.collect()}
    assert len(audits) > 1 and all(a.missed for a in audits[:-1]) and max(a.asked for a in audits) < 150 and audits[-1].recall >= e.TARGET
    assert sum(got[i] == i - i % 3 for i in range(360)) >= 0.9 * 360


def clustered(n):
    """n vectors of which a quarter are linked: pairs and chains between 0.93 and 0.97, and a cloud."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    pairs = n // 10
    x[1 : 2 * pairs : 2] = x[0 : 2 * pairs : 2] + 0.3 * rng.standard_normal((pairs, 64))
    cloud = slice(2 * pairs, 2 * pairs + n // 20)
    x[cloud] = x[2 * pairs] + 0.2 * rng.standard_normal((n // 20, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_and_pairs_at_two_sizes(spark, monkeypatch):
    """Linked vectors are found, no audit asks more than its share, and compared pairs grow little faster than the rows."""
    pairs, met, grouped, ordered = [], [], e.grouped, e._ordered

    def counted(df, key, *more):
        if key == "group":
            met.append(df.groupBy(key).count().selectExpr("sum(count * (count - 1) / 2)").first()[0] or 0)
        return grouped(df, key, *more)

    monkeypatch.setattr(e, "grouped", counted)
    monkeypatch.setattr(e, "_ordered", lambda nodes, *more: (met.append(nodes.count() * e.ORDERS * e.AHEAD), ordered(nodes, *more))[1])
    for n in (1500, 6000):
        x, before = clustered(n), len(met)
        df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
        out = e.linked(df)
        got = {r.vec_id: r.n_links for r in out.rows.collect()}
        want = ((x @ x.T) >= 0.93).sum(axis=1) - 1
        has = np.flatnonzero(want)
        assert len(has) > n / 5 and np.mean([got[i] == want[i] for i in has.tolist()]) >= 0.99 and all(got[i] == 0 for i in np.flatnonzero(want == 0).tolist())
        assert max(a.asked for a in out.audits) < 1.2 * e.AUDIT * n**0.5 and out.audits[-1].recall >= e.TARGET
        pairs.append(sum(met[before:]))
    assert pairs[0] > 10 * 1500 and np.log(pairs[1] / pairs[0]) / np.log(4) < 1.3


def test_repeated_ids_share_the_outcome(spark):
    """Rows that share a vec_id have its larger count and smaller component."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (4, [0.5, 0.5], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in e.near_duplicates(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_the_core_needs_no_pairs(spark, monkeypatch):
    """A tight group is counted without a comparison."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal(32) + 0.1 * rng.standard_normal((1500, 32))
    monkeypatch.setattr(e, "_counts", lambda threshold: lambda t: [t.column("rep"), pa.array([10**6] * t.num_rows)])
    reps = nodes_of(spark, x).selectExpr("rep", "vec", "1L as copies")
    got = {r.n for r in e.link_counts(reps, reps.selectExpr("rep", "0L as part"), 0.93).collect()}
    assert got == {1499}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, "x", 3), (2, [1.0, 0.1], 1, "y", 4), (3, [0.0, 1.0], 1, None, None)], "vec_id long, embedding array<double>, label int, cell string, part int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in e.near_duplicates(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
