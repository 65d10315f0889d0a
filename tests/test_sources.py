"""Files are read as they were written; synthetic data repeats; a stream moves centres as a batch does."""

from dataclasses import replace

import numpy as np
import pytest

from tessel.operators import cluster, features, hmm, mixture, neural
from tessel.sources import models, synthetic, text
from tessel.streaming.online_kmeans import OnlineCentres


def test_vectors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2.5  -3e1\n\n4 5 6\n")
    (tmp_path / "b.txt").write_text("7\t8 9\n")
    (tmp_path / "index").write_text(f"{tmp_path}/a.txt\n{tmp_path}/b.txt\n")
    got = sorted(r.features for r in text.read_index(spark, str(tmp_path / "index")).collect())
    assert got == [[1.0, 2.5, -30.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]
    data = text.read_vectors(spark, str(tmp_path / "a.txt"))
    assert sum(r.n for r in text.as_arrays(text.blocks(data, 3, ["features"])).selectExpr("size(features) as n").collect()) == 2


def test_table_percentiles_metadata(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b\n1;x y\n;z\n")
    assert [tuple(r) for r in text.read_table(spark, str(tmp_path / "t.csv"), "a int, b string").collect()] == [(1, "x y"), (None, "z")]
    (tmp_path / "p.txt").write_text("h\nh\nh\n0 1.0\n1 1.0\n2 0.5\n3 2.5\n4 3\n")
    assert [r.value for r in text.read_percentiles(spark, str(tmp_path / "p.txt")).orderBy("line").collect()] == [1.0, 2.5, 3.0]
    metas = [features.Meta("a b", features.CATEGORICAL, ("<empty>",), None, None, 2, ("x y", "z")), features.Meta("n", features.PERCENTILES, (-11.0,), None, None, 3, (0.1, 0.25, 7.0))]
    text.write_metadata(str(tmp_path / "m"), metas)
    assert text.read_metadata(str(tmp_path / "m")) == metas
    df = spark.createDataFrame([([1.0, 2.0], [0.5])], "x array<double>, y array<double>")
    text.write_encoded(df, str(tmp_path / "rows"))
    assert [r.value for r in spark.read.text(str(tmp_path / "rows")).collect()] == ["1.000000 2.000000 0.500000"]


def test_models(spark, tmp_path):
    m = mixture.Mixture("full", np.array([0.25, 0.75]), np.array([[1.0, 2.0], [3.0, 4.0]]), np.array([[[2.0, 0.5], [0.5, 1.0]], np.eye(2)]))
    path = models.save_mixture(m, str(tmp_path / "gmm"))
    models.save_mixture(m, str(tmp_path / "gmm"))
    back = models.load_mixture(path)
    assert np.allclose(back.sigma, m.sigma) and np.allclose(back.priors, m.priors) and (tmp_path / "gmm-0002.bak").exists()
    assert np.array_equal(mixture.Mixture.from_df(m.to_df(spark), "full").sigma, m.sigma)
    for h in (hmm.discrete(3, 4, seed=1), hmm.continuous(np.array([[0.5, 1.0], [2.0, 3.0]]))):
        models.save_hmm(h, str(tmp_path / "h"))
        got = models.load_hmm(str(tmp_path / "h"))
        assert np.allclose(got.transitions, h.transitions) and np.allclose(got.initial, h.initial)
        assert np.allclose(got.emissions, h.emissions) if h.emissions is not None else np.allclose(got.mixtures[1].mu, h.mixtures[1].mu)
    c = cluster.Clusters(np.array([[1.0, 2.0]]), 3.0, 4)
    models.save_clusters(c, None)
    assert models.load_clusters(str(tmp_path / "none")) is None
    models.save_clusters(c, str(tmp_path / "c"))
    assert np.array_equal(models.load_clusters(str(tmp_path / "c")).centres, c.centres)
    net = neural.network((3, 4, 2), ("tanh", "softmax"))
    models.save_network(net, str(tmp_path), "best")
    back = models.load_network("network", str(tmp_path))
    x = np.ones((2, 3))
    assert np.array_equal(back.output(x), net.output(x)) and models.load_network("other", str(tmp_path)) is None


def test_chains_in_files_of_their_own(tmp_path):
    b = np.array([[0.7, 0.3], [0.2, 0.8], [0.5, 0.5]])
    one = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), b[[0, 1]], name="one", state_names=("shared", "left"))
    two = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.5, 0.5], [0.2, 0.8]]), b[[0, 2]], name="two", state_names=("shared", "right"))
    r = hmm.registry(one, two).indexed()
    paths = [str(tmp_path / n) for n in ("transitions", "states", "chains")]
    models.save_registry(r, paths[1], paths[0], paths[2])
    assert open(paths[1]).read().count("<GINDEX>") == 3 and "~h" not in open(paths[1]).read() and "<TRANSP>" not in open(paths[2]).read()
    back = models.load_registry(*paths)
    assert {n: s.index for n, s in back.states.items()} == {"left": 0, "right": 1, "shared": 2} and back.chains == r.chains
    for h in (one, two):
        got = back.model(h.name)
        assert np.allclose(got.emissions, h.emissions) and np.allclose(got.transitions, h.transitions) and np.allclose(got.initial, h.initial) and got.state_names == h.state_names
    lr = hmm.continuous(np.array([[0.5, 1.0], [2.0, 3.0]]), left_to_right=True)
    models.save_hmm(lr, str(tmp_path / "lr"))
    again = models.load_hmm(str(tmp_path / "lr"), left_to_right=True)
    assert np.allclose(again.transitions, lr.transitions) and np.allclose(again.mixtures[1].mu, lr.mixtures[1].mu) and "<STATE> 2" in open(tmp_path / "lr").read()


@pytest.mark.parametrize("line", ["num_layers 2", "alpha_tanh 1.0", "beta_tanh 0.5", "olr_iterations 3"])
def test_keys_that_cannot_act_are_refused(tmp_path, line):
    text_ = "num_layers 3\nalpha_tanh 1.7159\nbeta_tanh 0.666667\nolr_iterations -1\nlayer 4 linear 1.0 0.1\nlayer 8 tanh 0.5 0.2\nlayer 2 softmax 1.0 0.3\n"
    (tmp_path / "n.cfg").write_text(text_)
    assert len(models.read_network_config(str(tmp_path / "n.cfg")).layers) == 2
    (tmp_path / "n.cfg").write_text(text_ + line + "\n")
    with pytest.raises(ValueError):
        models.read_network_config(str(tmp_path / "n.cfg"))


def test_network_config(tmp_path):
    (tmp_path / "n.cfg").write_text("# a network\nnum_layers 3\nlearning_rate 0.05\nadd_noise False\nlayer 4 linear 1.0 0.1\nlayer 8 tanh 0.5 0.2 0.01\nlayer 2 softmax 1.0 0.3\n")
    net = models.read_network_config(str(tmp_path / "n.cfg"))
    assert [(k, a, b) for _, k, a, b, _ in net.topology()] == [("tanh", 4, 8), ("softmax", 8, 2)]
    assert net.layers[0].learning_rate == 0.2 and net.layers[0].keep == 0.5 and net.settings.add_noise is False
    (tmp_path / "bad.cfg").write_text("nothing 3\n")
    with pytest.raises(ValueError):
        models.read_network_config(str(tmp_path / "bad.cfg"))


def test_synthetic_is_seeded(spark):
    a, none = synthetic.normals(spark, 3, 2, 50, 0, 5.0, 1.0, 7)
    b, test = synthetic.normals(spark, 3, 2, 50, 10, 5.0, 1.0, 7)
    assert none is None and test.count() == 30
    assert sorted(map(tuple, (r.features for r in a.collect()))) == sorted(map(tuple, (r.features for r in b.repartition(5).collect())))


def test_stream_moves_centres_like_one_pass(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=2)]) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "id long, features array<double>").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    online = OnlineCentres(3, 2)
    for k in range(3):
        online.update(spark.read.parquet(str(tmp_path / "in" / f"p{k}")), k)
        online.update(spark.read.parquet(str(tmp_path / "in" / f"p{k}")), k)
    whole = cluster.online(spark.createDataFrame(rows, "id long, features array<double>"), 3)
    assert np.allclose(online.centres, whole.centres)
    stream = spark.readStream.schema("id long, features array<double>").parquet(str(tmp_path / "in" / "*"))
    other = OnlineCentres(3, 2)
    q = other.start(stream, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert other.counts.sum() == 60


def test_blocks_hold_so_many_rows(spark):
    data = spark.createDataFrame([(i, [float(i)]) for i in range(103)], "id long, features array<double>").repartition(6)
    first, again = (sorted(tuple(r) for r in text.blocks(d, 10).select("block", "place", "id").collect()) for d in (data, data.repartition(2)))
    assert first == again and [(b, p) for b, p, _ in first] == [(i // 10, i % 10) for i in range(103)] and {i for *_, i in first} == set(range(103))
    arrays = {r.block: [x[0] for x in r.features] for r in text.as_arrays(text.blocks(data, 10)).collect()}
    assert arrays == {b: [float(i) for x, _, i in first if x == b] for b in range(11)}


def test_three_phases_over_files(spark, tmp_path, monkeypatch):
    from tessel import encode

    data = tmp_path / "data.csv"
    data.write_text("x;c;y\n" + "".join(f"{i / 4};{'abc'[i % 3]};{'no' if i % 5 else 'yes'}\n" for i in range(60)))
    first, refined, target, out = (str(tmp_path / n) for n in ("first", "refined", "target", "out"))
    encode.main(["--phase", "1", "--data", str(data), "--output-metadata", first])
    proposed = {m.name: m for m in text.read_metadata(first)}
    assert {k: m.type for k, m in proposed.items()} == {"x": features.RANGE, "c": features.CATEGORICAL, "y": features.CATEGORICAL}
    text.write_metadata(first, [replace(proposed["x"], type=features.STANDARD), proposed["c"]])
    encode.main(["--phase", "2", "--data", str(data), "--input-metadata", first, "--output-metadata", refined])
    text.write_metadata(target, [replace(proposed["y"], values=("yes",))])
    encode.main(["--phase", "3", "--data", str(data), "--input-metadata", refined, "--output-metadata", target, "--output", out])
    lines = [r[0].split() for r in spark.read.text(out).collect()]
    assert len(lines) == 12 and all(len(x) == 5 and sorted(x[1:4]) == ["0.000000", "0.000000", "1.000000"] and x[4] == "1.000000" for x in lines)
    # the same with a dictionary instead of a list
    (many,) = features.explore(text.read_table(spark, str(data)), ["c"], inline=1, folder=str(tmp_path / "kept"))
    text.write_metadata(refined, [text.read_metadata(refined)[0], many])
    assert text.read_metadata(refined)[1].values == many.values
    encode.main(["--phase", "3", "--data", str(data), "--input-metadata", refined, "--output-metadata", target, "--output", out + "-sparse"])
    sparse = sorted(r[0] for r in spark.read.text(out + "-sparse").collect())
    assert len(sparse) == 12 and all(line.endswith(" | 0:1.000000") and len(line.split(" | ")[0].split()) == 2 for line in sparse)
    with pytest.raises(SystemExit):
        encode.main(["--phase", "3", "--data", str(data), "--output-metadata", target])
