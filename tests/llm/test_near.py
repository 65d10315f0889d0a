import random

import pytest

from tessel.llm import graph, near_dedup
from tests.llm import brute


def classes(texts, k):
    """Brute force, by inverted lists of shingles."""
    sets = [brute.shingles(t, k) for t in texts]
    holders, linked = {}, []
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in holders.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            holders[x].append(i)
        linked += [(j, i) for j, n in near.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)]
    return [len(s) for s in sets], brute.components(len(texts), linked)


def corpus(seed, docs, groups):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    vocabulary = [word() for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n ", "One", "one", "ONE\ttwo", "one two", "É é", "é é", "K k"]
    texts += [" ".join(make(rng.randrange(1, 120))) for _ in range(docs)]
    for size, length, edits in groups:
        base = make(length)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_classes_equal_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 16)
    monkeypatch.setattr(near_dedup, "REST", 24)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    texts = corpus(k, 300, [(2, 60, 4)] * 20 + [(6, 100, 12), (40, 80, 6), (150, 60, 4), (90, 90, 12)])
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_classes(df, k).collect()}
    sizes, comp = classes(texts, k)
    assert [got[i][0] for i in range(len(texts))] == sizes
    assert [got[i][1] for i in range(len(texts))] == comp
    kept = near_dedup.keep_one_of_each(df, k)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A B C")], "doc_id long, text string")
    rows = near_dedup.near_classes(df, 2).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in near_dedup.keep_one_of_each(df, 2).collect()) == ["1", "None"]
    assert near_dedup.near_classes(df.limit(0), 2).count() == 0


def test_texts_that_share_an_id(spark):
    """Each is judged by its own text, and one row of each class stays, the same whatever the partitions."""
    a, b = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLM123456789")
    texts = [(1, " ".join(a), "x"), (1, " ".join(b), "y"), (2, " ".join(a) + " more", "x"), (3, " ".join(b) + " more", "z"), (4, " ".join(b), "z"), (5, "of its own, this one", "z"), (1, " ".join(b), "a")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_classes(df, 2).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]
    kept = [sorted(map(tuple, near_dedup.keep_one_of_each(x, 2).collect())) for x in (df, df.repartition(3))]
    assert kept[0] == kept[1] == sorted([texts[0], texts[6], texts[5]])


def rows_met(df, monkeypatch):
    """The rows that groups are handed for df."""
    n, grouped = [], near_dedup.grouped
    monkeypatch.setattr(near_dedup, "grouped", lambda rows, *a: n.append(rows.count()) or grouped(rows, *a))
    assert near_dedup.near_classes(df, 2).select("component_id").distinct().count() < 10
    monkeypatch.setattr(near_dedup, "grouped", grouped)
    return sum(n)


def test_rows_are_linear_in_a_cluster(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    copy = lambda: " ".join(rng.choice(base) + "x" if rng.random() < 0.01 else w for w in base)
    df = spark.createDataFrame([(i, copy()) for i in range(4000)], "doc_id long, text string").repartition(4)
    small, large = rows_met(df.filter("doc_id < 1000"), monkeypatch), rows_met(df, monkeypatch)
    assert large < 5 * small


@pytest.mark.parametrize("node", [16, 4096])
def test_first_level_is_made_once(spark, monkeypatch, node):
    """Whether nodes are large or small, one plan alone makes the rows of the first level, TREES for each representative."""
    plans, tables, saved = [], {}, near_dedup.Saved

    def spy(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        tables[name] = saved(df, name)
        return tables[name]

    monkeypatch.setattr(near_dedup, "NODE", node)
    monkeypatch.setattr(near_dedup, "Saved", spy)
    monkeypatch.setattr(graph, "Saved", spy)
    df = spark.createDataFrame(list(enumerate(corpus(5, 50, [(60, 80, 3)]))), "doc_id long, text string")
    near_dedup.near_classes(df, 2).collect()
    assert (tables["nodes"].df.count() > 0) == (node == 16)
    assert sum(p.count("explode(transform(roots") for p in plans) == 1
    assert tables["roots"].df.count() == near_dedup.TREES * tables["reps"].df.count()


def test_components(spark):
    rng = random.Random(1)
    assert graph.components(spark.createDataFrame([(None, 1), (1, None), (2, 2)], "a long, b long")).count() == 0
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute.components(301, [(a, b) for a, b in pairs])
    ends = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {i: want[i] for i in ends}


def test_rounds_of_components_shuffle_twice(spark, monkeypatch):
    """A small table takes two shuffles a round, with no pass of its own that looks whether the round was the last."""
    plans, saved = [], graph.Saved
    monkeypatch.setattr(graph, "Saved", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(i, i + 1) for i in range(20)] + [(30, 40), (31, 40), (31, 31)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 30 for i in (30, 31, 40)}
    assert max(p.count("Exchange") for p in plans) <= 2 and plans[0].count("Exchange") == 0
    monkeypatch.setattr(graph, "HOT", 1)
    assert {r.node: r.component for r in graph.components(links).collect()} == got
