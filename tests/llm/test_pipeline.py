import random

import corpus_pipeline
from tessel.llm import mixing
from tests.llm.test_near import classes


def test_run_equals_plain_version(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(3, 8))) for _ in range(500)]
    shared = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(5)]
    docs = {}
    for i in range(400):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(20)) for _ in range(rng.randrange(1, 8)))
        if rng.random() < 0.3:
            text += "\n" + rng.choice(shared)
        docs[i] = text
    for i in range(400, 440):
        docs[i] = docs[i - 400] + " extra"
    docs |= {440: None, 441: "", 442: "too short", 443: "### " * 50, 444: "same words here " * 40}
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t) if t else None, "more") for i, t in docs.items()]
    source = {r[0]: r[3] for r in rows}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: t for i, t in docs.items() if i < 440}
    holders = {}
    for i, t in kept.items():
        for x in t.split("\n"):
            if len(x.strip()) >= 40:
                holders.setdefault(x.strip().lower(), set()).add(i)
    cut = {i: "\n".join(x for x in t.split("\n") if len(holders.get(x.strip().lower(), ())) < 5 or max(holders[x.strip().lower()]) == i) for i, t in kept.items()}
    ids = sorted(cut)
    _, comp = classes([cut[i] for i in ids], 5)
    left = [i for k, i in enumerate(ids) if comp[k] == k]
    df = spark.createDataFrame([(i, cut[i], source[i]) for i in left], "doc_id long, text string, source string")
    want = sorted((r.doc_id for r in mixing.mix(df).collect() for _ in range(r.epochs)))
    assert sorted(r.doc_id for r in got) == want
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256(cut[r.doc_id].encode()).hexdigest() and r.round_trip for r in got)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_df = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert stage(spark, docs_df, str(tmp_path)).columns == docs_df.columns, name
        assert stage(spark, docs_df.limit(0), str(tmp_path)).count() == 0
