import math
import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tessel.llm import quality_classifier as q


def corpus(spark, n=600):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30, 200)))
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "### "), lambda t: " | ".join(t.split())])(text)
        rows.append((i, text, int(not good)))
        labels.append((i, int(good), 0))
    rows += [(n, None, 1), (n + 1, "", 0), (n + 2, "x" * 200_000, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1] for r in labels}


def test_held_out_accuracy(spark, tmp_path):
    docs, labels, truth = corpus(spark)
    model = q.fit(docs, labels)
    got = {r.doc_id: r.score for r in q.scores(docs, model).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == truth[i] for i in out) >= 0.97 * len(out)
    assert got[600] == got[601]
    assert {r[0] for r in docs.filter(q.held_out()).select("doc_id").collect()} & set(truth) == set(out)


def test_scores_do_not_see_labels_of_held_out_rows(spark):
    docs, labels, _ = corpus(spark, 200)
    flipped = labels.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert q.fit(docs, labels) == q.fit(docs, flipped)


def test_without_labels(spark):
    docs, labels, _ = corpus(spark, 40)
    model = q.fit(docs, labels.limit(0))
    assert {r.score for r in q.scores(docs, model).collect()} == {0.5}
    assert q.scores(docs.limit(0), model).count() == 0


def plain_scores(docs, labels, order, per_class):
    """The scores from the method's description: docs {id: text}, labels {id: quality}, order {id: the hash that ranks}."""
    raw = {i: (t or "").encode() for i, t in docs.items()}
    learnt = {q_: [i for i in sorted(labels, key=lambda i: (order[i], i)) if labels[i] == q_ and zlib.crc32(str(i).encode()) % 5][:per_class] for q_ in (0, 1)}
    held = {}
    for label, ids in learnt.items():
        texts = []
        for rank in range(0, len(ids), 2):
            t, rng = raw[ids[rank]], random.Random(rank)
            texts.append([t] if 0 < len(t) <= q.BLOCK else [t[k : k + q.BLOCK] for k in [rng.randrange(len(t) - q.BLOCK + 1) for _ in range(q.PIECES)]] if t else [])
        pieces, size = [], 0
        for k in range(q.PIECES):
            for blocks in texts:
                if k < len(blocks) and size < q.DICT_BYTES:
                    pieces.append(blocks[k])
                    size += len(blocks[k])
        content = b"\n".join(pieces)
        held[label] = zstandard.ZstdCompressionDict(content[-q.DICT_BYTES:] if size >= q.DICT_BYTES else content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held[label].precompute_compress(level=q.LEVEL)

    def size_with(label, t):
        c = zstandard.ZstdCompressor(dict_data=held[label], write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(t[k : k + q.BLOCK])) for k in range(0, len(t), q.BLOCK))

    gap = {i: (size_with(0, t) - size_with(1, t)) / len(t) if t else 0.0 for i, t in raw.items()}
    rows = [(gap[i], label, 1 / len(ids[1::2])) for label, ids in learnt.items() for i in ids[1::2]]
    x, y, w = (np.array(c, float) for c in zip(*rows))
    mean = (w * x).sum() / w.sum()
    sd = math.sqrt((w * (x - mean) ** 2).sum() / w.sum())
    z, beta = np.c_[np.ones(len(x)), (x - mean) / sd], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        beta = beta + np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag([1e-9, 1e-9 + 0.01]), z.T @ (w * (y - p)) - [0, 0.01 * beta[1]])
    return {i: 1 / (1 + math.exp(-(beta[0] + beta[1] * (g - mean) / sd))) for i, g in gap.items()}


def test_scores_equal_a_plain_version(spark):
    """Dictionaries, differences and calibration again, from the description; texts that are empty, very long or repeated among them."""
    docs, labels, truth = corpus(spark, 240)
    order = {r.doc_id: r.h for r in labels.select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("h")).collect()}
    got = {r.doc_id: r.score for r in q.scores(docs, q.fit(docs, labels, per_class=70)).collect()}
    want = plain_scores({r.doc_id: r.text for r in docs.collect()}, truth, order, 70)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_repeated_rows_and_clashing_columns(spark):
    docs, labels, _ = corpus(spark, 120)
    model = q.fit(docs, labels)
    more = docs.union(docs.filter("doc_id < 5")).selectExpr("doc_id", "text", "'x' AS score", "1 AS held_out", "2 AS predicted", "3 AS rank")
    once, twice = ({}, {})
    for into, rows in ((once, q.scores(docs, model)), (twice, q.scores(more, model))):
        for r in rows.collect():
            into.setdefault(r.doc_id, []).append(r.score)
    assert all(twice[i] == once[i] * (2 if i < 5 else 1) for i in once) and q.scores(more, model).columns == ["doc_id", "score"]
    assert q.fit(more, labels).good != b""
