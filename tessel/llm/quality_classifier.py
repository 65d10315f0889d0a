"""Quality classifier by compression: a text is good if a dictionary built from good texts compresses it better than one built from bad texts.

Two zstandard dictionaries are filled with pieces of labelled texts. Every whole text is cut in blocks of BLOCK bytes, which are
compressed each by itself with either dictionary, so that a long text is judged by the dictionaries and not by its own
beginning. The difference of the two sizes for each byte of the text, centred and scaled by a logistic fit to labelled texts that filled no
dictionary, is the score.

The fit reads a bounded sample: at most per_class texts of each label, those whose hashed ids come first. Half of them fill the
dictionaries: PIECES blocks each from all over the text are fetched, and blocks are taken text by text in turn until a dictionary
holds DICT_BYTES, so with texts of a block or more some 190 texts give one block each; the others calibrate, each with its whole text, and hand the driver
a number each. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have no difference and get the calibration's score for 0; a table without labels, or with
one label only (or one text of a label), gives every text the score 0.5; repeated rows are scored alike; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import table

BLOCK = 512
PIECES = 16
DICT_BYTES = 96 * 1024
LEVEL = 9


@dataclass(frozen=True)
class Model:
    """The two dictionaries and the calibration: score = 1 / (1 + exp(-(a + b * difference)))."""

    good: bytes
    bad: bytes
    a: float
    b: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        pack = lambda d: zstandard.ZstdCompressor(dict_data=_prepared(d), write_content_size=False, write_dict_id=False).compress
        self.with_good, self.with_bad = pack(model.good), pack(model.bad)

    def difference(self, text: str | None) -> float:
        """Bytes saved by the good dictionary against the bad one, for each byte of the text."""
        raw = (text or "").encode()
        if not raw or not self.model.good:
            return 0.0
        g = b = 0
        for k in range(0, len(raw), BLOCK):
            part = raw[k : k + BLOCK]
            g += len(self.with_good(part))
            b += len(self.with_bad(part))
        return (b - g) / len(raw)

    def score(self, text: str | None) -> float:
        z = self.model.a + self.model.b * self.difference(text)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _prepared(content: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return d


def _dictionary(texts: list[list[bytes]]) -> bytes:
    """Raw content: blocks of many texts in turn, so that no single text fills it."""
    parts, size = [], 0
    for k in range(PIECES):
        for blocks in texts:
            if k < len(blocks):
                parts.append(blocks[k])
                size += len(blocks[k])
                if size >= DICT_BYTES:
                    return b"\n".join(parts)[-DICT_BYTES:]
    return b"\n".join(parts)


def _logistic(xs: list[float], ys: list[int], weights: list[float]) -> tuple[float, float]:
    """Newton's method with a small ridge on the slope, over standardised differences."""
    n = sum(weights)
    mean = sum(w * x for x, w in zip(xs, weights)) / n
    sd = math.sqrt(sum(w * (x - mean) ** 2 for x, w in zip(xs, weights)) / n) or 1.0
    a = b = 0.0
    for _ in range(50):
        g0 = g1 = h01 = 0.0
        h00 = h11 = 1e-9
        for x, y, w in zip(xs, ys, weights):
            z = (x - mean) / sd
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * z))))
            g0 += w * (y - p)
            g1 += w * (y - p) * z
            v = w * p * (1 - p)
            h00 += v
            h01 += v * z
            h11 += v * z * z
        g1 -= 0.01 * b
        h11 += 0.01
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a - b * mean / sd, b / sd


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(rank, quality, text) of at most per_class labelled texts of each label, ranked by hashed id, which reruns repeat."""
    own = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality").withColumn("_h", F.xxhash64(F.lit(11), "doc_id"))
    picked = [r for label in (0, 1) for r in enumerate(own.filter(F.col("quality") == label).orderBy("_h", "doc_id").limit(per_class).collect())]
    # 2 * per_class ids at most: a proven bound for the broadcast
    ids = docs.sparkSession.createDataFrame([(k, r["doc_id"], r["quality"]) for k, r in picked], "rank int, _id bigint, quality int")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("rank", "quality", "text")


def _blocks(raw: bytes, rank: int) -> list[bytes]:
    """PIECES blocks from seeded places all over a text, all of it if it is short."""
    rng = random.Random(rank)
    if len(raw) <= BLOCK:
        return [raw] if raw else []
    return [raw[k : k + BLOCK] for k in (rng.randrange(len(raw) - BLOCK + 1) for _ in range(PIECES))]


def _pieces(rows: DataFrame) -> list[tuple[int, int, list[bytes]]]:
    """(quality, rank, blocks) in order; a bound number of blocks of each text reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column("text")]
            made = [_blocks(t, r) for t, r in zip(texts, batch.column("rank").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("rank"), pa.array(made, pa.list_(pa.binary()))], ["quality", "rank", "blocks"])

    found = rows.mapInArrow(run, "quality int, rank int, blocks array<binary>").collect()
    return sorted((r["quality"], r["rank"], [bytes(b) for b in r["blocks"]]) for r in found)


def _differences(rows: DataFrame, model: Model) -> list[tuple[int, int, float]]:
    """(quality, rank, difference) in order, each from a whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            out = pa.array([scorer.difference(x.as_py()) for x in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("rank"), out], ["quality", "rank", "difference"])

    return sorted(map(tuple, rows.mapInArrow(run, "quality int, rank int, difference double").collect()))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """per_class bounds the labelled texts of each label that are read; those of even rank fill the dictionaries, the others calibrate with their whole texts."""
    rows = labelled(docs, labels, per_class)
    filled = _pieces(rows.filter("rank % 2 = 0"))
    own = {label: [b for q, _, b in filled if q == label and b] for label in (0, 1)}
    if not all(own.values()):
        return Model(b"", b"", 0.0, 0.0)
    model = Model(_dictionary(own[1]), _dictionary(own[0]), 0.0, 1.0)
    data = _differences(rows.filter("rank % 2 = 1"), model)
    n = {label: sum(q == label for q, _, _ in data) for label in (0, 1)}
    if not all(n.values()):
        return Model(b"", b"", 0.0, 0.0)
    # each label has the same weight: the score does not depend on how many of each the sample holds
    a, b = _logistic([x for _, _, x in data], [q for q, _, _ in data], [1 / n[q] for q, _, _ in data])
    return Model(model.good, model.bad, a, b)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double) of every row, from its whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            out = pa.array([scorer.score(x.as_py()) for x in batch.column(text_col)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), out], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
