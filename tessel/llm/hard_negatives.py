"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidates are ordered by length, label and the place of their vector on a Hilbert curve through all dimensions, numbered, and cut in blocks of BLOCK rows of one label.
A block is a row of a Parquet table: its ids and vectors, and its zone map, which is the least and greatest value by dimension. Zone maps are read without the vectors, being columns of their own.

Interval arithmetic on a zone map bounds the inner product of an anchor with all rows of a block. Anchors go in groups of near ones, and a pass over (group, chunk of zone maps)
chooses the blocks that each anchor must read:

* for its positives, blocks of its label whose upper bound reaches the score that is sure for the last place: the anchor's own block gives one, so does the lower bound of any block
  with enough rows;
* for its negatives, blocks of other labels whose interval meets one of its windows [from, to] of scores, above the lower bound of a block that lies in the window with rows for all its places.

A second pass reads the chosen blocks, (group, span of blocks) by (group, span), with a mask of the anchors that need each, and keeps the best of every anchor and window; those of all spans are ranked in the end.
Groups, chunks and spans have bounded numbers of rows, whatever is common. Nothing is left out: what a bound excludes cannot be in the result.

Defined results: rows with a null vec_id or label, a null vector or a null or non-finite component take no part; vectors of other lengths are no candidates of an anchor, nor are empty vectors;
components are held to +-2 ** 26 after the floor; repeated rows count as rows each, an anchor being no positive of itself but one of a row that shares its vec_id; a positive score below zero
leaves an empty window; an anchor without positives or negatives has no rows; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import Saved, table
from tessel.llm.groups import grouped
from tessel.plans.tables import running_sum

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
ANCHOR, RELABEL, LABELS = 100, 7, 10
LIMIT = 1 << 26
#: Rows of a block; places in the order that a group of anchors comes from, a hundredth of which are anchors; blocks of a chunk of zone maps, and of a span that is read at least and at most.
BLOCK, GROUP, CHUNK, LEAST_SPAN, MOST_SPAN = 512, 204_800, 512, 4, 64
CURVE_BITS = 4
_NONE = np.iinfo(np.int64).min


def hilbert(cells: np.ndarray, bits: int) -> list[bytes]:
    """For rows of cells, integers below 2 ** bits by dimension, their places on the Hilbert curve, as bytes that sort like them. By Skilling's transposition of Gray codes."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.int64), top
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).reshape(bits * n, -1).T
    return [r.tobytes() for r in np.packbits(planes.astype(np.uint8), axis=1)]


def candidates(vectors: DataFrame) -> DataFrame:
    """(id, label, dim, key, vec) of the rows that take part: labels as they count, vec the floors of 256 times the components, key the place on the curve."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    held = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), v * 256))).cast("int"))
    label = F.col("label").cast("bigint")
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & sound).select(
        F.col("vec_id").cast("bigint").alias("id"), F.when(F.col("vec_id") % RELABEL == 0, (label + 1) % LABELS).otherwise(label).alias("label"), held.alias("x"))
    low, high = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if low is None:
        low = high = 0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            starts, flat = np.r_[0, np.cumsum(sizes)], lists.flatten().to_numpy()
            keys, vecs = [b""] * len(lists), [flat[a:b].astype(np.int32).tobytes() for a, b in zip(starts, starts[1:])]
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = np.stack([flat[a : a + d] for a in starts[at]])
                cells = (x.astype(np.int64) - low) * (1 << CURVE_BITS) // (high - low + 1)
                for i, k in zip(at.tolist(), hilbert(cells, CURVE_BITS)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "label", "dim", "key", "vec"])

    return rows.mapInArrow(keyed, "id bigint, label bigint, dim int, key binary, vec binary")


def _ints(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.int32).reshape(-1, dim).astype(np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: by doubles where these hold every sum."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of a with any vector between low and high, a column for each zone."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return _products(up, low) + _products(down, high), _products(up, high) + _products(down, low)


def _placed(rows: DataFrame) -> DataFrame:
    """rows with at, their numbers from 0 in the order of length, label and curve."""
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id()).withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(numbered, ["dim", "label", "key", "id", "_tie"], "_one", "_n").select("id", "label", "dim", "vec", (F.col("_n") - 1).alias("at"))


def blocks_of(placed: DataFrame) -> DataFrame:
    """(block, dim, label, n, ids, ats, vecs, low, high): blocks of rows of one label and length. block is the place of the first row; rows are in order of id."""
    same = F.xxhash64("dim", "label", F.floor(F.col("at") / F.lit(BLOCK)))

    def build(t: pa.Table) -> list[pa.Array]:
        # rows of two labels cannot meet under one key unless hashes do; each label then makes its own block
        out = []
        label, dims = t.column("label").to_numpy(), t.column("dim").to_numpy()
        for of, d in sorted(set(zip(label.tolist(), dims.tolist()))):
            rows = t.take(pa.array(np.flatnonzero((label == of) & (dims == d))))
            ids, at = rows.column("id").to_numpy(), rows.column("at").to_numpy()
            order = np.lexsort((at, ids))
            x = _ints(b"".join(rows.column("vec").to_pylist()), d)[order]
            out.append((int(at.min()), d, of, len(x), ids[order].tobytes(), at[order].tobytes(), x.astype(np.int32).tobytes(), x.min(axis=0).astype(np.int32).tobytes(), x.max(axis=0).astype(np.int32).tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return [pa.array(c, k) for c, k in zip(zip(*out), kinds)]

    names = ["block", "dim", "label", "n", "ids", "ats", "vecs", "low", "high"]
    return grouped(placed.withColumn("key", same), "key", build, names, "block bigint, dim int, label bigint, n int, ids binary, ats binary, vecs binary, low binary, high binary")


def anchors_of(blocks: DataFrame) -> DataFrame:
    """(at, id, label, dim, vec, sure): the anchors, with a score that their last positive is sure to reach, which their own block tells."""
    names = ["at", "id", "label", "dim", "vec", "sure"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                d, label = batch.column("dim")[k].as_py(), batch.column("label")[k].as_py()
                ids, ats = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in ("ids", "ats"))
                mine = np.flatnonzero(ids % ANCHOR == 0)
                if not len(mine):
                    continue
                x = _ints(batch.column("vecs")[k].as_py(), d)
                scores = _products(x[mine], x)
                scores[np.arange(len(mine)), mine] = _NONE
                sure = np.sort(scores, axis=1)[:, -POSITIVES] if len(x) > POSITIVES else np.full(len(mine), _NONE)
                yield pa.RecordBatch.from_arrays([pa.array(ats[mine]), pa.array(ids[mine]), pa.array([label] * len(mine), pa.int64()), pa.array([d] * len(mine), pa.int32()), pa.array([x[i].astype(np.int32).tobytes() for i in mine], pa.binary()), pa.array(sure)], names)

    return blocks.select("block", "dim", "label", "ids", "ats", "vecs").mapInArrow(run, "at bigint, id bigint, label bigint, dim int, vec binary, sure bigint")


def groups_of(anchors: DataFrame) -> DataFrame:
    """(g, dim, ats, labels, sure, vecs): groups of anchors of one length that are near in the order."""
    def build(t: pa.Table) -> list[pa.Array]:
        out, dims = [], t.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            rows = t.take(pa.array(np.flatnonzero(dims == d)))
            at = rows.column("at").to_numpy()
            order = np.argsort(at)
            blob = lambda c: rows.column(c).to_numpy()[order].tobytes()  # noqa: B023, E731
            out.append((int(at.min()), d, blob("at"), blob("label"), blob("sure"), _ints(b"".join(rows.column("vec").to_pylist()), d)[order].astype(np.int32).tobytes()))
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return [pa.array(c, k) for c, k in zip(zip(*out), kinds)]

    keyed = anchors.withColumn("key", F.xxhash64("dim", F.floor(F.col("at") / F.lit(GROUP))))
    return grouped(keyed, "key", build, ["g", "dim", "ats", "labels", "sure", "vecs"], "g bigint, dim int, ats binary, labels binary, sure binary, vecs binary")


def windows_of(positive_scores: np.ndarray, sure: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last score of the negatives of each positive; an empty window where the positive's score is below zero or missing."""
    from_, to = -((-LOW * positive_scores) // 100), HIGH * positive_scores // 100
    none = ~sure | (positive_scores < 0)
    return np.where(none, 1, from_), np.where(none, 0, to)


def _chosen(negatives: bool):
    """Of a group and a chunk of zone maps, (g, block, need): the blocks that anchors must read, need being the mask of these."""
    def fn(t: pa.Table) -> list[pa.Array]:
        side = t.column("side").to_numpy()
        g, zones = t.take(pa.array(np.flatnonzero(side == 0))), t.take(pa.array(np.flatnonzero(side == 1)))
        if not g.num_rows or not zones.num_rows:
            return _no_choice()
        dim = g.column("dim")[0].as_py()
        anchor, own = _ints(g.column("vecs")[0].as_py(), dim), np.frombuffer(g.column("labels")[0].as_py(), np.int64)
        low, high = (_ints(b"".join(zones.column(c).to_pylist()), dim) for c in ("low", "high"))
        n, label = zones.column("n").to_numpy(), zones.column("label").to_numpy()
        block = zones.column("block").to_numpy()
        need = np.zeros((len(block), len(anchor)), bool)
        for a in range(0, len(anchor), 512):
            cut = slice(a, a + 512)
            least, most = _bounds(anchor[cut], low, high)
            same = own[cut][:, None] == label
            if negatives:
                need[:, cut] = _meets(np.frombuffer(g.column("more")[0].as_py(), np.int64).reshape(2, len(anchor), POSITIVES)[:, cut], least, most, same, n).T
            else:
                # a block of the label with a row for each positive and the anchor tells what is sure
                told = np.where(same & (n > POSITIVES), least, _NONE).max(axis=1)
                sure = np.maximum(np.frombuffer(g.column("more")[0].as_py(), np.int64)[cut], told)
                need[:, cut] = (same & (most >= sure[:, None])).T
        some = need.any(axis=1)
        return [pa.array([g.column("g")[0].as_py()] * int(some.sum()), pa.int64()), pa.array(block[some]), pa.array([m.tobytes() for m in np.packbits(need[some], axis=1)], pa.binary())]

    return fn


def _no_choice() -> list[pa.Array]:
    return [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())]


def _meets(windows: np.ndarray, least: np.ndarray, most: np.ndarray, same: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a block can hold a place of one of an anchor's windows."""
    out = np.zeros(least.shape, bool)
    for w in range(windows.shape[2]):
        from_, to = windows[0, :, w, None], windows[1, :, w, None]
        inside = ~same & (least >= from_) & (most <= to) & (n >= NEGATIVES)
        sure = np.maximum(from_, np.where(inside, least, _NONE).max(axis=1)[:, None])
        out |= ~same & (most >= sure) & (least <= to) & (from_ <= to)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most best scores of each row among the allowed, ties by place (ids ascend), as scores and ids; _NONE fills up."""
    n = scores.shape[1]
    k = min(most, n)
    s = np.where(allowed, scores, _NONE)
    # a stable order of the negated scores keeps the smaller id first; only what reaches the kth best is sorted
    if n > 4 * k:
        kth = np.partition(s, n - k, axis=1)[:, n - k, None]
        keep = (s > kth) | ((s == kth) & (np.cumsum(s == kth, axis=1) <= k - (s > kth).sum(axis=1)[:, None]))
        at = np.nonzero(keep)[1].reshape(len(s), k)
        s = np.take_along_axis(s, at, 1)
    else:
        at = np.broadcast_to(np.arange(n), s.shape)
    order = np.argsort(-np.maximum(s, _NONE + 1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(s, order, 1), ids[np.take_along_axis(at, order, 1)]


def _read(negatives: bool):
    """Of a group and the blocks of a span that it needs, (at, w, id, score): the best of each anchor and window."""
    most, windows = (NEGATIVES, POSITIVES) if negatives else (POSITIVES, 1)

    def fn(t: pa.Table) -> list[pa.Array]:
        side = t.column("side").to_numpy()
        g, blocks = t.take(pa.array(np.flatnonzero(side == 0))), t.take(pa.array(np.flatnonzero(side == 1)))
        if not g.num_rows or not blocks.num_rows:
            return [pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())]
        dim = g.column("dim")[0].as_py()
        anchor, ats = _ints(g.column("vecs")[0].as_py(), dim), np.frombuffer(g.column("ats")[0].as_py(), np.int64)
        best_s, best_i = np.full((windows, len(anchor), most), _NONE), np.zeros((windows, len(anchor), most), np.int64)
        window = np.frombuffer(g.column("more")[0].as_py(), np.int64).reshape(2, len(anchor), POSITIVES) if negatives else None
        for k in range(blocks.num_rows):
            ids, places = (np.frombuffer(blocks.column(c)[k].as_py(), np.int64) for c in ("ids", "places"))
            x = _ints(blocks.column("rows")[k].as_py(), dim)
            need = np.flatnonzero(np.unpackbits(np.frombuffer(blocks.column("need")[k].as_py(), np.uint8), count=len(anchor)))
            for at in np.array_split(need, range(1024, len(need), 1024)):
                scores = _products(anchor[at], x)
                for w in range(windows):
                    if negatives:
                        allowed = (scores >= window[0, at, w, None]) & (scores <= window[1, at, w, None])
                    else:
                        allowed = ats[at][:, None] != places
                    rows = np.flatnonzero(allowed.any(axis=1))
                    if len(rows):
                        s, i = _best(scores[rows], ids, allowed[rows], most)
                        s, i = np.concatenate([best_s[w, at[rows]], s], axis=1), np.concatenate([best_i[w, at[rows]], i], axis=1)
                        order = np.lexsort((i, -np.maximum(s, _NONE + 1)), axis=1)[:, :most]
                        best_s[w, at[rows]], best_i[w, at[rows]] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        w, a, p = np.nonzero(best_s > _NONE)
        return [pa.array(ats[a]), pa.array(w, pa.int32()), pa.array(best_i[w, a, p]), pa.array(best_s[w, a, p])]

    return fn


def _best_rows(groups: DataFrame, blocks: DataFrame, rows: int, negatives: bool) -> DataFrame:
    """(at, w, id, score): what every span has best for each anchor and window. groups: (g, dim, ats, labels, vecs, more); rows: how many there are in all."""
    index = F.floor(F.col("g") / F.lit(GROUP)).alias("of")
    part = lambda size: F.floor(F.col("block") / F.lit(BLOCK * size))
    upto = lambda size: F.sequence(F.lit(0).cast("bigint"), F.lit(rows // size).cast("bigint"))
    # every group meets every chunk of zone maps of its length once; both are dealt to their cells by number
    left = groups.select(index, "g", "dim", "labels", "vecs", "more", F.explode(upto(BLOCK * CHUNK)).alias("part"))
    right = blocks.select(F.explode(upto(GROUP)).alias("of"), "block", "dim", "label", "n", "low", "high", part(CHUNK).alias("part"))
    choice = grouped(_sides(left, right, F.xxhash64("dim", "of", "part")), "cell", _chosen(negatives), ["g", "block", "need"], "g bigint, block bigint, need binary")
    chosen = Saved(choice, "chosen").df
    span = part(max(LEAST_SPAN, min(MOST_SPAN, rows // (BLOCK * 32)))).alias("part")
    left = groups.select("g", "dim", "ats", "vecs", "more").join(chosen.select("g", span).distinct(), "g")
    right = blocks.select("block", "ids", "ats", "vecs").join(chosen, "block").select("g", span, F.col("ids"), F.col("ats").alias("places"), F.col("vecs").alias("rows"), "need")
    return grouped(_sides(left, right, F.xxhash64("g", "part")), "cell", _read(negatives), ["at", "w", "id", "score"], "at bigint, w int, id bigint, score bigint")


def _sides(left: DataFrame, right: DataFrame, cell: Column) -> DataFrame:
    """Rows of both by cell: side 0 has left's columns, side 1 right's."""
    return left.select(cell.alias("cell"), F.lit(0).alias("side"), "*").unionByName(right.select(cell.alias("cell"), F.lit(1).alias("side"), "*"), allowMissingColumns=True)


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("at", "w").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= most)


def _windowed(groups: DataFrame, positives: DataFrame) -> DataFrame:
    """groups with more, the windows [first score, last score] of their anchors' positives (at, rank, score, dim)."""
    per = positives.groupBy("dim", F.floor(F.col("at") / F.lit(GROUP)).alias("of")).agg(F.collect_list(F.struct("at", "rank", "score")).alias("found"))
    joined = groups.withColumn("of", F.floor(F.col("g") / F.lit(GROUP))).join(per, ["dim", "of"]).select("g", "dim", "ats", "labels", "vecs", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for k in range(batch.num_rows):
                ats, found = np.frombuffer(batch.column("ats")[k].as_py(), np.int64), batch.column("found")[k].values
                score, sure = np.zeros((len(ats), POSITIVES), np.int64), np.zeros((len(ats), POSITIVES), bool)
                at, w = np.searchsorted(ats, found.field("at").to_numpy()), found.field("rank").to_numpy() - 1
                score[at, w], sure[at, w] = found.field("score").to_numpy(), True
                more.append(np.stack(windows_of(score, sure)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "dim", "ats", "labels", "vecs")), pa.array(more, pa.binary())], ["g", "dim", "ats", "labels", "vecs", "more"])

    return joined.mapInArrow(run, "g bigint, dim int, ats binary, labels binary, vecs binary, more binary")


def mine(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding): the hard negatives of each anchor and positive."""
    blocks = Saved(blocks_of(_placed(candidates(vectors))), "blocks").df
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    anchors = Saved(anchors_of(blocks), "anchors").df
    groups = Saved(groups_of(anchors), "groups").df
    near = _ranked(_best_rows(groups.withColumnRenamed("sure", "more"), blocks, rows, negatives=False), POSITIVES)
    positives = Saved(near.select("at", "rank", F.col("id").alias("positive_id"), "score").join(anchors.select("at", "dim", F.col("id").alias("anchor_id")), "at"), "positives").df
    windowed = Saved(_windowed(groups, positives), "windows").df
    hard = _ranked(_best_rows(windowed, blocks, rows, negatives=True), NEGATIVES)
    named = hard.select("at", (F.col("w") + 1).alias("p"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.select("at", F.col("rank").alias("p"), "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return named.join(of, ["at", "p"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda z: floor(256 * z)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda z: z IS NULL OR NOT isfinite(z))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
  FROM v AS a JOIN v AS c ON len(a.x) = len(c.x) AND a.vec_id <> c.vec_id WHERE a.vec_id % {ANCHOR} = 0
), p AS MATERIALIZED (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= {POSITIVES}
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= {NEGATIVES}
"""
