"""Centroid clustering over a vector approximation file.

Each vector of integers is kept twice: whole, and as an approximation of one cell of 2 ** BITS for each dimension, with cell bounds of about
equal numbers of values by dimension. Both are tables bucketed by row, so that joins of the two move nothing.

A round scans the approximations. Lookup tables give, by dimension and cell, the least and greatest squared distance to each centroid's
component; their sums are an interval of the distance between the vector and the centroid. Where only one centroid's interval begins at or below the least upper end,
it is the nearest, and the vector is not needed to know it. Where intervals overlap, the full vector is fetched and compared with those centroids whose intervals do, exactly.

Centroids are exact floors of sums over counts. The sums are kept and changed by the vectors that move, which are fetched for it: all in the first round, and fewer
and fewer later. The last pass fetches all vectors once for their distances. What reaches the driver are the centroids and sums, k rows of one vector's length.

Defined results: rows whose vector is null, has another length, or holds null or non-finite components are left out; components are held
to +-2 ** 26 after the floor, so that all distances are exact longs; repeated rows are vectors each; equal hashes (rows that share a vec_id) take their turn by components;
a row without a vec_id is clustered and starts no centroid while others can; fewer vectors than k make as many centroids; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import Saved, shared_dir, table
from tessel.plans.tables import dropped_at_exit

K, ROUNDS, DIM, SEED = 40, 5, 64, 2
BITS = 6
LIMIT = 1 << 26
#: Rows of a bucket, about; and rows whose distances a task computes at a time.
BUCKET, TILE = 1 << 18, 2048


def whole_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, x) of the vectors that are clustered, x holding the floors of 256 times their components as longs."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    held = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), v * 256))))
    return vectors.filter((F.size("embedding") == dim) & sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), held.alias("x"))


class Bucketed:
    """A table in buckets by row, in the shared folder. A join by row with another one of as many buckets moves no rows."""

    def __init__(self, df: DataFrame, buckets: int, name: str):
        self.spark = df.sparkSession
        self.name = f"tessel_{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        df.write.format("parquet").option("path", self.path).bucketBy(buckets, "row").sortBy("row").saveAsTable(self.name)
        dropped_at_exit(self.spark, self.path)  # what drop() does not delete before

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _matrix(blobs: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(len(blobs), -1)


def bounds(vectors: DataFrame, dim: int, bits: int) -> tuple[int, np.ndarray]:
    """The number of vectors, and (dim, 2 ** bits + 1): each dimension's cells, the first bound being the least value and the last the greatest. One aggregation; quantiles are approximate, which moves the bounds and no result."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    each = vectors.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"), F.percentile_approx("v", shares, 1000).alias("cuts")).collect()
    out = np.zeros((dim, (1 << bits) + 1), np.int64)
    for r in each:
        out[r["d"]] = [r["low"], *r["cuts"], r["high"]]
    return max((r["n"] for r in each), default=0), out


def cells_of(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The cell of each component: cell c holds values from its lower bound up to, and unless it is the last without, the next one."""
    return np.stack([np.searchsorted(cuts[d, 1:-1], x[:, d], side="right") for d in range(x.shape[1])], axis=1).astype(np.uint8)


def lookup(cuts: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By dimension, cell and centroid, the least and the greatest squared distance of a cell's value from the centroid's component."""
    low, high, c = cuts[:, :-1, None], cuts[:, 1:, None], centres.T[:, None, :]
    outside = np.maximum(0, np.maximum(low - c, c - high))
    far = np.maximum(np.abs(low - c), np.abs(high - c))
    return outside * outside, far * far


def intervals(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the distances of rows of cells from each centroid."""
    out = []
    for t in tables:
        total = np.zeros((len(cells), t.shape[2]), np.int64)
        for d in range(cells.shape[1]):
            total += t[d][cells[:, d]]
        out.append(total)
    return out[0], out[1]


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) < 1 << 22:  # sums of 64 such squares are exact as doubles
        a, b = x.astype(float), centres.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _scan(cuts: np.ndarray, centres: np.ndarray):
    """Approximations (row, cells, was) to (row, was, now, among): now is the nearest centroid where intervals tell, else -1 and among the mask of those that may be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lookup(cuts, centres)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, now, among = _matrix(batch.column("cells"), np.uint8), np.zeros(batch.num_rows, np.int32), []
            for a in range(0, len(cells), TILE):
                low, high = intervals(cells[a : a + TILE], tables)
                may = low <= high.min(axis=1)[:, None]
                alone = may.sum(axis=1) == 1
                now[a : a + TILE] = np.where(alone, may.argmax(axis=1), -1)
                among += [None if sure else m.tobytes() for sure, m in zip(alone.tolist(), np.packbits(may, axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cells"), batch.column("was"), pa.array(now), pa.array(among, pa.binary())], ["row", "cells", "was", "now", "among"])

    return run


def _exact(centres: np.ndarray):
    """Rows (row, cells, was, now, among, x) with their nearest centroid known: the fetched vector decides between those that may be it, the smaller number at ties."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            now = batch.column("now").to_numpy().copy()
            open_ = np.flatnonzero(now < 0)
            for at in np.array_split(open_, range(TILE, len(open_), TILE)):
                if len(at):
                    rows = batch.take(pa.array(at))
                    may = np.unpackbits(_matrix(rows.column("among"), np.uint8), axis=1, count=len(centres)).astype(bool)
                    now[at] = np.where(may, distances(_matrix(rows.column("x"), np.int64), centres), np.iinfo(np.int64).max).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cells"), batch.column("was"), pa.array(now), batch.column("x"), pa.array(np.isin(np.arange(len(now)), open_))], ["row", "cells", "was", "now", "x", "open"])

    return run


def _moves(k: int):
    """(cluster, i, value): what rows (was, now, x, open) add to the sums of clusters; i is -1 for their counts. Cluster -1 counts the rows that were open and those that moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = None, np.zeros(2, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), np.int64)
                x = np.c_[np.ones(len(x), np.int64), x]
                sums = np.zeros((k, x.shape[1]), np.int64) if sums is None else sums
                was, now = batch.column("was").to_numpy(), batch.column("now").to_numpy()
                seen += [batch.column("open").to_numpy(zero_copy_only=False).sum(), (was != now).sum()]
                for c in range(k):
                    sums[c] += x[now == c].sum(axis=0) - x[was == c].sum(axis=0)
        if sums is not None:
            c, i = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[c, -1, -1], pa.int32()), pa.array(np.r_[i - 1, 0, 1], pa.int32()), pa.array(np.r_[sums[c, i], seen])], ["cluster", "i", "value"])

    return run


@dataclass(frozen=True)
class Round:
    """What a round did: vectors, those whose intervals overlapped, and those that moved."""

    vectors: int
    fetched: int
    moved: int


_STATE = "row bigint, cells binary, was int, now int"


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, bits: int = BITS) -> tuple[DataFrame, np.ndarray, list[Round]]:
    """(vec_id, cluster, distance) of each vector, the final centroids, and what each round did. The centroids begin as the vectors of the k least sha256 of "seed:vec_id"."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dim)
    first = whole.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    centres = np.array([r["x"] for r in first], np.int64).reshape(len(first), dim)
    if not len(first):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centres, []
    n, cuts = bounds(whole, dim, bits)
    k, buckets = len(centres), max(spark.sparkContext.defaultParallelism, -(-n // BUCKET))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, dim)
            cells = cells_of(x, cuts) if len(x) else x
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array([r.tobytes() for r in cells], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["row", "vec_id", "cells", "x"])

    # rows get their numbers once, as they are written
    made = whole.withColumn("row", F.monotonically_increasing_id()).mapInArrow(packed, "row bigint, vec_id bigint, cells binary, x binary")
    full = Bucketed(made.repartition(buckets, "row"), buckets, "vectors")
    state = Bucketed(full.df.select("row", "cells", F.lit(-1).alias("was")), buckets, "cells")
    x_of = full.df.select("row", "x")
    sums, figures = np.zeros((k, dim + 1), np.int64), []
    for r in range(rounds + 1):
        scanned = Bucketed(state.df.mapInArrow(_scan(cuts, centres), f"{_STATE}, among binary"), buckets, "scan")
        state.drop()
        fetch = (F.col("now") < 0) | (F.col("now") != F.col("was"))
        told = Bucketed(scanned.df.filter(fetch).join(x_of, "row").mapInArrow(_exact(centres), f"{_STATE}, x binary, open boolean"), buckets, "fetched")
        seen = {0: 0, 1: 0}
        for row in told.df.select("was", "now", "x", "open").mapInArrow(_moves(k), "cluster int, i int, value bigint").groupBy("cluster", "i").agg(F.sum("value").alias("value")).collect():
            if row["cluster"] < 0:
                seen[row["i"]] = row["value"]
            else:
                sums[row["cluster"], row["i"] + 1] += row["value"]
        figures.append(Round(n, seen[0], seen[1]))
        if r < rounds:
            some = sums[:, 0] > 0
            centres = centres.copy()
            centres[some] = sums[some, 1:] // sums[some, :1]
        after = scanned.df.filter(~fetch).select("row", "cells", F.col("now").alias("was")).unionByName(told.df.select("row", "cells", F.col("now").alias("was")))
        state = Bucketed(after, buckets, "cells")
        scanned.drop()
        told.drop()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("was").to_numpy()
            gap = _matrix(batch.column("x"), np.int64) - centres[own] if len(own) else np.zeros((0, dim), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("was"), pa.array((gap * gap).sum(axis=1))], ["vec_id", "cluster", "distance"])

    found = state.df.select("row", "was").join(full.df.select("row", "vec_id", "x"), "row").select("vec_id", "was", "x")
    return found.mapInArrow(measured, "vec_id bigint, cluster int, distance bigint"), centres, figures


def digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centre).encode()).hexdigest()


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres, _ = cluster(table(spark, sf_dir, "embeddings"))
    found = Saved(found, "clustered").df
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in per)
    # a row for each centroid: at most K
    about = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, digest(centres[r["cluster"]])) for r in per], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_NEAREST = """SELECT vec_id, x, k, d FROM (SELECT v.vec_id, v.x, c.k, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.y) + list_dot_product(c.y, c.y) AS d,
  row_number() OVER (PARTITION BY v.vec_id ORDER BY list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.y) + list_dot_product(c.y, c.y), c.k) AS p FROM v, c{0} AS c) WHERE p = 1"""


def _sql() -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda z: floor(256 * z)) AS x FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda z: z IS NULL OR NOT isfinite(z))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, x AS y FROM v ORDER BY sha256('{SEED}:' || vec_id) LIMIT {K})",
    ]
    for r in range(ROUNDS):
        parts += [
            f"n{r} AS MATERIALIZED ({_NEAREST.format(r)})",
            f"m{r} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS y FROM (SELECT k, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT k, x, unnest(range(1, {DIM + 1})) AS i FROM n{r}) GROUP BY k, i) GROUP BY k)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.y, c.y) AS y FROM c{r} AS c LEFT JOIN m{r} AS m ON m.k = c.k)",
        ]
    parts.append(f"n AS MATERIALIZED ({_NEAREST.format(ROUNDS)})")
    return "WITH " + ", ".join(parts) + f""" SELECT vec_id, CAST(n.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY n.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.y, lambda z: CAST(z AS BIGINT)), ',')) AS centroid_sha256 FROM n JOIN c{ROUNDS} AS c ON c.k = n.k"""


SQL = _sql()
