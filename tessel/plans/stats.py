"""Sufficient statistics in one distributed aggregation, and stated queries against all rows in a grid.

A training step is a fold: every Arrow batch of rows becomes one row of partial sums per key, a groupBy sums them. Keys are few
(components, classes, layers), so what reaches the driver does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that a task holds while it streams rows past them, and the bytes of their vectors; and the most tasks that a grid of queries and rows is dealt to.
QUERY_BLOCK, QUERY_BYTES, MOST_TASKS = 131_072, 64 << 20, 20_000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix of doubles, a row each. Null vectors and vectors of different lengths raise; null elements become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        raise ValueError("a null vector")
    sizes = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    if n and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of different lengths, {sizes.min()} to {sizes.max()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(n, sizes[0]) if n else np.zeros((0, 0))


def fold(data: DataFrame, partial: Callable[[dict[str, pa.Array]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums, by key, of the vectors that partial makes of each batch (column name -> array). One job; a row for each key comes back."""
    names = data.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, value in partial({c: batch.column(c) for c in names}).items():
                    sums[key] = sums[key] + value if key in sums else value
        for key, value in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(value), pa.int64()), pa.array(range(len(value)), pa.int32()), pa.array(value, pa.float64())], ["key", "i", "value"])

    parts = data.mapInArrow(run, "key bigint, i int, value double")
    rows = parts.groupBy("key", "i").agg(F.sum("value").alias("value")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("v")).collect()
    return {r["key"]: np.array([x["value"] for x in r["v"]]) for r in rows}


def dimension(data: DataFrame, column: str = "features") -> int:
    """The one length of all vectors; raises if there are several, or none."""
    low, high = data.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low is None or low != high or low < 1:
        raise ValueError(f"vectors must have one length above 0; found {low} to {high}")
    return low


def query_columns(queries: DataFrame) -> int:
    """How many tasks' worth of queries (features) there are: QUERY_BLOCK, or fewer if these take more than QUERY_BYTES."""
    asked, width = queries.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    return max(1, -(-asked // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, width or 1))))))


def against_all(
    queries: DataFrame, data: DataFrame, update: Callable[[dict, np.ndarray, dict[str, pa.Array]], None], finish: Callable[[dict, np.ndarray], tuple], names: Sequence[str], schema: str, columns: int | None = None, by: str | None = None
) -> DataFrame:
    """Every query against every row of data: (qid, then names), rows from each cell of a grid to be combined by the caller.

    Queries (qid long, features) are dealt to columns of about QUERY_BLOCK queries (fewer if these take more than QUERY_BYTES), rows of data to lines; where they meet, a task holds the queries of its column
    and streams the rows of its line past them, so memory does not grow with the rows. One shuffle: a row goes to every column, a query to every line.
    Lines are as many as make the cells enough for all cores. A row's line is a hash of all its columns, so that a task that runs again sees the same rows;
    data without a column that tells equal rows apart keeps these in one line. With by, rows of one value of it share a line and come one after the other.
    If columns, their number, is given, queries bring their own in column, and rows those that they go to in an array columns, if they have one.

    A cell keeps one state (a dict, empty at first) over its batches; update changes it by a batch, finish gives the queries' indices and then a column for each of names.
    """
    spark = data.sparkSession
    own = columns is not None
    columns = columns if own else query_columns(queries)
    lines = max(1, -(-2 * spark.sparkContext.defaultParallelism // columns))
    cells, kept = columns * lines, [c for c in data.columns if c != "columns"]
    dealt = lambda over, n: F.pmod(F.xxhash64(*over), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("qid").cast("bigint").alias("_qid"), "features", (F.col("column").cast("int") if own else dealt(["qid"], columns)).alias("_column")).select("*", upto(lines).alias("_line")).withColumn("_side", F.lit(0))
    right = data.select("*", dealt([by] if by else kept, lines).alias("_line")).select(*kept, "_line", (F.explode("columns") if "columns" in data.columns else upto(columns)).alias("_column")).withColumn("_side", F.lit(1))
    met = left.unionByName(right, allowMissingColumns=True).withColumn("_cell", F.col("_column") * lines + F.col("_line")).drop("_column", "_line")
    tasks = min(cells, MOST_TASKS)
    met = met.repartitionById(tasks, F.pmod("_cell", F.lit(tasks))).sortWithinPartitions("_cell", "_side", "_qid", *([by] if by else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ids, held, x, at = {}, [], [], None, None

        def done() -> Iterator[pa.RecordBatch]:
            if state:
                who, *values = finish(state, x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)[who]), *[pa.array(v) for v in values]], ["qid", *names])

        for batch in batches:
            cell, side = (batch.column(c).to_numpy() for c in ("_cell", "_side"))
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if cell[a] != at:
                    yield from done()
                    state, ids, held, x, at = {}, [], [], None, cell[a]
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    ids.append(part.column("_qid").to_numpy(zero_copy_only=False).astype(np.int64))
                    held.append(matrix(part.column("features")))
                elif held:
                    x = np.concatenate(held) if x is None else x
                    update(state, x, {c: part.column(c) for c in kept})
        yield from done()

    return met.mapInArrow(run, f"qid bigint, {schema}")


def chunks(n: int, width: int, cells: int = 2_000_000) -> Iterator[slice]:
    """Slices of n rows whose products with width columns hold about cells numbers."""
    step = max(1, cells // max(1, width))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def sqdist_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, summed coordinate by coordinate, so that equal rows are at 0 exactly."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        diff = a[:, d, None] - b[None, :, d]
        out += diff * diff
    return out
