"""Kernel smoothing and resampling of signals on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.vectors import let, total


def smooth(signals: DataFrame, n_to: int | None = None, duration: float = 10.0, h: float = 0.05, n_from: int | None = None) -> DataFrame:
    """(signal_id, t, y) from (signal_id, idx, y): at each of n_to grid points the mean of all points, weighted by a Gaussian of width h.

    Both axes divide the duration evenly; n_to is n_from by default, n_from the signal's length; only the first n_from points count. A
    signal's points are one array and a row (a signal must fit one task); grid points are rows of their own only after that, so no pair
    of points is ever a row. Signals without points do not occur.
    """
    points = signals.groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("y").cast("double").alias("y")))), lambda p: p["y"]).alias("_all"))
    cut = points.select("signal_id", (F.slice("_all", 1, n_from) if n_from else F.col("_all")).alias("_ys"))
    n = F.size("_ys")
    to = F.lit(n_to) if n_to else n
    place = lambda i, size: F.when(size > 1, F.lit(float(duration)) * i / (size - 1)).otherwise(0.0)
    placed = cut.withColumn("_x", F.transform(F.sequence(F.lit(0), n - 1), lambda i: place(i, n)))

    def smoothed(at: Column) -> Column:
        weights = F.transform("_x", lambda x: F.exp(-0.5 * ((x - at) / h) * ((x - at) / h)))
        return let(weights, lambda w: total(F.zip_with(w, F.col("_ys"), lambda a, b: a * b)) / total(w))

    # all grid points within the signal's row: only the outcome is exploded, so the signal is not copied
    values = F.transform(F.sequence(F.lit(0), to - 1), lambda t: let(place(t, to), smoothed))
    return placed.select("signal_id", F.posexplode(values).alias("t", "y"))
