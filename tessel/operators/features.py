"""Column profiling, metadata and encoders: profile -> refine -> encode, all by aggregations and projections.

Missing is NULL or NaN. Metadata is one frozen record for each column; encoders are Column expressions, so that encoding a table is a
projection without a job of its own. An encoder's result is an array<double>.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.vectors import let, linspace, literal, total
from tessel.plans.tables import running_sum, written, written_path

CATEGORICAL, NUMERICAL, RANGE = "categorical", "numerical", "range_of_values"
PERCENTILES, PERCENTILES_ACCUM, STANDARD, INTEGER = "percentiles", "percentiles_accum", "zero_mean_variance_one", "integer"
TYPES = (CATEGORICAL, NUMERICAL, RANGE, PERCENTILES, PERCENTILES_ACCUM, STANDARD, INTEGER)
EMPTY = "<empty>"
MAX_INTERVALS = 100
DEFAULT_BINS = 10


@dataclass(frozen=True)
class Dictionary(Sequence):
    """The values of a category in order, as a written table (value, index), index from 0 and dense. A value asked for by place is looked up; iterating streams all through the driver."""

    path: str
    size: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("value string, index bigint").parquet(self.path)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, place: int) -> str:
        at = place + self.size if place < 0 else place
        found = self.table(SparkSession.active()).filter(F.col("index") == at).first()
        if found is None:
            raise IndexError(place)
        return found["value"]

    def __iter__(self) -> Iterator[str]:
        return (r["value"] for r in self.table(SparkSession.active()).orderBy("index").toLocalIterator())


@dataclass(frozen=True)
class Meta:
    """What is known of a column. excluded and values hold the column's own type, texts for categories. A category of many values holds them as a Dictionary."""

    name: str
    type: str
    excluded: tuple = ()
    min: float | None = None
    max: float | None = None
    num_intervals: int | None = None
    values: Sequence = ()


def is_missing(column: Column, kind: str) -> Column:
    return column.isNull() | F.isnan(column) if kind in ("double", "float") else column.isNull()


def fill_missing(column: Column, kind: str, sentinel: float | str) -> Column:
    """The column with a sentinel where it is missing."""
    return F.when(is_missing(column, kind), F.lit(sentinel)).otherwise(column)


def without(column: Column, excluded: Sequence) -> Column:
    """A predicate: the value is none of the excluded ones."""
    return ~column.isin(list(excluded)) if excluded else F.lit(True)


# --- encoders ---------------------------------------------------------------------------------------------------------


def standardise(column: Column, mean: float, std: float) -> Column:
    return (column - F.lit(float(mean))) / F.lit(float(std))


def unstandardise(column: Column, mean: float, std: float) -> Column:
    return column * F.lit(float(std)) + F.lit(float(mean))


def rbf_range(column: Column, bounds: tuple[float, float], bits: int, h: float | None = None) -> Column:
    """Memberships in Gaussian bins whose centres divide the bounds evenly; they sum to 1, far outside too, since the largest exponent is taken off."""
    h = (bounds[1] - bounds[0]) / (2 * bits + 1) if h is None else h
    alpha = -0.5 / (h * h)
    exponents = F.transform(literal(linspace(bounds[0], bounds[1], bits)), lambda m: alpha * (column - m) * (column - m))
    weights = let(exponents, lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top))))
    return let(weights, lambda w: let(total(w), lambda s: F.transform(w, lambda v: v / s)))


def category_bits(column: Column, categories: Sequence[str]) -> Column:
    """One-hot by text; an unknown or missing value is all zeros."""
    return F.array(*[F.when(column.cast("string") == str(c), 1.0).otherwise(0.0) for c in categories]) if categories else F.array().cast("array<double>")


def percentile_bits(column: Column, knots: Sequence[float]) -> Column:
    """Fuzzy membership: shares of the two knots around the value that sum to 1; the ends hold what lies outside. Equal knots count once."""
    k = sorted(set(float(v) for v in knots))
    if not k:
        raise ValueError("no knots")
    x, out = column.cast("double"), []
    for i, v in enumerate(k):
        share = F.when(x == v, 1.0)
        if i == 0:
            share = share.when(x < v, 1.0)
        if i == len(k) - 1:
            share = share.when(x > v, 1.0)
        if i:
            share = share.when((x > k[i - 1]) & (x < v), (x - k[i - 1]) / (v - k[i - 1]))
        if i < len(k) - 1:
            share = share.when((x > v) & (x < k[i + 1]), (k[i + 1] - x) / (k[i + 1] - v))
        out.append(share.otherwise(0.0))
    return F.array(*out)


def thermometer_bits(column: Column, knots: Sequence[float]) -> Column:
    """Bit i is 1 if the value is at knot i or above."""
    return F.array(*[F.when(column.cast("double") >= float(v), 1.0).otherwise(0.0) for v in sorted(set(float(v) for v in knots))])


# --- figures of columns -----------------------------------------------------------------------------------------------


def category_masses(data: DataFrame, column: str, excluded: Sequence = ()) -> DataFrame:
    """(value, n, p) of the values that are there and not excluded."""
    kept = data.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull() & without(F.col("value"), [str(v) for v in excluded]))
    counts = kept.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / counts.agg(F.sum("n")).scalar())


#: Distinct values of a column that one task places; the result is the same either way.
PLAIN = 1_000_000


def _running(counts: DataFrame, order: list, name: str) -> tuple[DataFrame, Column]:
    """counts (..., n), a row for each distinct value, with the running sum of n in an order that no two rows share, and the sum of all: by one window for PLAIN rows or fewer, by ranges beyond."""
    held = written(counts, "counts")
    rows, whole = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    whole = F.lit(whole)
    if rows > PLAIN:
        return running_sum(held, order, "n", name), whole
    upto = F.sum("n").over(Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return held.withColumn(name, upto), whole


def mass_cut(masses: DataFrame, mass: float = 0.95) -> DataFrame:
    """The categories whose share reaches that of the category at which the running share, largest first, first exceeds mass; ties at it all stay."""
    ordered, n = _running(masses, [F.desc("p"), F.col("value")], "_running")
    cut = ordered.agg(F.max(F.when(F.col("_running") / n > mass, F.col("p"))).alias("cut"), F.min("p").alias("least")).select(F.coalesce("cut", "least")).scalar()
    return ordered.filter(F.col("p") >= cut).select("value", "n", "p")


def quantile_grid(data: DataFrame, column: str, num_intervals: int, excluded: Sequence = ()) -> DataFrame:
    """(position, value): sorted values at places 0, step, 2 * step, ..., and the last, each value once; step = n // (num_intervals - 2).

    Values are counted before they are placed; where many are distinct they are dealt to ranges, so no task sorts all of them.
    """
    x = F.col(column).cast("double")
    kept = data.filter(~is_missing(F.col(column).cast("double"), "double") & without(F.col(column), excluded)).select(x.alias("value"))
    upto, n = _running(kept.groupBy("value").agg(F.count(F.lit(1)).alias("n")), ["value"], "_end")
    places = upto.withColumn("_n", n)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(num_intervals - 2))).cast("long")
    # a value holds the places _end - n .. _end - 1: it is on the grid if a multiple of step is among them
    on_grid = F.floor((F.col("_end") - 1) / step) > F.floor((F.col("_end") - F.col("n") - 1) / step)
    return places.filter(on_grid | (F.col("_end") == F.col("_n"))).select((F.col("_end") - F.col("n")).alias("position"), "value")


# --- metadata ---------------------------------------------------------------------------------------------------------


def profile(data: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each column: name, kind, n_rows, n_missing, n_distinct, share_numeric, min and max (numbers). One aggregation over all columns."""
    kinds = dict(data.dtypes)
    names = list(columns or data.columns)
    out = []
    for c in names:
        col, missing = F.col(c), is_missing(F.col(c), kinds[c])
        number = F.expr(f"try_cast(`{c}` as double)") if kinds[c] == "string" else col.cast("double")
        there = F.when(~missing, number)
        out.append(F.struct(
            F.lit(c).alias("name"), F.lit(kinds[c]).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.count(F.when(missing, 1)).alias("n_missing"),
            F.count_distinct(F.when(~missing, col)).alias("n_distinct"), F.avg(F.when(~missing, number.isNotNull().cast("double"))).alias("share_numeric"),
            F.min(there).alias("min"), F.max(there).alias("max")))
    return data.agg(F.array(*out).alias("all")).select(F.explode("all").alias("c")).select("c.*")


#: Categories of so many values or fewer are listed in their metadata; others have a dictionary.
INLINE = 1_000


def explore(data: DataFrame, columns: Sequence[str] | None = None, purity: float = 0.9, folder: str | None = None, inline: int = INLINE) -> list[Meta]:
    """First metadata: texts are categories, fractions ranges of values, whole numbers categories up to MAX_INTERVALS distinct values and numerical beyond.

    A column with missing numbers gets the sentinel min(-1, min) - 10 as an excluded value, one with missing texts EMPTY. A text column of
    which a share of purity or more, but not all, reads as numbers raises: its type is not clear. Values of a text column reach the driver if they are inline or fewer;
    else they are written to a dictionary below folder, by default the session's shared one, where they stay until the driver ends.
    """
    out = []
    for r in profile(data, columns).collect():
        whole = r["kind"] in ("int", "bigint", "smallint", "tinyint")
        if r["kind"] == "string":
            if r["share_numeric"] is not None and 1 - purity < r["share_numeric"] < purity:
                raise ValueError(f"{r['name']}: neither texts nor numbers make {purity:.0%} of it")
            excluded, few = (EMPTY,) if r["n_missing"] else (), r["n_distinct"] <= inline
            out.append(Meta(r["name"], CATEGORICAL, excluded, None, None, r["n_distinct"], _values(data, r["name"]) if few else write_dictionary(data, r["name"], (), folder)))
            continue
        low, high = r["min"], r["max"]
        excluded = (min(-1.0, low if low is not None else 0.0) - 10,) if r["n_missing"] else ()
        if whole and r["n_distinct"] <= MAX_INTERVALS:
            out.append(Meta(r["name"], CATEGORICAL, excluded, low, high, r["n_distinct"], _values(data, r["name"])))
        else:
            out.append(Meta(r["name"], NUMERICAL if whole else RANGE, excluded, low, high, min(r["n_distinct"], MAX_INTERVALS)))
    return out


def _values(data: DataFrame, column: str) -> tuple:
    """The distinct values in order, of a column that is known to have few."""
    return tuple(r[0] for r in data.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct().orderBy("v").collect())


def dictionary(data: DataFrame, column: str, excluded: Sequence = ()) -> DataFrame:
    """(value, index): the distinct values that are there and not excluded, numbered from 0 in order, by ranges."""
    kept = data.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull() & without(F.col("value"), [str(v) for v in excluded]))
    numbered = running_sum(kept.distinct().withColumn("_one", F.lit(1).cast("bigint")), ["value"], "_one", "_n")
    return numbered.select("value", (F.col("_n") - 1).alias("index"))


def write_dictionary(data: DataFrame, column: str, excluded: Sequence = (), folder: str | None = None) -> Dictionary:
    """A written dictionary. A folder given keeps it; in the shared one it goes when the driver ends."""
    found = dictionary(data, column, excluded)
    if folder is None:
        path = written_path(found, "dictionary")
    else:
        path = f"{folder}/{column}-{uuid.uuid4().hex}"
        found.write.parquet(path)
    return Dictionary(path, data.sparkSession.read.parquet(path).count())


def refine(data: DataFrame, metas: Sequence[Meta]) -> list[Meta]:
    """Metadata after a human has set the types: grids for percentiles and numerical columns without one, mean and deviation (population) for standardised ones, whole bounds for numerical ones."""
    kinds, out = dict(data.dtypes), []
    for m in metas:
        if m.type not in TYPES:
            raise ValueError(f"{m.name}: unknown type {m.type!r}")
        if m.type in (PERCENTILES, PERCENTILES_ACCUM, NUMERICAL) and not m.values:
            grid = tuple(r["value"] for r in quantile_grid(data, m.name, max(3, m.num_intervals or MAX_INTERVALS), m.excluded).orderBy("value").collect())
            m = replace(m, values=grid, num_intervals=len(grid), min=None if m.type != NUMERICAL else _whole(m.min), max=None if m.type != NUMERICAL else _whole(m.max))
        elif m.type == NUMERICAL:
            m = replace(m, min=_whole(m.min), max=_whole(m.max))
        elif m.type == STANDARD:
            kept = data.filter(~is_missing(F.col(m.name), kinds[m.name]) & without(F.col(m.name), m.excluded))
            mean, std = kept.agg(F.avg(m.name), F.stddev_pop(m.name)).first()
            m = replace(m, values=(mean, std), num_intervals=None, min=None, max=None)
        out.append(m)
    return out


def _whole(v: float | None) -> float | None:
    return None if v is None else float(math.trunc(v))


def encoder(m: Meta, kind: str) -> Column:
    """The column's encoding as an array<double>; a missing value is all zeros for categories and -1 for numbers."""
    col = F.col(m.name)
    if m.type == CATEGORICAL:
        return category_bits(col, [v for v in m.values if str(v) not in {str(e) for e in m.excluded}])
    x = fill_missing(col.cast("double"), "double", -1.0)
    if m.type == RANGE:
        return rbf_range(x, (m.min, m.max), m.num_intervals or DEFAULT_BINS)
    if m.type in (NUMERICAL, PERCENTILES):
        return percentile_bits(x, m.values)
    if m.type == PERCENTILES_ACCUM:
        return thermometer_bits(x, m.values)
    mean, std = (m.values if m.type == STANDARD else (0.0, 1.0))
    return F.array(standardise(x, mean, std))


def encode(data: DataFrame, metas: Sequence[Meta], name: str = "features") -> DataFrame:
    """data with a column of all encodings, one after another in metadata order. Columns with a dictionary are for encode_sparse()."""
    if found := [m.name for m in metas if isinstance(m.values, Dictionary)]:
        raise ValueError(f"{found}: many values make no dense encoding; use encode_sparse()")
    kinds = dict(data.dtypes)
    return data.withColumn(name, F.concat(*[encoder(m, kinds[m.name]) for m in metas]))


SPARSE = "array<struct<i:bigint,w:double>>"
#: Parts that the rows of one value are dealt to when a dictionary is joined.
PARTS = 64


def encode_sparse(data: DataFrame, metas: Sequence[Meta], name: str = "features") -> tuple[DataFrame, int]:
    """data with a column of the entries (i, w) that are not zero, i counting over all encodings in metadata order; and how many places there are.

    A column with a dictionary is joined with it; values that are missing, excluded or not in it have no entry. A value's rows are dealt to PARTS tasks by a hash of the
    whole row, so a value that most rows have is no task's alone.
    """
    kinds, spark = dict(data.dtypes), data.sparkSession
    out, parts, at = data, [], 0
    for k, m in enumerate(metas):
        if isinstance(m.values, Dictionary):
            words = m.values.table(spark)
            if m.excluded:  # what is excluded leaves no gap
                words = dictionary(words, "value", m.excluded)
            out = _looked_up(out, data.columns, m.name, words, f"_i{k}")
            entry = F.when(F.col(f"_i{k}").isNotNull(), F.array(F.struct((F.col(f"_i{k}") + at).alias("i"), F.lit(1.0).alias("w"))))
            parts.append(F.coalesce(entry, F.array().cast(SPARSE)))
            at += words.count()
            continue
        parts.append(_entries(encoder(m, kinds[m.name]), at))
        at += _width(m)
    return out.withColumn(name, F.concat(*parts)).select(*data.columns, name), at


def _entries(dense: Column, first: int) -> Column:
    """The entries of an array that are not zero, its places counted from first."""
    placed = F.transform(dense, lambda w, i: F.struct((i + first).cast("bigint").alias("i"), w.alias("w")))
    return F.filter(placed, lambda e: e["w"] != 0)


def _width(m: Meta) -> int:
    if m.type == CATEGORICAL:
        return len([v for v in m.values if str(v) not in {str(e) for e in m.excluded}])
    if m.type == RANGE:
        return m.num_intervals or DEFAULT_BINS
    return len(set(float(v) for v in m.values)) if m.type in (NUMERICAL, PERCENTILES, PERCENTILES_ACCUM) else 1


def _looked_up(rows: DataFrame, columns: Sequence[str], column: str, words: DataFrame, name: str) -> DataFrame:
    """rows with the index that words (value, index) have for a column, null if none. Words meet the (value, part) pairs that occur first, of which a value has PARTS at most."""
    salted = rows.withColumn("_value", F.col(column).cast("string")).withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(PARTS)))
    occur = salted.select("_value", "_part").distinct().join(words.withColumnRenamed("value", "_value"), "_value").withColumnRenamed("index", name)
    return salted.join(occur, ["_value", "_part"], "left").drop("_value", "_part")


def encoded_targets(data: DataFrame, inputs: Sequence[Meta], targets: Sequence[Meta]) -> DataFrame:
    """data with x and y; only rows whose target encodes to something."""
    both = encode(encode(data, inputs, "x"), targets, "y")
    return both.filter(total(F.col("y")) > 0)
