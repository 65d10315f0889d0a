"""Vectors in text files, delimited tables, percentile files, metadata files and encoded rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.operators.features import Dictionary, Meta
from tessel.plans.tables import running_sum


def parse_vector(line):
    """An array<double> of a line's numbers, which white space separates; null where one is no number."""
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double"))


def read_vectors(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, features) of text files, or directories of them: a line is a vector."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return lines.filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), parse_vector(F.col("value")).alias("features"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, features) of the files that a file lists, a name on each line."""
    names = [r[0] for r in spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value")).collect()]
    return read_vectors(spark, names)


def blocks(data: DataFrame, size: int, key: Sequence[str] = ("id",), seed: int = 0) -> DataFrame:
    """data with block and place: rows in the order of a seeded hash of key, the same in every run, in blocks of size rows, the last one of what is left; place counts within a block from 0.

    Rows are numbered by ranges, and a block is rows with its number, not a value: sort by (block, place) within partitions to stream them. Rows with the same key are in no order among themselves.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]), 256)
    keyed = data.withColumn("_order", order).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running_sum(keyed, ["_order", *key], "_one", "_n")
    return numbered.withColumn("block", F.floor((F.col("_n") - 1) / F.lit(size))).withColumn("place", (F.col("_n") - 1) % size).drop("_order", "_one", "_n")


def as_arrays(blocked: DataFrame) -> DataFrame:
    """(block, features array of vectors) of rows (block, place, features): a block's vectors as one value, of no more rows than a block has."""
    both = F.array_sort(F.collect_list(F.struct("place", "features")))
    return blocked.groupBy("block").agg(F.transform(both, lambda s: s["features"]).alias("features"))


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, separator: str = ";") -> DataFrame:
    """A delimited table with a header; types are inferred where no schema is given; empty fields and NA are missing."""
    reader = spark.read.option("sep", separator).option("header", True).option("nullValue", "")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_percentiles(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the second token of each line after three of header, where it exceeds all before it. One small file, read as one row."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    tokens = lines.filter("line >= 3").select("line", F.get(F.split(F.trim("text"), r"\s+"), 1).try_cast("double").alias("value")).filter("value is not null")
    before = F.max("value").over(Window.partitionBy().orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return tokens.withColumn("_m", before).filter("_m is null or value > _m").select("line", "value")


# --- metadata: name;type;excluded;min;max;num_intervals;values, lists parted by blanks, blanks in them as %20; @path instead of values is a dictionary ---


def _list(values: Sequence) -> str:
    return " ".join((repr(v) if isinstance(v, float) else str(v)).replace(" ", "%20") for v in values)


def _value(text: str, kind: str):
    text = text.replace("%20", " ")
    if kind == "categorical":
        return text
    try:
        return float(text)
    except ValueError:
        return text


def write_metadata(path: str, metas: Sequence[Meta]) -> None:
    show = lambda v: "" if v is None else str(v)
    with open(path, "w", encoding="utf-8") as f:
        for m in metas:
            f.write(";".join([m.name.replace(" ", "%20"), m.type, _list(m.excluded), show(m.min), show(m.max), show(m.num_intervals), f"@{m.values.path}" if isinstance(m.values, Dictionary) else _list(m.values)]) + "\n")


def read_metadata(path: str) -> list[Meta]:
    out = []
    number = lambda s, kind: kind(s) if s else None
    with open(path, encoding="utf-8") as f:
        for line in f:
            if not line.strip() or line.startswith("#"):
                continue
            name, kind, excluded, low, high, n, values = (line.rstrip("\n").split(";") + [""] * 6)[:7]
            parts = lambda s, kind=kind: tuple(_value(v, kind) for v in s.split())
            held = Dictionary(values[1:], int(n)) if re.match(r"@([a-z0-9]+:)?/", values) else parts(values)
            out.append(Meta(name.replace("%20", " "), kind, parts(excluded), number(low, float), number(high, float), number(n, int), held))
    return out


def write_encoded(data: DataFrame, path: str, columns: Sequence[str] = ("x", "y")) -> None:
    """A line for each row: all numbers of the columns with six decimals, parted by blanks."""
    numbers = F.concat(*[F.col(c) for c in columns])
    data.select(F.array_join(F.transform(numbers, lambda v: F.format_string("%.6f", v)), " ").alias("value")).write.text(path)


def write_sparse(data: DataFrame, path: str, columns: Sequence[str] = ("x", "y")) -> None:
    """A line for each row: the entries i:w of each column, w with six decimals, parted by blanks, and the columns parted by a bar."""
    entries = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["i"].cast("string"), F.lit(":"), F.format_string("%.6f", e["w"]))), " ")
    data.select(F.concat_ws(" | ", *[entries(c) for c in columns]).alias("value")).write.text(path)
