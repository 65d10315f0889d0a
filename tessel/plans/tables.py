"""Tables: the inputs by name, and written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint directory, which driver and executors share. Where none is set, a local master gets a temporary one, a cluster an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessel-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: its lineage is cut, and a lost executor loses none of it."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, name))


def written_path(df: DataFrame, name: str) -> str:
    """Where df was written, in the shared folder; it is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    dropped_at_exit(spark, path)
    return path


def dropped_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a path when the driver ends."""
    def drop() -> None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; what it left is beyond reach
            pass

    atexit.register(drop)


def dealt(df: DataFrame, column: str, name: str) -> DataFrame:
    """df written once in a folder for each value of column, an int of few values: a filter on it reads those folders alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel-{name}-{uuid.uuid4().hex}"
    df.repartition(column).write.partitionBy(column).parquet(path)
    dropped_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """df with name, the sum of value up to each row, its own included, in an order that no two rows share.

    Rows are dealt to ranges and written with them; each range adds the sums of those before it. Only these sums, a row a range, meet in one task.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum("_sum").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.withColumn(name, own).join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
