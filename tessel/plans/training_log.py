"""An append-only table of what a training run has done, from which it resumes after a lost driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "run string, step bigint, event string, figures map<string,double>, state string"


class TrainingLog:
    """Rows (run, step, event, figures, state) of a Parquet table at a path that driver and executors share. step counts a run's rows from 0; figures are metrics by name; state is whatever a run needs to go on, as JSON.

    A row is a file of its own, committed whole or not at all. Several runs may share a table, one driver each.
    """

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run
        found = self.rows().agg(F.max("step")).first()[0]
        self.step = 0 if found is None else found + 1

    def table(self) -> DataFrame:
        """All runs' rows; none where nothing has been written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(_SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], _SCHEMA)

    def rows(self) -> DataFrame:
        return self.table().filter(F.col("run") == self.run)

    def append(self, event: str, figures: dict[str, float], state: dict) -> None:
        row = (self.run, self.step, event, {k: float(v) for k, v in figures.items()}, json.dumps(state))
        self.spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.step += 1

    def events(self) -> list[tuple[str, dict[str, float], dict]]:
        """The run's rows in order, a row for each step it has taken."""
        return [(r["event"], r["figures"], json.loads(r["state"])) for r in self.rows().orderBy("step").collect()]
