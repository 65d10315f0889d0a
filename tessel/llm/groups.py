"""Bounded groups of rows, each handed whole to a function, in one pass over sorted Arrow batches; and a union of linked rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def grouped(df: DataFrame, key: str, fn: Callable[[pa.Table], list[pa.Array]], names: list[str], schema: str) -> DataFrame:
    """fn's rows for each group of df's rows with the same key (a long, not null). Groups must be bounded: a group is one table in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pending = None

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays(fn(pa.Table.from_batches(held).combine_chunks()), names)

        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if held and keys[a] != pending:
                    yield from flush()
                    held = []
                pending = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


class Union:
    """Labels of n rows; rows with the same label are known to be connected."""

    def __init__(self, labels: np.ndarray):
        self.label = labels

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
