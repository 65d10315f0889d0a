"""Online k-means over a stream: every micro-batch moves the centres in the order of its ids. Beyond the batch operators, an extension."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessel.operators.cluster import online_pass


class OnlineCentres:
    """The centres and counts so far, with a version for each micro-batch; a batch that is delivered again after a failure changes nothing twice."""

    def __init__(self, k: int, dim: int):
        self.k, self.dim, self.version = k, dim, -1
        self.centres, self.counts = np.zeros((0, dim)), np.zeros(0, np.int64)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.version:
            return
        ordered = batch.select("id", "features").repartitionByRange(1, "id").sortWithinPartitions("id")
        found = ordered.mapInArrow(online_pass(self.k, self.dim, (self.centres, self.counts)), "c int, n bigint, center array<double>").orderBy("c").collect()
        if found:
            self.centres, self.counts = np.array([r["center"] for r in found]).reshape(-1, self.dim), np.array([r["n"] for r in found])
        self.version = batch_id

    def start(self, stream: DataFrame, checkpoint: str, **options: str) -> StreamingQuery:
        """Follows a streaming DataFrame (id, features)."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).options(**options).start()
