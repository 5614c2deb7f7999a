"""Labels kept up to date while edges arrive.

State is a table of star edges, a forest of what has come so far. A
micro-batch is contracted together with the forest, which has at most one edge
per vertex, and the new forest is written under the batch's number; a batch
that is run again writes the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mycelia.operators.components import connected_components


class IncrementalComponents:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.last = spark, path, -1

    def _labels_path(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def update(self, edges: DataFrame, batch: int) -> None:
        """Take in edges (src, dst) of a micro-batch."""
        new = edges.select("src", "dst")
        if batch > 0 and self.last >= 0:
            before = min(self.last, batch - 1)
            new = new.unionByName(self.spark.read.parquet(self._labels_path(before)).selectExpr("id AS src", "component AS dst"))
        connected_components(new).write.mode("overwrite").parquet(self._labels_path(batch))
        self.last = batch

    def labels(self) -> DataFrame:
        """(id, component) of all vertices seen so far."""
        return self.spark.read.parquet(self._labels_path(self.last)) if self.last >= 0 else self.spark.createDataFrame([], "id long, component long")

    def start(self, edges: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """edges: a streaming table of (src, dst)."""
        return edges.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
