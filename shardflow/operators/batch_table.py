"""Batches as a table function, for sessions that speak SQL.

    select * from worker_batches(table(select worker, pos, id, length from placed)
        partition by worker order by pos, size => 32)

Spark deals the workers over tasks and sorts each worker's samples; the function
sees them one by one and holds one batch at a time, whatever a worker's length.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

NEEDED = ("worker", "id", "length")
BATCH = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("worker", "batch", "n_images", "bytes")]
    + [T.StructField("ids", T.ArrayType(T.StringType()))]
)


@udtf
class WorkerBatches:
    """``worker, batch, n_images, bytes, ids`` of every batch of ``size`` samples.

    A worker's last batch may be shorter; with ``drop_short`` it is left out.  A null
    length counts as no bytes.  Samples without worker are one stream of their own.
    Other columns are not looked at; a table without a needed one, or a size
    below one, is an error before anything runs.
    """

    @staticmethod
    def analyze(samples: AnalyzeArgument, size: AnalyzeArgument, drop_short: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not samples.isTable:
            raise ValueError("worker_batches takes a table first")
        missing = [c for c in NEEDED if c not in samples.dataType.names]
        if missing:
            raise ValueError(f"worker_batches needs the columns {', '.join(missing)}")
        if size.value is None or size.value < 1:
            raise ValueError("worker_batches needs a batch size of at least one")
        return AnalyzeResult(BATCH)

    def __init__(self) -> None:
        self.worker, self.batch, self.size, self.drop = None, 0, 0, False
        self.ids: list[str] = []
        self.bytes = 0

    def _done(self):
        row = (self.worker, self.batch, len(self.ids), self.bytes, self.ids)
        self.batch, self.ids, self.bytes = self.batch + 1, [], 0
        return row

    def eval(self, samples, size, drop_short=False):
        self.worker, self.size, self.drop = samples["worker"], size, drop_short
        self.ids.append(None if samples["id"] is None else str(samples["id"]))
        self.bytes += samples["length"] or 0
        if len(self.ids) == size:
            yield self._done()

    def terminate(self):
        if self.ids and not self.drop:
            yield self._done()


def register(spark: SparkSession, name: str = "worker_batches") -> None:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, WorkerBatches)
