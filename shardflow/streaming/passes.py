"""Shuffled passes over a listing as a stream with offsets of its own.

``prepare`` writes the seeded order of every epoch once, cut into pieces of neighbouring places.  The
stream's offset is ``(seed, epoch, position)``: a batch is the samples between two
offsets, over the end of an epoch into the next.  It is read from the written
order, so a batch that failed is replayed row for row, and a stream that is stopped and
started again with its checkpoint goes on at the very sample, whatever the names of the files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shardflow.functions.columns import idiv
from shardflow.operators.ordering import dense_index
from shardflow.scratch import materialise
from shardflow.sources.files import filesystem, put_file, read_file

META = "_pass.json"
PIECE_ROWS = 100_000


def prepare(listing: DataFrame, ids: Sequence[str], path: str, *, seed: int, epochs: int, piece_rows: int = PIECE_ROWS) -> None:
    """Write the order of ``epochs`` passes over a listing: rows ``epoch, i`` and the listing's columns.

    ``i`` is the place of ``ordering.dense_index`` with the same seed and epoch.  A piece lies in a
    folder of its own; its rows are sorted by place.  The description is written last: a folder
    without it is not ready.
    """
    taken = {"epoch", "i", "piece"} & set(listing.columns)
    if taken:
        raise ValueError(f"columns of the pass: {sorted(taken)}")
    spark, rows = listing.sparkSession, materialise(listing, "pass-listing")
    total = rows.count()
    for epoch in range(epochs):
        placed = dense_index(rows, ids, seed=seed, epoch=epoch).withColumn("piece", idiv("i", piece_rows))
        (
            placed.repartition("piece").sortWithinPartitions("piece", "i")
            .select("i", *listing.columns, "piece")
            .write.partitionBy("piece").parquet(f"{path}/epoch={epoch}")
        )
    schema = T.StructType([T.StructField("epoch", T.LongType()), T.StructField("i", T.LongType()), *listing.schema.fields])
    meta = {"seed": seed, "epochs": epochs, "total": total, "piece_rows": piece_rows, "schema": schema.json()}
    put_file(f"{path}/{META}", json.dumps(meta).encode())


@dataclass
class Slice(InputPartition):
    """Places ``first`` to ``end`` of an epoch, inside one piece."""

    epoch: int
    piece: int
    first: int
    end: int


class PassSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shardflow_pass"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(json.loads(read_file(f"{self.options['path']}/{META}"))["schema"]))

    def streamReader(self, schema) -> PassReader:
        return PassReader(self.options, schema)


class PassReader(DataSourceStreamReader):
    """Places are counted through all epochs inside; offsets name epoch and position."""

    def __init__(self, options, schema: T.StructType) -> None:
        self.path, self.checkpoint = options["path"].rstrip("/"), options.get("checkpoint")
        meta = json.loads(read_file(f"{self.path}/{META}"))
        self.seed, self.total, self.piece_rows = meta["seed"], meta["total"], meta["piece_rows"]
        self.last = min(self.total * meta["epochs"], int(options.get("until", 1 << 62)))
        self.batch, self.names = int(options.get("batchrows", options.get("batchRows", 100_000))), schema.names
        self.planned: int | None = None

    def place(self, offset: dict) -> int:
        if offset["seed"] != self.seed:
            raise ValueError(f"the checkpoint is of seed {offset['seed']}, the pass of seed {self.seed}")
        return offset["epoch"] * self.total + offset["position"]

    def offset(self, place: int) -> dict:
        total = max(1, self.total)
        return {"seed": self.seed, "epoch": place // total, "position": place % total}

    def initialOffset(self) -> dict:
        return self.offset(0)

    def latestOffset(self) -> dict:
        """A batch further than what was planned last, in this run or, by the checkpoint's log, in the run before."""
        if self.planned is None:
            self.planned = self.logged()
        self.planned = max(self.planned, min(self.planned + self.batch, self.last))
        return self.offset(self.planned)

    def logged(self) -> int:
        """The newest offset of the checkpoint's log, which Spark replays or has done; 0 without one."""
        if not self.checkpoint:
            return 0
        system, at = filesystem(f"{self.checkpoint.rstrip('/')}/offsets")
        if system.get_file_info(at).type != fs.FileType.Directory:
            return 0
        numbers = [f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.isdigit()]
        if not numbers:
            return 0
        with system.open_input_stream(f"{at}/{max(numbers, key=int)}") as log:
            return self.place(json.loads(log.read().decode().strip().split("\n")[-1]))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        at, upto, out = self.place(start), self.place(end), []
        while at < upto:
            epoch, i = at // self.total, at % self.total
            piece = i // self.piece_rows
            stop = min(self.total, (piece + 1) * self.piece_rows, i + upto - at)
            out.append(Slice(epoch, piece, i, stop))
            at += stop - i
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, at = filesystem(f"{self.path}/epoch={partition.epoch}/piece={partition.piece}")
        found = 0
        for info in system.get_file_info(fs.FileSelector(at)):
            if not info.base_name.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as opened:
                for batch in pq.ParquetFile(opened).iter_batches(batch_size=10_000):
                    i = batch.column("i")
                    here = batch.filter(pa.compute.and_(pa.compute.greater_equal(i, partition.first), pa.compute.less(i, partition.end)))
                    found += len(here)
                    if len(here):
                        epochs = pa.array([partition.epoch] * len(here), pa.int64())
                        yield pa.RecordBatch.from_arrays([epochs, *[here.column(n) for n in self.names[1:]]], self.names)
        if found != partition.end - partition.first:
            raise OSError(f"{found} of {partition.end - partition.first} samples in piece {partition.piece} of epoch {partition.epoch}")


def pass_stream(spark: SparkSession, path: str, checkpoint: str, *, batch_rows: int = 100_000, until: int | None = None) -> DataFrame:
    """The prepared passes as a stream in batches of ``batch_rows``; ``checkpoint`` is that of the query.

    With ``until`` the stream pauses after so many samples, counted from the first epoch on.
    """
    spark.dataSource.register(PassSource)
    reader = spark.readStream.format(PassSource.name()).option("checkpoint", checkpoint).option("batchRows", batch_rows)
    return (reader if until is None else reader.option("until", until)).load(path)


def run_pass(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append all that is there to a Parquet table, batch by batch, each sample once; then stop."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start(target)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
