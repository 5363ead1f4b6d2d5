"""Runs of arriving telemetry that close once they have been silent.

A run's record is given once, when the watermark has passed its last batch by
``silence``, and its state goes with it, so the state holds open runs only.
Batches are summed by run and time slot before they are shuffled, so a run
that holds a third of all batches costs one row for each slot of a task's
batch.  Slots that end before the watermark are late: Spark would drop them,
here they are kept in a table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from shardflow.functions.columns import rate
from shardflow.operators.telemetry import RUN, RUN_METRICS, micros

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEANS = ("load_time", "cpu", "ram")
#: Sums of a run or slot: first and last batch in microseconds, batches, images, and sum and count of each mean.
PARTS = ("first", "last", "n_batches", "n_images", *[f"{kind}_{m}" for m in MEANS for kind in ("sum", "n")])
MILLI = 1000


def _sum_type(of: T.DataType) -> T.DataType:
    return T.DecimalType(38, of.scale) if isinstance(of, T.DecimalType) else T.DoubleType()


def _parts_schema(tel: DataFrame) -> list[T.StructField]:
    whole = [T.StructField(n, T.LongType()) for n in PARTS[:4]]
    for m in MEANS:
        whole += [T.StructField(f"sum_{m}", _sum_type(tel.schema[m].dataType)), T.StructField(f"n_{m}", T.LongType())]
    return whole


def slot_sums(tel: DataFrame, slot_seconds: int) -> DataFrame:
    """``loader, run_id, slot_end`` (microseconds) and the sums of every slot in a task's Arrow batch; no shuffle."""
    width = slot_seconds * 1_000_000
    at = micros("ts")
    narrow = tel.select(
        *RUN, "ts", at.alias("at"), ((F.floor(at / F.lit(width)) + 1) * width).cast("bigint").alias("slot_end"),
        F.col("n_images").cast("bigint").alias("n_images"), *[F.col(m).cast(_sum_type(tel.schema[m].dataType)).alias(m) for m in MEANS],
    )
    parts = _parts_schema(tel)
    schema = T.StructType([*[tel.schema[k] for k in RUN], T.StructField("slot_end", T.LongType()), *parts])
    arrow = to_arrow_schema(schema)
    keys = [*RUN, "slot_end"]
    wanted = [("at", "min"), ("at", "max"), ([], "count_all"), ("n_images", "sum")]
    wanted += [(m, kind) for m in MEANS for kind in ("sum", "count")]
    made = ["at_min", "at_max", "count_all", "n_images_sum", *[f"{m}_{kind}" for m in MEANS for kind in ("sum", "count")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(keys).aggregate(wanted)
            table = table.select([*keys, *made]).rename_columns(arrow.names).cast(arrow)
            yield from table.to_batches()

    return narrow.mapInArrow(run, schema)


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def _plus(a, b):
    return b if a is None else a if b is None else a + b


JOIN = (_least, _most, *[_plus] * (len(PARTS) - 2))


def _out(key, slot_end, sums, late: bool) -> Row:
    return Row(**dict(zip(RUN, key)), slot_end=slot_end, **dict(zip(PARTS, sums)), late=late)


class ClosingRuns(StatefulProcessor):
    """Sums of every open run, and a timer at the end of its silence."""

    def __init__(self, silence_ms: int, state: T.StructType) -> None:
        self.silence_ms, self.schema = silence_ms, state

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = self.sums.get() if self.sums.exists() else None
        *sums, due = held if held is not None else (*[None] * len(PARTS), None)
        fresh = False
        for row in rows:
            parts = tuple(row[p] for p in PARTS)
            end = row["slot_end"]
            if end is not None and end // MILLI <= mark:
                yield _out(key, end, parts, late=True)
                continue
            fresh = True
            sums = [join(a, b) for join, a, b in zip(JOIN, sums, parts)]
            until = (mark if end is None else end // MILLI) + self.silence_ms
            if due is None or until > due:
                if due is not None:
                    self.handle.deleteTimer(due)
                due = until
                self.handle.registerTimer(due)
        if fresh:
            self.sums.update((*sums, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.sums.exists():
            *sums, _ = self.sums.get()
            self.sums.clear()
            yield _out(key, None, sums, late=False)

    def close(self) -> None:
        pass


def closed_runs(tel_stream: DataFrame, target: str, checkpoint: str, *, delay: str, silence_seconds: int, slot_seconds: int = 60) -> int:
    """Write records of runs that have closed and sums of late slots; returns the rows of state that are left.

    ``tel_stream`` has the telemetry columns, ``ts`` a timestamp.  A row without
    loader and run is a heartbeat: it moves the watermark and is in no run.  Rows
    without ``ts`` count in their run and are never late.  A run that is heard of
    again, in time, after it has closed opens another record.  Every trigger
    writes ``target/batch_id=<n>``, which replaces what an earlier attempt left;
    read it by ``run_results`` and ``late_slots``.
    """
    spark = tel_stream.sparkSession
    sums = slot_sums(tel_stream.withWatermark("ts", delay), slot_seconds).where("loader is not null or run_id is not null")
    parts = T.StructType(_parts_schema(tel_stream))
    state = T.StructType([*parts.fields, T.StructField("due", T.LongType())])
    out = T.StructType([*[tel_stream.schema[k] for k in RUN], T.StructField("slot_end", T.LongType()), *parts.fields, T.StructField("late", T.BooleanType())])
    closed = sums.groupBy(*RUN).transformWithState(ClosingRuns(silence_seconds * MILLI, state), out, "append", "eventTime")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # the store that keeps timers
    try:
        writer = closed.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    last = query.lastProgress
    return sum(s.numRowsTotal for s in last.stateOperators) if last else 0


def run_results(spark: SparkSession, target: str) -> DataFrame:
    """Records of closed runs, with the columns of ``telemetry.run_records``."""
    mean = lambda m: F.coalesce(F.try_divide(F.col(f"sum_{m}").cast("double"), F.col(f"n_{m}")), F.lit(0.0))
    rows = spark.read.parquet(target).where("not late")
    rows = rows.select(
        *RUN,
        ((F.col("last") - F.col("first")) / F.lit(1e6)).alias("total_time"),
        F.col("n_images").alias("total_images"),
        *[mean(m).alias("avg_data_load_time" if m == "load_time" else f"avg_{m}") for m in MEANS],
    )
    return rows.withColumn("images_per_sec", rate("total_images", "total_time")).select(*RUN, *RUN_METRICS)


def late_slots(spark: SparkSession, target: str) -> DataFrame:
    """Sums of what came too late, by run and slot."""
    return spark.read.parquet(target).where("late").drop("late", "batch_id")
