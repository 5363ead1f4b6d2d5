"""Per-batch telemetry to run records to statistics over runs.

Telemetry rows are ``loader, run_id, event_id, ts, n_images, load_time, cpu,
ram``.  All sums are partial aggregates, so a run with most of the rows is
reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardflow.functions.columns import free_names, idiv, rate
from shardflow.operators.ordering import sorted_index

RUN = ("loader", "run_id")
RUN_METRICS = ("total_time", "total_images", "images_per_sec", "avg_data_load_time", "avg_cpu", "avg_ram")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def exact_mean(column: str, empty: str = "zero") -> Column:
    """Mean as sum over count, exact for decimals; no values give 0 or NaN."""
    if empty not in ("zero", "nan"):
        raise ValueError(f"unknown empty value {empty!r}")
    mean = F.try_divide(F.sum(column).cast("double"), F.count(column))
    return F.coalesce(mean, F.lit(0.0 if empty == "zero" else float("nan")))


def elapsed(by: str = "ts") -> Column:
    """Aggregate: seconds between the first and the last batch."""
    return (F.max(micros(by)) - F.min(micros(by))) / F.lit(1e6)


def run_records(tel: DataFrame, extra: Sequence[str] = (), by: Sequence[str] = RUN) -> DataFrame:
    """One row per run; ``extra`` are optional telemetry columns to average (``gpu_util``, ``disk``)."""
    got = tel.groupBy(*by).agg(
        elapsed().alias("total_time"),
        F.sum("n_images").cast("bigint").alias("total_images"),
        exact_mean("load_time").alias("avg_data_load_time"),
        exact_mean("cpu").alias("avg_cpu"),
        exact_mean("ram").alias("avg_ram"),
        *[F.try_divide(F.sum(c).cast("double"), F.count(c)).alias(f"avg_{c}") for c in extra],
    )
    more = [f"avg_{c}" for c in extra]
    return got.withColumn("images_per_sec", rate("total_images", "total_time")).select(*by, *RUN_METRICS, *more)


def run_statistics(runs: DataFrame, metrics: Sequence[str] = RUN_METRICS) -> DataFrame:
    """``mean`` and population ``std`` of each metric over a loader's runs, two rows per loader."""
    packed = runs.groupBy("loader").agg(
        F.struct(F.lit("mean").alias("statistic"), *[F.avg(m).alias(m) for m in metrics]).alias("_mean"),
        F.struct(F.lit("std").alias("statistic"), *[F.stddev_pop(m).alias(m) for m in metrics]).alias("_std"),
    )
    return packed.select("loader", F.inline(F.array("_mean", "_std")))


def mean_statistics(runs: DataFrame, metrics: Sequence[str] = RUN_METRICS) -> DataFrame:
    """The mean rows alone, the input of all scores."""
    return runs.groupBy("loader").agg(*[F.avg(m).alias(m) for m in metrics])


def first_batches(tel: DataFrame) -> DataFrame:
    """The first batch of every run, as an aggregate."""
    first = F.min(F.struct("ts", "event_id", "n_images")).alias("first")
    return tel.groupBy(*RUN).agg(first).select(*RUN, "first.*")


def run_sequence(tel: DataFrame, run_start: Column | None = None, block_rows: int = 65_536) -> DataFrame:
    """Number the batches of each run and add latency and running total.

    Adds ``batch`` (from zero), ``latency`` (seconds since the batch before;
    for the first one since ``run_start``, or null without it) and
    ``images_so_far``.

    The rows of all runs are cut into equal blocks in sorted order, and one
    row per block and run is carried over: a run of any length is spread over tasks.
    """
    at, piece, first, images, last, start, before, last_before = free_names(
        tel, "_i", "_piece", "_first", "_images", "_last", "_start", "_before", "_last_before"
    )
    placed = sorted_index(tel, *RUN, "ts", "event_id", index=at)
    placed = placed.withColumn(piece, F.struct(*RUN, idiv(at, block_rows).alias("block")))
    pieces = placed.groupBy(piece).agg(
        F.min(at).alias(first), F.sum("n_images").alias(images), F.max(micros("ts")).alias(last)
    )
    run = Window.partitionBy(*[f"{piece}.{c}" for c in RUN]).orderBy(f"{piece}.block")
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = pieces.select(
        piece,
        F.min(first).over(upto).alias(start),
        (F.sum(images).over(upto) - F.col(images)).alias(before),
        F.lag(last).over(run).alias(last_before),
    )
    block = Window.partitionBy(piece).orderBy(at)
    inside = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(carried, piece).select(
        *tel.columns,
        (F.col(at) - F.col(start)).cast("bigint").alias("batch"),
        _since(F.coalesce(F.lag(micros("ts")).over(block), F.col(last_before)), run_start).alias("latency"),
        (F.col(before) + F.sum("n_images").over(inside)).cast("bigint").alias("images_so_far"),
    )


def _since(before: Column, run_start: Column | None) -> Column:
    if run_start is not None:
        before = F.coalesce(before, F.unix_micros(run_start.cast("timestamp")))
    return (micros("ts") - before) / F.lit(1e6)
