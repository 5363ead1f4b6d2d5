"""Worker splits, batches and shards.

All of them are arithmetic on the dense index ``i`` and the row count, so the
work needs no shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.functions.columns import free_names, idiv, shard_name
from shardflow.operators.ordering import dense_index, running_start


def strided_size(total: Column | str, workers: int, worker: Column | str) -> Column:
    total = F.col(total) if isinstance(total, str) else total
    worker = F.col(worker) if isinstance(worker, str) else worker
    return idiv(total - worker + (workers - 1), workers)


def split_strided(df: DataFrame, workers: int, total: str | None = None) -> DataFrame:
    """Worker ``k`` takes every ``workers``-th sample from ``k`` on."""
    out = df.withColumn("worker", F.col("i") % workers).withColumn("pos", idiv("i", workers))
    return out.withColumn("worker_rows", strided_size(total, workers, "worker")) if total else out


def split_contiguous(df: DataFrame, workers: int, total: str) -> DataFrame:
    """Consecutive runs of samples; the first ``total % workers`` are one longer."""
    short = idiv(total, workers)
    longer = F.col(total) % workers
    edge = longer * (short + 1)
    in_long = F.col("i") < edge
    safe = F.greatest(short, F.lit(1))
    worker = F.when(in_long, idiv("i", short + 1)).otherwise(longer + idiv(F.col("i") - edge, safe))
    pos = F.when(in_long, F.col("i") % (short + 1)).otherwise((F.col("i") - edge) % safe)
    return (
        df.withColumn("worker", worker)
        .withColumn("pos", pos)
        .withColumn("worker_rows", short + F.when(F.col("worker") < longer, 1).otherwise(0))
    )


def split_shards(df: DataFrame, workers: int, shard: str = "shard", pos: str = "pos") -> DataFrame:
    """Whole shards go to workers in turn; ``pos`` becomes the place in the worker's stream.

    ``shard`` counts from zero.  A column ``worker`` of ``df`` is replaced.
    """
    of, rows, start = free_names(df, "_shard", "_rows", "_start")
    shards = df.groupBy(F.col(shard).alias(of)).agg(F.count(F.lit(1)).alias(rows))
    shards = shards.withColumn("worker", F.col(of) % workers)
    starts = running_start(shards, of, rows, within=["worker"], start=start).drop(rows)
    kept = [c for c in df.columns if c != "worker"]
    return df.select(*kept).join(starts, F.col(shard) == F.col(of)).select(
        *[c for c in kept if c != pos], "worker", (F.col(start) + F.col(pos)).alias(pos)
    )


def batches(df: DataFrame, size: int = 32, by: str = "i") -> DataFrame:
    """Batches of ``size`` in the order of ``by``: ``i`` for all samples, ``pos`` per worker."""
    return df.withColumn("batch", idiv(by, size)).withColumn("batch_pos", F.col(by) % size)


def drop_short_batches(df: DataFrame, rows: str, size: int = 32) -> DataFrame:
    """Leave out a last batch that is not full; ``rows`` is the stream's length."""
    return df.where(F.col("batch") < idiv(rows, size))


def batch_lengths(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_images"))


def shards_fixed(df: DataFrame, size: int = 2000, prefix: str = "shard_") -> DataFrame:
    """Shards of ``size`` samples, the last one shorter."""
    return (
        df.withColumn("shard", idiv("i", size))
        .withColumn("pos", F.col("i") % size)
        .withColumn("shard_name", shard_name("shard", prefix))
    )


def shard_count(total: Column | str, size: int) -> Column:
    total = F.col(total) if isinstance(total, str) else total
    return idiv(total + (size - 1), size)


def repeat_runs(df: DataFrame, ids: Sequence[str], runs: int, seed: int = 0) -> DataFrame:
    """Every run passes over all samples, each in an order of its own."""
    each = df.withColumn("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(runs - 1).cast("bigint"))))
    return dense_index(each, ids, seed=seed, epoch=F.col("run_id"), within=["run_id"])


def collate(df: DataFrame, by: Sequence[str], fields: Sequence[str], size: int, pos: str = "batch_pos") -> DataFrame:
    """One row per batch with its samples in order.

    Batches hold at most ``size`` samples; more is an error, not a large row.
    """
    item = F.struct(pos, *fields)
    packed = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_images"), F.array_sort(F.collect_list(item)).alias("samples"))
    fits = F.when(F.col("n_images") > size, F.raise_error(F.lit("batch longer than its size"))).otherwise(
        F.col("n_images")
    )
    return packed.withColumn("n_images", fits)


def stack_tensors(df: DataFrame, by: Sequence[str], size: int, pos: str = "batch_pos") -> DataFrame:
    """Collate tensors ``(c, h, w, px)``; a batch of unequal shapes is an error."""
    shape = F.struct("c", "h", "w")
    packed = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.min(shape).alias("_lo"),
        F.max(shape).alias("_hi"),
        F.array_sort(F.collect_list(F.struct(pos, "px"))).alias("_rows"),
    )
    same = F.when(
        (F.col("_lo") != F.col("_hi")) | (F.col("n_images") > size),
        F.raise_error(F.lit("batch with unequal tensor shapes or too many samples")),
    ).otherwise(F.col("n_images"))
    return packed.select(*by, same.alias("n_images"), "_lo.*", F.flatten(F.col("_rows.px")).alias("px"))
