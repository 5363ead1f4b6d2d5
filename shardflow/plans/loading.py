"""Whole jobs: from a manifest to batches, to shards, and from telemetry to a ranking."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.functions import columns as C
from shardflow.operators import ordering, packing, samples, scoring, splits, telemetry
from shardflow.sources import tar


def worker_batches(
    manifest: DataFrame,
    ids: Sequence[str],
    *,
    exts: Iterable[str] = C.OBJECT_STORE_EXTS,
    workers: int = 4,
    size: int = 32,
    split: str = "strided",
    seed: int = 0,
    epoch: int = 0,
) -> DataFrame:
    """Loadable samples, shuffled, split over workers and cut into batches."""
    rows = samples.loadable(manifest, exts)
    placed = ordering.dense_index(rows, ids, seed=seed, epoch=epoch, total="n_total")
    if split == "strided":
        parts = splits.split_strided(placed, workers, "n_total")
    elif split == "contiguous":
        parts = splits.split_contiguous(placed, workers, "n_total")
    else:
        raise ValueError(f"unknown split {split!r}")
    return splits.batches(parts, size, by="pos").drop("n_total")


def fixed_shards(manifest: DataFrame, ids: Sequence[str], size: int = 2000, seed: int = 0) -> DataFrame:
    """Shuffled samples in shards of a fixed number; ``n_total`` is the number of samples."""
    return splits.shards_fixed(ordering.dense_index(manifest, ids, seed=seed, total="n_total"), size)


def byte_shards(manifest: DataFrame, ids: Sequence[str], limit: int = 200 << 20, seed: int = 0) -> DataFrame:
    """Shuffled samples in shards of at most ``limit`` bytes."""
    return packing.shards_by_bytes(ordering.dense_index(manifest, ids, seed=seed), limit, ids)


def with_payload(placed: DataFrame, payloads: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Bring the bytes in last, when order, split and shard are settled on small rows."""
    return placed.join(payloads, list(ids))


def labelled_tar(
    rows: DataFrame, payloads: DataFrame, ids: Sequence[str], path: str, size: int = 2000, seed: int = 0, prefix: str = "shard_"
) -> DataFrame:
    """Write samples and their JSON labels to tar shards; gives those without a label, which are not written, with an ``error``."""
    placed = fixed_shards(rows.where(F.col("label").isNotNull()), ids, size, seed)
    slim = placed.select(*ids, "shard", "pos", F.concat_ws("/", "class", "key").alias("key"), "ext", "label")
    tar.write_tar(samples.labelled_members(with_payload(slim, payloads, ids)), path, prefix=prefix)
    return samples.unlabelled(rows)


def ranking(tel: DataFrame, weights=scoring.WEIGHTS_FIVE) -> DataFrame:
    """Telemetry to run records to means to a leaderboard."""
    stats = telemetry.mean_statistics(telemetry.run_records(tel))
    return scoring.leaderboard(scoring.scores(stats, weights))


def batch_totals(batched: DataFrame) -> DataFrame:
    """Batches, samples and bytes of each worker."""
    per = batched.groupBy("worker", "batch").agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("length").cast("bigint").alias("bytes")
    )
    return per.groupBy("worker").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n_images").cast("bigint").alias("n_images"),
        F.min("n_images").alias("shortest"),
        F.sum("bytes").cast("bigint").alias("bytes"),
    )
