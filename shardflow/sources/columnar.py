"""Labelled shards in columns: compressed Parquet files with the shard as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "shard bigint, pos bigint, image binary, label int"


def write_column_shards(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write ``shard, pos, image, label``; a shard lies whole in one file, a file may hold several.

    Shards are limited in bytes beforehand, so a task never holds more than
    the shards that fall to it.  Rows are sorted by shard, whose range in a file lets
    a reader of one shard skip the others.
    """
    (
        df.selectExpr("cast(shard as bigint) shard", "cast(pos as bigint) pos", "cast(image as binary) image", "cast(label as int) label")
        .repartition("shard")
        .sortWithinPartitions("shard", "pos")
        .write.option("compression", compression)
        .parquet(path)
    )


def read_column_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
