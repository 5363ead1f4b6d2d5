"""Numbered snapshots of a folder of column shards.

Every append writes its shards, and a listing of them, into a folder of its own.
It counts from the moment its marker ``snapshot-<number>.json`` is there, which
names the folders of the snapshot before and the new one; the marker is created
only if no other writer has made it.  A reader pins a number and sees the same
shards whatever is appended, fails or runs meanwhile.  Folders in no marker (of
failed appends, or of snapshots given up) are never read; ``expire`` removes them.

The driver sees markers (a folder name for each append), never a list of shards.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.sources import columnar

LISTING = "shard bigint, n_images bigint, image_bytes bigint"
MARKER = re.compile(r"snapshot-(\d+)\.json$")


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _marker(root: str, number: int) -> str:
    return f"{root}/snapshot-{number:09d}.json"


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all snapshots, in order."""
    store, at = _store(spark, f"{root}/snapshot-*.json")
    names = [status.getPath().getName() for status in store.globStatus(at) or []]
    return sorted(int(MARKER.match(n).group(1)) for n in names if MARKER.match(n))


def _folders(spark: SparkSession, root: str, number: int | None) -> list[str]:
    """The folders of a snapshot, of the newest without a number; none if there is no snapshot yet."""
    known = snapshots(spark, root)
    if number is None:
        if not known:
            return []
        number = known[-1]
    if number not in known:
        raise ValueError(f"no snapshot {number} in {root}")
    return json.loads(spark.read.text(_marker(root, number), wholetext=True).first()[0])["folders"]


def _tables(spark: SparkSession, root: str, folders: list[str], what: str, schema: str) -> DataFrame:
    paths = [f"{root}/{folder}/{what}" for folder in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """``shard, pos, image, label`` of a snapshot (the newest); what is appended later doesn't change the result."""
    return _tables(spark, root, _folders(spark, root, number), "shards", columnar.SCHEMA)


def shard_listing(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """``shard, n_images, image_bytes`` of a snapshot; no image is read."""
    return _tables(spark, root, _folders(spark, root, number), "listing", LISTING)


def append(rows: DataFrame, root: str) -> int:
    """Add shards (``shard, pos, image, label``) behind those of the newest snapshot; the new one's number.

    Shards of ``rows`` count from zero.  Null images count no bytes.  If another writer has
    committed meanwhile, nothing is added and an error says so: shard numbers
    would clash.
    """
    spark = rows.sparkSession
    known = snapshots(spark, root)
    number = known[-1] if known else 0
    before = _folders(spark, root, number) if number else []
    last = _tables(spark, root, before, "listing", LISTING).agg(F.max("shard")).first()[0]
    folder = f"append-{uuid.uuid4().hex}"
    columnar.write_column_shards(rows.withColumn("shard", F.col("shard") + (0 if last is None else last + 1)), f"{root}/{folder}/shards")
    listing = columnar.read_column_shards(spark, f"{root}/{folder}/shards").groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_images"), F.coalesce(F.sum(F.octet_length("image")), F.lit(0)).cast("bigint").alias("image_bytes")
    )
    listing.write.parquet(f"{root}/{folder}/listing")
    _commit(spark, root, number + 1, [*before, folder])
    return number + 1


def _commit(spark: SparkSession, root: str, number: int, folders: list[str]) -> None:
    store, at = _store(spark, _marker(root, number))
    if store.exists(at):
        raise RuntimeError(f"snapshot {number} was committed by another writer; append again")
    out = store.create(at, False)  # fails where the file has come meanwhile
    out.write(bytearray(json.dumps({"folders": folders}).encode()))
    out.close()


def expire(spark: SparkSession, root: str, keep: int = 1, older_than: float = 86_400) -> list[str]:
    """Give up all but the newest ``keep`` snapshots, and remove folders that none of the kept ones names.

    Folders changed in the last ``older_than`` seconds stay: they may belong to an append
    that is still running.  The names of the removed folders are returned.
    """
    if keep < 1:
        raise ValueError("the newest snapshot can't be given up")
    known = snapshots(spark, root)
    named = {folder for number in known[-keep:] for folder in _folders(spark, root, number)}
    for number in known[:-keep]:
        store, at = _store(spark, _marker(root, number))
        store.delete(at, False)
    gone = []
    store, at = _store(spark, f"{root}/append-*")
    for status in store.globStatus(at) or []:
        name = status.getPath().getName()
        if name not in named and status.getModificationTime() <= (time.time() - older_than) * 1000:
            store.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
