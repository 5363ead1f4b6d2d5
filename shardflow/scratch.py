"""Written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting that says how many rows go to Python at a time.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own, which goes when the process ends; a cluster session without it is an
    error, because a machine-local folder cannot be seen by the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="shardflow-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below ``<scratch>/shardflow/<application id>``."""
    app = spark.sparkContext.applicationId
    return f"{scratch_dir(spark)}/shardflow/{app}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has a short lineage, keeps column pruning, and gives the same
    rows on every read even when executors are lost.  While it is written,
    Python functions get at most ``batch_rows`` rows at a time, where given and
    where the session does not ask for fewer.
    """
    path = scratch_path(df.sparkSession, label)
    conf = df.sparkSession.conf
    before = conf.get(BATCH_ROWS)
    if batch_rows is None or 0 < int(before) <= batch_rows:
        df.write.parquet(path)
    else:
        conf.set(BATCH_ROWS, str(batch_rows))
        try:
            df.write.parquet(path)
        finally:
            conf.set(BATCH_ROWS, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove what ``materialise`` wrote, once nothing that is still to run reads it."""
    spark = table.sparkSession
    folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
    for folder in folders:
        if f"/shardflow/{spark.sparkContext.applicationId}/" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove what this application has written below the scratch folder; call it when its results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/shardflow/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
