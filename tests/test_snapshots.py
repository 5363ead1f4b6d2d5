import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardflow.operators import batch_table
from shardflow.sources import snapshots


def shards(spark, first, n):
    rows = [(k // 3, k % 3, f"image {first + k}".encode(), k % 2) for k in range(n)]
    return spark.createDataFrame(rows, "shard long, pos long, image binary, label int")


def content(df):
    return sorted((r.shard, r.pos, bytes(r.image).decode()) for r in df.collect())


def test_appends_failures_and_readers(spark, tmp_path):
    root = str(tmp_path / "set")
    assert snapshots.snapshots(spark, root) == [] and snapshots.read_snapshot(spark, root).collect() == []
    assert snapshots.append(shards(spark, 0, 7), root) == 1
    reader = snapshots.read_snapshot(spark, root)
    one = content(reader)
    broken = shards(spark, 50, 9).withColumn("image", F.when(F.col("pos") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("image")))
    with pytest.raises(PySparkException):
        snapshots.append(broken, root)
    assert snapshots.snapshots(spark, root) == [1]
    assert snapshots.append(shards(spark, 7, 4), root) == 2
    assert content(reader) == one == [(k // 3, k % 3, f"image {k}") for k in range(7)]
    assert content(snapshots.read_snapshot(spark, root, 1)) == one
    assert content(snapshots.read_snapshot(spark, root)) == one + [(3 + k // 3, k % 3, f"image {7 + k}") for k in range(4)]
    listed = sorted(tuple(r) for r in snapshots.shard_listing(spark, root).collect())
    assert listed == [(0, 3, 21), (1, 3, 21), (2, 1, 7), (3, 3, 21), (4, 1, 8)]
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, root, 3)
    # An empty append is a snapshot with the same shards.
    assert snapshots.append(shards(spark, 0, 0), root) == 3
    assert content(snapshots.read_snapshot(spark, root)) == content(snapshots.read_snapshot(spark, root, 2))


def test_two_writers_and_expiry(spark, tmp_path):
    root = str(tmp_path / "set")
    snapshots.append(shards(spark, 0, 3), root)
    with pytest.raises(RuntimeError):  # both have started from no snapshot
        snapshots._commit(spark, root, 1, ["append-other"])
    (tmp_path / "set" / "append-left-over").mkdir()
    snapshots.append(shards(spark, 3, 3), root)
    assert snapshots.expire(spark, root, keep=1) == []  # too young
    assert snapshots.expire(spark, root, keep=1, older_than=-5) == ["append-left-over"]
    assert snapshots.snapshots(spark, root) == [2]
    assert len(content(snapshots.read_snapshot(spark, root))) == 6


def test_table_function(spark):
    batch_table.register(spark)
    rows = [(w, p, f"{w}-{p}", p) for w, n in ((0, 7), (1, 6), (2, 1)) for p in range(n)] + [(None, 0, None, None)]
    df = spark.createDataFrame(rows, "worker long, pos long, id string, length long").repartition(5)

    def cut(more):
        return spark.sql("select * from worker_batches(table({df}) partition by worker order by pos, size => " + more + ")", df=df).collect()

    got = sorted(((r.worker, r.batch, r.n_images, r.bytes, r.ids) for r in cut("3")), key=lambda r: (r[0] is None, r))
    want = [(w, b, len(p), sum(p), [f"{w}-{k}" for k in p]) for w, n in ((0, 7), (1, 6), (2, 1)) for b in range((n + 2) // 3) for p in [range(b * 3, min(n, b * 3 + 3))]]
    assert got == want + [(None, 0, 1, 0, [None])]
    assert sorted((r.worker, r.batch) for r in cut("3, drop_short => true")) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    with pytest.raises(PySparkException, match="at least one"):
        cut("0")
    with pytest.raises(PySparkException, match="needs the columns length"):
        spark.sql("select * from worker_batches(table({df}) partition by worker order by pos, size => 3)", df=df.drop("length")).collect()
