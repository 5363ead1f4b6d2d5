from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardflow.operators import ordering, splits


def indexed(spark, n):
    return spark.range(n).select("id", F.col("id").alias("i"), F.lit(n).cast("bigint").alias("n"))


def sizes(df, *by):
    return Counter(tuple(r) for r in df.select(*by).collect())


@pytest.mark.parametrize("n,batches,last", [(10_000, 313, 16), (7_958, 249, 22), (32, 1, 32), (1, 1, 1)])
def test_global_batches(spark, n, batches, last):
    got = sizes(splits.batches(indexed(spark, n)), "batch")
    assert len(got) == batches and got[(batches - 1,)] == last and sum(got.values()) == n


@pytest.mark.parametrize("n,workers,batches", [(10_000, 4, 316), (7_958, 4, 252)])
def test_strided_batches(spark, n, workers, batches):
    parts = splits.split_strided(indexed(spark, n), workers, "n")
    assert len(sizes(splits.batches(parts, by="pos"), "worker", "batch")) == batches
    for (worker, rows), count in sizes(parts, "worker", "worker_rows").items():
        assert rows == count


@pytest.mark.parametrize("n,batches", [(2_500, 80), (3_500, 112)])
def test_contiguous_batches(spark, n, batches):
    parts = splits.split_contiguous(indexed(spark, n), 4, "n")
    assert len(sizes(splits.batches(parts, by="pos"), "worker", "batch")) == batches


@pytest.mark.parametrize("n,workers", [(10, 4), (3, 5), (8, 4), (1, 1), (1000, 7)])
def test_contiguous_is_array_split(spark, n, workers):
    short, longer = divmod(n, workers)
    want = [short + 1] * longer + [short] * (workers - longer)
    rows = splits.split_contiguous(indexed(spark, n), workers, "n").orderBy("i").collect()
    assert [r.worker for r in rows] == [w for w, k in enumerate(want) for _ in range(k)]
    assert [r.pos for r in rows] == [p for k in want for p in range(k)]
    assert all(r.worker_rows == want[r.worker] for r in rows)


TARS = {5: [2500] * 5, 8: [2500] * 5 + [1000] * 3, 10: [2500] * 5 + [1000] * 5}


@pytest.mark.parametrize("tars,batches", [(5, 394), (8, 487), (10, 549)])
def test_whole_shards_to_workers(spark, tars, batches):
    rows = spark.createDataFrame(list(enumerate(TARS[tars])), "shard bigint, n int")
    rows = rows.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint"))).alias("pos"))
    parts = splits.split_shards(rows, 4)
    for worker in range(4):
        pos = sorted(r.pos for r in parts.where(F.col("worker") == worker).select("pos").collect())
        assert pos == list(range(len(pos)))
    assert len(sizes(splits.batches(parts, by="pos"), "worker", "batch")) == batches


def test_short_last_batches_can_be_dropped(spark):
    parts = splits.batches(splits.split_strided(indexed(spark, 300), 4, "n"), 32, by="pos")
    got = sizes(splits.drop_short_batches(parts, "worker_rows", 32), "worker", "batch")
    assert got == {(w, b): 32 for w in range(4) for b in range(2)}


@pytest.mark.parametrize("n,shards,last", [(10_000, 5, 2000), (7_958, 4, 1958), (1, 1, 1)])
def test_fixed_shards(spark, n, shards, last):
    df = splits.shards_fixed(indexed(spark, n)).withColumn("of", splits.shard_count("n", 2000))
    got = sizes(df, "shard", "shard_name", "of")
    assert len(got) == shards and got[(shards - 1, f"shard_{shards:02d}.tar", shards)] == last


def test_collate_keeps_order_and_refuses_long_batches(spark):
    df = splits.batches(ordering.dense_index(spark.range(100), ["id"], seed=1), 32)
    order = [r.id for r in df.orderBy("i").collect()]
    got = splits.collate(df, ["batch"], ["id"], 32).orderBy("batch").collect()
    assert [s.id for r in got for s in r.samples] == order
    assert [r.n_images for r in got] == [32, 32, 32, 4]
    with pytest.raises(Exception, match="longer than its size"):
        splits.collate(df, ["batch"], ["id"], 31).collect()


def test_stacked_tensors_must_agree_in_shape(spark):
    rows = [(0, k, 1, 1, 2, [float(k), k + 0.5]) for k in range(3)]
    df = spark.createDataFrame(rows, "batch int, batch_pos int, c int, h int, w int, px array<float>")
    got = splits.stack_tensors(df, ["batch"], 32).first()
    assert (got.n_images, got.c, got.h, got.w, got.px) == (3, 1, 1, 2, [0.0, 0.5, 1.0, 1.5, 2.0, 2.5])
    odd = df.withColumn("w", F.when(F.col("batch_pos") == 1, 1).otherwise(2))
    with pytest.raises(Exception, match="unequal tensor shapes"):
        splits.stack_tensors(odd, ["batch"], 32).collect()


def test_runs_repeat_all_samples_in_other_orders(spark):
    rows = splits.repeat_runs(spark.range(200), ["id"], 3, seed=2).collect()
    orders = [tuple(r.id for r in sorted((x for x in rows if x.run_id == k), key=lambda r: r.i)) for k in range(3)]
    assert all(sorted(o) == list(range(200)) for o in orders) and len(set(orders)) == 3
