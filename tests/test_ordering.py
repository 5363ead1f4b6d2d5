import hashlib

import pytest
from pyspark.sql import functions as F

from shardflow.operators import ordering as O
from shardflow.operators import splits


def places(df, key="id", index="i"):
    return {r[key]: r[index] for r in df.select(key, index).collect()}


def brute(ids, seed, epoch=0):
    keyed = sorted(ids, key=lambda k: (hashlib.md5(f"{seed}|{epoch}|{k}".encode()).hexdigest()[:15], k))
    return {k: i for i, k in enumerate(keyed)}


@pytest.mark.parametrize("tasks,inputs", [(1, 1), (8, 3), (100, 7)])
def test_dense_index_is_the_sorted_order(spark, partitions, tasks, inputs):
    partitions(tasks)
    df = spark.range(0, 3000, 1, inputs)
    assert places(O.dense_index(df, ["id"], seed=5, epoch=2)) == brute(range(3000), 5, 2)


def test_epochs_and_seeds_differ_and_repeat(spark):
    df = spark.range(500)
    one = places(O.shuffle_global(df, ["id"], 1))
    assert one == places(O.shuffle_global(df.repartition(5), ["id"], 1))
    assert one != places(O.shuffle_global(df, ["id"], 1, epoch=1))
    assert one != places(O.shuffle_global(df, ["id"], 2))
    assert sorted(one.values()) == list(range(500))


def test_limit_takes_the_first_of_the_order(spark):
    want = {k: i for k, i in brute(range(2000), 3).items() if i < 70}
    assert places(O.sample_permutation(spark.range(2000), ["id"], 3, limit=70)) == want
    assert len(places(O.sample_permutation(spark.range(20), ["id"], 3, limit=70))) == 20


def test_groups_of_any_size_are_indexed_apart(spark):
    # One group holds a third of the rows, one is null.
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") > 100, (F.col("id") % 50).cast("string")))
    rows = O.dense_index(df, ["id"], seed=1, within=["g"], total="n").collect()
    by = {}
    for r in rows:
        by.setdefault(r.g, []).append(r)
    assert sum(map(len, by.values())) == 3000 and None in by
    for group in by.values():
        assert sorted(r.i for r in group) == list(range(len(group)))
        assert {r.n for r in group} == {len(group)}


@pytest.mark.parametrize("tasks", [1, 8, 40])
def test_sorted_index_with_most_rows_in_one_folder(spark, partitions, tasks):
    partitions(tasks)
    paths = [f"hot/{k % 7}/{k}" for k in range(2000)] + [f"d{k}-x/{k}" for k in range(50)] + ["a/b", "a-b/c", "é/x"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(5)
    assert places(O.sort_paths(df), "path") == {p: i for i, p in enumerate(sorted(paths, key=lambda p: p.split("/")))}
    by_text = places(O.sort_paths(df, by="string"), "path")
    assert by_text == {p: i for i, p in enumerate(sorted(paths))}
    assert by_text["a-b/c"] < by_text["a/b"]


def test_running_start(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g", "(id * 7919) % 101 as v")
    got = {r.id: r.start for r in O.running_start(df, "id", "v", within=["g"], span=64).collect()}
    sums = [0, 0, 0]
    for k in range(1000):
        assert got[k] == sums[k % 3]
        sums[k % 3] += k * 7919 % 101


def test_shuffle_shards_keeps_each_shard_together(spark):
    # Shard 0 holds a third of all samples.
    df = spark.range(900).selectExpr("id", "if(id < 300, 0, id div 30) as shard", "if(id < 300, id, id % 30) as pos")
    rows = sorted(O.shuffle_shards(df, seed=4).collect(), key=lambda r: r.i)
    assert [r.i for r in rows] == list(range(900))
    order = list(dict.fromkeys(r.shard for r in rows))
    want = sorted(order, key=lambda s: (hashlib.md5(f"4|0|{s}".encode()).hexdigest()[:15], s))
    assert order == want
    for s in order:
        assert [r.pos for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))


@pytest.mark.parametrize("buffer", [1, 7, 250])
def test_local_shuffle_moves_less_than_the_buffer(spark, buffer):
    df = spark.range(1000).withColumn("i", F.col("id"))
    moved = places(O.shuffle_local(df, ["id"], buffer, seed=1))
    assert sorted(moved.values()) == list(range(1000))
    assert all(abs(k - i) < buffer for k, i in moved.items())
    assert buffer == 1 or any(k != i for k, i in moved.items())


def test_resume_goes_on_where_the_pass_stopped(spark):
    whole = places(O.shuffle_global(spark.range(300), ["id"], 9, epoch=1))
    rest = places(O.resume_from(spark.range(300), ["id"], 9, 1, 120))
    assert rest == {k: i for k, i in whole.items() if i >= 120}


def test_only_the_bucket_table_goes_through_one_task(spark):
    df = O.dense_index(spark.range(10_000), ["id"], seed=1)
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [k for k, line in enumerate(plan) if "SinglePartition" in line]
    assert len(single) == 1
    assert "_bucket" in plan[single[0] + 1] and "Aggregate" in plan[single[0] + 1]
    assert sum("Exchange hashpartitioning(_bucket" in line for line in plan) == 2
    assert "BroadcastHashJoin" in "".join(plan)


def test_columns_with_inner_names_are_kept(spark):
    names = ["_key", "_bucket", "_n", "_start", "_end", "_total", "_at", "_part", "_span", "_sum", "_base", "_shard", "_rows", "_block", "_place", "start", "_KEY_"]
    df = spark.range(300).selectExpr("id", "id div 50 as shard", "id % 50 as pos", *[f"concat('{n}', id) as `{n}`" for n in names])

    def kept(out):
        rows = out.collect()
        assert len(rows) == 300 and all(r[n] == f"{n}{r.id}" for r in rows for n in names)
        return rows

    assert sorted(r.i for r in kept(O.dense_index(df, ["id"], total="all"))) == list(range(300))
    assert [r.i for r in sorted(kept(O.dense_index(df, ["id"], within=["shard"])), key=lambda r: (r.shard, r.i))] == [*range(50)] * 6
    assert all(r.i == r.id for r in kept(O.sorted_index(df, "id")))
    assert all(r.sum == sum(range(r.id)) for r in kept(O.running_start(df, "id", "id", start="sum")))
    assert sorted(r.i for r in kept(O.shuffle_dataset(df, ["id"], 7))) == list(range(300))
    assert {(r.worker, r.shard % 2) for r in kept(splits.split_shards(df, 2))} == {(0, 0), (1, 1)}
