import math

import pytest
from pyspark.sql import functions as F

from shardflow.operators import telemetry as T


@pytest.fixture(scope="module")
def tel(spark):
    # One run holds a third of the rows; times repeat, so ids break ties.
    return spark.range(1500).selectExpr(
        "if(id % 3 = 0, 'hot', concat('l', id % 4)) as loader",
        "if(id % 3 = 0, 1L, id % 5) as run_id",
        "id as event_id",
        "timestamp_micros((id * 7919 % 700) * 1000003) as ts",
        "id % 32 + 1 as n_images",
        "cast(id % 100 / 10 as decimal(18,2)) as load_time",
        "cast(id % 7 as double) as cpu",
        "cast(0.5 as decimal(18,2)) as ram",
    )


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_long_runs_in_blocks_give_the_same(tel):
    start = F.lit("1970-01-01").cast("timestamp")
    for run_start in (None, start):
        whole = rows(T.run_sequence(tel, run_start))
        assert rows(T.run_sequence(tel, run_start, block_rows=100)) == whole
        assert rows(T.run_sequence(tel, run_start, block_rows=7)) == whole


def test_sequence_against_a_loop(tel):
    got = {r.event_id: r for r in T.run_sequence(tel).collect()}
    runs = {}
    for r in tel.collect():
        runs.setdefault((r.loader, r.run_id), []).append(r)
    for run in runs.values():
        total, before = 0, None
        for k, r in enumerate(sorted(run, key=lambda r: (r.ts, r.event_id))):
            total += r.n_images
            g = got[r.event_id]
            assert (g.batch, g.images_so_far) == (k, total)
            assert g.latency == (None if before is None else pytest.approx((r.ts - before).total_seconds()))
            before = r.ts


def test_no_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double").groupBy("g")
    assert {r.g: r.m for r in df.agg(T.exact_mean("v").alias("m")).collect()} == {"a": 0.0, "b": 2.0}
    nan = {r.g: r.m for r in df.agg(T.exact_mean("v", "nan").alias("m")).collect()}
    assert math.isnan(nan["a"]) and nan["b"] == 2.0


def test_run_of_one_batch_has_no_rate(tel):
    one = tel.where("event_id = 3")
    got = T.run_records(one).first()
    assert (got.total_time, got.total_images, got.images_per_sec) == (0.0, 4, 0.0)


def test_first_batches(tel):
    got = {(r.loader, r.run_id): r.event_id for r in T.first_batches(tel).collect()}
    runs = {}
    for r in tel.collect():
        key = (r.loader, r.run_id)
        runs[key] = min(runs.get(key, (r.ts, r.event_id)), (r.ts, r.event_id))
    assert got == {k: v[1] for k, v in runs.items()}


def test_aggregates_are_partial(tel):
    plan = T.run_records(tel)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan
