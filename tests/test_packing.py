import numpy as np
import pytest
from pyspark.sql import functions as F

from shardflow.operators import packing


def by_loop(lengths, limit):
    shards, held = [0], lengths[0]
    for n in lengths[1:]:
        if held + n > limit:
            shards.append(shards[-1] + 1)
            held = n
        else:
            shards.append(shards[-1])
            held += n
    return shards


@pytest.mark.parametrize("limit", [1, 50, 99, 1000])
def test_greedy_equals_the_loop(limit):
    lengths = np.random.default_rng(limit).integers(1, 100, 500)
    assert packing.greedy_shards(lengths, limit).tolist() == by_loop(lengths.tolist(), limit)


def test_sample_longer_than_the_limit_is_alone():
    assert packing.greedy_shards(np.array([5, 500, 5, 0, 95]), 100).tolist() == [0, 1, 2, 2, 2]


@pytest.mark.parametrize("span", [2, 5, 16, 1000])
@pytest.mark.parametrize("longest", [100, 2500, 40])
def test_blocks_do_not_change_the_shards(spark, span, longest):
    rng = np.random.default_rng(longest)
    lengths = rng.integers(0, 100, 700)
    lengths[rng.integers(0, 700, 5)] = longest  # some longer than a shard, or than a block
    lengths = lengths.tolist()
    df = spark.range(700).withColumn("i", F.col("id")).withColumn("length", F.array(*map(F.lit, lengths))[F.col("id").cast("int")])
    rows = sorted(packing.shards_by_bytes(df.repartition(5), 300, ["id"], span=span).collect(), key=lambda r: r.i)
    assert [r.shard for r in rows] == by_loop(lengths, 300)
    seen = {}
    for r in rows:
        assert r.pos == seen.get(r.shard, 0)
        seen[r.shard] = r.pos + 1


def test_levels_of_blocks(spark, monkeypatch):
    """Many blocks, composed in several levels; huge samples that leave blocks without any of their own."""
    rng = np.random.default_rng(9)
    lengths = rng.integers(0, 60, 3000)
    lengths[[700, 1500, 1501, 2999]] = [9000, 4000, 700, 20_000]
    lengths = lengths.tolist()
    df = spark.createDataFrame(list(enumerate(lengths)), "i long, length long").withColumn("id", F.col("i"))
    want = by_loop(lengths, 100)
    for fan in (2, 3):
        monkeypatch.setattr(packing, "FAN", fan)
        rows = sorted(packing.shards_by_bytes(df, 100, ["id"], span=4).collect(), key=lambda r: r.i)
        assert [r.shard for r in rows] == want


def test_no_task_holds_more_than_two_blocks(spark, monkeypatch, tmp_path):
    """Rows of the largest group that is composed or handed down, against those of a block."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(list(enumerate(rng.integers(1, 20, 8000).tolist())), "i long, length long").withColumn("id", F.col("i"))
    real, log = (packing.compose, packing.hand_down), str(tmp_path / "log")

    def noted(fn):
        def run(rows):
            with open(log, "a") as f:
                f.write(f"{len(rows)}\n")
            return fn(rows)

        return run

    monkeypatch.setattr(packing, "compose", noted(real[0]))
    monkeypatch.setattr(packing, "hand_down", noted(real[1]))
    packing.shards_by_bytes(df, 100, ["id"]).collect()
    block = 16 * 100 / 10
    sizes = [int(x) for x in open(log)]
    assert len(sizes) > 4 and max(sizes) <= 2 * block
