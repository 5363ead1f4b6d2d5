import math
import random

import pytest

from shardflow.llm import exact_topk

SCHEMA = "vec_id long, embedding array<float>, id string, v string, dim string"


def brute(rows, every, k, scale=256):
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    held = set()
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            held.add((i, tuple(math.floor(scale * single(x)) for x in v)))
    out = set()
    for q, a in held:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in held if i != q and len(a) == len(b))[:k]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("spread,block,shards", [(1.0, 4096, 16), (0.0, 3, 2), (3.0, 5, 1)])
def test_against_all_products(spark, spread, block, shards):
    rng = random.Random(int(spread * 10))
    rows = []
    for k in range(400):
        length = math.exp(spread * rng.gauss(0, 1))
        v = [length * rng.gauss(0, 1) * (4 if j < 2 else 1) for j in range(12)]
        rows.append((k, v if k % 3 else [1.0] * 12, "a", "b", "c"))  # a third of the rows are one vector
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = exact_topk.top_products(df, lambda i: i % 20 == 0, k=5, block=block, shards=shards)
    assert {tuple(r) for r in got.collect()} == brute(rows, 20, 5)


def test_odd_rows_and_empty_table(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.3]), (3, None), (4, []), (5, [1.0, None]), (6, [1.0, float("nan")]),
        (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (11, [0.0, 0.0]), (20, [5.0, 5.0, 5.0]), (30, [0.5]),
    ]
    rows = [(*r, "x", "y", "z") for r in rows]
    got = exact_topk.top_products(spark.createDataFrame(rows, SCHEMA), lambda i: i % 10 == 0, k=3)
    assert {tuple(r) for r in got.collect()} == brute(rows, 10, 3)
    assert exact_topk.top_products(spark.createDataFrame([], SCHEMA), lambda i: i % 10 == 0).collect() == []
