import pandas as pd
import pytest

from shardflow.operators import mapping


def test_modes(spark):
    def halves(rows):
        if (rows["id"] % 10 == 7).any():
            raise ValueError("seven")
        return pd.DataFrame({"id": rows["id"], "half": rows["id"] // 2})

    df = spark.range(0, 100, 1, 3)
    kept = mapping.map_samples(df, halves, "id bigint, half bigint", mode="PERMISSIVE", chunk=16)
    good, bad = mapping.split_errors(kept)
    assert sorted(r.half for r in good.collect()) == sorted(k // 2 for k in range(100) if k % 10 != 7)
    assert [(r.id, r.error) for r in bad.collect()] == [(None, "ValueError: seven")] * 10
    dropped = mapping.map_samples(df, halves, "id bigint, half bigint", mode="DROPMALFORMED")
    assert dropped.columns == ["id", "half"] and dropped.count() == 90
    with pytest.raises(Exception, match="seven"):
        mapping.map_samples(df, halves, "id bigint, half bigint").collect()
    with pytest.raises(ValueError, match="unknown mode"):
        mapping.map_samples(df, halves, "id bigint", mode="MAYBE")


def test_large_numbers_stay_whole_next_to_bad_rows(spark):
    big = 2**62 + 1

    def call(rows):
        if (rows["id"] == 3).any():
            raise KeyError("x")
        return rows.assign(v=rows["id"] + big)

    rows = mapping.map_samples(spark.range(8).coalesce(1), call, "id bigint, v bigint", mode="PERMISSIVE").collect()
    assert sorted(r.v for r in rows if r.error is None) == [big + k for k in range(8) if k != 3]


def test_errors_a_function_marks_itself(spark):
    def call(rows):
        return rows.assign(error=("odd " + rows["id"].astype(str)).where(rows["id"] % 2 == 1, None))

    rows = mapping.map_samples(spark.range(10), call, "id bigint", mode="PERMISSIVE").collect()
    assert sorted(r.error for r in rows if r.error) == [f"odd {k}" for k in (1, 3, 5, 7, 9)]
    assert mapping.map_samples(spark.range(10), call, "id bigint", mode="DROPMALFORMED").count() == 5
    with pytest.raises(Exception, match="odd"):
        mapping.map_samples(spark.range(10), call, "id bigint").collect()


def test_setup_runs_once_per_task(spark):
    def setup():
        import uuid

        return uuid.uuid4().hex

    def call(rows, token):
        return rows.assign(token=token)

    got = mapping.map_samples(spark.range(0, 1000, 1, 4), call, "id bigint, token string", setup=setup, chunk=10).collect()
    assert len({r.token for r in got}) == 4


def test_collate_function_sees_whole_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # batches are cut by frames
    try:
        df = spark.range(1000).selectExpr("id", "id div 32 as batch", "31 - id % 32 as batch_pos")
        call = lambda rows: pd.DataFrame({"batch": rows["batch"][:1], "ids": [",".join(map(str, rows["id"]))]})
        got = {r.batch: r.ids for r in mapping.collate_with(df, "batch", call, "batch bigint, ids string").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for b in range(32):
        ids = range(b * 32, min(1000, b * 32 + 32))
        assert got[b] == ",".join(map(str, reversed(ids)))
