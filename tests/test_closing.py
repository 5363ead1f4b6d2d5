import datetime as dt

from pyspark.sql import functions as F

from shardflow.operators import telemetry
from shardflow.streaming import closing
from shardflow.streaming import files as streams

SCHEMA = "loader string, run_id bigint, event_id bigint, ts timestamp, n_images bigint, load_time decimal(18,2), cpu double, ram decimal(18,2)"
START = dt.datetime(2024, 1, 1)


def put(spark, root, rows):
    df = spark.createDataFrame([(a, r, k, None if t is None else START + dt.timedelta(seconds=t), n, None, c, None) for a, r, k, t, n, c in rows], SCHEMA)
    df = df.withColumn("load_time", (F.col("event_id") / 100).cast("decimal(18,2)")).withColumn("ram", F.lit(1.5).cast("decimal(18,2)"))
    df.repartition(3).write.mode("append").parquet(root)
    return df


def go(spark, root, target, state):
    stream = streams.table_stream(spark, root, spark.createDataFrame([], SCHEMA).schema)
    return closing.closed_runs(stream, target, state, delay="10 seconds", silence_seconds=100, slot_seconds=10)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_runs_close_once_and_leave_no_state(spark, tmp_path):
    root, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = put(spark, root, [(f"l{k % 2}", k % 3, k, k, 2, k / 7) for k in range(300)] + [("l0", 0, 900, None, 5, None)])
    assert go(spark, root, target, state) > 0
    assert closing.run_results(spark, target).count() == 0  # silent for no more than a few seconds
    # run (l0, 1) goes on, the others stay silent
    more = put(spark, root, [("l0", 1, 1000 + k, 300 + k, 1, None) for k in range(200)])
    go(spark, root, target, state)
    want = telemetry.run_records(first.union(more))
    assert rows_of(closing.run_results(spark, target)) == rows_of(want.where("not (loader = 'l0' and run_id = 1)"))
    # late for a closed run and for an open one; then a heartbeat closes what is open
    put(spark, root, [("l1", 1, 2000, 5, 7, 1.0), ("l1", 1, 2001, 6, 8, None), ("l0", 1, 2002, 400, 9, 1.0), (None, None, 0, 9000, None, None)])
    assert go(spark, root, target, state) == 0
    assert rows_of(closing.run_results(spark, target)) == rows_of(want)
    late = closing.late_slots(spark, target).groupBy("loader", "run_id", "slot_end").agg(F.sum("n_batches"), F.sum("n_images"))
    end = lambda t: int((START + dt.timedelta(seconds=t)).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert rows_of(late) == [("l0", 1, end(410), 1, 9), ("l1", 1, end(10), 2, 15)]
    # heard of again in time: another record
    again = put(spark, root, [("l1", 2, 3000, 9100, 4, 2.0), (None, None, 0, 20000, None, None)])
    assert go(spark, root, target, state) == 0
    assert rows_of(closing.run_results(spark, target)) == sorted(rows_of(want) + rows_of(telemetry.run_records(again.where("loader is not null"))))


def test_no_telemetry(spark, tmp_path):
    root, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    put(spark, root, [(None, None, 0, 10, None, None)])
    assert go(spark, root, target, state) == 0
    assert closing.run_results(spark, target).count() == 0 and closing.late_slots(spark, target).count() == 0
