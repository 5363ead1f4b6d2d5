"""Shuffled passes as a stream: stopped, started again, failed and replayed."""

import pytest
from pyspark.sql import functions as F

from shardflow.operators.ordering import dense_index, resume_from
from shardflow.sources import files
from shardflow.streaming import passes


def listing(spark, n=230):
    return spark.range(n).select(F.concat(F.when(F.col("id") % 7 == 0, ".hidden").otherwise("f"), "id").alias("path"), (F.col("id") % 5).alias("length"))


def orders(df, epochs, seed=3):
    out = []
    for e in range(epochs):
        out += [(e, r.i, r.path, r.length) for r in dense_index(df, ["path"], seed=seed, epoch=e).collect()]
    return sorted(out)


def rows(spark, target):
    return sorted((r.epoch, r.i, r.path, r.length) for r in spark.read.parquet(target).collect())


@pytest.mark.parametrize("batch,piece", [(64, 50), (500, 1000), (7, 1000)])
def test_stopped_inside_an_epoch(spark, tmp_path, batch, piece):
    """Both runs together are the permutations, each sample once; a batch goes over the end of an epoch."""
    root, target, state = (str(tmp_path / n) for n in ("pass", "out", "state"))
    df = listing(spark, 230 if batch > 7 else 40)
    n = df.count()
    passes.prepare(df, ["path"], root, seed=3, epochs=2, piece_rows=piece)
    passes.run_pass(passes.pass_stream(spark, root, state, batch_rows=batch, until=n // 3), target, state)
    first = rows(spark, target)
    assert first == orders(df, 1)[: n // 3]
    rest = {(r.i, r.path) for r in resume_from(df, ["path"], 3, 0, n // 3).collect()}
    passes.run_pass(passes.pass_stream(spark, root, state, batch_rows=batch), target, state)
    assert rows(spark, target) == orders(df, 2)
    assert {(i, p) for e, i, p, _ in rows(spark, target) if e == 0} - {(i, p) for _, i, p, _ in first} == rest
    passes.run_pass(passes.pass_stream(spark, root, state, batch_rows=batch), target, state)  # nothing is left
    assert len(rows(spark, target)) == 2 * n


def test_a_failed_batch_is_replayed(spark, tmp_path):
    root, target, state = (str(tmp_path / n) for n in ("pass", "out", "state"))
    df, seen = listing(spark), []
    passes.prepare(df, ["path"], root, seed=3, epochs=1, piece_rows=40)

    def run(fail):
        def each(batch, number):
            found = sorted((r.epoch, r.i, r.path, r.length) for r in batch.collect())
            seen.append((number, found))
            if fail and number == 1:
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

        stream = passes.pass_stream(spark, root, state, batch_rows=90)
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="lost"):
        run(True)
    run(False)
    assert [n for n, _ in seen] == [0, 1, 1, 2] and seen[1] == seen[2]
    assert rows(spark, target) == orders(df, 1)


def test_another_seed_is_an_error(spark, tmp_path):
    a, b, target, state = (str(tmp_path / n) for n in ("a", "b", "out", "state"))
    df = listing(spark, 20)
    passes.prepare(df, ["path"], a, seed=3, epochs=1)
    passes.prepare(df, ["path"], b, seed=4, epochs=1)
    passes.run_pass(passes.pass_stream(spark, a, state, batch_rows=5, until=10), target, state)
    with pytest.raises(Exception, match="seed 3"):
        passes.run_pass(passes.pass_stream(spark, b, state, batch_rows=5), target, state)
    with pytest.raises(ValueError, match="piece"):
        passes.prepare(df.withColumn("piece", F.lit(1)), ["path"], str(tmp_path / "c"), seed=1, epochs=1)


def test_real_files_and_an_empty_listing(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / ".x").mkdir(parents=True)
    for name in ("a.png", ".b.png", ".x/c.png", "_d.png"):
        (tree / name).write_bytes(b"" if name == "a.png" else b"1")
    root, target, state = (str(tmp_path / n) for n in ("pass", "out", "state"))
    passes.prepare(files.scan(spark, str(tree)).select("path", "length"), ["path"], root, seed=1, epochs=3, piece_rows=3)
    passes.run_pass(passes.pass_stream(spark, root, state, batch_rows=5), target, state)
    got = spark.read.parquet(target).groupBy("path").agg(F.count("*").alias("n")).collect()
    assert len(got) == 4 and {r.n for r in got} == {3}
    none, out, state = (str(tmp_path / n) for n in ("none", "out2", "state2"))
    passes.prepare(listing(spark, 0), ["path"], none, seed=1, epochs=2)
    passes.run_pass(passes.pass_stream(spark, none, state), out, state)
