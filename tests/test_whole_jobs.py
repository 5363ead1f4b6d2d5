"""From files to shards to tensors to batches, and from batches to a ranking."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardflow.plans.png_files import png_bytes, png_decoder
from shardflow.operators import ordering, pixels, samples, splits, telemetry
from shardflow.plans import loading
from shardflow.sources import files, tar


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(3)
    for k in range(120):
        # Two thirds of the samples lie in one class.
        folder = root / ("made" if k % 3 == 0 else "seen")
        folder.mkdir(exist_ok=True)
        (folder / f"s{k}.png").write_bytes(png_bytes(rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)))
    (root / "made" / "bad.png").write_bytes(b"no image")
    (root / "made" / "notes.txt").write_bytes(b"text")
    return str(root)


def test_files_to_tar_to_worker_batches(spark, tree, tmp_path):
    found = files.scan(spark, tree, [".png"])
    labelled = samples.label_binary(found, ["class", "name"])
    placed = loading.fixed_shards(labelled, ["class", "name"], size=25, seed=8)
    key = F.concat_ws("/", "class", "key").alias("key")
    target = str(tmp_path / "tars")
    read = files.read_payloads(placed.select("shard", "pos", key, "ext", "label", "path"))
    tar.write_tar(samples.labelled_members(read), target, prefix="shared_")
    assert len(os.listdir(target)) == 6  # with the list of shards

    members = samples.assemble_members(tar.read_tar(spark, target))
    rows = members.select("shard", "key", F.col("members")["png"].alias("png"), F.decode(F.col("members")["json"], "utf-8").alias("meta"))
    tensors = pixels.load_tensors(rows, ["shard", "key", "meta"], 4, 4, payload="png", decoder=png_decoder)
    assert [r.key for r in tensors.where("error is not null").collect()] == ["made/bad"]

    order = ordering.dense_index(tensors.where("error is null").drop("error"), ["key"], seed=1, total="n")
    parts = splits.batches(splits.split_contiguous(order, 3, "n"), 16, by="pos")
    got = splits.collate(parts, ["worker", "batch"], ["key", "meta", "px"], 16).collect()
    assert Counter(r.n_images for r in got) == {16: 6, 8: 3}
    seen = [s for r in got for s in r.samples]
    assert sorted(s.key for s in seen) == sorted(f"{'made' if k % 3 == 0 else 'seen'}/s{k}" for k in range(120))
    assert {s.key.split("/")[0]: s.meta for s in seen} == {"made": '{"label": "fake"}', "seen": '{"label": "real"}'}
    assert all(len(s.px) == 4 * 3 * 4 * 4 for s in seen)


def test_batches_leave_no_sample_out(spark, tree):
    found = files.scan(spark, tree)
    for split in ("strided", "contiguous"):
        rows = loading.worker_batches(found, ["path"], workers=4, size=32, split=split, seed=5)
        assert Counter(r.worker for r in rows.collect()) == {0: 31, 1: 30, 2: 30, 3: 30}
    totals = loading.batch_totals(rows).collect()
    assert sum(r.n_images for r in totals) == 121 and all(r.n_batches == 1 for r in totals)


def test_telemetry_to_ranking(spark):
    rows = [
        (loader, run, batch, batch * seconds, 32, seconds / 2, cpu, 1.0)
        for loader, seconds, cpu in (("slow", 2.0, 10.0), ("fast", 1.0, 10.0))
        for run in range(3)
        for batch in range(10)
    ]
    tel = spark.createDataFrame(
        rows, "loader string, run_id int, event_id int, s double, n_images int, load_time double, cpu double, ram double"
    ).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")))
    record = telemetry.run_records(tel).where("loader = 'slow' and run_id = 1").first()
    assert (record.total_time, record.total_images, record.avg_data_load_time) == (18.0, 320, 1.0)
    board = loading.ranking(tel).orderBy("rank").collect()
    assert [r.loader for r in board] == ["fast", "slow"]
    assert board[0].overall == pytest.approx(100.0)
    assert board[1].overall == pytest.approx(0.35 * 50 + 0.35 * 50 + 0.15 * 100 + 0.10 * 100 + 0.05 * 50)
