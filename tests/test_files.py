import os
import tarfile

import numpy as np
import pytest
from pyarrow.fs import FileSelector, LocalFileSystem
from pyspark.sql import functions as F

from shardflow.plans.png_files import png_bytes
from shardflow.operators import samples
from shardflow.plans import loading
from shardflow.plans.all_queries import QUERIES
from shardflow.sources import columnar, files, tar


def put(root, path, data=b"x"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


@pytest.fixture()
def tree(tmp_path):
    root = str(tmp_path / "class tree")
    for path, data in {
        "cat/a.png": b"12345", "cat/B.PNG": b"1", "cat/.hidden.png": b"1", "cat/_under.png": b"1", "cat/r.jpeg.png": b"123",
        "cat/zero.png": b"", "cat/note.txt": b"text", "cat/100%.jpg": b"12", "two words/a.png": b"other", "two words/deep/x.png": b"1",
        ".git/a.png": b"1", "top.png": b"1234",
    }.items():
        put(root, path, data)
    return root


EVERY = {
    ("cat", "a.png", "a", ".png", 5), ("cat", "B.PNG", "B", ".png", 1), ("cat", "r.jpeg.png", "r.jpeg", ".png", 3),
    ("cat", "note.txt", "note", ".txt", 4), ("cat", "100%.jpg", "100%", ".jpg", 2), ("two words", "a.png", "a", ".png", 5),
    ("deep", "x.png", "x", ".png", 1), ("class tree", "top.png", "top", ".png", 4), ("cat", ".hidden.png", ".hidden", ".png", 1),
    ("cat", "_under.png", "_under", ".png", 1), ("cat", "zero.png", "zero", ".png", 0), (".git", "a.png", "a", ".png", 1),
}


def test_recursive_scan(spark, tree):
    rows = files.scan(spark, tree).collect()
    assert {(r["class"], r.name, r.key, r.ext, r.length) for r in rows} == EVERY and len(rows) == len(EVERY)
    assert all(r.path.startswith("file:/") and r.modificationTime.year > 2000 for r in rows)


def test_scan_by_extension_and_depth(spark, tree):
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(files.scan(spark, tree, [".JPG", ".txt"])) == ["100%.jpg", "note.txt"]
    assert names(files.scan(spark, tree + "/two words/", recursive=False)) == ["a.png"]
    assert names(files.scan(spark, tree, recursive=False)) == ["top.png"]
    os.makedirs(tree + "/empty")
    assert names(files.scan(spark, tree + "/empty")) == []
    with pytest.raises(NotADirectoryError):
        files.scan(spark, tree + "/top.png")


def test_a_folder_is_listed_in_pieces(spark, tmp_path, monkeypatch):
    """What a listing holds at a time does not grow with the folder."""
    for k in range(25):
        (tmp_path / f".d{k}.png").write_bytes(b"x" * k)
    (tmp_path / "below").mkdir()
    os.symlink(tmp_path / "gone", tmp_path / "broken.png")
    whole = {f.base_name: (f.type, f.size) for f in LocalFileSystem().get_file_info(FileSelector(str(tmp_path)))}
    monkeypatch.setattr(files, "LISTED_ROWS", 10)
    found = list(files.listed_pieces(str(tmp_path)))
    assert len(found) == 3 and all(len(p) <= 10 for p in found) and sum(map(len, found)) == 26
    assert {f.base_name: (f.type, f.size) for p in found for f in p} == whole
    assert [len(p) for p in files.listed_pieces(str(tmp_path / "below"))] == [0]


def test_contents_are_written_from_the_batch(spark, tmp_path, monkeypatch):
    """No bytes object is made of a content, and none may be missing."""
    rows = spark.createDataFrame([(f"{tmp_path}/a/{k}", bytes([k]) * k) for k in range(5)], "path string, content binary")
    written = files.write_files(rows)
    assert "MapInArrow" in written._jdf.queryExecution().toString() and all(r.ok and r.error is None for r in written.collect())
    assert [(tmp_path / "a" / str(k)).read_bytes() for k in range(5)] == [bytes([k]) * k for k in range(5)]
    with pytest.raises(Exception, match="no content"):
        files.write_files(rows.withColumn("content", F.lit(None).cast("binary"))).collect()


def test_images_of_other_extensions_are_not_read(spark, tmp_path):
    put(str(tmp_path), "in/a.PNG", png_bytes(np.zeros((2, 2, 3), np.uint8)))
    put(str(tmp_path), "in/b.txt", b"no image")
    put(str(tmp_path), "in/c.png", b"broken")
    got = {os.path.basename(r.path): r.image.height for r in files.images(spark, str(tmp_path / "in"), [".png"]).collect()}
    assert set(got) <= {"a.PNG", "c.png", ""} and 2 in got.values() and len(got) == 2


def test_copy_keeps_classes_and_reports_failures(spark, tree, tmp_path):
    target = str(tmp_path / "copy")
    listing = files.scan(spark, tree)
    gone = listing.limit(1).withColumns({"path": F.lit("file:/none/x.png"), "class": F.lit("lost"), "name": F.lit("x.png")})
    rows = files.copy_files(listing.union(gone), target).collect()
    bad = [r for r in rows if not r.ok]
    assert [(r["class"], r.name) for r in bad] == [("lost", "x.png")] and bad[0].error
    assert sorted(r.name for r in rows if r.ok) == ["100%.jpg", "B.PNG", "_under.png", "a.png", "a.png", "r.jpeg.png", "top.png", "x.png", "zero.png"]
    assert open(f"{target}/two words/a.png", "rb").read() == b"other"
    assert not [n for _, _, names in os.walk(target) for n in names if n.startswith("_part")]


def members(spark, n, size=7):
    rows = [(k // size, k % size, f"c/d{k}", "png", bytes([k % 256]) * (k * 37 % 900)) for k in range(n)]
    return spark.createDataFrame(rows, "shard bigint, pos bigint, key string, ext string, payload binary")


def test_tar_round_trip(spark, tmp_path):
    df, target = members(spark, 40).repartition(6), str(tmp_path / "tars")
    tar.write_tar(df, target)
    assert sorted(os.listdir(target)) == ["_shards", *[f"shard_{k + 1:02d}.tar" for k in range(6)]]
    with tarfile.open(f"{target}/shard_02.tar") as t:
        assert t.getnames() == [f"c/d{k}.png" for k in range(7, 14)]
    want = sorted((f"shard_{r.shard + 1:02d}.tar", r.pos, r.key, r.ext, bytes(r.payload), None) for r in df.collect())
    for split in (1 << 30, 2000, 512):
        got = sorted((*r[:4], bytes(r.payload), r.error) for r in tar.read_tar(spark, target, split_bytes=split).collect())
        assert got == want
    one = tar.read_tar(spark, [f"{target}/shard_01.tar", f"{target}/shard_06.tar"])
    assert one.count() == 7 + 5


def test_writing_again_gives_the_same_bytes(spark, tmp_path):
    for name in ("a", "b"):
        tar.write_tar(members(spark, 20).repartition(3), str(tmp_path / name))
    for shard in os.listdir(tmp_path / "a"):
        assert (tmp_path / "a" / shard).read_bytes() == (tmp_path / "b" / shard).read_bytes()


def test_no_stale_shards(spark, tmp_path):
    target = str(tmp_path / "a,b c")
    tar.write_tar(members(spark, 20), target)
    with pytest.raises(FileExistsError):
        tar.write_tar(members(spark, 5), target)
    tar.write_tar(members(spark, 5), target, overwrite=True)
    assert sorted(os.listdir(target)) == ["_shards", "shard_01.tar"] and tar.read_tar(spark, target).count() == 5
    put(target, "shard_09.tar", b"left by a job that failed")
    assert tar.read_tar(spark, target, mode="FAILFAST").count() == 5


def test_damaged_shards_come_through_to_samples(spark, tmp_path):
    target = str(tmp_path / "tars")
    tar.write_tar(members(spark, 21), target)
    put(target, "shard_02.tar", open(f"{target}/shard_02.tar", "rb").read()[:700])
    rows = samples.assemble_members(tar.read_tar(spark, target)).collect()
    assert sum(r.members is not None and r.error is None for r in rows) >= 14
    assert [(r.shard, r.key, r.members) for r in rows if r.error] == [("shard_02.tar", None, None)]


def test_damaged_shards(spark, tmp_path):
    target = str(tmp_path / "tars")
    tar.write_tar(members(spark, 28), target)
    whole = open(f"{target}/shard_02.tar", "rb").read()
    with tarfile.open(f"{target}/shard_02.tar") as t:
        third, fifth = t.getmembers()[2].offset, t.getmembers()[4].offset
    put(target, "shard_02.tar", whole[:third] + b"\xff" * 512 + whole[third + 512 :])
    put(target, "shard_03.tar", open(f"{target}/shard_03.tar", "rb").read()[:700])
    put(target, "shard_04.tar", b"")
    for split in (1 << 30, 1024):
        rows = tar.read_tar(spark, target, split_bytes=split).collect()
        count = lambda s: sum(r.shard == s and r.error is None for r in rows)
        assert (count("shard_01.tar"), count("shard_02.tar"), count("shard_04.tar")) == (7, 2, 0)
        assert sorted(r.shard for r in rows if r.error) == ["shard_02.tar", "shard_03.tar", "shard_04.tar"]
    dropped = tar.read_tar(spark, target, mode="DROPMALFORMED").collect()
    assert len(dropped) == sum(r.error is None for r in rows) and not any(r.error for r in dropped)
    with pytest.raises(Exception, match="bad header|ReadError"):
        tar.read_tar(spark, target, mode="FAILFAST").collect()
    with pytest.raises(Exception, match="none.tar"):
        tar.read_tar(spark, f"{target}/none.tar").collect()


def test_labelled_samples_with_a_missing_member(spark, tmp_path):
    target = str(tmp_path / "tars")
    df = members(spark, 10).withColumn("ext", F.lit(".png")).withColumn("label", F.when(F.col("pos") < 3, "real").otherwise("fake"))
    both = samples.labelled_members(df).where("not (key = 'c/d4' and ext = 'json')")
    tar.write_tar(both, target, prefix="shared_")
    with tarfile.open(f"{target}/shared_01.tar") as t:
        assert t.getnames()[:2] == ["c/d0.json", "c/d0.png"]
        assert t.extractfile("c/d0.json").read() == b'{"label": "real"}'
    got = {r.key: dict(r.members) for r in samples.assemble_members(tar.read_tar(spark, target)).collect()}
    assert len(got) == 10 and set(got["c/d4"]) == {"png"} and bytes(got["c/d9"]["json"]) == b'{"label": "real"}'
    assert samples.project_member(tar.read_tar(spark, target), "png").count() == 10


def test_samples_without_a_label_are_reported(spark, tmp_path):
    df = members(spark, 10).selectExpr("cast(substr(key, 4) as int) id", "'c' class", "substr(key, 3) key", "'.png' ext", "payload")
    df = df.withColumn("label", F.when(F.col("id") % 3 > 0, "real"))
    without = loading.labelled_tar(df.drop("payload"), df.select("id", "payload"), ["id"], str(tmp_path / "tars"), 4, prefix="shared_")
    assert sorted((r.key, r.error) for r in without.collect()) == [(f"d{k}", "no label") for k in (0, 3, 6, 9)]
    got = {r.key: set(r.members) for r in samples.assemble_members(tar.read_tar(spark, str(tmp_path / "tars"))).collect()}
    assert got == {f"c/d{k}": {"json", "png"} for k in (1, 2, 4, 5, 7, 8)}
    with pytest.raises(Exception, match="no label: d3"):
        samples.labelled_members(df.selectExpr("0 shard", "id pos", "*").where("id = 3")).collect()


def test_queries_report_what_is_not_written(spark):
    sf = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    n = documents.join(labels, "doc_id", "left_anti").count()
    with pytest.warns(UserWarning, match=f"^{n} samples without a label"):
        QUERIES["write_tar_labelled"](spark, sf)


def test_check_shards_goes_by_a_listing(spark, monkeypatch):
    listed, scan = [], files.scan
    monkeypatch.setattr(files, "scan", lambda *a, **b: listed.append(scan(*a, **b)) or listed[-1])
    QUERIES["check_shards"](spark, "/root/testdata/sf0.001").collect()
    assert len(listed) == 1 and listed[0].where("length <= 15000").count() == 0


def test_column_shards(spark, tmp_path):
    target = str(tmp_path / "columns")
    df = members(spark, 50).select("shard", "pos", F.col("payload").alias("image"), (F.col("pos") % 2).alias("label"))
    columnar.write_column_shards(df, target)
    parts = [n for _, _, names in os.walk(target) for n in names if n.endswith(".parquet")]
    assert 1 <= len(parts) <= 8 and all(".zstd." in n for n in parts)
    got = sorted((r.shard, r.pos, bytes(r.image), r.label) for r in columnar.read_column_shards(spark, target).collect())
    assert got == sorted((r.shard, r.pos, bytes(r.image), r.label) for r in df.collect())
    stored = files.scan(spark, target, [".parquet"])
    row = samples.size_ratio(df.select(F.octet_length("image").alias("length")), stored).first()
    assert row.original_bytes == sum(k * 37 % 900 for k in range(50))
    assert row.ratio == pytest.approx(row.stored_bytes / row.original_bytes)


def test_fractions_are_reduced():
    assert samples.reduced_fraction(250, 1000) == (1, 4) and samples.reduced_fraction(5, 0) == (0, 1)
    assert samples.reduced_fraction(10**12 + 1, 10**18) == (10**12 + 1, 10**18)


def test_inputs_that_must_be_there(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert samples.require_inputs(names("a", "b"), names("a", "b", "c")).count() == 2
    with pytest.raises(FileNotFoundError, match="b.tar"):
        samples.require_inputs(names("a.tar", "b.tar"), names("a.tar"))


def test_images(spark, tmp_path):
    from shardflow.operators import pixels

    root = str(tmp_path / "img")
    rng = np.random.default_rng(1)
    want = {}
    for name, c in (("grey.png", 1), ("rgb.PNG", 3), ("rgba.png", 4), ("rgb.dat", 3)):
        a = rng.integers(0, 256, (3, 2, c), dtype=np.uint8)
        if c == 4:
            a[:, :, 3] = 255
        put(root, name, png_bytes(a))
        want[name] = np.repeat(a, 3, 2) if c == 1 else a[:, :, :3]
    put(root, "broken.png", b"no image at all")
    found = files.images(spark, root, [".png"], drop_invalid=True).withColumn("name", F.element_at(F.split("path", "/"), -1))
    got = {r.name: r for r in pixels.rgb_images(found, ["name"]).collect()}
    assert set(got) == {"grey.png", "rgb.PNG", "rgba.png"}
    for name, r in got.items():
        assert (r.height, r.width, r.channels) == (3, 2, 3)
        assert bytes(r.pixels) == want[name].tobytes()
    assert files.images(spark, root).count() == 5
