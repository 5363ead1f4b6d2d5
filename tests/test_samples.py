import os

import pytest
from pyspark.sql import functions as F

import shardflow.scratch as scratch
from shardflow.functions import columns as C
from shardflow.operators import samples


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "name,stem,ext",
    [("a.png", "a", ".png"), ("r.jpeg.PNG", "r.jpeg", ".png"), (".png", ".png", ""), ("none", "none", ""), ("a.", "a", "."), ("d/.h.txt", ".h", ".txt")],
)
def test_stem_and_extension(spark, name, stem, ext):
    assert (one(spark, C.file_stem("p"), p=name), one(spark, C.file_ext("p"), p=name)) == (stem, ext)


@pytest.mark.parametrize("value,width,want", [(7, 2, "07"), (123, 2, "123"), (10, 2, "10"), (1, 5, "00001"), (123456, 5, "123456")])
def test_zero_pad(spark, value, width, want):
    assert one(spark, C.zero_pad("v", width), v=value) == want


@pytest.mark.parametrize("uri,want", [("s3://b/p//", "b/p"), ("b/p/", "b/p"), ("s3://", "s3:"), ("b", "b")])
def test_normalise_uri(spark, uri, want):
    assert one(spark, C.normalise_uri("u"), u=uri) == want


def test_labels_as_json(spark):
    assert one(spark, C.label_json("v"), v='a "b": c') == '{"label": "a \\"b\\": c"}'


@pytest.mark.parametrize("text,want", [(" 1.5 ", 1.5), ("1e-7", 1e-7), ("x", None), ("", None)])
def test_safe_double(spark, text, want):
    assert one(spark, C.safe_double("t"), t=text) == want


def test_rate_of_no_time_is_zero(spark):
    assert one(spark, C.rate("n", "t"), n=5, t=0.0) == 0.0 and one(spark, C.rate("n", "t"), n=5, t=2.0) == 2.5


def test_binary_labels_with_a_hot_class(spark):
    df = spark.range(3000).withColumn("class", F.when(F.col("id") % 4 == 0, "aa").otherwise("zz"))
    rows = samples.label_binary(df, ["id"]).collect()
    assert {(r["class"], r.label) for r in rows} == {("aa", "fake"), ("zz", "real")}
    assert sorted(r.label_id for r in rows) == [f"fake{k + 1:05d}" for k in range(750)] + [f"real{k + 1:05d}" for k in range(2250)]
    with pytest.raises(Exception, match="exactly two classes"):
        samples.label_binary(df.withColumn("class", F.lit("x")), ["id"]).collect()


def test_class_numbers_skip_hidden_folders(spark):
    df = spark.createDataFrame([("b",), ("a",), (".x",), ("b",)], "class string")
    assert {(r["class"], r.label) for r in samples.label_int(df).collect()} == {("a", 0), ("b", 1)}
    kept = samples.attach_label(df, samples.class_labels(df), "class").collect()
    assert sorted((r["class"], r.label) for r in kept if r.label is not None) == [("a", 0), ("b", 1), ("b", 1)]
    assert len(kept) == 4


def test_members_with_a_key_of_most_rows(spark):
    # One key has a third of all members, most of them repeats of one extension.
    df = spark.range(3000).selectExpr(
        "0 as shard", "if(id % 3 = 0, 'hot', concat('k', id div 6)) as key", "id as pos",
        "if(id % 3 = 0, concat('e', id % 2), concat('e', id % 6)) as ext", "cast(cast(id as string) as binary) as payload",
    )
    got = {r.key: {k: bytes(v) for k, v in r.members.items()} for r in samples.assemble_members(df).collect()}
    assert got["hot"] == {"e0": b"0", "e1": b"3"} and len(got) == 501
    errors = {r.key: r.error for r in samples.assemble_members(df).collect()}
    assert errors["hot"] == "repeated members: e0, e1" and errors["k2"] is None
    assert got["k2"] == {"e1": b"13", "e2": b"14", "e4": b"16", "e5": b"17"}


def test_scratch_is_the_folder_the_session_names(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch.scratch_path(spark, "x").startswith(f"{root}/shardflow/")
    table = scratch.materialise(spark.range(5), "five")
    assert table.count() == 5 and all(root in name for name in table.inputFiles())
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    scratch.discard(table)
    assert not os.path.exists(folder)
