"""Registered queries on tar shards by the sample: index, ranged reads, grouped samples, seeded loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardflow.operators import ordering
from shardflow.plans import queries_files as Q, stand_ins as V
from shardflow.plans.queries_order import SEED
from shardflow.plans.registry import query
from shardflow.plans.stand_ins import key_sql, with_sql
from shardflow.sources import tar, tar_samples

WORKERS, BUFFER, EPOCH, FETCHED = 4, 50, 3, 20
# Splits small enough that every shard is read by several tasks.
SPLIT = 40_000


def indexed_folder(spark: SparkSession, sf_dir: str) -> str:
    """Every document as a tar member, with the index written beside the shards."""
    return V._made_once(spark, sf_dir, "indexed", lambda root: tar.write_tar(Q.tar_members(spark, sf_dir), root, index=True))


def exchange_folder(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as shards whose samples have a member for each role."""

    def make(root: str) -> None:
        place = Window.partitionBy("shard").orderBy("key", "pos")
        rows = V.members(spark, sf_dir).withColumn("pos", F.row_number().over(place).cast("bigint"))
        tar.write_tar(rows.withColumn("payload", F.encode("payload", "utf-8")), root, index=True)

    return V._made_once(spark, sf_dir, "exchanges", make)


NAME = Q.tar_name_sql(f"(i // {Q.TAR_ROWS})")
PLACES = f"""places as (select {NAME} as shard, i % {Q.TAR_ROWS} as pos, class || '/' || key as key, ltrim(ext, '.') as ext, length as size, body,
  sum(512 + (length + 511) // 512 * 512) over (partition by i // {Q.TAR_ROWS} order by i) - (length + 511) // 512 * 512 as data_at from placed)"""


@query(
    "tar_index",
    with_sql("manifest", more=f"{Q.TARS},\n{PLACES}")
    + """select shard, pos, key, ext, cast(data_at - 512 as bigint) as header, cast(data_at as bigint) as "offset", size, true as as_written from places""",
)
def tar_index(spark, sf_dir):
    """The index built from headers, and whether the one written with the shards has the same row."""
    folder = indexed_folder(spark, sf_dir)
    built, written = tar_samples.build_index(spark, folder), tar_samples.tar_index(spark, folder)
    both = built.join(written.withColumn("as_written", F.lit(True)), built.columns, "full_outer")
    return both.select(*built.columns, F.coalesce("as_written", F.lit(False)).alias("as_written"))


def chosen(index: DataFrame) -> DataFrame:
    """A seeded twentieth of all members."""
    return index.where(ordering.order_key(["shard", "key"], SEED) % FETCHED == 0)


@query(
    "fetch_members",
    with_sql("manifest", more=f"{Q.TARS},\n{PLACES}")
    + f"""select shard, key, ext, size, md5(body) as digest from places
where cast('0x' || {key_sql(SEED, 0, 'shard', 'key')} as bigint) % {FETCHED} = 0""",
)
def fetch_members(spark, sf_dir):
    folder = indexed_folder(spark, sf_dir)
    got = tar_samples.fetch_members(chosen(tar_samples.tar_index(spark, folder)), folder)
    return got.select("shard", "key", "ext", "size", F.md5("payload").alias("digest"))


EXCHANGES = f"""select {Q.tar_name_sql('shard')} as shard, key, count(*) as n_members, string_agg(ext || '=' || md5(payload), ',' order by ext) as digests
from (select shard, key, ext, arg_min(payload, pos) as payload from members group by shard, key, ext)
group by shard, key"""


def _digests(got: DataFrame) -> DataFrame:
    digests = F.transform(F.map_entries("members"), lambda e: F.concat(e["key"], F.lit("="), F.md5(e["value"])))
    return got.select("shard", "key", F.size("members").cast("bigint").alias("n_members"), F.array_join(F.array_sort(digests), ",").alias("digests"))


@query("grouped_samples", with_sql("members") + EXCHANGES)
def grouped_samples(spark, sf_dir):
    """Samples put together while reading, in splits that cut through them."""
    return _digests(tar_samples.read_samples(spark, exchange_folder(spark, sf_dir), split_bytes=SPLIT))


@query("indexed_samples", with_sql("members") + EXCHANGES)
def indexed_samples(spark, sf_dir):
    """The same, with splits that begin where the index says that a sample does."""
    folder = exchange_folder(spark, sf_dir)
    return _digests(tar_samples.read_samples(spark, folder, split_bytes=SPLIT, index=tar_samples.tar_index(spark, folder)))


@query(
    "load_seeded",
    with_sql("manifest", more=Q.TARS)
    + f""",
shards as (select k as shard, sum(n) over (order by {key_sql(SEED, EPOCH, 'k')}, k) - n as start
  from (select i // {Q.TAR_ROWS} as k, count(*) as n from placed group by 1)),
passed as (select shard, start + i % {Q.TAR_ROWS} as i, class || '/' || key as key, ltrim(ext, '.') as ext, body from placed join shards on shard = i // {Q.TAR_ROWS}),
local as (select *, i // {BUFFER} * {BUFFER} + row_number() over (partition by i // {BUFFER} order by {key_sql(SEED, EPOCH, 'key')}, key) - 1 as spot from passed)
select cast(shard % {WORKERS} as integer) as worker, row_number() over (partition by shard % {WORKERS} order by spot) - 1 as place,
  {Q.tar_name_sql('shard')} as shard, key, md5(body) as digest from local""",
)
def load_seeded(spark, sf_dir):
    """A shuffled pass read by four workers, each in its order."""
    folder = indexed_folder(spark, sf_dir)
    got = tar_samples.load_seeded(spark, folder, workers=WORKERS, seed=SEED, epoch=EPOCH, buffer=BUFFER)
    payload = F.element_at(F.map_values("members"), 1)
    return got.select("worker", "place", "shard", "key", F.md5(payload).alias("digest"))
