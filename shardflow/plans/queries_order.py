"""Registered queries on order, splits, batches and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardflow.functions import columns as C
from shardflow.operators import mapping, ordering, samples, splits
from shardflow.plans import loading, stand_ins as V
from shardflow.plans.registry import query
from shardflow.plans.stand_ins import key_sql, order_sql, with_sql
from shardflow.scratch import materialise, scratch_path
from shardflow.sources import files

SEED = 42
# Sizes for the small given tables; real shards are larger.
SHARD_ROWS, WORKERS, BATCH, BUFFER = 2000, 4, 32, 250


def _placed(spark, sf_dir, **kw):
    return ordering.dense_index(V.samples(spark, sf_dir), ["id"], seed=SEED, **kw)


def _in_order(spark, sf_dir):
    """Samples in shards, written down as they lie on disk before a pass."""
    s = V.samples(spark, sf_dir)
    return materialise(splits.shards_fixed(ordering.dense_index(s, ["id"], seed=1), SHARD_ROWS).drop("i"), "shards")


ORDERED = order_sql("samples", "id", SEED)
# The shards a pass reads, as in _in_order.
SHARDED = f"sharded as (select *, i // {SHARD_ROWS} as shard, i % {SHARD_ROWS} as pos from ({order_sql('samples', 'id', 1)}))"
SHUFFLED_SHARDS = f"""{SHARDED},
ranks as (select shard, n, sum(n) over (order by r rows unbounded preceding) - n as start, r - 1 as shard_rank
  from (select shard, n, row_number() over (order by {key_sql(SEED, 0, 'shard')}, shard) as r
    from (select shard, count(*) as n from sharded group by shard))),
placed as (select id, sharded.shard, shard_rank, cast(start + pos as bigint) as i from sharded join ranks using (shard))"""


def _local_sql(source: str, buffer: int) -> str:
    key = key_sql(SEED, 0, "id")
    return f"i // {buffer} * {buffer} + row_number() over (partition by i // {buffer} order by {key}, id) - 1 as i from {source}"


@query("shuffle_global", with_sql("samples") + order_sql("samples", "id", SEED, extra="id, class"))
def shuffle_global(spark, sf_dir):
    return ordering.shuffle_global(V.samples(spark, sf_dir), ["id"], SEED).select("id", "class", "i")


@query("sample_perm", with_sql("samples") + f"select id, i from ({order_sql('samples', 'id', SEED, 3)}) where i < 5000")
def sample_perm(spark, sf_dir):
    return ordering.sample_permutation(V.samples(spark, sf_dir), ["id"], SEED, limit=5000, epoch=3).select("id", "i")


@query("udf_sampler", with_sql("samples") + order_sql("samples", "id", 7, 1, extra="id"))
def udf_sampler(spark, sf_dir):
    return V.samples(spark, sf_dir).transform(ordering.sample_permutation, ["id"], 7, None, 1).select("id", "i")


@query("resume_from", with_sql("samples") + f"select id, i from ({order_sql('samples', 'id', SEED, 2)}) where i >= 1000")
def resume_from(spark, sf_dir):
    return ordering.resume_from(V.samples(spark, sf_dir), ["id"], SEED, 2, 1000).select("id", "i")


@query("shuffle_shards", with_sql("samples", more=SHUFFLED_SHARDS) + "select id, shard, shard_rank, i from placed")
def shuffle_shards(spark, sf_dir):
    got = ordering.shuffle_shards(_in_order(spark, sf_dir), seed=SEED)
    return got.select("id", "shard", "shard_rank", "i")


@query("shuffle_local", with_sql("samples") + f"select id, {_local_sql('(' + order_sql('samples', 'id', 1) + ')', BUFFER)}")
def shuffle_local(spark, sf_dir):
    placed = ordering.dense_index(V.samples(spark, sf_dir), ["id"], seed=1)
    return ordering.shuffle_local(placed, ["id"], BUFFER, SEED).select("id", "i")


@query(
    "shuffle_dataset",
    with_sql("samples", more=SHUFFLED_SHARDS) + f"select id, shard, {_local_sql('placed', BUFFER)}",
)
def shuffle_dataset(spark, sf_dir):
    return ordering.shuffle_dataset(_in_order(spark, sf_dir), ["id"], BUFFER, SEED).select("id", "shard", "i")


@query(
    "sort_paths",
    with_sql("manifest")
    + """select path, row_number() over (order by string_split(path, '/')) - 1 as i,
  row_number() over (order by path) - 1 as i_text from manifest""",
)
def sort_paths(spark, sf_dir):
    paths = V.manifest(spark, sf_dir).select("path")
    by_text = ordering.sort_paths(paths, by="string").withColumnRenamed("i", "i_text")
    return ordering.sort_paths(by_text).select("path", "i", "i_text")


@query("split_strided", with_sql("samples") + f"select id, i % {WORKERS} as worker, i // {WORKERS} as pos from ({ORDERED})")
def split_strided(spark, sf_dir):
    return splits.split_strided(_placed(spark, sf_dir), WORKERS).select("id", "worker", "pos")


@query(
    "split_contiguous",
    with_sql("samples")
    + f"""select id, worker - 1 as worker, row_number() over (partition by worker order by i) - 1 as pos,
  count(*) over (partition by worker) as worker_rows
from (select id, i, ntile(7) over (order by i) as worker from ({ORDERED}))""",
)
def split_contiguous(spark, sf_dir):
    placed = _placed(spark, sf_dir, total="n_total")
    return splits.split_contiguous(placed, 7, "n_total").select("id", "worker", "pos", "worker_rows")


@query(
    "split_shards",
    with_sql("samples", more=SHARDED)
    + f"""select id, shard, shard % {WORKERS} as worker,
  row_number() over (partition by shard % {WORKERS} order by shard, pos) - 1 as pos from sharded""",
)
def split_shards(spark, sf_dir):
    return splits.split_shards(_in_order(spark, sf_dir), WORKERS).select("id", "shard", "worker", "pos")


@query("batch_global", with_sql("samples") + f"select id, i // {BATCH} as batch, i % {BATCH} as batch_pos from ({ORDERED})")
def batch_global(spark, sf_dir):
    return splits.batches(_placed(spark, sf_dir), BATCH).select("id", "batch", "batch_pos")


@query(
    "batch_per_worker",
    with_sql("manifest")
    + f"""select worker, batch, count(*) as n_images, cast(sum(length) as bigint) as bytes
from (select i % {WORKERS} as worker, i // {WORKERS} // {BATCH} as batch, length
  from ({order_sql("(select * from manifest where class not like '.%' and name not like '.%' and length > 0 and ext in ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tiff'))", "doc_id", SEED)}))
group by worker, batch""",
)
def batch_per_worker(spark, sf_dir):
    got = loading.worker_batches(V.manifest(spark, sf_dir), ["doc_id"], workers=WORKERS, size=BATCH, seed=SEED)
    return got.groupBy("worker", "batch").agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("length").cast("bigint").alias("bytes")
    )


@query(
    "batch_drop_last",
    with_sql("samples")
    + f"""select id, worker, batch from (select *, count(*) over (partition by worker, batch) as n
  from (select id, i % {WORKERS} as worker, i // {WORKERS} // {BATCH} as batch from ({ORDERED}))) where n = {BATCH}""",
)
def batch_drop_last(spark, sf_dir):
    parts = splits.split_strided(_placed(spark, sf_dir, total="n_total"), WORKERS, "n_total")
    got = splits.drop_short_batches(splits.batches(parts, BATCH, by="pos"), "worker_rows", BATCH)
    return got.select("id", "worker", "batch")


COLLATED = f"""select batch, n_images, ids, classes from (select i // {BATCH} as batch, count(*) as n_images,
  string_agg(cast(id as varchar), ',' order by i) as ids, string_agg(class, ',' order by i) as classes from ({ORDERED})
group by i // {BATCH})"""


@query("collate", with_sql("samples") + COLLATED)
def collate(spark, sf_dir):
    got = splits.collate(splits.batches(_placed(spark, sf_dir), BATCH), ["batch"], ["id", "class"], BATCH)
    ids = F.transform("samples.id", lambda v: v.cast("string"))
    return got.select(
        "batch", "n_images", F.array_join(ids, ",").alias("ids"), F.array_join("samples.class", ",").alias("classes")
    )


def join_fields(rows):
    """One row per batch, its ids and classes in order."""
    ids, classes = ",".join(map(str, rows["id"])), ",".join(rows["class"])
    return rows.iloc[:1][["batch"]].assign(n_images=len(rows), ids=ids, classes=classes)


@query("udaf_collate", with_sql("samples") + COLLATED)
def udaf_collate(spark, sf_dir):
    rows = splits.batches(_placed(spark, sf_dir), BATCH).select("batch", "batch_pos", "id", "class")
    return mapping.collate_with(rows, "batch", join_fields, "batch bigint, n_images bigint, ids string, classes string")


@query(
    "batch_length",
    with_sql("samples") + f"select i // {BATCH} as batch, count(*) as n_images from ({ORDERED}) group by i // {BATCH}",
)
def batch_length(spark, sf_dir):
    return splits.batch_lengths(splits.batches(_placed(spark, sf_dir), BATCH), ["batch"])


@query(
    "shard_fixed",
    with_sql("samples")
    + f"""select id, i // {SHARD_ROWS} as shard, i % {SHARD_ROWS} as pos,
  'shard_' || case when i // {SHARD_ROWS} < 9 then '0' else '' end || (i // {SHARD_ROWS} + 1) || '.tar' as shard_name
from ({ORDERED})""",
)
def shard_fixed(spark, sf_dir):
    got = loading.fixed_shards(V.samples(spark, sf_dir), ["id"], SHARD_ROWS, SEED)
    return got.select("id", "shard", "pos", "shard_name")


LIMIT = 20_000


def packed_sql(placed: str, limit: int) -> str:
    """One writer that goes through all samples, one sample per step of a recursive query."""
    return f"""placed as materialized ({placed}),
lengths as materialized (select list(length order by i) as ls from placed),
fill(k, shard, held) as (
  select cast(0 as bigint), cast(0 as bigint), ls[1] from lengths
  union all
  select k + 1, case when held + ls[k + 2] > {limit} then shard + 1 else shard end,
    case when held + ls[k + 2] > {limit} then ls[k + 2] else held + ls[k + 2] end
  from fill, lengths where k + 1 < len(ls)),
packed as (select placed.*, shard, k from fill join placed on placed.i = k)"""


@query(
    "shard_bytes",
    with_sql(
        "manifest", more=packed_sql(order_sql("manifest", "doc_id", SEED, extra="doc_id, length"), LIMIT)
    )
    + "select doc_id, length, shard, row_number() over (partition by shard order by k) - 1 as pos from packed",
)
def shard_bytes(spark, sf_dir):
    got = loading.byte_shards(V.manifest(spark, sf_dir), ["doc_id"], LIMIT, SEED)
    return got.select("doc_id", "length", "shard", "pos")


@query(
    "repeat_runs",
    with_sql("samples", more="each as (select id, r as run_id from samples, range(0, 3) t(r))")
    + order_sql("each", "id", SEED, "run_id", within="run_id", extra="id, run_id"),
)
def repeat_runs(spark, sf_dir):
    return splits.repeat_runs(V.samples(spark, sf_dir).select("id"), ["id"], 3, SEED).select("id", "run_id", "i")


@query(
    "zip_join",
    with_sql("samples", "manifest")
    + f"""select a.i, a.id, b.name from ({ORDERED}) a
join ({order_sql('manifest', 'doc_id', SEED)}) b using (i)""",
)
def zip_join(spark, sf_dir):
    left = _placed(spark, sf_dir).select("i", "id")
    right = ordering.dense_index(V.manifest(spark, sf_dir), ["doc_id"], seed=SEED).select("i", "name")
    return samples.zip_by_index(left, right)


@query(
    "shard_summary",
    with_sql("samples")
    + f"""select shard, shard + 1 as number, count(*) over () as of, n_images, bytes
from (select i // {SHARD_ROWS} as shard, count(*) as n_images, cast(sum(length) as bigint) as bytes from ({ORDERED})
  group by i // {SHARD_ROWS})""",
)
def shard_summary(spark, sf_dir):
    rows = loading.fixed_shards(V.samples(spark, sf_dir), ["id"], SHARD_ROWS, SEED)
    return samples.shard_summary(rows, splits.shard_count("n_total", SHARD_ROWS))


@query(
    "check_shards",
    with_sql("manifest")
    + f"""select 's' || s as name from (select unnest(range(0, (count(*) + 9) // 10)) as s from manifest)
where s not in (select i // 10 from ({order_sql('manifest', 'doc_id', SEED)}) group by 1 having sum(length) > 15000)""",
)
def check_shards(spark, sf_dir):
    """Expected shards that the listing of a folder does not have, to which only the larger ones were written."""
    rows = V.manifest(spark, sf_dir)
    n = rows.agg(splits.shard_count(F.count(F.lit(1)), 10).alias("n"))
    name = F.concat(F.lit("s"), F.col("shard").cast("string"))
    expected = n.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("shard")).select(name.alias("name"))
    placed = loading.fixed_shards(rows, ["doc_id"], 10, SEED)
    larger = samples.shard_summary(placed, splits.shard_count("n_total", 10)).where("bytes > 15000").select("shard")
    slim = loading.with_payload(placed.join(larger, "shard").select("doc_id", "shard", "pos"), V.payloads(spark, sf_dir), ["doc_id"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "payload"))), lambda m: m["payload"])
    content = F.aggregate(parts, F.lit(b""), lambda out, part: F.concat(out, part)).alias("content")
    target = scratch_path(spark, "check-shards")
    system, root = files.filesystem(target)
    system.create_dir(root)  # listed also when nothing is written
    whole = slim.groupBy("shard").agg(content)
    V.run_writes(files.write_files(whole.select(F.concat(F.lit(f"{target}/"), name).alias("path"), "content")))
    return samples.missing_inputs(expected, files.scan(spark, target).select("name"))


@query(
    "skip_missing",
    with_sql("manifest")
    + "select doc_id, name, doc_id in (select doc_id from labels) as present from manifest",
)
def skip_missing(spark, sf_dir):
    """Inputs that are there, and those that are only warned of."""
    wanted, there = V.manifest(spark, sf_dir).select("doc_id", "name"), V.table(spark, sf_dir, "labels").select("doc_id")
    present = samples.present_inputs(wanted, there, "doc_id").withColumn("present", F.lit(True))
    gone = samples.missing_inputs(wanted, there, "doc_id").withColumn("present", F.lit(False))
    return samples.union_sources(present, gone)
