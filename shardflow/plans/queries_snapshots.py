"""Queries of the batch table function and of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardflow.operators import batch_table, ordering, splits
from shardflow.plans import stand_ins as V
from shardflow.plans.registry import query
from shardflow.plans.stand_ins import order_sql, with_sql
from shardflow.scratch import scratch_path
from shardflow.sources import snapshots

WORKERS, BATCH, SHARD_ROWS = 4, 32, 200


@query(
    "udtf_batches",
    with_sql("samples")
    + f"""select worker, pos // {BATCH} as batch, count(*) as n_images, cast(sum(length) as bigint) as bytes,
  string_agg(cast(id as varchar), ',' order by pos) as ids
from (select i % {WORKERS} as worker, i // {WORKERS} as pos, id, length from ({order_sql("samples", "id", 5)}))
group by worker, pos // {BATCH}""",
)
def udtf_batches(spark, sf_dir):
    """Batches of every worker by the table function, in SQL text."""
    batch_table.register(spark)
    placed = splits.split_strided(ordering.dense_index(V.samples(spark, sf_dir), ["id"], seed=5), WORKERS)
    return spark.sql(
        f"""select worker, batch, n_images, bytes, array_join(ids, ',') as ids
        from worker_batches(table({{placed}}) partition by worker order by pos, size => {BATCH})""",
        placed=placed.select("worker", "pos", "id", "length"),
    )


FIRST = "coalesce(class, '') <= 'src3'"


@query(
    "shard_snapshots",
    with_sql(
        "manifest",
        more=f"""placed as ({order_sql(f"(select *, case when {FIRST} then 1 else 2 end as part from manifest)", "doc_id", 6, within="part")}),
shards as (select part, i // {SHARD_ROWS} as shard, count(*) as n_images, cast(coalesce(sum(length), 0) as bigint) as image_bytes
  from placed group by part, i // {SHARD_ROWS})""",
    )
    + """select 1 as snapshot, shard, n_images, image_bytes from shards where part = 1
union all select 2, shard + case when part = 2 then (select count(*) from shards where part = 1) else 0 end, n_images, image_bytes
from shards""",
)
def shard_snapshots(spark, sf_dir):
    """Two appends; the shards of both snapshots, the first pinned before the second append, read from their images."""
    root = scratch_path(spark, "snapshots")
    rows = V.full_samples(spark, sf_dir).select("doc_id", "class", "payload")

    def part(of):
        placed = splits.shards_fixed(ordering.dense_index(rows.where(of), ["doc_id"], seed=6), SHARD_ROWS)
        return placed.select("shard", "pos", F.col("payload").alias("image"), F.lit(0).alias("label"))

    first = snapshots.append(part(FIRST), root)
    pinned = snapshots.read_snapshot(spark, root, first)
    second = snapshots.append(part(f"not ({FIRST})"), root)
    newest = snapshots.read_snapshot(spark, root, second)
    both = pinned.withColumn("snapshot", F.lit(first)).unionByName(newest.withColumn("snapshot", F.lit(second)))
    return both.groupBy("snapshot", "shard").agg(
        F.count(F.lit(1)).alias("n_images"), F.coalesce(F.sum(F.octet_length("image")), F.lit(0)).cast("bigint").alias("image_bytes")
    )
