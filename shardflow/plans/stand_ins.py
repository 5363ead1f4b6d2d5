"""The given tables seen as manifests, samples, members, tensors and telemetry.

Each stand-in exists as a DataFrame and as the same thing in SQL (``SQL``),
which the checks use.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.functions import columns as C
from shardflow.plans.png_files import png_bytes
from shardflow.operators.samples import with_path_parts
from shardflow.scratch import scratch_path
from shardflow.sources.files import write_files

EXTS = (".png", ".PNG", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".txt")
BUCKET = "s3://bkt"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sample_path(root: str) -> Column:
    class_ = F.when(F.col("source") == "src7", ".src7").otherwise(F.col("source"))
    exts = F.array(*[F.lit(e) for e in EXTS])
    ext = F.element_at(exts, (F.col("doc_id") % len(EXTS) + 1).cast("int"))
    dot = F.when(F.col("doc_id") % 17 == 0, ".").otherwise("")
    return F.concat(F.lit(root + "/"), class_, F.lit("/"), dot, F.lit("d"), F.col("doc_id").cast("string"), ext)


def _empty() -> Column:
    return F.col("doc_id") % 23 == 0


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``s3://bkt/<source>/d<id>.<ext>``: some hidden, some empty."""
    docs = table(spark, sf_dir, "documents")
    length = F.when(_empty(), F.lit(0)).otherwise(F.octet_length("text")).cast("bigint")
    rows = docs.select("doc_id", _sample_path(BUCKET).alias("path"), length.alias("length"))
    return with_path_parts(rows)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, payload``: the bytes of the manifest's files."""
    docs = table(spark, sf_dir, "documents")
    body = F.when(_empty(), F.lit("")).otherwise(F.col("text"))
    return docs.select("doc_id", F.encode(body, "utf-8").alias("payload"))


def full_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest columns and payload from one scan of the documents."""
    docs = table(spark, sf_dir, "documents")
    body = F.encode(F.when(_empty(), F.lit("")).otherwise(F.col("text")), "utf-8")
    rows = docs.select("doc_id", _sample_path(BUCKET).alias("path"), body.alias("payload"))
    return with_path_parts(rows.withColumn("length", F.octet_length("payload").cast("bigint")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bulk samples: ``id, class, length``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("class"),
        F.floor("o_totalprice").cast("bigint").alias("length"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tar members: an exchange of turns is a sample, the role its extension."""
    turns = table(spark, sf_dir, "conversations")
    exchange = C.idiv(F.col("turn") + 1, 2).cast("string")
    return turns.select(
        (F.col("conv_id") % 8).alias("shard"),
        F.concat_ws("-", F.col("conv_id").cast("string"), exchange).alias("key"),
        F.col("turn").alias("pos"),
        F.col("role").alias("ext"),
        F.col("text").alias("payload"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images of one channel: ``vec_id, height, width, channels, pixels``.

    A value from -1 to 1 becomes a whole pixel value from 0 to 255.
    """
    q = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 127.5))))
    chars = F.transform(q, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("channels"),
        F.unhex(F.array_join(chars, "")).alias("pixels"),
        "label",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loader telemetry: the type is the loader, the day the run."""
    return as_telemetry(table(spark, sf_dir, "events"))


def as_telemetry(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return events.select(
        F.col("event_type").alias("loader"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("bigint").alias("run_id"),
        "event_id",
        "ts",
        (F.col("event_id") % 32 + 1).alias("n_images"),
        F.col("value").cast("decimal(18,2)").alias("load_time"),
        k.try_cast("double").alias("cpu"),
        (F.col("user_id") / F.lit(100.0)).cast("decimal(18,2)").alias("ram"),
    )


# --- files made from the tables ------------------------------------------------

_made: dict[tuple[str, str, str], str] = {}


def _made_once(spark: SparkSession, sf_dir: str, what: str, make) -> str:
    """The folder ``make`` fills, made once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _made:
        root = scratch_path(spark, what)
        make(root)
        _made[key] = root
    return _made[key]


def run_writes(written: DataFrame) -> None:
    """Run a lazy writing step on all its partitions; a file that could not be written is an error."""
    bad = written.where(~F.col("ok")).agg(F.min(F.struct("path", "error")).alias("first")).first().first
    if bad:
        raise OSError(f"{bad.path}: {bad.error}")


def file_tree(spark: SparkSession, sf_dir: str) -> str:
    """A real folder per class with the manifest's files in it."""

    def make(root: str) -> None:
        rows = full_samples(spark, sf_dir)
        at = F.concat(F.lit(root), F.substr("path", F.lit(len(BUCKET) + 1)))
        run_writes(write_files(rows.select(at.alias("path"), "payload"), content="payload"))

    return _made_once(spark, sf_dir, "tree", make)


def nested_tree(spark: SparkSession, sf_dir: str) -> str:
    """A root with files of its own (those of one class), and folders that have folders below."""

    def make(root: str) -> None:
        rows = full_samples(spark, sf_dir)
        base = F.lit(root)
        top = rows.where("class = 'src4'").select(F.concat(base, F.lit("/top-"), "name").alias("path"), "payload")
        inside = rows.where("class = 'src3'").select(F.concat(base, F.lit("/src3/"), "name").alias("path"), "payload")
        deep = rows.where("class not in ('src3', 'src4')").select(F.concat(base, F.lit("/src3/"), "class", F.lit("/"), "name").alias("path"), "payload")
        run_writes(write_files(top.union(inside).union(deep), content="payload"))

    return _made_once(spark, sf_dir, "nested", make)


def png_frame(rows: pd.DataFrame) -> pd.DataFrame:
    """Grey, RGB or RGBA PNG files in turn; green is inverted and blue halved."""
    out = []
    for vec_id, raw in zip(rows["vec_id"], rows["pixels"]):
        grey = np.frombuffer(raw, np.uint8).reshape(8, 8)
        colour = np.stack([grey, 255 - grey, grey // 2, np.full_like(grey, 255)], axis=2)
        out.append(png_bytes(grey[:, :, None] if vec_id % 3 == 0 else colour[:, :, : 2 + vec_id % 3]))
    return rows[["vec_id"]].assign(content=out)


def png_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, content``: the images as PNG bytes."""
    rows = pixels(spark, sf_dir).select("vec_id", "pixels")
    return rows.mapInPandas(lambda frames: map(png_frame, frames), "vec_id bigint, content binary")


def png_tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder of real PNG files, one per embedding."""

    def make(root: str) -> None:
        ext = F.when(F.col("vec_id") % 5 == 0, ".PNG").otherwise(".png")
        at = F.concat(F.lit(f"{root}/v"), F.col("vec_id").cast("string"), ext)
        run_writes(write_files(png_payloads(spark, sf_dir).withColumn("path", at)))

    return _made_once(spark, sf_dir, "png", make)


# --- the same in SQL ---------------------------------------------------------------

_EXT_SQL = " ".join(f"when {k} then '{e}'" for k, e in enumerate(EXTS))

SQL = {
    "manifest": f"""manifest as (
  select doc_id, class, name, '{BUCKET}/' || class || '/' || name as path, length, body,
    regexp_replace(name, '(.)\\.[^.]*$', '\\1') as key, lower(ext) as ext
  from (select doc_id, case when source = 'src7' then '.src7' else source end as class, ext,
      case when doc_id % 17 = 0 then '.' else '' end || 'd' || doc_id || ext as name,
      case when doc_id % 23 = 0 then 0 else strlen(text) end as length,
      case when doc_id % 23 = 0 then '' else text end as body
    from (select *, case doc_id % {len(EXTS)} {_EXT_SQL} end as ext from documents)))""",
    "samples": """samples as (
  select o_orderkey as id, o_orderstatus as class, cast(floor(o_totalprice) as bigint) as length from orders)""",
    "members": """members as (
  select conv_id % 8 as shard, conv_id || '-' || ((turn + 1) // 2) as key, turn as pos, role as ext, text as payload
  from conversations)""",
    "pixels": """pixels as (
  select vec_id, j - 1 as k, least(255, greatest(0, cast(floor((cast(embedding[j] as double) + 1) * 127.5) as bigint))) as q
  from embeddings, range(1, 65) r(j))""",
    "telemetry": """telemetry as (
  select event_type as loader, date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as run_id, event_id, ts,
    event_id % 32 + 1 as n_images, cast(value as decimal(18,2)) as load_time,
    try_cast(json_extract_string(props, '$.k') as double) as cpu, cast(user_id / 100.0 as decimal(18,2)) as ram
  from events)""",
    "runs": """runs as (
  select loader, run_id, total_time, total_images,
    case when total_time > 0 then total_images / total_time else 0.0 end as images_per_sec,
    avg_data_load_time, avg_cpu, avg_ram
  from (select loader, run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as total_time,
      cast(sum(n_images) as bigint) as total_images,
      coalesce(cast(sum(load_time) as double) / nullif(count(load_time), 0), 0) as avg_data_load_time,
      coalesce(cast(sum(cpu) as double) / nullif(count(cpu), 0), 0) as avg_cpu,
      coalesce(cast(sum(ram) as double) / nullif(count(ram), 0), 0) as avg_ram
    from telemetry group by loader, run_id))""",
    "stats": """stats as (
  select loader, avg(total_time) as total_time, avg(total_images) as total_images, avg(images_per_sec) as images_per_sec,
    avg(avg_data_load_time) as avg_data_load_time, avg(avg_cpu) as avg_cpu, avg(avg_ram) as avg_ram
  from runs group by loader)""",
    "scored": """scored as (
  select *, 0.35 * speed + 0.35 * efficiency + 0.15 * memory + 0.10 * cpu + 0.05 * load_time as overall
  from (select *, images_per_sec / max(images_per_sec) over () * 100 as speed,
      min(total_time) over () / total_time * 100 as efficiency, min(avg_ram) over () / avg_ram * 100 as memory,
      min(avg_cpu) over () / avg_cpu * 100 as cpu,
      min(avg_data_load_time) over () / avg_data_load_time * 100 as load_time
    from stats))""",
}
# What each of them is built from.
_NEEDS = {"runs": ("telemetry",), "stats": ("runs",), "scored": ("stats",)}


def with_sql(*names: str, more: str = "") -> str:
    """A ``with`` clause of the named stand-ins and all they need, and of ``more``."""

    def needed(got: list[str], name: str) -> list[str]:
        got = reduce(needed, _NEEDS.get(name, ()), got)
        return got if name in got else [*got, name]

    parts = [SQL[n] for n in reduce(needed, names, [])]
    return "with recursive " + ",\n".join([*parts, more] if more else parts) + "\n"


def key_sql(seed: int, epoch: int | str, *ids: str) -> str:
    """The seeded sort key: the first 60 bits of an md5, here as 15 hex digits."""
    parts = ", ".join(f"cast({x} as varchar)" for x in (epoch, *ids))
    return f"substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15)"


def order_sql(table_: str, ids: str, seed: int, epoch: int | str = 0, within: str = "", extra: str = "*") -> str:
    """SQL of a seeded dense index ``i`` over a table."""
    part = f"partition by {within} " if within else ""
    return f"select {extra}, row_number() over ({part}order by {key_sql(seed, epoch, ids)}, {ids}) - 1 as i from {table_}"
