"""Registered queries on manifests, labels, members and pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shardflow.functions import columns as C
from shardflow.operators import mapping, ordering, pixels, samples, splits
from shardflow.plans import stand_ins as V
from shardflow.plans.registry import query
from shardflow.plans.stand_ins import order_sql, with_sql

SEED = 42


@query("filter_ext", with_sql("manifest") + "select path, ext from manifest where ext in ('.jpg', '.jpeg', '.png')")
def filter_ext(spark, sf_dir):
    return V.manifest(spark, sf_dir).where(C.has_ext("path", C.COPY_EXTS)).select("path", "ext")


@query(
    "filter_hidden",
    with_sql("manifest") + "select path from manifest where class not like '.%' and name not like '.%'",
)
def filter_hidden(spark, sf_dir):
    return V.manifest(spark, sf_dir).where(C.is_visible("class", "name")).select("path")


@query("filter_empty", with_sql("manifest") + "select path, length from manifest where length > 0")
def filter_empty(spark, sf_dir):
    return V.manifest(spark, sf_dir).where(F.col("length") > 0).select("path", "length")


@query("path_parts", with_sql("manifest") + "select path, class, name, key, ext from manifest")
def path_parts(spark, sf_dir):
    return samples.with_path_parts(V.manifest(spark, sf_dir).select("path"))


@query(
    "scan_prefix",
    with_sql("manifest")
    + """select path, row_number() over (order by path) - 1 as i from manifest
where starts_with(path, 's3://bkt/src1') and ext in ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tiff')""",
)
def scan_prefix(spark, sf_dir):
    rows = V.manifest(spark, sf_dir).where(F.startswith("path", F.lit("s3://bkt/src1")))
    return ordering.sort_paths(rows.where(C.has_ext("path", C.OBJECT_STORE_EXTS)).select("path"), by="string")


def stem_number(rows: pd.DataFrame) -> pd.DataFrame:
    """The number in names such as ``d12.png``; other names are an error of their row."""
    digits = rows["name"].str.extract(r"^d(\d+)\.", expand=False)
    bad = digits.isna()
    return pd.DataFrame(
        {
            "path": rows["path"].mask(bad, None),
            "number": digits.astype("Int64"),
            "error": ("no number in " + rows["name"]).where(bad, None),
        }
    )


@query(
    "tolerant_map",
    with_sql("manifest")
    + """select case when bad then null else path end as path, case when bad then null else doc_id end as number,
  case when bad then 'no number in ' || name end as error
from (select *, name like '.%' as bad from manifest)""",
)
def tolerant_map(spark, sf_dir):
    rows = V.manifest(spark, sf_dir).select("path", "name")
    return mapping.map_samples(rows, stem_number, "path string, number bigint", mode="PERMISSIVE")


def byte_sums(rows: pd.DataFrame) -> pd.DataFrame:
    data = [np.frombuffer(p, np.uint8) for p in rows["payload"]]
    return rows[["doc_id"]].assign(
        n_bytes=[len(d) for d in data], n_lines=[int((d == 10).sum()) for d in data]
    )


@query(
    "udf_map",
    with_sql("manifest")
    + """select doc_id, cast(strlen(body) as bigint) as n_bytes,
  cast(length(body) - length(replace(body, chr(10), '')) as bigint) as n_lines from manifest""",
)
def udf_map(spark, sf_dir):
    return mapping.map_samples(V.payloads(spark, sf_dir), byte_sums, "doc_id bigint, n_bytes bigint, n_lines bigint")


@query(
    "label_binary",
    f"""with named as (select doc_id, 'q' || quality as class from labels),
placed as ({order_sql('named', 'doc_id', SEED, within='class')})
select doc_id, class, p || case when i < 99999 then lpad(cast(i + 1 as varchar), 5, '0') else cast(i + 1 as varchar) end as label_id,
  p as label from (select *, case when class = 'q0' then 'fake' else 'real' end as p from placed)""",
)
def label_binary(spark, sf_dir):
    quality = F.concat(F.lit("q"), F.col("quality").cast("string"))
    rows = V.table(spark, sf_dir, "labels").select("doc_id", quality.alias("class"))
    return samples.label_binary(rows, ["doc_id"], SEED).select("doc_id", "class", "label_id", "label")


@query(
    "label_int",
    with_sql("manifest")
    + "select path, class, dense_rank() over (order by class) - 1 as label from manifest where class not like '.%'",
)
def label_int(spark, sf_dir):
    return samples.label_int(V.manifest(spark, sf_dir)).select("path", "class", "label")


@query(
    "attach_label",
    with_sql("manifest") + "select doc_id, class, quality, toxic from manifest left join labels using (doc_id)",
)
def attach_label(spark, sf_dir):
    rows = V.manifest(spark, sf_dir).select("doc_id", "class")
    return samples.attach_label(rows, V.table(spark, sf_dir, "labels"), "doc_id")


@query(
    "json_meta",
    """select doc_id, '{"label": "' || case when quality = 1 then 'real' else 'fake' end || '"}' as meta, cast(17 as bigint) as n_bytes
from labels""",
)
def json_meta(spark, sf_dir):
    word = F.when(F.col("quality") == 1, "real").otherwise("fake")
    rows = V.table(spark, sf_dir, "labels").select("doc_id", C.label_json(word).alias("meta"))
    return rows.withColumn("n_bytes", F.octet_length(F.encode("meta", "utf-8")).cast("bigint"))


@query(
    "label_composite",
    with_sql("manifest")
    + f"select class || '/' || name || '/' || (i + 1) as label from ({order_sql('manifest', 'doc_id', SEED)})",
)
def label_composite(spark, sf_dir):
    rows = ordering.dense_index(V.manifest(spark, sf_dir), ["doc_id"], seed=SEED)
    return rows.select(C.composite_label("class", "name", "i").alias("label"))


@query(
    "zero_pad",
    """select o_orderkey as id, case when length(s) >= 5 then s else lpad(s, 5, '0') end as five,
  case when length(s) >= 2 then s else lpad(s, 2, '0') end as two
from (select o_orderkey, cast(o_orderkey as varchar) as s from orders)""",
)
def zero_pad(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return rows.select("id", C.zero_pad("id", 5).alias("five"), C.zero_pad("id", 2).alias("two"))


@query(
    "normalise_uri",
    with_sql("manifest") + "select doc_id, 'bkt/' || class as folder, rtrim(url, '/') as url from manifest left join pages on page_id = doc_id",
)
def normalise_uri(spark, sf_dir):
    folder = F.concat(F.lit("s3://bkt/"), "class", F.repeat(F.lit("/"), (F.col("doc_id") % 3).cast("int")))
    rows = V.manifest(spark, sf_dir).select("doc_id", C.normalise_uri(folder).alias("folder"))
    urls = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), C.normalise_uri("url").alias("url"))
    return rows.join(urls, "doc_id", "left")


@query(
    "safe_cast",
    with_sql("telemetry")
    + """select event_id, value, case when value is null then 'not a number' end as reason from (
  select event_id, case when event_id % 5 = 0 then null else cpu end as value from telemetry)""",
)
def safe_cast(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(
        F.concat(F.lit("  "), F.get_json_object("props", "$.k"), F.lit(" "))
    )
    value = C.safe_double(text)
    return events.select("event_id", value.alias("value"), F.when(value.isNull(), "not a number").alias("reason"))


@query(
    "units",
    with_sql("samples")
    + """select id, round(length / 1073741824.0, 9) as gib, round(length / 1048576.0, 6) as mib,
  round(length / 32.0 * 1e6, 3) as us from samples""",
)
def units(spark, sf_dir):
    return V.samples(spark, sf_dir).select(
        "id",
        F.round(C.bytes_to_gib("length"), 9).alias("gib"),
        F.round(C.bytes_to_mib("length"), 6).alias("mib"),
        F.round(C.seconds_to_us(F.col("length") / F.lit(32.0)), 3).alias("us"),
    )


@query(
    "payload_kind",
    with_sql("manifest")
    + """select doc_id, case when ext = '.bmp' then 'image' when length > 0 then 'bytes' else 'passthrough' end as kind
from manifest""",
)
def payload_kind(spark, sf_dir):
    """Bitmaps stand for decoded images here, empty files for values that pass as they are."""
    rows = V.full_samples(spark, sf_dir)
    decoded = F.when(F.col("ext") == ".bmp", F.col("payload"))
    encoded = F.when(F.col("length") > 0, F.col("payload"))
    return rows.select("doc_id", C.payload_kind(decoded, encoded).alias("kind"))


@query(
    "class_counts",
    with_sql("manifest")
    + """select class, count(*) as n_images, cast(coalesce(sum(length), 0) as bigint) as bytes
from manifest group by rollup (class)""",
)
def class_counts(spark, sf_dir):
    return samples.class_counts(V.manifest(spark, sf_dir))


@query(
    "union_sources",
    with_sql("samples", "manifest")
    + """select cast(id as varchar) as key, class, length, 'orders' as origin from samples
union all select key, class, length, 'documents' from manifest""",
)
def union_sources(spark, sf_dir):
    a = V.samples(spark, sf_dir).select(F.col("id").cast("string").alias("key"), "class", "length", F.lit("orders").alias("origin"))
    b = V.manifest(spark, sf_dir).select("length", "class", "key", F.lit("documents").alias("origin"))
    return samples.union_sources(a, b)


@query("project_member", with_sql("members") + "select shard, key, pos, md5(payload) as digest from members where ext = 'user' and payload is not null")
def project_member(spark, sf_dir):
    got = samples.project_member(V.members(spark, sf_dir), "user")
    return got.select("shard", "key", "pos", F.md5("payload").alias("digest"))


@query(
    "assemble_members",
    with_sql("members")
    + """select shard, key, count(*) as n_members, string_agg(ext || '=' || md5(payload), ',' order by ext) as digests
from (select shard, key, ext, arg_min(payload, pos) as payload from members group by shard, key, ext)
group by shard, key""",
)
def assemble_members(spark, sf_dir):
    got = samples.assemble_members(V.members(spark, sf_dir))
    digests = F.transform(F.map_entries("members"), lambda e: F.concat(e["key"], F.lit("="), F.md5(e["value"])))
    return got.select(
        "shard", "key", F.size("members").cast("bigint").alias("n_members"), F.array_join(F.array_sort(digests), ",").alias("digests")
    )


# --- pixels -----------------------------------------------------------------------


def _cells(tensors, keep: str):
    """Tensor values as rows, for comparing them one by one."""
    px = tensors.select(keep, "h", "w", F.posexplode("px").alias("n", "v"))
    area = F.col("h") * F.col("w")
    return px.select(
        keep,
        C.idiv("n", area).alias("c"),
        (F.col("n") % area).cast("bigint").alias("k"),
        F.round(F.col("v").cast("double"), 4).alias("v"),
    )


@query(
    "to_tensor",
    with_sql("pixels") + "select vec_id, cast(0 as bigint) as c, k, round(cast(cast(q / 255.0 as float) as double), 4) as v from pixels",
)
def to_tensor(spark, sf_dir):
    return _cells(pixels.to_tensor(V.pixels(spark, sf_dir), ["vec_id"]), "vec_id")


@query(
    "stack_tensors",
    with_sql("pixels", more=f"""placed as ({order_sql('embeddings', 'vec_id', 11)})""")
    + """select batch, n_images, labels, n_values, total from (
  select i // 32 as batch, count(*) as n_images, string_agg(label, ',' order by i) as labels from placed group by 1) join (
  select i // 32 as batch, count(*) as n_values, round(sum(q * (k + 1 + 64 * (i % 32))) / 255, 3) as total
  from placed join pixels using (vec_id) group by 1) using (batch)""",
)
def stack_tensors(spark, sf_dir):
    """Batches of 32 stacked tensors with their labels; every value is checked at its place in the stack."""
    rows = V.pixels(spark, sf_dir)
    tensors = pixels.to_tensor(rows, ["vec_id", "label"])
    batched = splits.batches(ordering.dense_index(tensors, ["vec_id"], seed=11), 32)
    stacks = splits.stack_tensors(batched, ["batch"], 32)
    labels = splits.collate(batched, ["batch"], ["label"], 32).select("batch", F.array_join("samples.label", ",").alias("labels"))
    summed = F.aggregate(
        F.transform("px", lambda v, k: F.round(v.cast("double") * 255) * (k + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return stacks.join(labels, "batch").select(
        "batch", "n_images", "labels", F.size("px").cast("bigint").alias("n_values"), F.round(summed / 255, 3).alias("total")
    )


@query("udf_setup", with_sql("manifest") + "select doc_id, ext || '-' || length(ext) as tag, true as once from manifest")
def udf_setup(spark, sf_dir):
    """A row function with a state that each task makes once, such as a client or a table."""
    rows = V.manifest(spark, sf_dir).select("doc_id", "ext")
    return mapping.map_samples(rows, tagged, "doc_id bigint, tag string, once boolean", setup=tag_table, chunk=100)


def tag_table() -> dict:
    return {"made": 0, "tags": {}}


def tagged(rows, state):
    """Counts how often it sees a state that another call has not used yet."""
    state["made"] += "used" not in state
    state["used"] = True
    tags = [state["tags"].setdefault(e, f"{e}-{len(e)}") for e in rows["ext"]]
    return rows[["doc_id"]].assign(tag=tags, once=state["made"] == 1)


# Weights of the 8 to 4 resize: a triangle of half width 2 around each output centre.
WEIGHTS = """raw as (select o, src, greatest(0.0, 1 - abs(src + 0.5 - (o + 0.5) * 2) / 2.0) as w
  from range(0, 4) a(o), range(0, 8) b(src)),
weights as (select o, src, w / sum(w) over (partition by o) as w from raw)"""


def _resize_sql(rounded: bool) -> str:
    step = (lambda x: f"floor({x} + 0.5)") if rounded else (lambda x: x)
    source = "cast(q as double)" if rounded else "q / 255.0"
    scale = " / 255.0" if rounded else ""
    more = f"""{WEIGHTS},
across as (select vec_id, k // 8 as y, o as x, {step(f'sum(w * {source})')} as v
  from pixels join weights on src = k % 8 group by vec_id, k // 8, o),
both_ways as (select vec_id, o as y, x, {step('sum(w * v)')} as v from across join weights on src = y group by vec_id, o, x)"""
    return with_sql("pixels", more=more) + (
        f"select vec_id, cast(0 as bigint) as c, y * 4 + x as k, round(cast(cast(v{scale} as float) as double), 4) as v from both_ways"
    )


@query("resize_tensor", _resize_sql(True))
def resize_tensor(spark, sf_dir):
    return _cells(pixels.resize_to_tensor(V.pixels(spark, sf_dir), ["vec_id"], 4, 4), "vec_id")


@query("tensor_then_resize", _resize_sql(False))
def tensor_then_resize(spark, sf_dir):
    return _cells(pixels.tensor_then_resize(V.pixels(spark, sf_dir), ["vec_id"], 4, 4), "vec_id")


# Sizes of the fixed-point query: both axes larger, both smaller, one of each.
SIZES = ((11, 13), (3, 5), (20, 6))


def _fixed_sql() -> str:
    """Whole-number weights and sums of the tensors' bytes, said in SQL for every size."""
    axes = sorted({n for size in SIZES for n in size})
    taps = ", ".join(f"({n})" for n in axes)
    more = f"""axes as (select n, 8.0::double / n as scale, greatest(8.0::double / n, 1.0) as width from (values {taps}) t(n)),
raw as (select n, o, src, greatest(0.0, 1 - abs(src + 0.5 - (o + 0.5) * scale) / width) as w from axes, range(0, 20) a(o), range(0, 8) b(src) where o < n),
shares as (select n, o, src, w / sum(w) over (partition by n, o) as w from raw),
taps as (select n, o, src, cast(floor(w * 4194304 + 0.5) as bigint) as w from shares where w > 0),
sizes as (select * from (values {", ".join(map(str, SIZES))}) t(h, w)),
across as (select vec_id, s.h, s.w as wide, k // 8 as y, o as x, cast((sum(t.w * cast(q as bigint)) + 2097152) // 4194304 as bigint) as v
  from pixels, sizes s join taps t on t.n = s.w where t.src = k % 8 group by all),
both_ways as (select vec_id, a.h, wide, o as y, x, cast((sum(t.w * v) + 2097152) // 4194304 as bigint) as v
  from across a join taps t on t.n = a.h and t.src = y group by all)"""
    return with_sql("pixels", more=more) + (
        """select vec_id, cast(h as integer) as h, cast(wide as integer) as w,
  string_agg(lpad(cast(v as varchar), 3, '0'), '' order by y, x) as px from both_ways group by vec_id, h, wide"""
    )


@query("resize_images", _fixed_sql())
def resize_images(spark, sf_dir):
    """Whole pixel values of images resized to larger and smaller sizes, by taps with whole-number weights."""
    source = V.pixels(spark, sf_dir)
    out = None
    for h, w in SIZES:
        sized = pixels.resize_images(source, ["vec_id"], h, w)
        cells = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda k: F.lpad(F.conv(F.hex(F.col("pixels").substr(k + 1, F.lit(1))), 16, 10), 3, "0"))
        sized = sized.select("vec_id", F.col("height").alias("h"), F.col("width").alias("w"), F.array_join(cells, "").alias("px"))
        out = sized if out is None else out.unionByName(sized)
    return out
