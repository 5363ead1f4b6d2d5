"""Registered queries on real files, which Spark makes from the given tables first."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.functions import columns as C
from shardflow.operators import mapping, ordering, pixels, samples, telemetry
from shardflow.plans import loading, stand_ins as V
from shardflow.plans.queries_metrics import M, RUN_NUMBERS, RUN_SQL, rounded, rounded_sql
from shardflow.plans.queries_order import SEED, packed_sql
from shardflow.plans.registry import query
from shardflow.plans.stand_ins import SQL, key_sql, order_sql, with_sql
from shardflow.scratch import scratch_path
from shardflow.sources import columnar, files, reports, tar, tar_samples
from shardflow.streaming import closing
from shardflow.streaming import files as streams
from shardflow.streaming import passes

# Samples per tar and bytes per column shard for the small given tables.
TAR_ROWS, SHARD_BYTES = 200, 50_000
SHOWN = "class not like '.%' and name not like '.%'"


# --- listings ----------------------------------------------------------------------


@query(
    "scan_manifest",
    with_sql("manifest")
    + """select class, name, key, ext, length, row_number() over (order by class, name) - 1 as i from manifest""",
)
def scan_manifest(spark, sf_dir):
    """Every file of a tree in path order, hidden and empty ones as well."""
    found = ordering.sort_paths(files.scan(spark, V.file_tree(spark, sf_dir)))
    return found.select("class", "name", "key", "ext", "length", "i")


@query("scan_exts", with_sql("manifest") + "select class, name, length from manifest where ext in ('.jpg', '.png')")
def scan_exts(spark, sf_dir):
    """A listing that keeps two extensions."""
    return files.scan(spark, V.file_tree(spark, sf_dir), [".JPG", ".png"]).select("class", "name", "length")


@query(
    "scan_flat",
    with_sql("manifest") + """select name, length from manifest where class = 'src3'
union all select 'top-' || name, length from manifest where class = 'src4'""",
)
def scan_flat(spark, sf_dir):
    """The files of a folder itself and of a root, without those in the folders below."""
    root = V.nested_tree(spark, sf_dir)
    here = files.scan(spark, root, recursive=False)
    inside = files.scan(spark, f"{root}/src3", recursive=False)
    return inside.unionByName(here).select("name", "length")


@query(
    "scan_by_class",
    with_sql("manifest")
    + f"""select class, count(*) as n_images, cast(sum(length) as bigint) as bytes
from manifest where {SHOWN} and ext in ('.jpg', '.jpeg', '.png') group by class""",
)
def scan_by_class(spark, sf_dir):
    """Folders that hold images, as classes."""
    found = files.scan(spark, V.file_tree(spark, sf_dir), C.COPY_EXTS).where(C.is_visible("class", "name"))
    return samples.class_counts(found).where(F.col("class").isNotNull())


@query(
    "copy_images",
    with_sql("manifest") + f"select class, name, length from manifest where {SHOWN} and ext in ('.jpg', '.jpeg', '.png')",
)
def copy_images(spark, sf_dir):
    target = scratch_path(spark, "copy")
    copied = files.copy_files(files.scan(spark, V.file_tree(spark, sf_dir)), target)
    V.run_writes(copied.withColumnRenamed("dst", "path"))
    return files.scan(spark, target).select("class", "name", "length")


# --- images ----------------------------------------------------------------------


PNGS = """pngs as (
  select vec_id, 'v' || vec_id || case when vec_id % 5 = 0 then '.PNG' else '.png' end as name,
    cast(sum(q) as bigint) as red, cast(sum(case when vec_id % 3 = 0 then q else 255 - q end) as bigint) as green,
    cast(sum(case when vec_id % 3 = 0 then q else q // 2 end) as bigint) as blue
  from pixels group by vec_id)"""


@query(
    "scan_images",
    with_sql("pixels", more=PNGS)
    + """select name, 8 as height, 8 as width, case vec_id % 3 when 0 then 1 when 1 then 3 else 4 end as n_channels from pngs""",
)
def scan_images(spark, sf_dir):
    found = files.images(spark, V.png_tree(spark, sf_dir), C.PNG_ONLY)
    return found.select(
        C.file_name("path").alias("name"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels")
    )


def channel_sums(rows: pd.DataFrame) -> pd.DataFrame:
    sums = [memory_sums(p) for p in rows["pixels"]]
    return rows[["name"]].assign(**{c: [s[k] for s in sums] for k, c in enumerate(("red", "green", "blue"))})


def memory_sums(raw: bytes) -> list[int]:
    return [sum(raw[k::3]) for k in range(3)]


SUMS = "name string, red bigint, green bigint, blue bigint"


@query("decode_images", with_sql("pixels", more=PNGS) + "select name, red, green, blue from pngs")
def decode_images(spark, sf_dir):
    """Image files decoded by Spark's image source, brought to RGB."""
    found = files.images(spark, V.png_tree(spark, sf_dir), C.PNG_ONLY).withColumn("name", C.file_name("path"))
    return mapping.map_samples(pixels.rgb_images(found, ["name"]), channel_sums, SUMS)


# --- tar shards -------------------------------------------------------------------------


def tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a tar member; order and shard are settled before the payload joins."""
    placed = loading.fixed_shards(V.manifest(spark, sf_dir), ["doc_id"], TAR_ROWS, SEED)
    slim = placed.select("doc_id", "shard", "pos", F.concat_ws("/", "class", "key").alias("key"), F.substr("ext", F.lit(2)).alias("ext"))
    return loading.with_payload(slim, V.payloads(spark, sf_dir), ["doc_id"])


def tar_folder(spark: SparkSession, sf_dir: str) -> str:
    return V._made_once(spark, sf_dir, "tars", lambda root: tar.write_tar(tar_members(spark, sf_dir), root))


def tar_name_sql(shard: str, prefix: str = "shard_") -> str:
    return f"'{prefix}' || case when {shard} < 9 then '0' else '' end || ({shard} + 1) || '.tar'"


# Files are ordered by class and name, the documents by their number.
FILES_PLACED = f"""files as (select class || '|' || name as id, length from manifest),
placed as ({order_sql('files', 'id', SEED)})"""
TAR_SIZES = f"""tars as (select i // {TAR_ROWS} as shard, count(*) as n,
    (cast(sum(512 + (length + 511) // 512 * 512) as bigint) + 1024 + 10239) // 10240 * 10240 as bytes
  from placed group by 1)"""
TARS = f"""placed as ({order_sql('manifest', 'doc_id', SEED)}),
{TAR_SIZES}"""


@query(
    "write_tar",
    with_sql("manifest", more=f"{FILES_PLACED},\n{TAR_SIZES}") + f"select {tar_name_sql('shard')} as name, bytes from tars",
)
def write_tar(spark, sf_dir):
    """Write real files into tar shards and list those: whole tar records, to the byte."""
    target = scratch_path(spark, "write-tar")
    found = files.scan(spark, V.file_tree(spark, sf_dir))
    placed = loading.fixed_shards(found, ["class", "name"], TAR_ROWS, SEED)
    key, ext = F.concat_ws("/", "class", "key").alias("key"), F.substr("ext", F.lit(2)).alias("ext")
    tar.write_tar(placed.select("shard", "pos", key, ext, "path"), target)
    return files.scan(spark, target, [".tar"]).select("name", F.col("length").alias("bytes"))


@query(
    "read_tar_shards",
    with_sql("manifest", more=TARS)
    + f"""select {tar_name_sql(f'(i // {TAR_ROWS})')} as shard, i % {TAR_ROWS} as pos, class || '/' || key as key, ltrim(ext, '.') as ext,
  length as n_bytes, md5(body) as digest, '' as error from placed""",
)
def read_tar_shards(spark, sf_dir):
    got = tar.read_tar(spark, tar_folder(spark, sf_dir))
    n_bytes = F.octet_length("payload").cast("bigint")
    digest, error = F.md5("payload").alias("digest"), F.coalesce("error", F.lit("")).alias("error")
    return got.select("shard", "pos", "key", "ext", n_bytes.alias("n_bytes"), digest, error)


@query(
    "write_tar_labelled",
    with_sql(
        "manifest",
        more=f"""labelled as (select m.*, case when quality = 1 then 'real' else 'fake' end as word
  from manifest m join labels using (doc_id)), placed as ({order_sql('labelled', 'doc_id', SEED)})""",
    )
    + f"""select {tar_name_sql(f'(i // {TAR_ROWS})', 'shared_')} as shard, class || '/' || key as key, md5(body) as digest,
  '{{"label": "' || word || '"}}' as meta, cast(2 as bigint) as n_members from placed""",
)
def write_tar_labelled(spark, sf_dir):
    """Write image and JSON label side by side, read them back, and join them to samples.

    Samples without a label are not written; a warning tells their number.
    """
    word = F.when(F.col("quality") == 1, "real").otherwise("fake")
    labels = V.table(spark, sf_dir, "labels").select("doc_id", word.alias("label"))
    rows = samples.attach_label(V.manifest(spark, sf_dir), labels, "doc_id")
    target = scratch_path(spark, "write-tar-labelled")
    without = loading.labelled_tar(rows, V.payloads(spark, sf_dir), ["doc_id"], target, TAR_ROWS, SEED, "shared_").count()
    if without:
        warnings.warn(f"{without} samples without a label are in no shard", stacklevel=2)
    got = samples.assemble_members(tar.read_tar(spark, target))
    image = F.filter(F.map_entries("members"), lambda e: e["key"] != "json")[0]["value"]
    return got.select(
        "shard",
        "key",
        F.md5(image).alias("digest"),
        F.decode(F.try_element_at("members", F.lit("json")), "utf-8").alias("meta"),
        F.size("members").cast("bigint").alias("n_members"),
    )


@query(
    "compression_ratio",
    with_sql("manifest")
    + """select cast(sum(length) as bigint) as original_bytes, true as smaller, true as fits, true as zstd
from manifest where class not like '.%'""",
)
def compression_ratio(spark, sf_dir):
    """Bytes of the samples and of the compressed column shards they are stored in.

    How well they compress is the codec's affair: checked is that it is less, and that the
    fraction is the ratio.
    """
    stored = files.scan(spark, column_folder(spark, sf_dir), [".parquet"])
    original = V.manifest(spark, sf_dir).where(C.is_visible("class"))
    codec = stored.agg(F.bool_and(F.contains("name", F.lit(".zstd."))).alias("zstd"))
    sizes = samples.size_ratio(original, stored)
    fits = F.abs(F.col("ratio") * F.col("original_bytes") - F.col("stored_bytes")) < 1e-3
    return sizes.select("original_bytes", (F.col("stored_bytes") < F.col("original_bytes")).alias("smaller"), fits.alias("fits"), codec.scalar().alias("zstd"))


@query(
    "damaged_shards",
    with_sql("manifest", more=TARS)
    + f"""select 'whole' as state, count(*) as n from placed where i // {TAR_ROWS} < (select max(i) // {TAR_ROWS} from placed) having count(*) > 0
union all select 'reported', cast(1 as bigint)""",
)
def damaged_shards(spark, sf_dir):
    """Shards of which the last is cut inside its first header, read through to samples."""
    target = scratch_path(spark, "damaged")
    tar.write_tar(tar_members(spark, sf_dir), target)
    last = tar_samples.shard_paths(target)[-1][0]
    files.put_file(last, files.read_file(last)[:300])
    got = samples.assemble_members(tar.read_tar(spark, target))
    state = F.when(F.col("error").isNull(), "whole").otherwise("reported")
    return got.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "require_shards",
    with_sql("manifest", more=TARS)
    + f"""select {tar_name_sql('k')} as name from (select unnest(range(n, n + 3)) as k
  from (select max(shard) + 1 as n from tars))""",
)
def require_shards(spark, sf_dir):
    """The real listing of a tar folder lacks the last three of the shards asked for; the error carries them."""
    listing = files.scan(spark, tar_folder(spark, sf_dir), [".tar"])
    n = listing.count() + 3
    expected = spark.range(n).select(C.shard_name("id", "shard_").alias("name"))
    try:
        return samples.require_inputs(expected, listing)
    except samples.MissingInputs as e:
        return e.missing


# --- column shards ---------------------------------------------------------------------


def column_folder(spark: SparkSession, sf_dir: str) -> str:
    """Visible documents with their class number, in compressed shards of limited bytes."""

    return V._made_once(spark, sf_dir, "columns", lambda root: write_column_folder(spark, sf_dir, root))


def write_column_folder(spark: SparkSession, sf_dir: str, root: str) -> None:
    labelled = samples.label_int(V.manifest(spark, sf_dir))
    placed = loading.byte_shards(labelled, ["doc_id", "label"], SHARD_BYTES, SEED)
    rows = loading.with_payload(placed.drop("length"), V.payloads(spark, sf_dir), ["doc_id"])
    columnar.write_column_shards(rows.withColumnRenamed("payload", "image"), root)


LABELLED = """labelled as (select *, dense_rank() over (order by class) - 1 as label from manifest where class not like '.%')"""
KEY = key_sql(SEED, 0, "doc_id", "label")
PACKED = LABELLED + ",\n" + packed_sql(
    f"select doc_id, label, length, body, row_number() over (order by {KEY}, doc_id, label) - 1 as i from labelled", SHARD_BYTES
)


@query(
    "write_columns",
    with_sql("manifest", more=PACKED)
    + """select shard, count(*) as n_images, cast(sum(length) as bigint) as image_bytes, cast(min(label) as bigint) as lowest,
  cast(max(label) as bigint) as highest from packed group by shard""",
)
def write_columns(spark, sf_dir):
    """Write labelled column shards, and read them back."""
    target = scratch_path(spark, "write-columns")
    write_column_folder(spark, sf_dir, target)
    got = columnar.read_column_shards(spark, target)
    return got.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.sum(F.octet_length("image")).alias("image_bytes"),
        F.min("label").cast("bigint").alias("lowest"),
        F.max("label").cast("bigint").alias("highest"),
    )


def _reader_sql() -> str:
    """Shards in seeded order, then blocks of 32 samples shuffled."""
    key, shard = key_sql(9, 0, "shard", "pos"), key_sql(9, 0, "shard")
    return f"""select shard, pos, cast(label as bigint) as label, md5(body) as digest,
  i // 32 * 32 + row_number() over (partition by i // 32 order by {key}, shard, pos) - 1 as i
from (select * exclude (i), row_number() over (order by {shard}, shard, pos) - 1 as i
  from (select *, row_number() over (partition by shard order by k) - 1 as pos from packed))"""


@query("read_column_shards", with_sql("manifest", more=PACKED) + _reader_sql())
def read_column_shards(spark, sf_dir):
    """Column shards in shuffled order; the image column joins the order last."""
    rows = columnar.read_column_shards(spark, column_folder(spark, sf_dir))
    order = ordering.shuffle_dataset(rows.select("shard", "pos"), ["shard", "pos"], 32, seed=9)
    got = loading.with_payload(order, rows, ["shard", "pos"])
    return got.select("shard", "pos", F.col("label").cast("bigint").alias("label"), F.md5("image").alias("digest"), "i")


# --- report files --------------------------------------------------------------------------


def _loader_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("loader", reports.loader_of("file"))


def _odd_names(runs: DataFrame) -> DataFrame:
    """Loaders with blanks and signs in their names."""
    return runs.withColumn("loader", F.concat(F.lit("The "), "loader", F.lit(": a+b 100%")))


ODD_NAMES = "odd as (select * replace ('The ' || loader || ': a+b 100%' as loader) from runs)"


@query(
    "scan_metrics",
    with_sql("runs", more=ODD_NAMES)
    + f"""select loader, cast(run_id as varchar) as run_id, {rounded_sql(*M)} from odd
union all select loader, 'statistic', {', '.join(['null'] * len(M))} from odd group by loader
union all select loader, 'mean', {', '.join(f'round(avg({m}), 6)' for m in M)} from odd group by loader
union all select loader, 'std', {', '.join(f'round(stddev_pop({m}), 6)' for m in M)} from odd group by loader""",
)
def scan_metrics(spark, sf_dir):
    """Run reports written as text, with commas or with tabs, and read back."""
    runs = _odd_names(telemetry.run_records(V.telemetry(spark, sf_dir)))
    target = scratch_path(spark, "reports")
    for k, delimiter in enumerate((",", "\t")):
        some = runs.where(F.length("loader") % 2 == k)
        reports.write_reports(some, telemetry.run_statistics(some), f"{target}/part{k}", delimiter=delimiter)
    rows = _loader_of(reports.read_reports(spark, target))
    return rounded(reports.metric_columns(rows, ["loader", "run_id"]), *M)


def section_files(runs: DataFrame, target: str) -> None:
    """One file per loader with a titled block for even and one for odd runs."""
    blocks = []
    for half, word in enumerate(("even", "odd")):
        some = runs.where(F.col("run_id") % 2 == half)
        text = reports.report_lines(some, telemetry.run_statistics(some))
        title = text.where("section = 0").withColumns({"section": F.lit(-1), "line": F.lit(f",,,{word} runs,,,")})
        blocks.append(samples.union_sources(title, text).withColumn("half", F.lit(half)))
    (
        samples.union_sources(*blocks)
        .repartition("loader")
        .sortWithinPartitions("loader", "half", "section", "run_id")
        .select("loader", "line")
        .write.partitionBy("loader")
        .text(target)
    )


@query(
    "scan_metric_sections",
    with_sql(
        "runs",
        more="""halves as (select *, run_id % 2 + 1 as block,
  case run_id % 2 when 0 then 'even' else 'odd' end || ' runs' as title from runs)""",
    )
    + f"""select loader, block, title, 'run' as kind, cast(run_id as varchar) as name, {rounded_sql(*M)} from halves
union all select loader, block, title, 'statistic', 'mean', {', '.join(f'round(avg({m}), 6)' for m in M)} from halves group by 1, 2, 3
union all select loader, block, title, 'statistic', 'std', {', '.join(f'round(stddev_pop({m}), 6)' for m in M)} from halves group by 1, 2, 3""",
)
def scan_metric_sections(spark, sf_dir):
    target = scratch_path(spark, "sections")
    section_files(telemetry.run_records(V.telemetry(spark, sf_dir)), target)
    rows = _loader_of(reports.read_sections(spark, target))
    return rounded(reports.metric_columns(rows, ["loader", "block", "title", "kind", "name"]), *M)


# --- streams ---------------------------------------------------------------------------------


#: What Spark's file stream takes in: it leaves out hidden names and files without bytes.
STREAMED = "class not like '.%' and name not like '.%' and length > 0"
FILES_PER_TRIGGER = 200


def _two_halves(spark: SparkSession, sf_dir: str, run, sized: bool = False) -> None:
    """Half of the files arrive, a stream takes them in and stops; the rest arrives and it goes on.

    With ``sized`` a micro-batch grows with the files that arrive.
    """
    root = scratch_path(spark, "arriving")
    rows = V.full_samples(spark, sf_dir)
    at = F.concat(F.lit(root), F.substr("path", F.lit(len(V.BUCKET) + 1)))
    for half in (0, 1):
        some = rows.where(F.col("doc_id") % 2 == half)
        V.run_writes(files.write_files(some.select(at.alias("path"), "payload"), content="payload"))
        per_trigger = streams.files_a_trigger(some.count(), FILES_PER_TRIGGER) if sized else FILES_PER_TRIGGER
        run(streams.file_stream(spark, root, per_trigger))


@query("stream_ingest", with_sql("manifest") + f"select class, name, length from manifest where {STREAMED}")
def stream_ingest(spark, sf_dir):
    """Files taken in by a stream into a Parquet manifest, over several micro-batches and a restart."""
    target, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")
    _two_halves(spark, sf_dir, lambda stream: streams.ingest(stream, target, checkpoint), sized=True)
    return spark.read.parquet(target).select("class", "name", "length")


@query(
    "stream_callback",
    with_sql("manifest") + f"""select count(*) as n_images, cast(sum(length) as bigint) as bytes,
  cast((count(*) filter (doc_id % 2 = 0) + {FILES_PER_TRIGGER - 1}) // {FILES_PER_TRIGGER}
    + (count(*) filter (doc_id % 2 = 1) + {FILES_PER_TRIGGER - 1}) // {FILES_PER_TRIGGER} as bigint) as n_batches from manifest where {STREAMED}""",
)
def stream_callback(spark, sf_dir):
    """Measures of each micro-batch, summed up over a restart."""
    target, checkpoint = scratch_path(spark, "measured"), scratch_path(spark, "measure-state")
    _two_halves(spark, sf_dir, lambda stream: streams.with_callback(stream, streams.batch_measure, target, checkpoint))
    return spark.read.parquet(target).agg(
        F.sum("n_images").alias("n_images"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_batches")
    )


@query("stream_run_record", with_sql("runs") + RUN_SQL)
def stream_run_record(spark, sf_dir):
    """Run records from a stream of telemetry that arrives in eight files, with a restart between; equal to those of a batch."""
    target, checkpoint, root = scratch_path(spark, "records"), scratch_path(spark, "record-state"), scratch_path(spark, "events")
    events = V.table(spark, sf_dir, "events")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).repartition(4).write.mode("append").parquet(root)
        arriving = streams.table_stream(spark, root, events.schema, files_per_trigger=1)
        streams.running_records(V.as_telemetry(arriving), target, checkpoint)
        streams.compact_records(spark, target)
    return rounded(streams.latest_records(spark, target), *RUN_NUMBERS)


# Batches of the first ten days that arrive when their runs have closed.
HELD_BACK = "event_id % 20 = 7 and run_id <= 10"
IN_TIME = SQL["runs"].replace("from telemetry", f"from telemetry where not ({HELD_BACK})")
LATE = f"""late as (select loader, run_id, count(*) as late_batches, cast(sum(n_images) as bigint) as late_images
  from telemetry where {HELD_BACK} group by loader, run_id)"""


@query(
    "stream_closed_runs",
    with_sql("telemetry", more=f"{IN_TIME},\nin_time as ({RUN_SQL}),\n{LATE}")
    + f"""select loader, run_id, total_images, {", ".join(RUN_NUMBERS)}, late_batches, late_images, cast(0 as bigint) as open_rows
from in_time full join late using (loader, run_id)""",
)
def stream_closed_runs(spark, sf_dir):
    """Records of runs that have closed, and what came too late for them, from a stream that is started three times.

    A heartbeat at the end closes the last runs; ``open_rows`` counts the state that is left.
    """
    target, checkpoint, root = scratch_path(spark, "closed"), scratch_path(spark, "closed-state"), scratch_path(spark, "telemetry")
    tel = V.telemetry(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    heartbeat = spark.range(1).select(F.lit("2024-12-31").cast("timestamp").alias("ts"))
    turns = (
        tel.where(f"run_id <= 15 and not ({HELD_BACK})"),
        tel.where(f"run_id > 15 and not ({HELD_BACK})"),
        tel.where(HELD_BACK).unionByName(heartbeat, allowMissingColumns=True),
    )
    for arrived in turns:
        arrived.write.mode("append").parquet(root)
        stream = streams.table_stream(spark, root, tel.schema)
        left = closing.closed_runs(stream, target, checkpoint, delay="1 hour", silence_seconds=86_400, slot_seconds=3600)
    late = closing.late_slots(spark, target).groupBy(*telemetry.RUN)
    late = late.agg(F.sum("n_batches").alias("late_batches"), F.sum("n_images").alias("late_images"))
    records = rounded(closing.run_results(spark, target), *RUN_NUMBERS)
    return records.join(late, list(telemetry.RUN), "full").withColumn("open_rows", F.lit(left).cast("bigint"))


@query(
    "stream_pass",
    with_sql("manifest")
    + f"""select cast(0 as bigint) as epoch, i, doc_id, length, cast(1 as bigint) as times from ({order_sql("manifest", "doc_id", SEED, 0)})
union all select cast(1 as bigint), i, doc_id, length, cast(1 as bigint) from ({order_sql("manifest", "doc_id", SEED, 1)})""",
)
def stream_pass(spark, sf_dir):
    """Two epochs of all files, hidden and empty ones too; the stream is stopped inside the first and started again."""
    root, target, state = (scratch_path(spark, n) for n in ("pass", "passed", "pass-state"))
    listing = V.manifest(spark, sf_dir).select("doc_id", "length")
    passes.prepare(listing, ["doc_id"], root, seed=SEED, epochs=2, piece_rows=2000)
    rows = listing.count()
    for until in (rows * 2 // 3, None):
        stream = passes.pass_stream(spark, root, state, batch_rows=max(1, rows // 2), until=until)
        passes.run_pass(stream, target, state)
    return spark.read.parquet(target).groupBy("epoch", "i", "doc_id", "length").agg(F.count(F.lit(1)).alias("times"))
