"""Manifests, labels, tar members and the joins on them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardflow.functions import columns as C
from shardflow.operators.ordering import dense_index

# --- manifests ---------------------------------------------------------------


def with_path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``class, name, key, ext`` taken from the path."""
    name = C.file_name(path)
    return df.select(
        *[c for c in df.columns if c not in ("class", "name", "key", "ext")],
        C.folder_name(path).alias("class"),
        name.alias("name"),
        C.file_stem(path).alias("key"),
        C.file_ext(name).alias("ext"),
    )


def loadable(df: DataFrame, exts: Iterable[str], min_bytes: int = 1) -> DataFrame:
    """Visible samples in visible folders with a known extension and a payload."""
    return df.where(C.is_visible("class", "name") & C.has_ext("name", exts) & (F.col("length") >= min_bytes))


def direct_children(df: DataFrame, base: str, path: str = "path") -> DataFrame:
    """Files that lie in ``base`` itself."""
    base = base.rstrip("/")
    return df.where(F.startswith(F.col(path), F.lit(base + "/")) & (C.depth_below(path, base) == 1))


def under_prefix(df: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    return df.where(F.startswith(F.col(path), F.lit(prefix.rstrip("/") + "/")))


def present_inputs(expected: DataFrame, listing: DataFrame, name: str = "name") -> DataFrame:
    return expected.join(listing, name, "left_semi")


def missing_inputs(expected: DataFrame, listing: DataFrame, name: str = "name") -> DataFrame:
    return expected.join(listing, name, "left_anti")


class MissingInputs(FileNotFoundError):
    """Inputs are not there; ``missing`` is the table of all of them."""

    def __init__(self, message: str, missing: DataFrame) -> None:
        super().__init__(message)
        self.missing = missing


def require_inputs(expected: DataFrame, listing: DataFrame, name: str = "name") -> DataFrame:
    """``expected``, or a ``MissingInputs`` error that carries the table of inputs not in the listing."""
    gone = missing_inputs(expected, listing, name)
    first = gone.select(F.min(name)).first()[0]
    if first is not None:
        raise MissingInputs(f"inputs not found, the first of them: {first}", gone)
    return expected


def class_counts(df: DataFrame) -> DataFrame:
    """Samples and bytes per class, and in a last row (null class) of all."""
    return df.rollup("class").agg(
        F.count(F.lit(1)).alias("n_images"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )


def shard_summary(df: DataFrame, of: Column, shard: str = "shard") -> DataFrame:
    """Samples and bytes per shard, with its number from one and ``of`` how many shards."""
    per = df.groupBy(shard).agg(
        F.max(of).alias("of"), F.count(F.lit(1)).alias("n_images"), F.sum("length").cast("bigint").alias("bytes")
    )
    return per.withColumn("number", F.col(shard) + 1)


def size_ratio(original: DataFrame, stored: DataFrame, length: str = "length") -> DataFrame:
    """Bytes of two listings and ``stored / original``, 0 when there are none."""
    before = original.agg(F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("original_bytes"))
    after = stored.agg(F.coalesce(F.sum(length), F.lit(0)).cast("bigint")).scalar()
    out = before.select("original_bytes", after.alias("stored_bytes"))
    ratio = F.when(F.col("original_bytes") > 0, F.col("stored_bytes") / F.col("original_bytes")).otherwise(0.0)
    return out.select("*", ratio.alias("ratio"))


def reduced_fraction(part: int, whole: int) -> tuple[int, int]:
    """``part / whole`` in lowest terms; nothing of nothing is 0 / 1."""
    divisor = math.gcd(part, whole)
    return (part // divisor, whole // divisor) if whole else (0, 1)


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs; a column that an input lacks is null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


# --- labels --------------------------------------------------------------------


def class_labels(df: DataFrame) -> DataFrame:
    """``class, label``: visible classes in sorted order, numbered from zero.

    One row per class is ranked, not one per sample.
    """
    classes = df.where(C.is_visible("class")).select("class").distinct()
    rank = F.row_number().over(Window.orderBy("class")) - 1
    return classes.select("class", rank.cast("bigint").alias("label"))


def attach_label(df: DataFrame, labels: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Add label columns; samples without a label are kept by default."""
    return df.join(labels, on, how)


def label_int(df: DataFrame) -> DataFrame:
    return attach_label(df, class_labels(df), "class", "inner")


# The label of the first and of the second folder in sorted order.
BINARY_LABELS = ("fake", "real")


def label_binary(df: DataFrame, ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Label two folders ``fake`` and ``real`` in sorted order.

    ``label_id`` counts inside each class (``real00001``); ``label`` is what a
    shard stores.  More or fewer than two classes are an error.
    """
    two = class_labels(df)
    names = F.element_at(F.array(*[F.lit(v) for v in BINARY_LABELS]), (F.col("label") + 1).cast("int"))
    n = two.agg(F.count(F.lit(1))).scalar()
    checked = F.when(n != 2, F.raise_error(F.lit("a binary label needs exactly two classes"))).otherwise(names)
    named = attach_label(df, two.select("class", checked.alias("prefix")), "class", "inner")
    placed = dense_index(named, ids, seed=seed, within=["class"], index="in_class")
    label_id = F.concat("prefix", C.zero_pad(F.col("in_class") + 1, 5))
    return placed.withColumn("label_id", label_id).withColumn("label", binary_label("label_id")).drop("prefix")


def binary_label(label_id: Column | str) -> Column:
    """Reduce a label id to its class name by its beginning."""
    label_id = F.col(label_id) if isinstance(label_id, str) else label_id
    return F.when(F.startswith(label_id, F.lit("real")), "real").otherwise("fake")


# --- tar members -----------------------------------------------------------------


def project_member(members: DataFrame, ext: str) -> DataFrame:
    """The samples' payload of one kind; a filter, so nothing is assembled."""
    return members.where((F.col("ext") == ext) & F.col("payload").isNotNull())


def assemble_members(members: DataFrame, *, pos: str = "pos") -> DataFrame:
    """One row per ``(shard, key)`` with its members as a map from extension to payload.

    Payloads cross the network once.  Of repeated members of one extension the
    first is taken, and ``error`` names the extension.  A row that reports a
    damaged shard (``error``, without a key) comes through as a row without members.
    """
    damaged = F.col("error") if "error" in members.columns else F.lit(None).cast("string")
    rows = members.withColumn("error", damaged)
    whole = rows.where("key is not null and ext is not null").repartition("shard", "key")
    first = whole.groupBy("shard", "key", "ext").agg(F.min_by("payload", pos).alias("payload"), F.count(F.lit(1)).alias("n"))
    repeated = F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("ext"))))
    done = first.groupBy("shard", "key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "payload")))).alias("members"),
        F.when(F.size(repeated) > 0, F.concat(F.lit("repeated members: "), F.array_join(repeated, ", "))).alias("error"),
    )
    broken = rows.where("key is null or ext is null")
    nothing = F.lit(None).cast("map<string,binary>")
    return done.unionByName(broken.select("shard", "key", nothing.alias("members"), F.coalesce("error", F.lit("no name")).alias("error")))


def unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    """The samples without a label, as rows with an ``error``."""
    return df.where(F.col(label).isNull()).withColumn("error", F.lit("no label"))


def labelled_members(df: DataFrame, label: str = "label", payload: str = "payload") -> DataFrame:
    """Two tar members per sample: the image and its JSON label.  A sample without a label is an error that names it."""
    nameless = F.raise_error(F.concat(F.lit("no label: "), F.coalesce("key", F.lit("null"))))
    checked = F.when(F.col(label).isNull(), nameless).otherwise(F.col(label))
    pair = F.array(
        F.struct(F.substr(F.col("ext"), F.lit(2)).alias("ext"), F.col(payload).alias("payload")),
        F.struct(F.lit("json").alias("ext"), F.encode(C.label_json(checked), "utf-8").alias("payload")),
    )
    return df.select("shard", "pos", "key", F.inline(pair))


def zip_by_index(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pair the rows of two lists by their place ``i``."""
    return left.join(right, "i")
