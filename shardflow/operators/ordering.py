"""Dense indexes, seeded shuffles and samplers.

An order over all samples must never run through one task.  Two ways:

* ``dense_index`` orders by a hash of the sample id.  The hash spreads ids
  evenly over buckets, bucket sizes come from a map-side aggregate, and only
  the (bounded) bucket table is summed in one place.  The plan is lazy and the
  result depends on values alone, so a retried task gives the same index.  The
  input is read twice, the first time for the ids only; write an expensive
  input to a table first.
* ``sorted_index`` orders by any columns with a range shuffle.  Partition
  numbers are written down before they are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from shardflow.functions.columns import free_names, idiv
from shardflow.scratch import materialise


KEY_BITS = 60


def order_key(ids: Sequence[str], seed: int = 0, epoch: int | Column = 0) -> Column:
    """The seeded sort key; another epoch gives another permutation.

    The first ``KEY_BITS`` bits of an md5 as a number: it sorts faster and
    travels lighter than the text.  Ids break ties.
    """
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), *parts))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint")


#: Leading bits of the key that name a bucket; any number gives the same index.
BUCKET_BITS = 16


def _piece(piece: Column, within: Sequence[str]) -> Column:
    """One column that names a piece of a group, or of all rows.

    For groups it is a struct, which compares null group values as equal; a
    join and a window on it share one shuffle.
    """
    if not within:
        return piece
    return F.struct(*[F.col(c).alias(f"g{k}") for k, c in enumerate(within)], piece.alias("piece"))


def _groups(piece: str, within: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """Windows over the table of pieces: each group's whole, and up to a piece."""
    whole = Window.partitionBy(*[f"{piece}.g{k}" for k in range(len(within))])
    order = whole.orderBy(f"{piece}.piece" if within else piece)
    return whole, order.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def dense_index(
    df: DataFrame,
    ids: Sequence[str],
    *,
    seed: int = 0,
    epoch: int | Column = 0,
    within: Sequence[str] = (),
    first: int = 0,
    limit: int | None = None,
    index: str = "i",
    total: str | None = None,
) -> DataFrame:
    """Add a 0-based index without gaps, in seeded shuffled order.

    ``ids`` identify a row.  With ``within`` the index restarts per group; a
    group of any size is still spread over the hash buckets.  Rows from ``first``
    on and before ``limit`` are kept; the buckets outside are skipped.  ``total``
    names a column for the number of rows (of the group).
    """
    key, bucket, rows, start, end, all_rows = free_names(df, "_key", "_bucket", "_n", "_start", "_end", "_total")
    keyed = df.withColumn(key, order_key(ids, seed, epoch))
    keyed = keyed.withColumn(bucket, _piece(F.shiftright(key, KEY_BITS - BUCKET_BITS).cast("int"), within))
    sizes = keyed.groupBy(bucket).agg(F.count(F.lit(1)).alias(rows))
    whole, upto = _groups(bucket, within)
    offsets = sizes.select(
        bucket,
        (F.sum(rows).over(upto) - F.col(rows)).alias(start),
        F.sum(rows).over(upto).alias(end),
        F.sum(rows).over(whole).alias(all_rows),
    )
    # Without groups there are at most 2**BUCKET_BITS offsets, whatever the data.
    joined = keyed.join(offsets if within else F.broadcast(offsets), bucket)
    if limit is not None:
        joined = joined.where(F.col(start) < limit)
    if first:
        joined = joined.where(F.col(end) > first)
    place = Window.partitionBy(bucket).orderBy(key, *ids)
    out = joined.select(
        *df.columns,
        (F.col(start) + F.row_number().over(place) - 1).cast("bigint").alias(index),
        *([F.col(all_rows).alias(total)] if total else []),
    )
    out = out if limit is None else out.where(F.col(index) < limit)
    return out.where(F.col(index) >= first) if first else out


def sorted_index(df: DataFrame, *order: Column | str, index: str = "i", total: str | None = None) -> DataFrame:
    """Add a 0-based index without gaps, in the order of ``order``.

    One range shuffle and one written table.  End ``order`` with a column that
    makes rows differ, so that equal leading values (a folder with most of the
    files) can be cut anywhere.
    """
    at, part, start, all_rows = free_names(df, "_at", "_part", "_start", "_total")
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(at, F.monotonically_increasing_id())
    )
    table = materialise(placed, "sorted")
    # monotonically_increasing_id holds the partition above bit 33, the row below.
    mine = F.shiftright(at, 33)
    sizes = table.groupBy(mine.alias(part)).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(
        part,
        (F.sum("n").over(upto) - F.col("n")).alias(start),
        F.sum("n").over(whole).alias(all_rows),
    )
    # One row per shuffle partition.
    return table.join(F.broadcast(offsets), mine == F.col(part)).select(
        *df.columns,
        (F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(index),
        *([F.col(all_rows).alias(total)] if total else []),
    )


def running_start(
    df: DataFrame, order: str, value: str, *, within: Sequence[str] = (), span: int = 65_536, start: str = "start"
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the whole-number ``order``.

    Summed in two levels, so no task holds more than ``span`` order values or
    the list of spans.
    """
    of, part, base = free_names(df, "_span", "_sum", "_base")
    spans = df.withColumn(of, _piece(idiv(order, span), within))
    tops = spans.groupBy(of).agg(F.sum(value).alias(part))
    _, upto = _groups(of, within)
    tops = tops.select(of, (F.sum(part).over(upto) - F.col(part)).alias(base))
    inner = Window.partitionBy(of).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spans.join(tops, of).select(
        *df.columns, (F.col(base) + F.sum(value).over(inner) - F.col(value)).cast("bigint").alias(start)
    )


# --- shuffles ----------------------------------------------------------------


def shuffle_global(df: DataFrame, ids: Sequence[str], seed: int, epoch: int = 0) -> DataFrame:
    """Shuffle all samples; ``i`` is the new place."""
    return dense_index(df, ids, seed=seed, epoch=epoch)


def sample_permutation(
    df: DataFrame, ids: Sequence[str], seed: int, limit: int | None = None, epoch: int = 0
) -> DataFrame:
    """A seeded draw without replacement of ``limit`` (or all) samples."""
    return dense_index(df, ids, seed=seed, epoch=epoch, limit=limit)


def shuffle_shards(
    df: DataFrame, shard: str = "shard", pos: str = "pos", seed: int = 0, epoch: int = 0, index: str = "i"
) -> DataFrame:
    """Shuffle whole shards and keep the order inside each of them.

    A column ``shard_rank`` of ``df`` is replaced.
    """
    of, rows, start = free_names(df, "_shard", "_rows", "_start")
    shards = df.groupBy(F.col(shard).alias(of)).agg(F.count(F.lit(1)).alias(rows))
    # One row for a shard: ranked and summed in one step.
    place = Window.orderBy(order_key([of], seed, epoch), of)
    before = F.coalesce(F.sum(rows).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select(
        of, (F.row_number().over(place) - 1).cast("bigint").alias("shard_rank"), before.cast("bigint").alias(start)
    )
    kept = [c for c in df.columns if c != "shard_rank"]
    return df.select(*kept).join(starts, F.col(shard) == F.col(of)).select(
        *kept, "shard_rank", (F.col(start) + F.col(pos)).alias(index)
    )


def shuffle_local(
    df: DataFrame, ids: Sequence[str], buffer: int, seed: int = 0, epoch: int = 0, index: str = "i"
) -> DataFrame:
    """Shuffle inside blocks of ``buffer`` samples; 1 leaves the order alone.

    No sample moves by more than ``buffer - 1`` places.
    """
    if buffer <= 1:
        return df
    (block,) = free_names(df, "_block")
    place = Window.partitionBy(block).orderBy(order_key(ids, seed, epoch), *ids)
    moved = (F.col(block) * buffer + F.row_number().over(place) - 1).cast("bigint").alias(index)
    out = df.withColumn(block, idiv(index, buffer))
    return out.select(*[moved if c == index else c for c in df.columns])


def shuffle_dataset(
    df: DataFrame, ids: Sequence[str], buffer: int, seed: int = 0, epoch: int = 0, shard: str = "shard", pos: str = "pos"
) -> DataFrame:
    """Shards in random order, then samples inside a bounded buffer."""
    return shuffle_local(shuffle_shards(df, shard, pos, seed, epoch), ids, buffer, seed, epoch)


def path_segments(path: Column | str) -> Column:
    """Sort key that compares paths folder by folder, not letter by letter."""
    return F.split(F.col(path) if isinstance(path, str) else path, "/")


def sort_paths(df: DataFrame, path: str = "path", by: str = "segments") -> DataFrame:
    """Index samples in path order, by ``segments`` or by the whole ``string``."""
    if by not in ("segments", "string"):
        raise ValueError(f"unknown path order {by!r}")
    return sorted_index(df, path_segments(path) if by == "segments" else F.col(path))


def resume_from(df: DataFrame, ids: Sequence[str], seed: int, epoch: int, position: int) -> DataFrame:
    """The rest of a shuffled pass, from the saved ``(seed, epoch, position)``."""
    return dense_index(df, ids, seed=seed, epoch=epoch, first=position)
