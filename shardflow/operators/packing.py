"""Shards limited by bytes, as one writer fills them.

A block of samples is a function: from the sample with which a shard opens in it, to
the sample that opens the first shard behind it.  Functions of neighbouring blocks are
composed in levels, ``FAN`` at a time, and the starts that a single writer would have are
handed down again, level by level: a scan over a tree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardflow.functions.columns import idiv
from shardflow.operators.ordering import running_start
from shardflow.scratch import materialise


def next_openings(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For a shard opened at each sample, the sample that opens the next one.

    A sample that would pass the limit opens a new shard; one longer than the
    limit has a shard of its own.
    """
    ends = np.cumsum(lengths.astype(np.int64))
    return np.maximum(np.searchsorted(ends, ends - lengths + limit, side="right"), np.arange(1, len(lengths) + 1))


def greedy_shards(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Shard of each sample when the first one opens a shard."""
    to, shards = next_openings(lengths, limit), np.zeros(len(lengths), np.int64)
    at = 0
    while at < len(lengths):
        shards[at] = 1
        at = to[at]
    return np.cumsum(shards) - 1


ENTRIES = "_node long, entry long, leaves long, opened long, last long"
STARTS = "_node long, entry long, shards long, open long"
#: Neighbouring nodes that are composed at a time; their tables hold about as many rows as one block.
FAN = 16


def compose(rows: pd.DataFrame) -> pd.DataFrame:
    """The table of a parent from those of its children ``_node``: one row for each entry of the first child.

    Bytes are covered without a gap, so a shard that opens before a block never passes over all
    of its samples, unless it is the last one: entries of later children are
    reached through the first.
    """
    nodes = [part.sort_values("entry") for _, part in rows.sort_values("_node").groupby("_node")]
    out = nodes[0].reset_index(drop=True)
    for node in nodes[1:]:
        at = np.minimum(np.searchsorted(node["entry"], out["leaves"]), len(node) - 1)
        here = node.iloc[at].reset_index(drop=True)
        met = (here["entry"] == out["leaves"]).to_numpy()
        out["opened"] += np.where(met, here["opened"], 0)
        out["last"] = np.where(met, here["last"], out["last"])
        out["leaves"] = np.where(met, here["leaves"], out["leaves"])
    out["_node"] = rows["_parent"].iloc[0]
    return out[["_node", "entry", "leaves", "opened", "last"]]


def hand_down(rows: pd.DataFrame) -> pd.DataFrame:
    """Where each child really starts, from the start of the parent (``_entry, _shards, _open``)."""
    at, shards, opened = (int(rows[c].iloc[0]) for c in ("_entry", "_shards", "_open"))
    out = []
    for node, part in rows.sort_values("_node").groupby("_node"):
        out.append((node, at, shards, opened))
        met = part[part["entry"] == at]
        if len(met):
            at, shards, opened = int(met["leaves"].iloc[0]), shards + int(met["opened"].iloc[0]), int(met["last"].iloc[0])
    return pd.DataFrame(out, columns=["_node", "entry", "shards", "open"])


def block_starts(table: DataFrame) -> DataFrame:
    """For every block of ``table`` the sample and shard with which a single writer enters it: ``STARTS``.

    A level is a shuffle of the tables, each a sixteenth of the one before; there are
    as many levels as the logarithm of the blocks.
    """
    parent = idiv("_node", FAN)
    levels = [table]
    top = table.agg(F.max("_node")).first()[0] or 0
    while top >= FAN:
        up = levels[-1].withColumn("_parent", parent).groupBy("_parent").applyInPandas(compose, ENTRIES)
        levels.append(materialise(up, "composed"))
        top //= FAN
    zero = F.lit(0).cast("bigint")
    starts = None
    for level in reversed(levels):
        if starts is None:
            rows = level.select("*", zero.alias("_parent"), zero.alias("_entry"), zero.alias("_shards"), zero.alias("_open"))
        else:
            above = starts.select(F.col("_node").alias("_parent"), F.col("entry").alias("_entry"), F.col("shards").alias("_shards"), F.col("open").alias("_open"))
            rows = level.withColumn("_parent", parent).join(above, "_parent")
        starts = materialise(rows.groupBy("_parent").applyInPandas(hand_down, STARTS), "starts")
    return starts


def shards_by_bytes(df: DataFrame, limit: int, ids: Sequence[str], *, length: str = "length", span: int = 16) -> DataFrame:
    """Assign samples with a dense index ``i`` to shards of at most ``limit`` bytes.

    Gives ``ids, i, length, shard, pos``, the same as a single writer that goes
    through the samples in order.  Blocks of ``span`` limits are worked on side
    by side: for every sample in a block's first limit, which are those where the
    first shard of the block may open, a block tells where the shard after its
    last one opens and how many lie between.  ``block_starts`` composes these tables
    and gives the place where each block really starts; then blocks are filled side by side.
    No task holds more than two blocks.  The result does not depend on ``span``.  Only
    ids, index and length take part.
    """
    slim = running_start(df.select(*ids, "i", length), "i", length, start="_start")
    slim = materialise(slim.withColumn("_block", idiv("_start", span * limit)), "lengths")
    places = slim.select("_block", "i", "_start", F.col(length).cast("bigint").alias("n"))
    # The shard that is open at a block's end goes on into the next block's first limit.
    head = F.col("_start") - F.col("_block") * F.lit(span * limit) < limit
    tails = places.where(head & (F.col("_block") > 0)).withColumn("_block", F.col("_block") - 1)
    both = places.withColumn("own", F.lit(True)).unionByName(tails.withColumn("own", F.lit(False)))

    def entries(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", ignore_index=True)
        own = int(rows["own"].sum())
        if not own:
            return pd.DataFrame({"_node": [], "entry": [], "leaves": [], "opened": [], "last": []}, dtype="int64")
        to = next_openings(rows["n"].to_numpy(), limit)
        leaves, opened, last = np.zeros(own, np.int64), np.zeros(own, np.int64), np.zeros(own, np.int64)
        for k in range(own - 1, -1, -1):  # from the end, so what follows a shard is known
            after = to[k]
            if after < own:
                leaves[k], opened[k], last[k] = leaves[after], opened[after] + 1, last[after]
            else:
                leaves[k], opened[k], last[k] = after, 1, k
        first = int(rows["i"].iloc[0])
        start = rows["_start"].to_numpy()[:own]
        may = np.flatnonzero(start - rows["_block"].iloc[0] * span * limit < limit)
        may = np.union1d(may, [0])
        return pd.DataFrame(
            {"_node": rows["_block"].iloc[0], "entry": first + may, "leaves": first + leaves[may], "opened": opened[may], "last": first + last[may]}
        )

    starts = block_starts(materialise(both.groupBy("_block").applyInPandas(entries, ENTRIES), "entries"))
    named = starts.select(F.col("_node").alias("_of"), F.col("entry").alias("_entry"), F.col("shards").alias("_shards"), F.col("open").alias("_open"))
    placed = slim.join(named, F.col("_block") == F.col("_of"))
    local = T.StructType([*placed.schema.fields, T.StructField("shard", T.LongType()), T.StructField("pos", T.LongType())])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i", ignore_index=True)
        i, entry = rows["i"].to_numpy(), int(rows["_entry"].iloc[0])
        before = int(np.searchsorted(i, entry))
        shard = np.full(len(rows), rows["_shards"].iloc[0] - 1)
        pos = i - int(rows["_open"].iloc[0])
        if before < len(rows):
            own = greedy_shards(rows[length].to_numpy()[before:], limit)
            shard[before:] = own + int(rows["_shards"].iloc[0])
            pos[before:] = np.arange(len(own)) - np.searchsorted(own, own, side="left")
        return rows.assign(shard=shard, pos=pos)

    return placed.groupBy("_block").applyInPandas(fill, local).select(*ids, "i", length, "shard", "pos")
