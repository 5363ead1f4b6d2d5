"""User functions over samples, with a choice of what happens on errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def map_samples(
    df: DataFrame,
    fn: Callable[..., pd.DataFrame],
    schema: T.StructType | str,
    *,
    mode: str = "FAILFAST",
    setup: Callable[[], object] | None = None,
    chunk: int = 1024,
) -> DataFrame:
    """Map ``fn`` over samples, ``chunk`` rows at a time as a pandas frame.

    ``fn`` must treat rows one by one (its result for a row must not depend on
    the others) and return one row per input row.  ``setup`` runs once per
    task; its result is the second argument of ``fn``.

    ``FAILFAST`` lets an error end the job.  The other modes halve a failing
    chunk until the bad rows stand alone: ``PERMISSIVE`` keeps them with nulls
    and the message in ``error``, ``DROPMALFORMED`` leaves them out.  A ``fn``
    that can tell bad rows without raising returns an ``error`` column of its
    own, which saves the halving where bad rows are many.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = schema.fieldNames()
    full = schema if mode == "FAILFAST" else T.StructType([*schema.fields, T.StructField("error", T.StringType())])

    def isolate(rows: pd.DataFrame, call) -> list[pd.DataFrame]:
        try:
            out = call(rows)
            return [out[[*names, "error"]] if "error" in out else out[names].assign(error=None)]
        except Exception as e:  # any failure of the user's function belongs to a row
            if len(rows) == 1:
                return [pd.DataFrame([[None] * len(names) + [f"{type(e).__name__}: {e}"]], columns=[*names, "error"], dtype=object)]
        half = len(rows) // 2
        first, rest = rows.iloc[:half], rows.iloc[half:].reset_index(drop=True)
        return isolate(first, call) + isolate(rest, call)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        call = (lambda rows: fn(rows, state)) if setup else fn
        for frame in frames:
            for at in range(0, len(frame), chunk):
                rows = frame.iloc[at : at + chunk].reset_index(drop=True)
                if mode == "FAILFAST":
                    out = call(rows)
                    if "error" in out and out["error"].notna().any():
                        raise ValueError(out["error"].dropna().iloc[0])
                    yield out[names]
                    continue
                parts = isolate(rows, call)
                # Objects keep whole numbers whole next to nulls.
                out = parts[0] if len(parts) == 1 else pd.concat([p.astype(object) for p in parts], ignore_index=True)
                yield out if mode == "PERMISSIVE" else out[out["error"].isna()]

    mapped = df.mapInPandas(run, full)
    return mapped.drop("error") if mode == "DROPMALFORMED" else mapped


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows and the bad rows of a ``PERMISSIVE`` map."""
    return df.where(F.col("error").isNull()).drop("error"), df.where(F.col("error").isNotNull())


def collate_with(
    df: DataFrame, by: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, pos: str = "batch_pos"
) -> DataFrame:
    """A custom collate function, called once per batch with its samples in order.

    One shuffle brings batches together and many of them pass through a task as
    a stream; only a batch cut by the end of a frame is held back.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            keys = frame[by].to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1)]
            done = [fn(frame.iloc[a:b].reset_index(drop=True)) for a, b in zip(edges, edges[1:])]
            held = frame.iloc[edges[-1] :]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None:
            yield fn(held.reset_index(drop=True))

    # A fixed number of partitions: small rows would be merged into few tasks, but the function is the work.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, by).sortWithinPartitions(by, pos).mapInPandas(run, schema)
