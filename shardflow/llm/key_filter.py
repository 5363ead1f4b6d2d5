"""Joins of long rows with a table of keys, in which few of the rows have to travel.

A bitmap of hashed keys goes to every task.  Rows whose bit is not set have no
key in the table and stay where they are; only the others are shuffled to the exact
join, which decides.  The bitmap has at most ``MOST_BITS`` bits: with many more keys
than that more rows travel, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_BITS = 16  # bits for each key, of which one is set
MOST_BITS = 1 << 25


def marked(rows: DataFrame, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """``rows`` and a boolean ``mark``: false only where no row of ``keys`` has the same ``key``.

    ``keys`` is a written table.  Columns named ``bit``, ``word`` or ``held`` must not be in ``rows``.
    """
    bits = min(MOST_BITS, max(64, KEY_BITS * keys.count()))
    bit = F.pmod(F.xxhash64(key), F.lit(bits)).alias("bit")
    words = keys.select(bit).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("held"))
    placed = rows.select("*", bit).withColumn("word", F.expr("bit div 64"))
    known = F.expr("coalesce(shiftright(held, cast(bit % 64 as int)) & 1L, 0L) = 1L")
    return placed.join(F.broadcast(words), "word", "left").withColumn(mark, known).drop("bit", "word", "held")


def having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in the written table ``keys``; null is in none."""
    perhaps = marked(rows, keys, key, "perhaps").where("perhaps").drop("perhaps")
    return perhaps.join(keys, key, "left_semi")


def lacking(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not in the written table ``keys``, whatever their other columns; null is in none."""
    keys = keys.select(F.col(key).alias("key"))
    packed = rows.select(F.struct("*").alias("row"), F.col(key).cast(keys.schema["key"].dataType).alias("key"))
    packed = marked(packed, keys, "key", "perhaps")
    sure = packed.where("not perhaps").select("row")
    rest = packed.where("perhaps").join(keys, "key", "left_anti").select("row")
    return sure.unionByName(rest).select("row.*")
