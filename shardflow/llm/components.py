"""Connected components of a table of links, on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.scratch import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link: the smallest node it reaches.

    Every round hangs each node's larger neighbours, then its smaller ones, on
    the smallest node around (both halves together let chains shrink by a
    constant factor), until the links are stars around smallest nodes: no node
    hangs on two, or on one that hangs itself.  A hub's links are aggregated
    before they are shuffled; the join that hands its smallest neighbour back
    can be split.  The driver sees one count a round, never a link, and a round's
    table goes when the next one is written.
    """
    edges = materialise(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    while not _stars(edges):
        # Large step: every neighbour above a node is hung on the node's smallest neighbour or itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small step: the neighbours below a node, and the node, are hung on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = materialise(small, "links")
        discard(edges)
        edges = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node that hangs on another hangs on one only, which hangs on none."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    hung = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return twice.unionByName(hung).count() == 0
