"""Exact top-k search by inner product, over vectors sorted by length.

Vectors are rotated by the singular vectors of the whole table, so that the
first components hold most of every product.  Queries stand in blocks; every
shard of the vectors passes by a block in the order of falling length.  A
product is bounded by the partial sum over the first components plus the
product of what is left of both lengths (Cauchy-Schwarz); pairs whose bound is
below a query's k-th score so far are not computed, and once no vector to come
can reach any query's, the shard is done.  The best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardflow.scratch import materialise

CHUNK = 512  # vectors held against a block of queries at a time


def whole_vectors(table: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """``(id, v, dim, norm)``: vectors as whole numbers; those null, empty or with a null or non-finite component go.

    Repeated rows, equal in id and vector, count once.
    """
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    rows = table.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", finite))
    rows = rows.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v")).distinct()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    return rows.select("id", "v", F.size("v").alias("dim"), length.alias("norm"))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For every dimension the singular vectors of the table, strongest first.

    Tasks add up products of components; the driver gets one matrix of
    dimension squared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, m in matrices(batch):
                sums[dim] = sums.get(dim, 0) + m[1].T @ m[1]
        yield pa.RecordBatch.from_pydict(
            {"dim": list(sums), "gram": [g.ravel().tolist() for g in sums.values()]}, pa.schema([("dim", pa.int32()), ("gram", pa.list_(pa.float64()))])
        )

    parts = vectors.select("id", "v", "dim").mapInArrow(run, "dim int, gram array<double>")
    cells = parts.select("dim", F.posexplode("gram").alias("at", "value")).groupBy("dim", "at").agg(F.sum("value").alias("value"))
    grams: dict[int, np.ndarray] = {}
    for r in cells.collect():
        grams.setdefault(r.dim, np.zeros(r.dim * r.dim))[r.at] = r.value
    out = {}
    for dim, gram in grams.items():
        gram = np.nan_to_num(gram.reshape(dim, dim), posinf=np.finfo(float).max / dim, neginf=-np.finfo(float).max / dim)
        _, axes = np.linalg.eigh(gram / max(1.0, np.abs(gram).max()))
        out[dim] = axes[:, ::-1]
    return out


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each dimension in a batch: ids, vectors, places of the rows."""
    dim = batch.column("dim").to_numpy()
    lists = batch.column("v")
    flat, offsets = lists.values.to_numpy(), np.asarray(lists.offsets).astype(np.int64)
    for d in np.unique(dim):
        at = np.flatnonzero(dim == d)
        yield int(d), (batch.column("id").to_numpy()[at], flat[offsets[at][:, None] + np.arange(d)], at)


class Block:
    """Queries of one dimension and their best products so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, k: int):
        self.ids, self.vectors, self.axes, self.k = ids, vectors, axes, k
        turned = vectors @ axes
        self.head = max(1, len(axes) // 4)
        self.turned = turned[:, : self.head]
        self.rest = np.sqrt((turned[:, self.head :] ** 2).sum(axis=1))
        self.length = np.sqrt((vectors**2).sum(axis=1))
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), -1, np.int64)

    def done(self, length: float) -> bool:
        """No vector of this length or less can reach a k-th score."""
        return bool((self.length * length * (1 + 1e-9) + 1e-6 < self.scores[:, -1]).all())

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        turned = vectors @ self.axes
        rest = np.sqrt((turned[:, self.head :] ** 2).sum(axis=1))
        length = np.sqrt((vectors**2).sum(axis=1))
        bound = self.turned @ turned[:, : self.head].T + np.outer(self.rest, rest)
        slack = np.outer(self.length, length) * 1e-9 + 1e-6
        q, c = np.nonzero((bound + slack >= self.scores[:, -1:]) & (self.ids[:, None] != ids))
        if not len(q):
            return
        if len(q) * 4 > bound.size:
            score = (self.vectors @ vectors.T)[q, c]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", self.vectors[q[a : a + 65536]], vectors[c[a : a + 65536]]) for a in range(0, len(q), 65536)])
        own = np.repeat(np.arange(len(self.ids)), self.k)
        held = self.found.ravel() >= 0
        held |= np.isfinite(self.scores.ravel())
        q = np.concatenate([q, own[held]])
        score = np.concatenate([score, self.scores.ravel()[held]])
        found = np.concatenate([ids[c], self.found.ravel()[held]])
        order = np.lexsort((found, -score, q))
        q, score, found = q[order], score[order], found[order]
        begin = np.searchsorted(q, q)
        rank = np.arange(len(q)) - begin
        top = rank < self.k
        self.scores[:], self.found[:] = -np.inf, -1
        self.scores[q[top], rank[top]] = score[top]
        self.found[q[top], rank[top]] = found[top]


def top_products(
    table: DataFrame,
    query: Callable[[Column], Column],
    id: str = "vec_id",
    vector: str = "embedding",
    *,
    k: int = 5,
    scale: int = 256,
    block: int = 4096,
    shards: int = 16,
) -> DataFrame:
    """``(query_id, rank, <id>, score)``: for every vector whose id
    meets the condition ``query``, the ``k`` others with the largest inner product.

    Components are ``floor(scale * x)``; scores are whole numbers, exact while
    a vector's squared length stays below 2**53.  Ties go to the smaller id,
    and a query with fewer than ``k`` others lists all.  Vectors are compared
    with those of their own dimension.  Vectors that are null, empty, or hold a
    null or non-finite component take no part, nor do rows without id.
    A vector is no answer to a query with its id.  Repeated rows count once.
    Other columns are not looked at.
    """
    vectors = materialise(whole_vectors(table, id, vector, scale), "vectors")
    axes = rotations(vectors)
    wanted = vectors.where(query(F.col("id")))
    blocks = max(1, -(-wanted.count() // block))
    kind = [F.col(c) for c in ("id", "v", "dim", "norm")]
    asked = wanted.select(F.pmod(F.xxhash64("id"), F.lit(blocks).cast("bigint")).alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.lit(0).alias("turn"), *kind)
    passing = vectors.select(F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards).cast("bigint")).alias("shard"), F.lit(1).alias("turn"), *kind)
    meet = asked.unionByName(passing).repartition("block", "shard").sortWithinPartitions("block", "shard", "dim", "turn", F.col("norm").desc(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gathered, current = None, [], None

        def answers() -> Iterator[pa.RecordBatch]:
            if current is None:
                return
            q, r = np.nonzero(np.isfinite(current.scores))
            yield pa.RecordBatch.from_arrays(
                [pa.array(current.ids[q]), pa.array(current.found[q, r]), pa.array(np.clip(current.scores[q, r], -(2.0**63), 2.0**63 - 1024).astype(np.int64))],
                ["query_id", "found", "score"],
            )

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "shard", "dim", "turn")], axis=1)
            cuts = np.concatenate([[0], 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)), [len(keys)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                group, turn = tuple(keys[lo, :3]), keys[lo, 3]
                if group != key:
                    yield from answers()
                    key, gathered, current = group, [], None
                dim, (ids, values, _) = next(matrices(batch.slice(lo, hi - lo)))
                if turn == 0:
                    gathered.append((ids, values))
                    continue
                if current is None:
                    if not gathered:
                        continue  # no query of this dimension in the block
                    current = Block(np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered]), axes[dim], k)
                for at in range(0, len(ids), CHUNK):
                    part = values[at : at + CHUNK]
                    if current.done(float(np.sqrt((part[0] ** 2).sum()))):
                        break
                    current.take(ids[at : at + CHUNK], part)
        yield from answers()

    found = meet.mapInArrow(run, "query_id long, found long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(id), "score")
