"""Ranked lexical search with K2-treaps over blocks of the term-document grid.

An index row is a block of documents: its distinct terms (rows of the grid, most
frequent first), its documents (columns, by size), and a point with a count for every
term of every document, in Z-order.  From the points a K2-treap is built: a
quadtree without empty cells, each level a bitmap of four children a cell and the
largest impact below it.

A search goes down the columns of a block: a range of documents is bounded by the
sum, over an item's terms, of weight times the largest impact of the cell that the
term's row shares with the range.  The ranges with the largest bounds are halved first;
all row paths of the item go down together.  Ranges below the score of the k-th
best document so far are never opened.

Terms are compared as bytes; nothing rests on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardflow.llm.words import pieces
from shardflow.scratch import materialise

#: Bytes inside a term: digits, letters, and all of letters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLOCK_BYTES = 2 << 20
#: Documents that travel to Python at a time.
BATCH_ROWS = 500
#: Ranges of documents that are halved at a time.
OPENED = 64
#: Distinct terms of the items that one task searches for at a time.
ITEM_TERMS = 100_000

INDEX = "docs array<long>, sizes array<long>, terms array<struct<term: string, df: long>>, points binary, counts binary"


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts in order, and how many each text has; null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets - lo] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    row = np.searchsorted(offsets - lo, start, side="right") - 1
    ends = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[data[inside[1:-1]]]))
    return words.dictionary_encode(), np.bincount(row, minlength=len(texts)).astype(np.int64)


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of a number below 2**31 with a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def block_of(ids: list, texts: pa.Array) -> dict:
    """The index row of a list of documents."""
    coded, sizes = terms_of(texts)
    order = np.argsort(sizes, kind="stable")  # columns
    column = np.empty(len(sizes), np.int64)
    column[order] = np.arange(len(sizes))
    vocabulary = len(coded.dictionary)
    at = np.repeat(column, sizes) * max(vocabulary, 1) + coded.indices.to_numpy().astype(np.int64)
    key, tf = np.unique(at, return_counts=True)
    term, doc = key % max(vocabulary, 1), key // max(vocabulary, 1)
    df = np.bincount(term, minlength=vocabulary)
    ranked = np.argsort(-df, kind="stable")
    row = np.empty(vocabulary, np.int64)
    row[ranked] = np.arange(vocabulary)
    points = (spread(row[term]) << np.uint64(1)) | spread(doc)
    order_z = np.argsort(points, kind="stable")
    names = coded.dictionary.take(pa.array(ranked)).cast(pa.string())
    return {
        "docs": [ids[k] for k in order.tolist()],
        "sizes": sizes[order],
        "terms": pa.StructArray.from_arrays([names, pa.array(df[ranked].astype(np.int64))], ["term", "df"]),
        "points": points[order_z].tobytes(),
        "counts": tf[order_z].astype(np.uint32).tobytes(),
    }


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for a block of documents (about ``BLOCK_BYTES`` of text, one document at least).

    Whole texts; rows with a null id or a repeated id are documents of their
    own, a null text has no terms.  Write the result down (``write_index``)
    before searching it.
    """
    schema = pa.schema(
        [
            ("docs", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int64())),
            ("terms", pa.list_(pa.struct([("term", pa.string()), ("df", pa.int64())]))),
            ("points", pa.binary()),
            ("counts", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            made = block_of(table.column("id").to_pylist(), table.column("text").combine_chunks())
            listed = pa.ListArray.from_arrays(pa.array([0, len(made["terms"])], pa.int32()), made["terms"])
            rest = [pa.array([made[n]], schema.field(n).type) for n in ("docs", "sizes")]
            return pa.RecordBatch.from_arrays([*rest, listed.cast(schema.field("terms").type), pa.array([made["points"]]), pa.array([made["counts"]])], schema=schema)

        for batch in batches:
            for piece in pieces(batch, "text", BLOCK_BYTES):
                n = pc.sum(pc.fill_null(pc.binary_length(piece.column("text")), 0)).as_py() or 0
                if held and size + n > BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
                held.append(piece)
                size += n
        if held:
            yield block()

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, INDEX)


def write_index(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``build_index``, written down; texts travel ``BATCH_ROWS`` at a time."""
    return materialise(build_index(docs, id, text), "lexical-index", batch_rows=BATCH_ROWS)


class Treap:
    """A K2-treap over points in Z-order (row bit above column bit at every level).

    The cells of all levels stand in one list, the points first; ``bits`` says
    which quarters of a cell are not empty and ``first`` where their cells begin.
    """

    def __init__(self, points: np.ndarray, value: np.ndarray, columns: int):
        self.depth = max(0, int(columns - 1).bit_length())
        bits, first, most = [np.zeros(len(points), np.uint8)], [np.zeros(len(points), np.int32)], [value]
        cells, base = points, 0
        for _ in range(self.depth):
            parent = cells >> np.uint64(2)
            starts = np.flatnonzero(np.diff(parent, prepend=~parent[:1]))
            child = np.left_shift(1, (cells & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
            bits.append(np.bitwise_or.reduceat(child, starts))
            first.append((starts + base).astype(np.int32))
            most.append(np.maximum.reduceat(most[-1], starts))
            base, cells = base + len(cells), parent[starts]
        self.top, self.base = cells, base
        # An empty cell at the end stands for every missing one.
        self.bits, self.first, self.most = (np.append(np.concatenate(x), x[0].dtype.type(0)) for x in (bits, first, most))
        self.none = len(self.most) - 1

    def roots(self, rows: np.ndarray) -> np.ndarray:
        """The top cell of each row."""
        cell = spread(rows >> self.depth) << np.uint64(1)
        at = np.searchsorted(self.top, cell)
        here = at < len(self.top)
        here[here] = self.top[at[here]] == cell[here]
        return np.where(here, at + self.base, self.none)

    def down(self, cell: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """The child of a cell in one of its quarters."""
        bits = self.bits[cell]
        return np.where(bits >> quarter & 1, self.first[cell] + BELOW[bits, quarter], self.none)


#: How many of the quarters before one are not empty.
BELOW = np.array([[bin(bits & ((1 << quarter) - 1)).count("1") for quarter in range(4)] for bits in range(16)], np.int32)


@dataclass
class Best:
    """The ``k`` best documents so far: largest score first, then smallest id, null before all."""

    k: int
    found: list

    def floor(self) -> int:
        return self.found[-1][0] if len(self.found) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = [*self.found, *zip(scores.tolist(), ids)]
        rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
        self.found = rows[: self.k]


def descend(treap: Treap, docs: list, rows: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Open the ranges of a block best first, until none can change ``best``."""
    if not len(rows):
        return
    # A waiting range: its bound, level and first column, and a cell for every term.
    cells = treap.roots(rows)[None, :]
    bound, level, start = treap.most[cells] @ weight, np.array([treap.depth]), np.array([0])
    while len(bound):
        stay = bound >= best.floor()
        done = stay & (level == 0)
        if done.any():
            best.add(bound[done], [docs[k] for k in start[done].tolist()])
            stay &= level > 0
        if not stay.all():
            bound, level, start, cells = bound[stay], level[stay], start[stay], cells[stay]
            continue
        order = np.argsort(-bound, kind="stable")
        take, rest = order[:OPENED], order[OPENED:]
        depth = level[take] - 1
        quarter = (rows[None, :] >> depth[:, None] & 1) << 1
        low = treap.down(cells[take], quarter)
        high = treap.down(cells[take], quarter | 1)
        below = np.concatenate([low, high])
        bound = np.concatenate([treap.most[below] @ weight, bound[rest]])
        level = np.concatenate([depth, depth, level[rest]])
        start = np.concatenate([start[take], start[take] + (1 << depth), start[rest]])
        cells = np.concatenate([below, cells[rest]])


def item_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, item_id, term, times``: the distinct terms of each item and how often it has them.

    Rows with one id and one text are one item; null ids are ids like any other.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), letters, letters.lower())
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    item = F.struct(F.col(id).cast("long").alias("item_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text"))
    rows = items.select(item.alias("item"), found.alias("terms")).dropDuplicates(["item"])
    return rows.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def term_weight(documents: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * documents + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def search(index: DataFrame, items: DataFrame, k: int = 20, id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of a written index for every item: ``item_id, rank, doc_id, score``.

    Items go in blocks of about ``ITEM_TERMS`` terms; every block of items meets every block of
    documents once, one at a time.  A task keeps the best of the blocks it has seen, so later
    ones are opened less, and tells only those.  Documents with score 0 are left
    out, equal scores go by ascending id (null first).  Items without terms, and
    an empty index, give no rows.
    """
    spark = index.sparkSession
    totals = index.select(
        F.sum(F.size(F.filter("sizes", lambda n: n > 0))).cast("long").alias("n"),
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l"),
    ).first()
    documents, length = totals["n"] or 0, totals["l"] or 0
    asked = materialise(item_terms(items, id, text), "item-terms")
    blocks = max(1, -(-asked.count() // ITEM_TERMS))
    held = index.select(F.explode("terms").alias("t")).select("t.term", "t.df")
    # Both sides are cut down before the sums travel.
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = asked.join(df, "term").withColumn("weight", F.col("times") * term_weight(F.lit(documents), F.col("df")))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    packed = materialise(
        weighed.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")).groupBy(block).agg(F.collect_list(F.struct("item", "terms", "weights")).alias("items")),
        "items",
    )
    rows = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block").select("block", "docs", "sizes", "terms.term", "points", "counts", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_for: dict[int, tuple] = {}
        for batch in batches:
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                number = one.column("block")[0].as_py()
                if number not in asked_for:
                    listed = one.column("items").flatten()
                    names = listed.field("terms").flatten()
                    cut = np.concatenate([[0], np.cumsum(pc.list_value_length(listed.field("terms")).to_numpy())]).astype(np.int64)
                    # Copies: a slice would hold the whole batch, with its block, until the task ends.
                    names = names.take(pa.array(np.arange(len(names))))
                    asked_for[number] = (listed.field("item").to_pylist(), names, listed.field("weights").flatten().to_numpy().copy(), cut, [Best(k, []) for _ in range(len(listed))])
                items_here, names, weights, cut, best = asked_for[number]
                docs = one.column("docs")[0].as_py()
                sizes = one.column("sizes").flatten().to_numpy()
                points = np.frombuffer(one.column("points")[0].as_buffer(), np.uint64)
                tf = np.frombuffer(one.column("counts")[0].as_buffer(), np.uint32).astype(np.int64)
                if not len(points):
                    continue
                m = 75 + 25 * sizes * documents // length
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[gather(points)])
                treap = Treap(points, impact, len(docs))
                row = pc.fill_null(pc.index_in(names, value_set=one.column("term").flatten()), -1).to_numpy().astype(np.int64)
                for j in range(len(items_here)):
                    own = slice(int(cut[j]), int(cut[j + 1]))
                    known = row[own] >= 0
                    descend(treap, docs, row[own][known], weights[own][known], best[j])
        out = [(item["item_id"], item["text"], s, d) for items_here, *_, best in asked_for.values() for item, b in zip(items_here, best) for s, d in b.found]
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["item_id", "item_text", "score", "doc_id"])

    told = "item_id long, item_text string, score long, doc_id long"
    found = materialise(rows.mapInArrow(run, told), "found", batch_rows=1) if length else spark.createDataFrame([], told)
    place = Window.partitionBy("item_id", "item_text").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def gather(points: np.ndarray) -> np.ndarray:
    """The column of each point: every second bit."""
    x = points & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)
