"""N-gram Jaccard join with PartEnum signatures.

Two texts link when the Jaccard similarity of their sets of word n-grams
reaches ``num / den``.  Sets are put into bands of sizes such that linked sets
lie in the same band or in neighbouring ones.  For a band pair, linked sets
differ in at most ``k`` elements, so of the ``k + 1 + slack`` partitions of
the hashed element domain at least ``slack + 1`` hold the same elements in
both: the content of one partition is a signature.  An empty partition says
nothing and gives none; ``slack`` makes up for as many as a set of that size
usually has.  Sets with more empty partitions than the slack also enumerate, in
each of ``k // 3 + 1`` wider partitions, the subsets of three out of five
subpartitions (two of which linked sets may disagree on), so two such sets
always share one of those.  No link is lost.

Steps, each on tables that follow the input:

1. sets with the same elements become one (smallest id) by a 128-bit digest;
2. signatures, one row each, meet in a shuffle; those of one text alone go, and
   buckets with the same texts become one;
3. in every bucket each text is held against one leader, equal pairs once, in
   a few turns with other leaders and without what is joined already: a
   small histogram of elements bounds the difference from below; of the pairs that
   it leaves, the nearest of each component is verified on its whole sets in a turn;
   the links make first components;
4. what is left are pairs in one bucket and not in one component: they are
   compared by their histograms, where buckets with the same smallest id stand
   together, and those that hang together are verified in one place.

A large group of near copies is joined in step 3 by a number of pairs in
proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.components import components
from shardflow.llm.key_filter import marked
from shardflow.llm.words import U64, Words, mix, pieces
from shardflow.scratch import discard, materialise

CELLS = 256  # of a histogram: one byte each
LEADERS = 3  # turns in which a bucket has one leader
HELD = 1 << 21  # elements that a task holds to compare sets
BATCH_ROWS = 1000  # texts or sets that travel to Python at a time


@dataclass(frozen=True)
class Bands:
    """Size bands for ``num / den`` and the number of partitions of each."""

    num: int
    den: int

    def table(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per band: smallest size, largest difference ``k``, partitions."""
        return _bands(self.num, self.den, max(16, int(largest).bit_length()))


def _bands(num: int, den: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, differ, parts = [1], [], []
    while low[-1] <= 1 << bits or len(differ) < len(low):
        high = max(low[-1], low[-1] * den // num)
        k = 2 * high * (den - num) // (den + num)
        # Partitions: enough for k differences and the usual number of empty ones.
        m = k + 1
        for _ in range(4):
            empty = m * np.exp(-low[-1] / m)
            m = k + 1 + int(np.ceil(empty + 3 * np.sqrt(empty)) if k else 0)
        differ.append(k)
        parts.append(min(m, 2 * (k + 1)))
        if low[-1] > 1 << bits:
            break
        low.append(high + 1)
    return np.array(low), np.array(differ), np.array(parts)


def sets_of(texts: pa.Array, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of every text: element hashes, their rows, set sizes."""
    words = Words(texts)
    grams, at = words.grams(words.hashes(lower), n, short=True)
    row = words.row[at] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, row, np.bincount(row, minlength=words.rows) if words.rows else np.zeros(0, np.int64)


def digests(grams: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that name a set."""
    both = []
    for seed in (11, 12):
        total = np.zeros(rows, U64)
        np.add.at(total, row, mix(grams, seed))
        both.append(total.view(np.int64))
    return both[0], both[1]


SUBSETS = [(a, b, c) for a in range(5) for b in range(a + 1, 5) for c in range(b + 1, 5)]


def signatures(grams: np.ndarray, row: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all sets: ``(signature, row)``."""
    low, differ, parts = bands.table(int(size.max(initial=1)) * 2)
    band = np.searchsorted(low, np.maximum(size, 1), side="right") - 1
    out, owner = [], []
    some = np.flatnonzero(size > 0)
    for step in (0, 1):  # a set meets its own band as the larger or equal one, and the next as the smaller
        g = band + step
        count = np.where(size > 0, parts[g], 0)
        base = np.concatenate([[0], np.cumsum(count)])
        tag = mix(g.astype(U64), 21)
        spread = mix(grams ^ tag[row], 22) >> U64(32)
        slot = base[row] + ((spread * count[row].astype(U64)) >> U64(32)).astype(np.int64)
        total, held = np.zeros(base[-1], U64), np.bincount(slot, minlength=base[-1])
        np.add.at(total, slot, mix(grams, 23))
        of = np.repeat(np.arange(len(size)), count)
        place = np.arange(base[-1]) - base[of]
        full = held > 0
        out.append(mix(total[full] ^ mix(tag[of[full]] + place[full].astype(U64), 24)))
        owner.append(of[full])
        # Sets with more empty partitions than the slack.
        empty = np.bincount(of[~full], minlength=len(size))
        thin = some[empty[some] > (parts - differ - 1)[g[some]]]
        if len(thin):
            is_thin = np.zeros(len(size), bool)
            is_thin[thin] = True
            mine = is_thin[row]
            count = np.where(is_thin, 5 * (differ[g] // 3 + 1), 0)
            base = np.concatenate([[0], np.cumsum(count)])
            spread = mix(grams[mine] ^ tag[row[mine]], 25) >> U64(32)
            slot = base[row[mine]] + ((spread * count[row[mine]].astype(U64)) >> U64(32)).astype(np.int64)
            total = np.zeros(base[-1], U64)
            np.add.at(total, slot, mix(grams[mine], 26))
            total = total.reshape(-1, 5)
            of = np.repeat(np.arange(len(size)), count // 5)
            place = np.arange(len(of)) - base[of] // 5
            for k, (a, b, c) in enumerate(SUBSETS):
                joint = mix(total[:, a], 27) + mix(total[:, b], 28) + mix(total[:, c], 29)
                out.append(mix(joint ^ mix(tag[of] + (place * 10 + k).astype(U64), 30)))
                owner.append(of)
    return np.concatenate(out), np.concatenate(owner)


def _longs(name_values: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {k: pa.array(v.view(np.int64) if v.dtype == U64 else v.astype(np.int64)) for k, v in name_values.items()}
    )


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)


def set_keys(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """``(id, size, k1, k2)``: size and digest of every text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                grams, row, size = sets_of(piece.column("text"), n, lower)
                k1, k2 = digests(grams, row, len(size))
                yield _longs({"id": _ids(piece), "size": size, "k1": k1, "k2": k2})

    return docs.mapInArrow(run, "id long, size long, k1 long, k2 long")


def signature_rows(docs: DataFrame, n: int, lower: bool, bands: Bands, memory: int = 200_000) -> DataFrame:
    """``(sig, id)`` of every set; a task gives those of equal sets once while it remembers them.

    Forgetting (after ``memory`` sets) costs repeated rows, never a signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                grams, row, size = sets_of(piece.column("text"), n, lower)
                k1, k2 = digests(grams, row, len(size))
                fresh = np.zeros(len(size), bool)
                if len(seen) > memory:
                    seen.clear()
                for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if size[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                keep = fresh[row]
                sig, owner = signatures(grams[keep], row[keep], np.where(fresh, size, 0), bands)
                ids = _ids(piece)[owner]
                for at in range(0, len(sig), 1 << 17):
                    yield _longs({"sig": sig[at : at + (1 << 17)], "id": ids[at : at + (1 << 17)]})

    return docs.mapInArrow(run, "sig long, id long")


def _shared(rows: DataFrame, hold: int = 1 << 16, memory: int = 200_000) -> DataFrame:
    """``(sig, id)`` of the signatures that occur again, under a name made of the bucket's ids.

    Buckets with the same ids thereby become one: a task gives them once while it
    remembers them, and the rest are equal rows.  Should two buckets get one
    name by chance, more is compared, never less.  A bucket of more than ``hold`` rows
    is not held, and keeps its signature as its name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting, long = 0, None  # rows held; the signature of a bucket that is not
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append((batch.column("sig").to_numpy(), batch.column("id").to_numpy()))
                waiting += batch.num_rows
                if waiting <= hold:
                    continue
            if not waiting:
                continue
            sig, ids = (np.concatenate([h[k] for h in held]) for k in range(2))
            if long is not None:
                more = int((sig == long).sum())
                if more:
                    yield _longs({"sig": sig[:more], "id": ids[:more]})
                sig, ids = sig[more:], ids[more:]
            long = None if len(sig) else long
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
            upto = len(sig) if batch is None or not len(sig) else int(start[-1])  # the last bucket may go on
            if len(sig) - upto > hold:
                long = sig[-1]
                yield _longs({"sig": sig[upto:], "id": ids[upto:]})
                held, waiting = [], 0
            else:
                held, waiting = [(sig[upto:], ids[upto:])], len(sig) - upto
            start = start[start < upto]
            if not len(start):
                continue
            count = np.diff(np.append(start, upto))
            name = mix(np.add.reduceat(mix(ids[:upto].view(U64), 41), start) ^ mix(count.astype(U64), 42), 43)
            fresh = count > 1
            if len(seen) > memory:
                seen.clear()
            for k in np.flatnonzero(fresh).tolist():
                if (key := int(name[k])) in seen:
                    fresh[k] = False
                seen.add(key)
            if fresh.any():
                keep = np.repeat(fresh, count)
                yield _longs({"sig": np.repeat(name, count)[keep], "id": ids[:upto][keep]})

    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "sig long, id long")


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The sorted rows, one table for every run with equal keys."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *starts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _root(above: dict[int, int], x: int) -> int:
    while (up := above.get(x, x)) != x:
        above[x] = above.get(up, up)
        x = up
    return x


def verified(pairs: DataFrame, docs: DataFrame, n: int, lower: bool, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sets reach ``num / den``, enough of them to join all that do; written down.

    ``pairs`` is a written table ``(a, b, place)``.  A text travels once to every
    place that has pairs of it, however many, and its set is made there.  Pairs that
    links of the same place join already are not compared.
    """
    reach = lambda x, y: len(x) and len(y) and (den + num) * _common(x, y) >= num * (len(x) + len(y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "place"):
            sets: dict[int, list[np.ndarray]] = {}
            mates: dict[int, list[int]] = {}
            for batch in rows.to_batches():
                for piece in pieces(batch, "text"):
                    grams, _, size = sets_of(piece.column("text"), n, lower)
                    own = np.split(grams, np.cumsum(size)[:-1])
                    for id, of, x in zip(_ids(piece).tolist(), piece.column("mates").to_pylist(), own):
                        mates[id] = of
                        known = sets.setdefault(id, [])
                        if not any(np.array_equal(x, y) for y in known):  # rows may share an id
                            known.append(x)
            above: dict[int, int] = {}
            found = []
            for a, of in mates.items():
                for b in of:
                    u, v = _root(above, a), _root(above, b)
                    if u != v and any(reach(x, y) for x in sets[a] for y in sets[b]):
                        above[max(u, v)] = min(u, v)
                        found.append((a, b))
            if found:
                yield _longs(dict(zip("ab", np.array(found).T)))

    ends = F.array(F.struct("place", F.col("a").alias("id"), F.col("b").alias("mate")), F.struct("place", F.col("b").alias("id"), F.lit(None).cast("bigint").alias("mate")))
    needed = pairs.select(F.inline(ends)).groupBy("place", "id").agg(F.collect_list("mate").alias("mates"))
    needed = materialise(needed, "pair-ids")
    rows = marked(docs, needed.select("id"), "id", "perhaps").where("perhaps").drop("perhaps").join(needed, "id")
    rows = rows.select("place", "id", "mates", "text").repartition("place").sortWithinPartitions("place")
    found = materialise(rows.mapInArrow(run, "a long, b long"), "whole-sets", BATCH_ROWS)
    discard(needed)
    return found


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[at] == y).sum())


def _at_hubs(pairs: DataFrame, hub: str) -> DataFrame:
    """Pairs ``(a, b, n)`` with a ``place``: those of a hub together, in parts of about ``HELD`` elements."""
    parts = pairs.groupBy(hub).agg(F.ceil(F.sum("n") / HELD).cast("bigint").alias("parts"))
    part = F.pmod(F.xxhash64("a", "b"), F.col("parts"))
    return pairs.join(parts, hub).select("a", "b", F.xxhash64(hub, part).alias("place"))


def _at_families(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with a ``place``: all that hang together, in blocks of about ``HELD`` elements.

    ``sizes`` has ``(id, size)``, an id once.
    """
    family = materialise(components(pairs).withColumnRenamed("node", "a").withColumnRenamed("component", "family"), "families")
    parts = family.join(sizes.withColumnRenamed("id", "a"), "a").groupBy("family").agg(F.ceil(F.sum("size") / HELD).cast("bigint").alias("parts"))
    i, j = (F.pmod(F.xxhash64(end), F.col("parts")) for end in ("a", "b"))
    place = F.xxhash64("family", F.least(i, j), F.greatest(i, j)).alias("place")
    return pairs.join(family.join(parts, "family"), "a").select("a", "b", place)


def _may_link(pairs: DataFrame, cells: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` that their histograms don't rule out, with the sum of both sizes and the histograms' difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("x", "y"))
            total = batch.column("n").to_numpy()
            differ = np.abs(x - y).sum(axis=1).astype(np.int64)
            keep = pa.array(differ * (den + num) <= (den - num) * total)
            kept = [batch.column(c).filter(keep) for c in ("a", "b", "n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(differ).filter(keep)], ["a", "b", "n", "differ"])

    left = cells.select(F.col("id").alias("a"), F.col("size").alias("p"), F.col("cells").alias("x"))
    right = cells.select(F.col("id").alias("b"), F.col("size").alias("q"), F.col("cells").alias("y"))
    near = F.least("p", "q") * den >= F.greatest("p", "q") * num
    both = pairs.join(left, "a").join(right, "b").where(near)
    both = both.select("a", "b", (F.col("p") + F.col("q")).alias("n"), "x", "y")
    return both.mapInArrow(run, "a long, b long, n long, differ long")


def _histograms(docs: DataFrame, ids: DataFrame, n: int, lower: bool) -> DataFrame:
    """``(id, size, cells)``: how many elements fall in each of ``CELLS`` classes, at most 255 each.

    Of the texts named in the written table ``ids``, and of some others: no text
    travels to tell them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                grams, row, size = sets_of(piece.column("text"), n, lower)
                slot = row * CELLS + (mix(grams, 31) >> U64(56)).astype(np.int64)
                cells = np.minimum(np.bincount(slot, minlength=len(size) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_ids(piece)), pa.array(size.astype(np.int64)), pa.array([r.tobytes() for r in cells], pa.binary())],
                    ["id", "size", "cells"],
                )

    perhaps = marked(docs, ids, "id", "perhaps").where("perhaps").drop("perhaps")
    return perhaps.mapInArrow(run, "id long, size long, cells binary")


def _close_pairs(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one bucket and two components whose histograms don't rule a link out.

    The sum of differences of two histograms is at most the number of elements in
    which the sets differ.  A row is a text with all its buckets (``sigs``) in the
    blocks ``i`` and ``j`` of one lead.  However many buckets two texts share there,
    they are compared once.
    """

    def close(ids, label, side, size, cells, buckets, mixed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        done = np.zeros((len(ids), len(ids)), bool)
        for rows in buckets:
            for k, one in enumerate(rows[:-1]):
                rest = rows[k + 1 :]
                rest = rest[~done[one, rest]]
                done[one, rest] = True
                may = (label[rest] != label[one]) & (np.minimum(size[rest], size[one]) * den >= np.maximum(size[rest], size[one]) * num)
                if mixed:  # two blocks of a lead: pairs inside one are met where it stands alone
                    may &= side[rest] != side[one]
                at = rest[may]
                if len(at):
                    apart = np.abs(cells[at].astype(np.int16) - cells[one]).sum(axis=1)
                    at = at[apart * (den + num) <= (den - num) * (size[at] + size[one])]
                    yield np.minimum(ids[at], ids[one]), np.maximum(ids[at], ids[one])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "lead", "i", "j"):
            if table.num_rows < 2:
                continue
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            ids, label, side, size = (table[c].to_numpy() for c in ("id", "label", "at", "size"))
            cells = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint8).reshape(-1, CELLS)
            sigs = table["sigs"].combine_chunks()
            row = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(sigs).to_numpy(zero_copy_only=False))
            sig = sigs.flatten().to_numpy()
            order = np.argsort(sig, kind="stable")  # rows of a bucket stay in order
            buckets = np.split(row[order], np.flatnonzero(np.diff(sig[order])) + 1)
            found = list(close(ids, label, side, size, cells, buckets, i != j))
            if found:
                a, b = (np.concatenate([f[k] for f in found]) for k in range(2))
                for at in range(0, len(a), 1 << 16):
                    yield _longs({"a": a[at : at + (1 << 16)], "b": b[at : at + (1 << 16)]})

    return blocks.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j").mapInArrow(run, "a long, b long")


def _lead_blocks(left: DataFrame, block: int) -> DataFrame:
    """``(lead, i, j, id, label, at, sigs)`` of the bucket rows ``(sig, id, label)``.

    Buckets with the same smallest id, their lead, stand together, in blocks of
    about ``block`` texts: near copies share many buckets, but few leads.
    """
    lead = left.groupBy("sig").agg(F.min("id").alias("lead"))
    rows = left.join(lead, "sig").groupBy("lead", "id", "label").agg(F.collect_set("sig").alias("sigs"))
    rows = materialise(rows, "led-texts")
    blocks = rows.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(blocks, "lead").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("lead", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "id", "label", "at", "sigs")


def ngram_jaccard_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    *,
    n: int = 5,
    num: int = 4,
    den: int = 5,
    lower: bool = True,
    block: int = 2048,
) -> DataFrame:
    """``(<id>, n_shingles, component_id)``, one row per row of ``docs``.

    Texts whose sets of ``n``-word shingles have a similarity of ``num / den``
    or more are linked; ``component_id`` is the smallest id reachable by links.
    ``lower`` folds A-Z.  A text of fewer than ``n`` words has its whole
    sequence as its only shingle.  A null or empty text, or one without words,
    has no shingle and is alone; so is a row without id, whose component is
    null.  Rows with equal id and text get equal answers.  Other columns are
    not looked at.  ``block`` bounds the texts compared with each other at a
    time, not the size of a bucket.
    """
    spark, bands = docs.sparkSession, Bands(num, den)
    whole = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    given = whole.where("id is not null")

    keys = materialise(set_keys(given, n, lower), "set-keys", BATCH_ROWS)
    some = keys.where("size > 0")
    first = some.groupBy("size", "k1", "k2").agg(F.min("id").alias("rep"))
    named = materialise(some.join(first, ["size", "k1", "k2"]).select("id", "size", "rep"), "set-reps")
    rep_of = named.select("id", "rep").distinct()

    shared = materialise(_shared(signature_rows(given, n, lower, bands)), "shared-signatures", BATCH_ROWS)
    # Most ids stand for themselves alone; only the others are looked up.
    moved = materialise(rep_of.join(rep_of.where("id <> rep").select("id").distinct(), "id", "left_semi"), "other-reps")
    members = shared.join(moved, "id", "left").select("sig", F.coalesce("rep", "id").alias("id")).distinct()
    members = materialise(members, "members")
    bucket = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single, members = members, materialise(members.join(bucket, "sig"), "buckets")
    discard(single)

    met = materialise(members.select("id").distinct(), "bucket-ids")
    cells = materialise(_histograms(given, met, n, lower).distinct(), "histograms", BATCH_ROWS)
    discard(met)

    def labelled(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
        if joined is None:
            return rows.withColumn("label", F.col("id"))
        rows = rows.join(joined.withColumnRenamed("node", "id"), "id", "left")
        return rows.withColumn("label", F.coalesce("component", "id")).drop("component")

    joined, tried, live = None, [], None
    sizes = cells.groupBy("id").agg(F.sum("size").alias("size"))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs in two components, with ``lo`` and ``hi``: the components' labels in order."""
        if joined is None:
            return pairs.select("*", F.col("a").alias("lo"), F.col("b").alias("hi"))
        given = pairs.columns
        for end in ("a", "b"):
            at = joined.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
            pairs = pairs.join(at, end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
        labels = F.least("a_in", "b_in").alias("lo"), F.greatest("a_in", "b_in").alias("hi")
        return pairs.select(*given, *labels).where("lo < hi")

    def untried(pairs: DataFrame) -> DataFrame:
        """Pairs whose sets were not compared in a turn before: they would fail again."""
        if not tried:
            return pairs
        before = tried[0].select("a", "b")
        for more in tried[1:]:
            before = before.unionByName(more.select("a", "b"))
        return pairs.join(before, ["a", "b"], "left_anti")

    for turn in range(LEADERS):
        # In every turn another text leads; what is in one component with it is not compared again.
        # All pairs with leaders that are left after the first turn meet by histogram in the second,
        # among them the only pair of every bucket of two; those not verified wait for later turns.
        rank = F.xxhash64("id", F.lit(turn))
        left = labelled((members if turn < 2 else members.where("n > 2")).select("sig", "id"), joined)
        led = left.groupBy("sig").agg(F.min_by("id", rank).alias("leader"), F.min_by("label", rank).alias("led"))
        stars = left.join(led, "sig").where("label <> led")
        if not turn:  # one leader each: what that joins needs no other
            stars = stars.groupBy("id").agg(F.min_by("leader", F.xxhash64("leader", F.lit(turn))).alias("leader"))
        stars = stars.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        near = untried(_may_link(stars, cells, num, den))
        if live is not None:  # these wait already
            near = near.join(live.select("a", "b"), ["a", "b"], "left_anti")
        stars = materialise(near, "star-pairs", BATCH_ROWS)
        if turn:
            # One link makes two components one: of each component the nearest pair is verified.
            every = stars if live is None else stars.unionByName(live)
            every = materialise(apart(every).dropDuplicates(["a", "b"]), "live-pairs")
            nearest = F.struct(F.col("differ") / F.col("n"), F.xxhash64("a", "b"))
            picked = every.groupBy("hi").agg(F.min_by(F.struct("a", "b", "n"), nearest).alias("pair")).select("pair.*")
            discard(stars)
        else:
            every, picked = None, stars.dropDuplicates(["a", "b"])
        one = materialise(_at_hubs(picked, "a"), "tested-pairs")
        tried.append(one)
        if every is not None:
            rest = materialise(every.join(one.select("a", "b"), ["a", "b"], "left_anti").drop("lo", "hi"), "waiting-pairs")
            if live is not None:
                discard(live)
            discard(every)
            live = rest
        if one.isEmpty():
            continue
        found = verified(one, given, n, lower, num, den)
        # What is joined already is told by stars; the links behind it are not needed again.
        known = found if joined is None else found.unionByName(joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        after = materialise(components(known), "first-components")
        discard(found)
        if joined is not None:
            discard(joined)
        joined = after
    if joined is None:
        joined = spark.createDataFrame([], "node long, component long")

    # Pairs in one bucket that are not in one component yet.
    # In a bucket of two, the leader's pair is the only one; it was tested or waits.
    left = labelled(members.where("n > 2").select("sig", "id"), joined)
    mixed = left.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("sig")
    left = _lead_blocks(materialise(left.join(mixed, "sig"), "mixed-buckets"), block).join(cells, "id")
    near = materialise(_close_pairs(left, num, den).distinct(), "near-pairs", BATCH_ROWS)
    close = near if live is None else near.unionByName(live.select("a", "b"))
    close = materialise(apart(untried(close.distinct())).select("a", "b"), "close-pairs")
    placed = materialise(_at_families(close, sizes), "placed-pairs")
    more = verified(placed, given, n, lower, num, den)
    label = joined.select("node", "component")
    ends = more
    for end in ("a", "b"):
        ends = ends.join(label.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    merged = materialise(components(ends.select("a", "b")), "second-components")
    for table in (shared, moved, members, cells, near, close, placed, more, *tried, *([] if live is None else [live])):
        discard(table)

    final = (
        rep_of.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("label", F.coalesce("component", "rep"))
        .drop("component")
        .join(merged.withColumnRenamed("node", "label"), "label", "left")
        .groupBy("id", "rep")
        .agg(F.min(F.coalesce("component", "label")).alias("component"))
    )
    out = named.join(final, ["id", "rep"]).select("id", "size", "component").unionByName(
        keys.where("size = 0").select("id", "size", F.col("id").alias("component"))
    )
    nameless = set_keys(whole.where("id is null").withColumn("id", F.lit(0).cast("bigint")), n, lower)
    nothing = F.lit(None).cast("bigint")
    out = out.unionByName(nameless.select(nothing.alias("id"), "size", nothing.alias("component")))
    return out.select(F.col("id").alias(id), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
