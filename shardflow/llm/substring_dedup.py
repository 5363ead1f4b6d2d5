"""Substring dedup by an index of anchored windows, in place of a relative Lempel-Ziv parse.

A run of ``window`` words that also stands at an earlier place (smaller id, or
earlier in the same document), its source, is a duplicate span.  No document is
factored greedily against a reference text: every document would have to meet
every block of the text before it, which grows with the square of the corpus.
The index finds every repeated window all the same, which is all that the words
taken out depend on.  Windows are equal if two 64-bit hashes are; no words are
compared.

The index is dealt over the cluster.  Each run
of ``window`` words is entered under its anchor, the ``seed`` words inside it
with the smallest hash; neighbouring windows mostly share an anchor and make
one segment, so the index has about one entry for eight words.  Equal windows
have equal anchors, so all their entries meet in one block of the index.
There

* a segment that equals an earlier one whole is a found part at once;
* the first segments of an anchor with several different ones are where
  repeats begin or end: their windows are indexed one by one.

Parts whose sources follow one another are then joined for the column
``factors``; it changes nothing in what is taken out.  These are not always the
longest factors: the source of a part is the earliest of the equal places in its
Arrow batch, if there is an earlier one, and else the earliest of all, so a
passage may come in pieces with several sources, and ``factors`` may differ
with the batches.  A window belongs to one segment, so no window between two
parts is overlooked.  Equal segments are reduced to the earliest one inside a task
before they are shuffled, however often a passage occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.words import U64, Words, mix, pieces, spans
from shardflow.scratch import materialise

MARKS = "anchor long, whole long, doc long, start int, n int, src long, src_start int, kind int"
#: Kinds of rows: an entry of the index, a found part of a factor, a segment whose windows are indexed one by one.
ENTRY, FOUND, SPLIT = 0, 1, 2
TYPES = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32)
NAMES = tuple(part.split()[0] for part in MARKS.split(", "))


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t)) for c, t in zip(columns, TYPES)], list(NAMES))


def segments(words: Words, hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Segments of all texts: anchor, hash of the whole, row, first word in the text, number of windows."""
    total = len(hashes)
    empty = np.zeros(0, np.int64)
    if total < window:
        return empty, empty, empty, empty, empty
    s = spans(hashes, np.arange(total - seed + 1), np.arange(seed, total + 1))
    # Leftmost smallest seed of every window: doubling steps, then one that overlaps.
    width, best = 1, np.arange(len(s))
    seeds = window - seed + 1
    while width < seeds:
        step = min(width, seeds - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(s[left] <= s[right], left, right)
        width += step
    at = np.arange(total - window + 1)
    valid = words.row[at] == words.row[at + window - 1]
    at, best = at[valid], best[valid]
    if not len(at):
        return empty, empty, empty, empty, empty
    new = np.ones(len(at), bool)
    new[1:] = (best[1:] != best[:-1]) | (words.row[at[1:]] != words.row[at[:-1]])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    start = at[begin]
    row = words.row[start]
    whole = spans(hashes, start, start + n + window - 1)
    return s[best[begin]].view(np.int64), whole.view(np.int64), row, start - words.first[row], n


def _earliest(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Entries of one task: the earliest of equal ones stay, the others become found parts."""
    anchor, whole, doc, start, n = columns
    order = np.lexsort((start, doc, whole, anchor))
    anchor, whole, doc, start, n = (c[order] for c in (anchor, whole, doc, start, n))
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    later = (doc != doc[first]) | (start != start[first])
    # Found parts only pass through the index: they are spread over its blocks.
    spread = mix(doc.view(U64), 51) ^ start.astype(U64)
    return [np.where(later, spread.view(np.int64), anchor), whole, doc, start, n, doc[first], start[first], np.where(later, FOUND, ENTRY)]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)


def index_entries(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Entries of the index, and what equals an earlier segment of the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"))
                anchor, whole, row, start, n = segments(words, words.hashes(), window, seed)
                parts.append((anchor, whole, _ids(piece)[row], start, n))
            if parts:
                yield _batch(_earliest([np.concatenate([p[k] for p in parts]) for k in range(5)]))

    return docs.mapInArrow(run, MARKS)


def window_entries(docs: DataFrame, window: int) -> DataFrame:
    """The windows of the segments in ``split``, each an entry of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"))
                hashes = words.hashes()
                split = piece.column("split")
                owner = np.repeat(np.arange(piece.num_rows), np.diff(np.asarray(split.offsets)))
                flat = split.flatten()
                start, n = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                each = np.repeat(np.arange(len(start)), n)
                offset = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                own = start[each] + offset
                at = words.first[owner[each]] + own
                # Two hashes of 64 bits: of all words, and of the first half.
                anchor = spans(hashes, at, at + window).view(np.int64)
                whole = spans(hashes, at, at + window // 2).view(np.int64)
                parts.append((anchor, whole, _ids(piece)[owner[each]], own, np.ones(len(own), np.int64)))
            if parts:
                yield _batch(_earliest([np.concatenate([p[k] for p in parts]) for k in range(5)]))

    return docs.mapInArrow(run, MARKS)


def looked_up(entries: DataFrame, split: bool) -> DataFrame:
    """Found parts and, with ``split``, the first segments of anchors that have several.

    A block of the index is read in order of anchor, whole, document and
    place; between Arrow batches only the first row of the running group is
    carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the first row of the running (anchor, whole), and whether its anchor has several
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            known = columns[7] == FOUND
            if known.any():
                yield _batch([c[known] for c in columns])
                columns = [c[~known] for c in columns]
            anchor, whole, doc, start, n = columns[:5]
            if not len(anchor):
                continue
            if carried is not None:
                anchor, whole, doc, start, n = (
                    np.concatenate([[v], c]) for v, c in zip(carried[0], (anchor, whole, doc, start, n))
                )
            new_anchor = np.ones(len(anchor), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new = new_anchor.copy()
            new[1:] |= whole[1:] != whole[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[first]) | (start != start[first])
            if later.any():
                at = np.flatnonzero(later)
                yield _batch([anchor[at], whole[at], doc[at], start[at], n[at], doc[first[at]], start[first[at]], np.full(len(at), FOUND)])
            group = np.cumsum(new_anchor) - 1
            several = np.bincount(group, weights=new) > 1
            if carried is not None and carried[1]:
                several[0] = True
            if split:
                give = new & several[group]
                if carried is not None and carried[1]:
                    give[0] = False  # given before
                at = np.flatnonzero(give)
                if len(at):
                    nothing = np.zeros(len(at))
                    yield _batch([anchor[at], whole[at], doc[at], start[at], n[at], nothing, nothing, np.full(len(at), SPLIT)])
            top = first[-1]
            carried = ([c[top] for c in (anchor, whole, doc, start, n)], bool(several[-1]))

    keys = ["anchor", "whole", "doc", "start"]
    return entries.repartition("anchor").sortWithinPartitions(*keys).mapInArrow(run, MARKS)


def duplicate_factors(docs: DataFrame, id: str = "doc_id", text: str = "text", *, window: int = 20, seed: int = 6) -> DataFrame:
    """``(doc, parts)``: for documents with factors, parts as ``(start, n, src, src_start)``
    in windows; a part covers ``n + window - 1`` words."""
    whole = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    marks = materialise(looked_up(index_entries(whole, window, seed), True).drop("anchor", "whole"), "marks")
    split = marks.where(F.col("kind") == SPLIT).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("split"))
    few = whole.join(split.withColumnRenamed("doc", "id"), "id")
    more = looked_up(window_entries(few, window), False).drop("anchor", "whole")
    found = marks.where(F.col("kind") == FOUND).unionByName(more)
    parts = found.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "src", "src_start")).alias("parts"))
    return materialise(parts, "factors")


def factors_of(parts: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """Runs ``(start, words, source document, source place)``: parts whose sources follow one another, joined; not always the longest."""
    out: list[list[int]] = []
    for p in sorted(parts, key=lambda p: (p["start"], p["n"])):
        start, n, src, at = p["start"], p["n"], p["src"], p["src_start"]
        if out and out[-1][2] == src and start <= out[-1][0] + out[-1][1] and start - out[-1][0] == at - out[-1][3]:
            out[-1][1] = max(out[-1][1], start + n - out[-1][0])
        else:
            out.append([start, n, src, at])
    return [(start, n + window - 1, src, at) for start, n, src, at in out]


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", *, window: int = 20, seed: int = 6) -> DataFrame:
    """``(<id>, n_words, n_removed, kept, factors)``, one row per row of ``docs``.

    ``kept`` has the words outside every duplicate span, joined by one space.
    A null text counts as one without words.  A row without id is compared with
    nothing and keeps all its words; rows that share an id stand at the same place,
    so neither is earlier.  Other columns are not looked at.
    """
    parts = duplicate_factors(docs, id, text, window=window, seed=seed)
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    rows = rows.join(parts.withColumnRenamed("doc", "id"), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                out: dict[str, list] = {k: [] for k in ("id", "n_words", "n_removed", "kept", "factors")}
                for doc, content, found in zip(*(piece.column(k).to_pylist() for k in ("id", "text", "parts"))):
                    words = (content or "").encode().split()  # bytes split at ASCII white space alone
                    factors = factors_of(found or [], window)
                    gone = np.zeros(len(words) + 1, np.int64)
                    for start, n, _, _ in factors:
                        gone[start] += 1
                        gone[start + n] -= 1
                    stay = np.cumsum(gone)[:-1] == 0
                    left = words if not factors else [words[k] for k in np.flatnonzero(stay)]
                    out["id"].append(doc)
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(left))
                    out["kept"].append(b" ".join(left).decode())
                    out["factors"].append([dict(zip(("start", "n", "src", "src_start"), f)) for f in factors])
                yield pa.RecordBatch.from_pydict(out, pa.schema(SCHEMA))

    done = rows.mapInArrow(
        run, "id long, n_words long, n_removed long, kept string, factors array<struct<start:int,n:int,src:long,src_start:int>>"
    )
    return done.withColumnRenamed("id", id)


SCHEMA = [
    ("id", pa.int64()),
    ("n_words", pa.int64()),
    ("n_removed", pa.int64()),
    ("kept", pa.string()),
    ("factors", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("src", pa.int64()), ("src_start", pa.int32())]))),
]
