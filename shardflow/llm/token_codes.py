"""Token ids on disk as directly addressable codes.

An id is split into chunks of ``bits`` bits.  All lowest chunks stand together
in the first level, the next chunks of ids that have any in the second, and so
on.  A bitmap for each level says which ids continue, and a directory has the
number of continued ids before every 512th position: the place of an id's next
chunk is the rank of its bit.  Any token is read with one look into each level,
without decoding a block.

Files are Parquet, one row for a segment: whole documents in ascending id, their
lengths, and the codes.  Spark writes and commits them, so they can live in any
store, and a lost executor leaves no half file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardflow.llm.unit_ids import UnitIds, word_cuts
from shardflow.llm.words import Texts, pieces

MAGIC = b"DAC1"
STEP = 512  # positions between two entries of a directory


def pack(ids: np.ndarray, bits: int = 8) -> bytes:
    """The codes of ``ids`` (below 2**32); chunks of ``bits`` bits, 1 to 8, a byte each or packed."""
    rest = np.asarray(ids).astype(np.uint64)
    levels = []
    while True:
        chunk = (rest & np.uint64((1 << bits) - 1)).astype(np.uint8)
        rest = rest >> np.uint64(bits)
        more = rest > 0
        held = chunk if bits == 8 else np.packbits(np.unpackbits(chunk[:, None], axis=1, bitorder="little")[:, :bits], bitorder="little")
        step = np.add.reduceat(more, np.arange(0, len(more), STEP), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(step) - step).astype("<u4")
        levels.append((len(chunk), held.tobytes(), np.packbits(more, bitorder="little").tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more]
    head = MAGIC + struct.pack("<II", bits, len(levels))
    table = b"".join(struct.pack("<QQQQ", n, len(a), len(b), len(c)) for n, a, b, c in levels)
    return head + table + b"".join(part for _, *parts in levels for part in parts)


class Codes:
    """Reads codes in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not token codes")
        self.bits, count = struct.unpack_from("<II", data, 4)
        at = 12 + 32 * count
        self.levels = []
        for k in range(count):
            n, a, b, c = struct.unpack_from("<QQQQ", data, 12 + 32 * k)
            parts = [np.frombuffer(data, t, size // w, at + skip) for t, size, w, skip in ((np.uint8, a, 1, 0), (np.uint8, b, 1, a), ("<u4", c, 4, a + b))]
            self.levels.append((n, *parts))
            at += a + b + c

    def __len__(self) -> int:
        return self.levels[0][0]

    def _chunks(self, held: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.bits == 8:
            return held[at]
        bit = at[:, None] * self.bits + np.arange(self.bits)
        return (((held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1) << np.arange(self.bits)).sum(axis=1)

    def at(self, positions) -> np.ndarray:
        """The ids at any positions."""
        place = np.atleast_1d(np.asarray(positions, np.int64))
        if len(place) and (place.min() < 0 or place.max() >= len(self)):
            raise IndexError("position outside the codes")
        out = np.zeros(len(place), np.uint64)
        live = np.arange(len(place))
        for k, (_, held, bitmap, ranks) in enumerate(self.levels):
            out[live] |= self._chunks(held, place).astype(np.uint64) << np.uint64(k * self.bits)
            on = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            live, place = live[on], place[on]
            if not len(live):
                break
            # Rank of the bit: the directory's entry, whole bytes since, bits of the last byte.
            block = place // STEP
            since = block[:, None] * (STEP // 8) + np.arange(STEP // 8)
            whole = np.where(since < (place >> 3)[:, None], np.bitwise_count(bitmap[np.minimum(since, len(bitmap) - 1)]), 0).sum(axis=1, dtype=np.int64)
            last = np.bitwise_count(bitmap[place >> 3] & ((1 << (place & 7)) - 1).astype(np.uint8)).astype(np.int64)
            place = ranks[block].astype(np.int64) + whole + last
        return out.astype(np.uint32)

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, live = np.zeros(len(self), np.uint64), slice(None)
        for k, (n, held, bitmap, _) in enumerate(self.levels):
            chunk = held if self.bits == 8 else self._chunks(held, np.arange(n))
            out[live] |= chunk.astype(np.uint64) << np.uint64(k * self.bits)
            on = np.flatnonzero(np.unpackbits(bitmap, count=n, bitorder="little"))
            live = on if isinstance(live, slice) else live[on]
        return out.astype(np.uint32)


class LibraryEncoder:
    """Ids of texts by the tokenizers library, on one thread; ``model`` is the content of its file.

    With ``by_word`` texts are encoded by units (see ``word_cuts``).  That is right for
    tokenizers that drop white space and cut between letters and signs; every
    task holds its first text against the library's answer for the whole and ends in
    an error if they differ.  Texts with one of the special tokens are
    always encoded whole.
    """

    def __init__(self, model: str, by_word: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.units = None
        if by_word:
            settings = json.loads(model)
            suffix = settings["model"].get("end_of_word_suffix")
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
            self.special = [t["content"].encode() for t in settings.get("added_tokens", [])]
            self.units = UnitIds(self._units, word_cuts(), lower='"Lowercase"' in json.dumps(settings["normalizer"]), spaces=False)
            self.checked = False

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, texts: list[str]) -> tuple[list, np.ndarray]:
        """Words of plain letters are encoded in one text; each ends with a token that ends a word."""
        out: list = [None] * len(texts)
        words = [k for k, t in enumerate(texts) if t.isascii() and t.isalpha()]
        if words:
            (ids,) = self.whole([" ".join(texts[k] for k in words)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(words) and cuts[-1] == len(ids):
                for k, lo, hi in zip(words, [0, *cuts[:-1].tolist()], cuts.tolist()):
                    out[k] = ids[lo:hi]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.whole([texts[k] for k in rest])):
            out[k] = ids
        return out, np.ones(len(texts), bool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        if self.units is None:
            lists = self.whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *[np.asarray(x, np.uint32) for x in lists]]), np.array([len(x) for x in lists], np.int64)
        words = Texts(texts)
        ids, sizes, _ = self.units(words.bytes, words.offsets)
        raw = words.bytes.tobytes()
        odd = range(0)
        if any(token in raw for token in self.special):
            content = texts.to_pylist()
            odd = [k for k, t in enumerate(content) if any(token in t.encode() for token in self.special)]
        if not self.checked and len(texts) and 0 not in odd:
            self.checked = True
            if self.whole([texts[0].as_py()])[0] != ids[: sizes[0]].tolist():
                raise ValueError("this tokenizer cannot be used by words")
        if odd:
            lists = np.split(ids, np.cumsum(sizes)[:-1])
            for k, found in zip(odd, self.whole([content[k] for k in odd])):
                lists[k] = np.asarray(found, np.uint32)
            ids, sizes = np.concatenate(lists), np.array([len(x) for x in lists], np.int64)
        return ids, sizes


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    id: str = "doc_id",
    text: str = "text",
    end: int | None = None,
    by_word: bool = False,
    segment: int = 1 << 20,
    bits: int = 8,
) -> None:
    """Encode every text and write the ids to ``path``, in ascending id.

    ``tokenizer`` is the content of a tokenizers file; executors get it with
    the job, since it is not data and does not grow.  ``end`` is appended to every document.
    A null text is empty; rows without id come first; rows that share an id
    are ordered by text.  For ``by_word`` see ``LibraryEncoder``.
    A segment holds whole documents, ``segment`` ids or a few more, or one longer
    document.  Other columns are not written.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def encoded(texts: pa.Array, encode: LibraryEncoder) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = encode(texts)
        if end is not None:
            ids = np.insert(ids, np.cumsum(sizes), end)
            sizes = sizes + 1
        return ids, sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = LibraryEncoder(shared.value, by_word)
        number = TaskContext.get().partitionId() << 32
        docs_held: list = []
        sizes_held: list[np.ndarray] = []
        ids_held: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(ids_held) if ids_held else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([docs_held], pa.list_(pa.int64())),
                    pa.array([np.concatenate(sizes_held)], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([pack(ids, bits)], pa.binary()),
                ],
                ["segment", "docs", "sizes", "n_tokens", "codes"],
            )

        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, sizes = encoded(piece.column("text"), encode)
                names = piece.column("id").to_pylist()
                ends = np.cumsum(sizes)
                at = 0
                while at < len(sizes):
                    before = ends[at - 1] if at else 0
                    upto = min(len(sizes), int(np.searchsorted(ends, before + segment - held)) + 1)
                    docs_held += names[at:upto]
                    sizes_held.append(sizes[at:upto])
                    ids_held.append(ids[before : ends[upto - 1]])
                    held += int(ends[upto - 1] - before)
                    at = upto
                    if held >= segment:
                        yield row()
                        number, held = number + 1, 0
                        docs_held, sizes_held, ids_held = [], [], []
        if docs_held:
            yield row()

    schema = "segment long, docs array<long>, sizes array<long>, n_tokens long, codes binary"
    rows.mapInArrow(run, schema).write.mode("errorifexists").parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(segment, start)``: ids before every segment; summed by file part, then inside the parts."""
    sizes = spark.read.parquet(path).select("segment", "n_tokens").withColumn("part", F.shiftright("segment", 32))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row per task that wrote
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(parts, "part").select(
        "segment", "n_tokens", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).cast("bigint").alias("start")
    )


def read_documents(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files; with ``digest`` the crc32 of the ids in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, docs, sizes, codes in zip(*(batch.column(k) for k in ("segment", "docs", "sizes", "codes"))):
                ids = Codes(codes.as_py()).all().astype("<u4")
                size = sizes.values.to_numpy() if sizes.values is not None else np.zeros(0, np.int64)
                ends = np.cumsum(size)
                values = [ids[b - n : b] for b, n in zip(ends, size)]
                last = pa.array([zlib.crc32(v) for v in values] if digest else values, pa.int64() if digest else pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(size), segment.as_py())), docs.values, pa.array(ends - size), pa.array(size), last],
                    ["segment", "doc_id", "place", "n_tokens", "ids"],
                )

    kind = "long" if digest else "array<long>"
    found = spark.read.parquet(path).select("segment", "docs", "sizes", "codes").mapInArrow(run, f"segment long, doc_id long, place long, n_tokens long, ids {kind}")
    starts = segment_starts(spark, path).select("segment", "start")
    return found.join(starts, "segment").select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", F.col("ids").alias("ids_crc32" if digest else "ids"))


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, position: str = "position", span: int = 1 << 20) -> DataFrame:
    """``(position, id)`` for places in the whole sequence of ids, read without decoding segments.

    Segments and positions meet by ``position div span``; repeated places are
    answered once, places outside are left out.
    """
    held = segment_starts(spark, path).where("n_tokens > 0")
    held = held.withColumn("block", F.explode(F.sequence(F.expr(f"start div {span}"), F.expr(f"(start + n_tokens - 1) div {span}"))))
    asked = positions.select(F.col(position).cast("bigint").alias("position")).where("position >= 0").withColumn("block", F.expr(f"position div {span}"))
    found = asked.join(held, "block").where("position >= start and position < start + n_tokens")
    # Distinct places of one segment: at most as many as it has ids.
    found = found.distinct().groupBy("segment").agg(F.collect_list(F.struct("position", "start")).alias("asked"))
    joined = spark.read.parquet(path).select("segment", "codes").join(found, "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, asked in zip(batch.column("codes"), batch.column("asked")):
                place = asked.values.field(0).to_numpy()
                ids = Codes(codes.as_py()).at(place - asked.values.field(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids.astype(np.int64))], ["position", "id"])

    return joined.mapInArrow(run, "position long, id long")
