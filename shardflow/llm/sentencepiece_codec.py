"""SentencePiece encoding and decoding of whole tables with the tokenizers backend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm import sentencepiece_model
from shardflow.llm.sentencepiece_model import MARKER
from shardflow.llm.unit_ids import UnitIds, piece_cuts
from shardflow.llm.words import Texts, pieces


def _threads(count: int) -> None:
    """How many threads the library may use; read when it encodes its first batch."""
    import os

    os.environ["RAYON_NUM_THREADS"] = str(count)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if count > 1 else "false"


#: The model's normaliser without its dummy prefix: a field at the end of a message replaces an earlier one.
NO_PREFIX = b"\x1a\x02\x18\x00"


class Encoder:
    """Encodes lists of texts and compares with the sentencepiece library on request.

    Where the model allows it, a text is taken apart between letters that stand
    together in no piece, and a task encodes, and compares, every distinct
    unit once while it remembers it.  The dummy prefix is then written in
    front of the text, and both libraries get units without one.
    """

    def __init__(self, data: bytes, verify: bool):
        model = sentencepiece_model.parse(data)
        self.plain = model.plain()
        self.tokenizer = sentencepiece_model.tokenizer(model, prefix=not self.plain)
        self.reference = None
        if verify:
            from sentencepiece import SentencePieceProcessor

            self.reference = SentencePieceProcessor(model_proto=data + NO_PREFIX if self.plain else data)
        joined = [p.replace(MARKER, " ").encode() for p, _, kind in model.pieces if kind == sentencepiece_model.NORMAL]
        self.units = UnitIds(self._encode, piece_cuts(joined)) if self.plain else None

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.reference is None:
            return lists, np.ones(len(texts), bool)
        wanted = self.reference.encode(texts, num_threads=1)
        return lists, np.array([a == b for a, b in zip(lists, wanted)], bool)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, and whether the libraries agree on it."""
        if self.units is None:
            lists, agree = self._encode(texts)
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64), agree
        # The marker itself counts as a space.
        prefixed = Texts(pa.array([" " + t.replace(MARKER, " ") if t else "" for t in texts], pa.string()))
        return self.units(prefixed.bytes, prefixed.offsets)


def encode_texts(
    docs: DataFrame,
    model: bytes,
    *,
    text: str = "text",
    ids: str = "ids",
    verified: str | None = "verified",
    round_trip: str | None = None,
    threads: int = 2,
) -> DataFrame:
    """``docs`` with the ids of every whole text in ``ids``.

    ``model`` is the content of a SentencePiece file; executors get it with the job.
    With ``verified`` the ids are compared with those of the sentencepiece
    library, for every distinct unit of every batch, and the column says
    whether they agree.  With ``round_trip`` the ids of every text are decoded again and
    that column says whether the text comes back (the marker letter as a space).
    Both happen in the pass that encodes.  A null text is empty and has no ids.  A column of
    ``docs`` with a name used here is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    checks = [c for c in (verified, round_trip) if c]
    kept = docs.drop(ids, *checks)
    names = kept.columns
    if text not in names:
        raise ValueError(f"no column {text!r}")
    fields = [*names, ids, *checks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(threads)
        encoder = Encoder(shared.value, verified is not None)
        for batch in batches:
            for piece in pieces(batch, text, 1 << 20):
                texts = [t or "" for t in piece.column(text).to_pylist()]
                values, sizes, agree = encoder(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
                columns = [*piece.columns, lists, *([pa.array(agree)] if verified else [])]
                if round_trip:
                    back = encoder.tokenizer.decode_batch(_lists(lists), skip_special_tokens=False)
                    columns.append(pa.array([a == b.replace(MARKER, " ") for a, b in zip(back, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, fields)

    schema = kept.withColumn(ids, F.lit(None).cast("array<int>"))
    for check in checks:
        schema = schema.withColumn(check, F.lit(None).cast("boolean"))
    return kept.mapInArrow(run, schema.schema)


def _lists(column: pa.Array) -> list[list[int]]:
    """Lists of whole numbers without their nulls; a null list is empty.  Values are not touched one by one."""
    column = column.fill_null([]) if column.null_count else column
    values, offsets = column.values, np.asarray(column.offsets).astype(np.int64)
    if values.null_count:
        there = np.concatenate([[0], np.cumsum(values.is_valid().to_numpy(zero_copy_only=False))])
        values, offsets = values.drop_null(), there[offsets]
    flat = values.to_numpy()
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def decode_ids(rows: DataFrame, model: bytes, *, ids: str = "ids", text: str = "decoded", threads: int = 2) -> DataFrame:
    """``rows`` with the text of ``ids`` in ``text``; no ids, or null, give the empty text.

    A null inside the ids is left out.  The marker letter itself comes back as a space.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = rows.drop(text)
    fields = [*kept.columns, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(threads)
        tokenizer = sentencepiece_model.tokenizer(sentencepiece_model.parse(shared.value))
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                texts = tokenizer.decode_batch(_lists(part.column(ids)), skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], fields)

    return kept.mapInArrow(run, kept.withColumn(text, F.lit(None).cast("string")).schema)
