"""Words, word hashes and word n-grams of whole texts, on Arrow batches.

A word is a longest run without ASCII white space (0x20, 0x09-0x0D).  UTF-8
never has these bytes inside a letter, so everything works on the bytes of
many texts at once.  Hashes have 64 bits and depend on content alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x5851F42D4C957F2D
LONG = 128
LETTER = mix(np.arange(256, dtype=U64), 7)
LOWER = LETTER.copy()
LOWER[65:91] = LETTER[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**j`` and its inverse modulo 2**64, for j up to ``n``."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A hash of ``values[start:end]`` for every pair, the same wherever it stands.

    ``block`` values are summed at a time, or as many as the longest pair spans.
    Sums of powers cannot tell some long, regular sequences apart (modulo 2**64), so
    ``LONG`` values and more are hashed by BLAKE2 instead.
    """
    if len(start) > 1 and (start[1:] < start[:-1]).any():
        order = np.argsort(start, kind="stable")
        out = np.empty(len(start), U64)
        out[order] = spans(values, start[order], end[order], block)
        return out
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        lo = int(start[at])
        upto = int(np.searchsorted(start, lo + block))
        a, b = start[at:upto] - lo, end[at:upto] - lo
        held = values[lo : lo + int(b.max())]
        up, down = powers(len(held) + 1)
        total = np.zeros(len(held) + 1, U64)
        np.cumsum(held * up[: len(held)], out=total[1:])
        out[at:upto] = mix((total[b] - total[a]) * down[a] + (b - a).astype(U64))
        for k in np.flatnonzero(b - a >= LONG).tolist():
            out[at + k] = int.from_bytes(hashlib.blake2b(held[a[k] : b[k]].tobytes(), digest_size=8).digest(), "little")
        at = upto
    return out


def pieces(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text, one row at least; memory follows the longest text."""
    column = batch.column(text)
    sizes = np.zeros(len(column), np.int64)
    if len(column):
        sizes[:] = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(column):
        upto = int(np.searchsorted(np.cumsum(sizes[at:]), limit, side="right"))
        upto = max(1, upto)
        yield batch.slice(at, upto)
        at += upto


class Texts:
    """The bytes of a column of texts, one after the other; null is empty."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        self.bytes = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
        self.offsets = offsets - lo if len(texts) else np.zeros(1, np.int64)
        self.rows = len(texts)


class Words(Texts):
    """The words of a column of texts: byte range and row of each, in order."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        solid = np.zeros(len(self.bytes) + 2, bool)
        solid[1:-1] = ~SPACE[self.bytes]
        edge = np.zeros(len(self.bytes) + 1, bool)  # before a byte: a text ends or begins
        edge[self.offsets] = True
        self.start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        self.end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=self.rows) if self.rows else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1].astype(np.int64)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return spans((LOWER if lower else LETTER)[self.bytes], self.start, self.end)

    def grams(self, hashes: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of ``n`` words inside a text.

        With ``short`` a text of fewer words, but not none, has its whole
        sequence as the only gram.
        """
        at = np.arange(max(0, len(hashes) - n + 1))
        at = at[self.row[at] == self.row[at + n - 1]] if len(at) else at
        until = at + n
        if short:
            few = np.flatnonzero((self.count > 0) & (self.count < n))
            at = np.concatenate([at, self.first[few]])
            until = np.concatenate([until, self.first[few] + self.count[few]])
        return spans(hashes, at, until), at
