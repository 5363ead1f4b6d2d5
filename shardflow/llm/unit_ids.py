"""Token ids of many texts from those of their units.

A text is taken apart where its tokenizer never joins anything, and a task
encodes every distinct unit once while it remembers it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

from shardflow.llm.words import LETTER, LOWER, SPACE, U64, spans

#: Lists of ids of some texts, and whether each is confirmed.
Encode = Callable[[list[str]], tuple[list, np.ndarray]]


def word_cuts() -> np.ndarray:
    """Pairs of bytes between which a tokenizer of words cuts: at white space, and between
    an ASCII letter and an ASCII sign or digit other than the apostrophe."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    sign = np.zeros(256, bool)
    sign[0x21:0x7F] = True
    sign &= ~letter
    sign[ord("'")] = False
    return (SPACE[:, None] ^ SPACE) | (letter[:, None] & sign) | (sign[:, None] & letter)


def piece_cuts(pieces: list[bytes]) -> np.ndarray:
    """Pairs of bytes that stand next to each other in no piece, the second beginning a letter.

    A token is a piece, so none reaches over such a pair.
    """
    cut = np.ones((256, 256), bool)
    for piece in pieces:
        b = np.frombuffer(piece, np.uint8)
        cut[b[:-1], b[1:]] = False
    cut[:, 0x80:0xC0] = False
    return cut


class UnitIds:
    """Encodes texts by units; ``limit`` units are remembered, ``chunk`` are with the library at a time."""

    def __init__(self, encode: Encode, cut: np.ndarray, *, lower: bool = False, spaces: bool = True, limit: int = 1 << 19, chunk: int = 4096):
        self.encode, self.cut, self.letters = encode, cut.ravel(), LOWER if lower else LETTER
        self.spaces, self.limit, self.chunk = spaces, limit, chunk
        self.forget()

    def forget(self) -> None:
        self.hash, self.begin, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fine, self.flat = np.zeros(0, bool), np.zeros(0, np.uint32)

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        sizes, fine, flat = [self.size], [self.fine], [self.flat]
        for at in range(0, len(start), self.chunk):
            lists, agree = self.encode([raw[a:b].decode() for a, b in zip(start[at : at + self.chunk].tolist(), end[at : at + self.chunk].tolist())])
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat.append(np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes[-1].sum())))
            fine.append(agree)
        size = np.concatenate(sizes[1:])
        begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate(flat)
        both = np.concatenate([self.hash, hashes])
        order = np.argsort(both)
        self.hash, self.begin = both[order], begin[order]
        self.size, self.fine = np.concatenate(sizes)[order], np.concatenate(fine)[order]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts ``data[offsets[k]:offsets[k + 1]]``, how many each has, and whether all of its are confirmed."""
        rows = len(offsets) - 1
        begin = np.zeros(len(data), bool)
        if len(data):
            begin[1:] = self.cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
            begin[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data)) if len(start) else start
        if not self.spaces:
            solid = ~SPACE[data[start]]
            start, end = start[solid], end[solid]
        row = np.searchsorted(offsets, start, side="right") - 1
        hashes = spans(self.letters[data], start, end)
        different, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            at = np.searchsorted(self.hash, different)
            known = np.zeros(len(different), bool)
            inside = at < len(self.hash)
            known[inside] = self.hash[at[inside]] == different[inside]
            if known.all():
                break
            if len(self.hash) and len(self.hash) + int((~known).sum()) > self.limit:
                self.forget()
                known[:] = False
            new = first[~known]
            self._learn(data.tobytes(), start[new], end[new], different[~known])
        counts = self.size[at][place]
        begin_at = self.begin[at][place]
        ids = self.flat[np.repeat(begin_at - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        agree = np.ones(rows, bool)
        agree[row[~self.fine[at][place]]] = False
        return ids, np.bincount(row, weights=counts, minlength=rows).astype(np.int64), agree
