"""SentencePiece models on the tokenizers library.

The model file is a protobuf of three parts: pieces with scores and kinds, the
trainer's settings and the normaliser's.  Only the wire format is read here; the
tokenizer is put together from it: normaliser, meta space marker, unigram
scores or BPE merges in order of score, byte fallback.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Fixed values of the model format: kinds of pieces and of models, the marker for a space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARKER = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of every field of a message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if wire == 2:
            size = varint()
        if size is None or at + size > len(data):
            raise ValueError("not a SentencePiece model")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces_go: bool = True
    marks_spaces: bool = True

    def plain(self) -> bool:
        """Whether a text may be encoded in units.

        So it is when the normaliser only marks spaces and adds its prefix, every
        letter has a code (byte fallback), and no piece has a space after
        another letter.
        """
        inside = any(MARKER in p.lstrip(MARKER) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        listed = any(kind == USER_DEFINED for _, _, kind in self.pieces)
        return not (inside or listed or self.charsmap or self.extra_spaces_go or not self.dummy_prefix or not self.marks_spaces or not self.byte_fallback)


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.extra_spaces_go = bool(v)
                elif n == 5:
                    model.marks_spaces = bool(v)
    if not model.pieces:
        raise ValueError("not a SentencePiece model")
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """All ways to put a piece together from two others, best piece first."""
    known = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, k in known.items():
        for cut in range(1, len(piece)):
            left, right = known.get(piece[:cut]), known.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-model.pieces[k][1], left, right, piece[:cut], piece[cut:]))
    return [(left, right) for *_, left, right in sorted(found)]


def tokenizer(model: Model, prefix: bool = True):
    """A ``tokenizers.Tokenizer``; without ``prefix`` no dummy space is put in front."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    texts = [p for p, _, _ in model.pieces]
    unknown = next((k for k, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        # Control and unused pieces are never chosen.
        low = min(s for _, s, _ in model.pieces) - 1e6
        scored = [(p, s if kind in (NORMAL, USER_DEFINED, UNKNOWN, BYTE) else low) for p, s, kind in model.pieces]
        core = models.Unigram(scored, unknown, model.byte_fallback)
    else:
        core = models.BPE(
            {p: k for k, p in enumerate(texts)}, merges(model), fuse_unk=True, byte_fallback=model.byte_fallback,
            unk_token=None if unknown is None else texts[unknown],
        )
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.extra_spaces_go:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARKER if model.marks_spaces else " "
    if model.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(space))
    if model.marks_spaces:
        steps.append(normalizers.Replace(" ", MARKER))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    if model.plain():
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{re.escape(MARKER)}*[^{MARKER}]+|{re.escape(MARKER)}+"), "isolated")
    parts = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(parts)
    listed = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if listed:
        out.add_tokens(listed)
    return out
