"""PNG files for the stand-ins and tests: written, and read back where no image library is installed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

from shardflow.functions.tensors import to_rgb

# Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_CHANNELS = {0: 1, 2: 3, 6: 4}  # colour type to channels: grey, RGB, RGBA


def png_bytes(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of ``(h, w, c)`` pixels with 1, 3 or 4 channels."""
    h, w, c = pixels.shape
    colour = {n: t for t, n in PNG_CHANNELS.items()}[c]
    rows = np.zeros((h, 1 + w * c), np.uint8)
    rows[:, 1:] = pixels.reshape(h, w * c)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """Pixels ``(h, w, c)`` of an 8-bit, not interlaced grey, RGB or RGBA PNG."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in PNG_CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    w, h, c = head[0], head[1], PNG_CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w + 1, c), np.int16)  # one row and column of zeros before the image
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].reshape(w, c).astype(np.int16)
        up = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) % 256
        elif kind == 2:
            out[y + 1, 1:] = (line + up) % 256
        elif kind in (3, 4):
            for x in range(w):
                a, b, d = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = np.abs(np.stack([b - d, a - d, a + b - 2 * d]))
                    guess = np.choose(near.argmin(axis=0), [a, b, d])
                out[y + 1, x + 1] = (line[x] + guess) % 256
        else:
            raise ValueError("unknown PNG filter")
    return out[1:, 1:].astype(np.uint8)


def png_decoder() -> Callable[[bytes], np.ndarray]:
    """A decoder for the kind of PNG that ``png_bytes`` writes."""
    return lambda data: to_rgb(png_pixels(data))
