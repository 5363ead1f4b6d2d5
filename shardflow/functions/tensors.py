"""Small numpy helpers on single images, used inside map tasks."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np


# Whole-number weights have this many fraction bits: 255 times a sum of weights stays below 2 ** 31.
WEIGHT_BITS = 22
# Values summed at once: they should stay in a core's cache.
BLOCK_VALUES = 1 << 16

# Taps by (in, out) size, kept for the length of a task.
_taps: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def bilinear_taps(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Source places and weights ``(taps, n_out)`` of triangle-filter resampling along one axis.

    When shrinking, the triangle is widened by the scale, so that every source
    pixel counts.  A tap outside the axis stands at its edge and weighs nothing.
    """
    if (n_in, n_out) in _taps:
        return _taps[n_in, n_out]
    scale = n_in / n_out
    width = max(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) * scale
    first = np.floor(centre - width).astype(np.int64)
    at = first[None, :] + np.arange(int(np.ceil(2 * width)) + 1)[:, None]
    w = np.clip(1.0 - np.abs(at + 0.5 - centre[None, :]) / width, 0.0, None)
    w[(at < 0) | (at >= n_in)] = 0.0
    used = w.any(axis=1)
    if len(_taps) >= 256:
        _taps.clear()
    _taps[n_in, n_out] = at, w = np.clip(at[used], 0, n_in - 1), w[used] / w.sum(axis=0)
    return at, w


def _along_first(values: np.ndarray, n_out: int, whole: bool) -> np.ndarray:
    """Resize the first axis of ``(n_in, rest)``; ``whole`` sums whole numbers and gives bytes."""
    at, w = bilinear_taps(values.shape[0], n_out)
    kind, made = (np.int32, np.uint8) if whole else (np.float64, np.float64)
    w = np.floor(w * (1 << WEIGHT_BITS) + 0.5).astype(np.int32) if whole else w
    out = np.empty((n_out, values.shape[1]), made)
    step = max(1, BLOCK_VALUES // max(1, values.shape[1]))
    for x in range(0, n_out, step):
        block = slice(x, min(n_out, x + step))
        total = np.full((block.stop - x, values.shape[1]), 1 << (WEIGHT_BITS - 1) if whole else 0, kind)
        for place, weight in zip(at[:, block], w[:, block]):
            total += np.multiply(values[place], weight[:, None], dtype=kind)
        out[block] = total >> WEIGHT_BITS if whole else total
    return out


def _resize_axis(planes: np.ndarray, axis: int, n_out: int, whole: bool) -> np.ndarray:
    front = np.moveaxis(planes, axis, 0)
    done = _along_first(np.ascontiguousarray(front).reshape(len(front), -1), n_out, whole)
    return np.moveaxis(done.reshape(n_out, *front.shape[1:]), 0, axis)


def resize_planes(planes: np.ndarray, height: int, width: int, rounding: str = "uint8") -> np.ndarray:
    """Resize ``(n, c, h, w)``: first along rows, then along columns.

    ``uint8`` takes whole pixel values and whole-number weights and rounds to
    bytes after each axis, ``none`` keeps fractions.  An output pixel costs its
    taps, two when enlarging, whatever the size of the image.
    """
    if rounding not in ("uint8", "none"):
        raise ValueError(f"unknown rounding {rounding!r}")
    whole = rounding == "uint8"
    out = planes.astype(np.uint8 if whole else np.float64, copy=False)
    if out.shape[3] != width:
        out = _resize_axis(out, 3, width, whole)
    if out.shape[2] != height:
        out = _resize_axis(out, 2, height, whole)
    return out


def resize_stack(pixels: np.ndarray, height: int, width: int, rounding: str = "uint8") -> np.ndarray:
    """``resize_planes`` for ``(n, h, w, c)``."""
    return resize_planes(pixels.transpose(0, 3, 1, 2), height, width, rounding).transpose(0, 2, 3, 1)


def to_rgb(pixels: np.ndarray, bgr: bool = False) -> np.ndarray:
    """``(h, w, c)`` with 1, 3 or 4 channels to three channels; alpha is dropped."""
    if pixels.shape[2] == 1:
        return np.repeat(pixels, 3, axis=2)
    rgb = pixels[:, :, :3]
    return rgb[:, :, ::-1] if bgr else rgb


def pillow_decoder() -> Callable[[bytes], np.ndarray]:
    """RGB pixels ``(h, w, 3)`` of encoded bytes, by Pillow; called once in a task, so a worker without it is one clear error."""
    try:
        from PIL import Image
    except ImportError as e:
        raise ImportError("decoding encoded bytes needs Pillow on every worker, or another decoder") from e
    return lambda data: np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
