"""Decode, resize and tensor jobs on image columns.

Pixels stay on the executors.  An image row is ``(height, width, channels,
pixels)`` with ``pixels`` as bytes in row, column, channel order; a tensor row
is ``(c, h, w, px)`` with ``px`` as a flat float array in channel order, or,
``packed``, as the bytes of those floats, which pass Spark without a look at
each value and are what a consumer on a tensor library reads.
A task works on a few images at a time and never on a whole partition.
``load_tensors`` does the whole way from file to tensor in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shardflow.functions.tensors import pillow_decoder, resize_planes, resize_stack, to_rgb
from shardflow.operators.mapping import MODES, map_samples
from shardflow.sources.files import read_file

Decoder = Callable[[], Callable[[bytes], np.ndarray]]
IMAGE = "height int, width int, channels int, pixels binary"
TENSOR = "c int, h int, w int, px array<float>"
PACKED = "c int, h int, w int, px binary"


def _kept(df: DataFrame, keep: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in keep]


def _schema(df: DataFrame, keep: Sequence[str], ddl: str) -> T.StructType:
    return T.StructType([*_kept(df, keep), *T.StructType.fromDDL(ddl).fields])


def _image_rows(rows: pd.DataFrame, keep: Sequence[str], images: list[np.ndarray]) -> pd.DataFrame:
    out = rows[list(keep)].copy()
    out["height"] = [a.shape[0] for a in images]
    out["width"] = [a.shape[1] for a in images]
    out["channels"] = [a.shape[2] for a in images]
    out["pixels"] = [np.ascontiguousarray(a).tobytes() for a in images]
    return out


def _arrays(rows: Mapping | pd.DataFrame) -> list[np.ndarray]:
    return [
        np.frombuffer(p, np.uint8).reshape(h, w, c)
        for p, h, w, c in zip(rows["pixels"], rows["height"], rows["width"], rows["channels"])
    ]


# The float of each pixel value.
LEVELS = (np.arange(256) / 255.0).astype(np.float32)

# Values of a stack that is worked on at once: it should stay in a core's cache.
STACK_VALUES = 1 << 19


def _by_shape(images: list[np.ndarray], call, cells: int = 0) -> list[np.ndarray]:
    """Apply ``call`` to stacks of equal shape and give results in the old order.

    ``cells`` is height times width of the result, where that is known to differ.
    """
    places: dict[tuple, list[int]] = {}
    for k, a in enumerate(images):
        places.setdefault(a.shape, []).append(k)
    out: list = [None] * len(images)
    for shape, at in places.items():
        step = max(1, STACK_VALUES // max(1, shape[2] * max(shape[0] * shape[1], cells)))
        for first in range(0, len(at), step):
            some = at[first : first + step]
            for k, a in zip(some, call(np.stack([images[k] for k in some]))):
                out[k] = a
    return out


def _flat_images(df: DataFrame, keep: Sequence[str], image: str) -> DataFrame:
    """The image struct as columns; a row that could not be decoded is an error."""
    height = F.when(F.col(f"{image}.height") >= 0, F.col(f"{image}.height")).otherwise(
        F.raise_error(F.concat(F.lit("cannot decode "), F.coalesce(f"{image}.origin", F.lit("an image"))))
    )
    names = {"height": "height", "width": "width", "nChannels": "channels", "data": "pixels"}
    return df.withColumn(image, F.col(image).withField("height", height)).select(*keep, *[F.col(f"{image}.{k}").alias(v) for k, v in names.items()])


def rgb_images(df: DataFrame, keep: Sequence[str], *, image: str = "image") -> DataFrame:
    """RGB pixels of rows that Spark's image source has decoded on the executors; one it could not decode is an error."""
    flat = _flat_images(df, keep, image)

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        return _image_rows(rows, keep, [to_rgb(a, bgr=True) for a in _arrays(rows)])

    return map_samples(flat, call, _schema(df, keep, IMAGE), chunk=32)


def decode_payloads(
    df: DataFrame, keep: Sequence[str], payload: str = "payload", mode: str = "PERMISSIVE", decoder: Decoder = pillow_decoder
) -> DataFrame:
    """RGB pixels of encoded image bytes, as read from shards; ``decoder`` makes the decoding function, once a task."""

    def call(rows: pd.DataFrame, decode) -> pd.DataFrame:
        return _image_rows(rows, keep, [decode(bytes(p)) for p in rows[payload]])

    return map_samples(df.select(*keep, payload), call, _schema(df, keep, IMAGE), mode=mode, chunk=32, setup=decoder)


def _resized(height: int, width: int):
    """Resize whole pixel values, then scale."""
    return lambda planes: LEVELS[resize_planes(planes, height, width, "uint8")]


def _scaled_first(height: int, width: int):
    """Scale first and resize fractions, without rounding between."""
    return lambda planes: resize_planes(planes / 255.0, height, width, "none")


def resize_to_tensor(
    df: DataFrame, keep: Sequence[str], height: int, width: int, packed: bool = False
) -> DataFrame:
    """Resize whole pixel values, then scale to floats in 0..1, channels first."""
    return _image_tensors(df, keep, _resized(height, width), height * width, packed)


def images_to_tensor(
    df: DataFrame, keep: Sequence[str], height: int, width: int, *, image: str = "image", packed: bool = False
) -> DataFrame:
    """``rgb_images`` and ``resize_to_tensor`` in one Python pass over rows of Spark's image source."""
    return _image_tensors(_flat_images(df, keep, image), keep, _resized(height, width), height * width, packed, bgr=True)


def tensor_then_resize(
    df: DataFrame, keep: Sequence[str], height: int, width: int, packed: bool = False
) -> DataFrame:
    """Scale to floats first and resize those, without rounding between."""
    return _image_tensors(df, keep, _scaled_first(height, width), height * width, packed)


def to_tensor(df: DataFrame, keep: Sequence[str], packed: bool = False) -> DataFrame:
    """Whole pixel values, channels last, to floats in 0..1, channels first."""
    return _image_tensors(df, keep, lambda planes: LEVELS[planes], 0, packed)


def load_tensors(
    df: DataFrame,
    keep: Sequence[str],
    height: int,
    width: int,
    *,
    path: str | None = None,
    payload: str | None = None,
    scale_first: bool = False,
    mode: str = "PERMISSIVE",
    packed: bool = True,
    decoder: Decoder = pillow_decoder,
) -> DataFrame:
    """Encoded images to tensors in one Python pass: read, decode, resize, scale.

    Images come from the files named in ``path`` or from the bytes in
    ``payload``.  Neither encoded nor decoded pixels pass between processes.
    An image that cannot be read or decoded is treated as ``mode`` says (see
    ``map_samples``).  ``decoder`` makes the decoding function, once a task.
    """
    if (path is None) == (payload is None):
        raise ValueError("give either path or payload")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    source = path or payload

    held: list = []  # the task's decoder

    def images_of(rows: pa.RecordBatch):
        if not held:
            held.append(decoder())
        decode_image = held[0]
        images, errors = [], []
        for value in rows.column(source).to_pylist():
            try:
                images.append(decode_image(read_file(value) if path else value))
                errors.append(None)
            except Exception as e:  # whatever a decoder raises belongs to its image
                if mode == "FAILFAST":
                    raise
                images.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return images, errors

    tensors = (_scaled_first if scale_first else _resized)(height, width)
    columns = [*keep, *([source] if source not in keep else [])]
    out = _tensor_map(df.select(*columns), keep, images_of, tensors, height * width, packed)
    return out if mode == "PERMISSIVE" else out.where("error is null").drop("error")


def _image_tensors(df: DataFrame, keep: Sequence[str], tensors, cells: int, packed: bool, bgr: bool = False) -> DataFrame:
    def images_of(rows: pa.RecordBatch):
        images = _arrays({n: rows.column(n).to_pylist() for n in ("height", "width", "channels", "pixels")})
        return [to_rgb(a, bgr=True) for a in images] if bgr else images, [None] * len(images)

    images = df.select(*keep, "height", "width", "channels", "pixels")
    return _tensor_map(images, keep, images_of, tensors, cells, packed).drop("error")


def _tensor_map(df: DataFrame, keep: Sequence[str], images_of, tensors, cells: int, packed: bool) -> DataFrame:
    """Map images to tensors, with Arrow on both sides so that no value becomes a Python object."""
    chunk = max(4, min(1024, (1 << 22) // (3 * cells))) if cells else 32
    schema = _schema(df, keep, f"{PACKED if packed else TENSOR}, error string")
    arrow = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, chunk):
                rows = part.slice(at, chunk)
                images, errors = images_of(rows)
                good = [a for a in images if a is not None]
                done = _by_shape(good, lambda stack: tensors(stack.transpose(0, 3, 1, 2)).astype(np.float32, copy=False), cells)
                flat = np.concatenate([a.ravel() for a in done]) if done else np.zeros(0, np.float32)
                ends = np.cumsum([0, *(a.size for a in done)]).astype(np.int32)
                shapes = [pa.array([a.shape[k] for a in done], pa.int32()) for k in range(3)]
                if packed:
                    px = pa.Array.from_buffers(pa.binary(), len(done), [None, pa.py_buffer(ends * 4), pa.py_buffer(flat)])
                else:
                    px = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), type=arrow.field("px").type)
                made = [*shapes, px]
                if len(good) < len(images):
                    place = np.cumsum([a is not None for a in images]) - 1
                    back = pa.array([int(k) if a is not None else None for k, a in zip(place, images)], pa.int32())
                    made = [m.take(back) for m in made]
                kept = [rows.column(n) for n in keep]
                yield pa.RecordBatch.from_arrays([*kept, *made, pa.array(errors, pa.string())], schema=arrow)

    return df.mapInArrow(run, schema)


def resize_images(
    df: DataFrame, keep: Sequence[str], height: int, width: int, chunk: int = 32
) -> DataFrame:
    """Resize and keep whole pixel values."""

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        done = _by_shape(_arrays(rows), lambda stack: resize_stack(stack, height, width, "uint8"), height * width)
        return _image_rows(rows, keep, done)

    images = df.select(*keep, "height", "width", "channels", "pixels")
    return map_samples(images, call, _schema(df, keep, IMAGE), chunk=chunk)
