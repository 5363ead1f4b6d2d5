"""Column expressions on paths, labels, numbers and payloads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The file name endings each kind of loader accepts.
ITERABLE_EXTS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")
OBJECT_STORE_EXTS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff")
COPY_EXTS = (".jpg", ".jpeg", ".png")
PNG_ONLY = (".png",)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: Column | str, b: Column | str | int) -> Column:
    """Whole-number division that stays exact beyond 2**53."""
    b = F.lit(b) if isinstance(b, int) else _col(b)
    return F.call_function("div", _col(a), b)


# --- paths -----------------------------------------------------------------


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def folder_name(path: Column | str) -> Column:
    """Name of the folder a file lies in, which is the class of a sample."""
    return F.element_at(F.split(_col(path), "/"), -2)


def file_ext(name: Column | str) -> Column:
    """Last extension with its dot, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(_col(name), r"[^/](\.[^./]*)$", 1))


def file_stem(name: Column | str) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(name), r"(?<=.)\.[^.]*$", "")


def has_ext(path: Column | str, exts: Iterable[str]) -> Column:
    return file_ext(path).isin([e.lower() for e in exts])


def is_visible(*names: Column | str) -> Column:
    """No given name starts with a dot."""
    ok = F.lit(True)
    for name in names:
        ok = ok & ~F.startswith(_col(name), F.lit("."))
    return ok


def depth_below(path: Column | str, base: str) -> Column:
    """How many steps ``path`` lies below the folder ``base``; 1 is a direct child."""
    return F.size(F.split(_col(path), "/")) - len(base.rstrip("/").split("/"))


def normalise_uri(uri: Column | str, scheme: str = "s3://") -> Column:
    """Drop trailing slashes and the scheme: ``s3://b/p//`` becomes ``b/p``."""
    bare = F.regexp_replace(_col(uri), "/+$", "")
    return F.when(F.startswith(bare, F.lit(scheme)), F.substr(bare, F.lit(len(scheme) + 1))).otherwise(bare)


# --- labels ----------------------------------------------------------------


def zero_pad(value: Column | str, width: int) -> Column:
    """Pad with zeros to ``width``; longer values are kept whole."""
    text = _col(value).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def shard_name(shard: Column | str, prefix: str = "shard_", width: int = 2, suffix: str = ".tar") -> Column:
    """File name of a 0-based shard; names count from one."""
    return F.concat(F.lit(prefix), zero_pad(_col(shard) + 1, width), F.lit(suffix))


def composite_label(class_: Column | str, name: Column | str, index: Column | str) -> Column:
    """``class/name/count`` with a count from one."""
    return F.concat_ws("/", _col(class_), _col(name), (_col(index) + 1).cast("string"))


def label_json(label: Column | str) -> Column:
    """The JSON text stored next to an image, as ``{"label": "real"}``."""
    compact = F.to_json(F.struct(_col(label).alias("label")))
    return F.concat(F.lit('{"label": '), F.substr(compact, F.lit(len('{"label":') + 1)))


def payload_kind(pixels: Column | str, payload: Column | str) -> Column:
    """How a collate step treats a value: decoded pixels, encoded bytes or as is."""
    return (
        F.when(_col(pixels).isNotNull(), "image")
        .when(_col(payload).isNotNull(), "bytes")
        .otherwise("passthrough")
    )


# --- numbers ---------------------------------------------------------------


def safe_double(value: Column | str) -> Column:
    """The number in a text, or null when it holds none."""
    return F.trim(_col(value)).try_cast("double")


def bytes_to_gib(n: Column | str) -> Column:
    return _col(n) / F.lit(float(1024**3))


def bytes_to_mib(n: Column | str) -> Column:
    return _col(n) / F.lit(float(1024**2))


def seconds_to_us(t: Column | str) -> Column:
    return _col(t) * F.lit(1e6)


def rate(n: Column | str, seconds: Column | str) -> Column:
    """``n / seconds``, and zero when no time has passed."""
    s = _col(seconds).cast("double")
    return F.when(s > 0, _col(n).cast("double") / s).otherwise(F.lit(0.0))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    longest = max(map(len, taken), default=0)
    return [next(n for n in (name + "_" * k for k in range(longest + 2)) if n.lower() not in taken) for name in names]
