"""File listings as manifests, image folders, and file copies by executors."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardflow.functions import columns as C
from shardflow.operators.samples import with_path_parts
from shardflow.scratch import materialise


LISTING = "path string, length bigint, modificationTime timestamp, folder boolean"


def scan(spark: SparkSession, root: str, exts: Iterable[str] | None = None, recursive: bool = True) -> DataFrame:
    """Manifest of all files below ``root``; contents are not read.

    Executors list folder by folder into a written table, one job for a level of
    folders, so neither the driver nor a status call per file is in the way.  A local folder
    is listed ``LISTED_ROWS`` files at a time, however many it has.
    Names with ``.`` or ``_`` in front and files without bytes are listed like
    any other; ``functions.columns.is_visible`` and a length tell them apart.
    ``exts`` is applied while listing.  A root that is a file is an error.
    """
    wanted = None if exts is None else sorted({e.lower() for e in exts})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["path"]:
                prefix = folder.rstrip("/")
                for found in listed_pieces(folder):
                    rows = [
                        (f"{prefix}/{f.base_name}", None if f.is_file is False else f.size, f.mtime, f.type == fs.FileType.Directory)
                        for f in found
                        if f.type == fs.FileType.Directory or wanted is None or f".{f.extension.lower()}" in wanted
                    ]
                    yield pd.DataFrame(rows, columns=["path", "length", "modificationTime", "folder"]).astype({"length": "Int64", "folder": bool})

    system, at = filesystem(root)
    if system.get_file_info(at).type != fs.FileType.Directory:
        raise NotADirectoryError(root)
    start = root.rstrip("/") if SCHEME_NAME.match(root) else "file:" + re.sub("/+$", "", at)
    level = spark.createDataFrame([(start,)], "path string")
    found = []
    while True:
        listed = materialise(level.mapInPandas(run, LISTING), "listing")
        found.append(listed.where("not folder").drop("folder"))
        level = listed.where("folder").select("path")
        if not recursive or level.isEmpty():
            break
        level = level.repartition("path")
    table = found[0]
    for more in found[1:]:
        table = table.unionByName(more)
    return with_path_parts(table)


LISTED_ROWS = 10_000


def listed_pieces(folder: str) -> Iterator[list[fs.FileInfo]]:
    """The files and folders in a folder, some at a time; an empty folder gives one empty piece.

    A store lists a folder by pyarrow, whole; a local folder is gone through by its names.
    """
    system, at = filesystem(folder)
    if not isinstance(system, fs.LocalFileSystem):
        found = system.get_file_info(fs.FileSelector(at))
        for k in range(0, max(1, len(found)), LISTED_ROWS):
            yield found[k : k + LISTED_ROWS]
        return
    with os.scandir(at) as names:
        some = [entry.path for entry in islice(names, LISTED_ROWS)]
        while True:
            # What has gone since, and a link to nothing, is left out as pyarrow does.
            yield [f for f in system.get_file_info(some) if f.type != fs.FileType.NotFound]
            if not (some := [entry.path for entry in islice(names, LISTED_ROWS)]):
                break


# The scheme of a path with the slashes after it.
SCHEME = "^([a-z0-9]+:)?/+"
SCHEME_NAME = re.compile("^[a-z0-9]+:")


def any_case(ext: str) -> str:
    """A glob of an extension in any case: ``.png`` as ``*.[pP][nN][gG]``."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def images(spark: SparkSession, root: str, exts: Iterable[str] | None = None, drop_invalid: bool = False) -> DataFrame:
    """Images decoded on the executors: ``path, image``; files of other extensions are not read.

    A file that cannot be decoded has an image of height -1, or is left out with ``drop_invalid``.
    """
    reader = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", str(drop_invalid).lower())
    if exts is not None:
        reader = reader.option("pathGlobFilter", "{" + ",".join(any_case(e) for e in sorted(exts)) + "}")
    return reader.load(root).select(F.col("image.origin").alias("path"), "image")


# One client for a store, in every task; options (region, anonymous access) by bucket.
_clients: dict = {}
_options: dict = {}


def client_options(bucket: str, **options) -> None:
    """Settings of the client for ``s3a://bucket``, as ``pyarrow.fs.S3FileSystem`` takes them; they travel with the jobs."""
    _options[bucket] = options
    _clients.pop(bucket, None)


def filesystem(path: str):
    """The pyarrow file system of a path or URI, and the path on it; one client is kept for a store."""
    if path.startswith("file:") or path.startswith("/"):
        return _clients.setdefault("", fs.LocalFileSystem()), re.sub(SCHEME, "/", path)
    scheme, rest = re.match("^([a-z0-9]+)://(.*)$", path).groups()
    bucket = rest.split("/", 1)[0]
    if scheme in ("s3", "s3a"):
        if bucket not in _clients:
            _clients[bucket] = fs.S3FileSystem(**_options[bucket]) if bucket in _options else fs.FileSystem.from_uri(f"s3://{bucket}")[0]
        return _clients[bucket], rest.rstrip("/")
    return fs.FileSystem.from_uri(path)


def read_file(path: str) -> bytes:
    system, at = filesystem(path)
    with system.open_input_stream(at) as f:
        return f.read()


def put_file(path: str, data: bytes | pa.Buffer) -> None:
    """Write a file under a temporary name and move it into place."""
    system, at = filesystem(path)
    folder, _, name = at.rpartition("/")
    if folder not in _folders:
        system.create_dir(folder, recursive=True)
        _folders.add(folder)
    part = f"{folder}/_part-{uuid.uuid4().hex}-{name}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, at)


# Folders a task has made.
_folders: set[str] = set()


def read_payloads(df: DataFrame, path: str = "path", payload: str = "payload") -> DataFrame:
    """Add the bytes of each row's file, read on the executors.

    Rows keep their place, so files can be read after all shuffles are done and
    their bytes never travel between executors.  A file that cannot be read
    ends the job; a listing made just before is what makes that rare.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(payload, T.BinaryType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                rows = frame.iloc[at : at + 64]
                yield rows.assign(**{payload: [read_file(name) for name in rows[path]]})

    return df.mapInPandas(run, schema)


def write_files(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Write each row's bytes to its path on the executors; gives ``path, ok, error``.

    Lazy like any other transformation, and writing a file again gives the
    same file.  Bytes go from a batch to their files without a copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for to, data in zip(batch.column("path"), batch.column("content")):
                if not data.is_valid:
                    raise TypeError(f"no content for {to}")
                try:
                    put_file(to.as_py(), data.as_buffer())
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string())], ["path", "ok", "error"]
            )

    rows = df.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return rows.mapInArrow(run, "path string, ok boolean, error string")


def copy_files(manifest: DataFrame, target: str, exts: Iterable[str] = C.COPY_EXTS) -> DataFrame:
    """Copy visible files into ``target/<class>/<name>``; gives ``class, name, src, dst, ok, error``.

    Only paths travel through Spark; each task streams its files from source
    to target.  A file that fails is reported and the others go on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = []
            for src, dst in zip(frame["src"], frame["dst"]):
                try:
                    stream_copy(src, dst)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield frame.assign(ok=[e is None for e in errors], error=errors)

    rows = manifest.where(C.is_visible("class", "name") & C.has_ext("name", exts)).select(
        "class",
        "name",
        F.col("path").alias("src"),
        F.concat_ws("/", F.lit(target.rstrip("/")), "class", "name").alias("dst"),
    )
    return rows.mapInPandas(run, "class string, name string, src string, dst string, ok boolean, error string")


def stream_copy(src: str, dst: str, piece: int = 4 << 20) -> None:
    from_fs, from_path = filesystem(src)
    to_fs, to_path = filesystem(dst)
    folder, _, name = to_path.rpartition("/")
    to_fs.create_dir(folder, recursive=True)
    part = f"{folder}/_part-{uuid.uuid4().hex}-{name}"
    with from_fs.open_input_stream(from_path) as data, to_fs.open_output_stream(part) as out:
        while block := data.read(piece):
            out.write(block)
    to_fs.move(part, to_path)
