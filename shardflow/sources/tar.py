"""Tar shards as a Spark data source, for reading and writing.

``spark.read.format("shardflow_tar").load(path)`` gives one row per member:
``shard, pos, key, ext, payload, error``.  ``path`` is a folder or a tar file;
several of them are given as a JSON list in the option ``paths``.  A folder
written by the sink holds a list of its shards, and only those are read.  Options:

* ``mode``: what to do with a damaged shard.  ``PERMISSIVE`` (default) gives a
  row with ``error``, ``DROPMALFORMED`` goes on without one, ``FAILFAST`` ends
  the job.
* ``splitBytes`` (1 GiB): a longer shard is read by several tasks.  Each task
  steps over the headers and reads the payloads of the members that begin in
  its range.

``df.write.format("shardflow_tar").mode("append").save(path)`` takes rows
``shard, key, ext, payload`` that are grouped by shard (see ``write_tar``).
"""

from __future__ import annotations

import io
import json
import posixpath
import tarfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from shardflow.functions.columns import shard_name
from shardflow.sources.files import filesystem, read_payloads

FORMAT = "shardflow_tar"
SCHEMA = "shard string, pos bigint, key string, ext string, payload binary, error string"
ARROW = pa.schema(
    [
        ("shard", pa.string()),
        ("pos", pa.int64()),
        ("key", pa.string()),
        ("ext", pa.string()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)
#: The index of a folder of shards (see ``sources.tar_samples``), and where the sink writes it.
INDEX_SCHEMA = pa.schema(
    [
        ("shard", pa.string()),
        ("pos", pa.int64()),
        ("key", pa.string()),
        ("ext", pa.string()),
        ("header", pa.int64()),
        ("offset", pa.int64()),
        ("size", pa.int64()),
    ]
)
INDEX_COLUMNS = "shard string, pos long, key string, ext string, header long, offset long, size long"
INDEX_FOLDER = "index"
SPLIT_BYTES = 1 << 30
READ_AHEAD = 4 << 20
# Members go to Spark in batches of at most so many bytes (and the one that passes it) or rows.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1024


#: Names of the shards that a finished job has written, one in a line.
COMMITTED = "_shards"


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)

    def writer(self, schema, overwrite: bool) -> TarWriter:
        if overwrite:
            raise ValueError("use write_tar(..., overwrite=True)")
        return TarWriter(self.options)


@dataclass
class TarRange(InputPartition):
    path: str
    first: int
    end: int


class TarReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.mode = options.get("mode", "PERMISSIVE").upper()
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[TarRange]:
        out = []
        for path in self.paths:
            system, at = filesystem(path)
            info = system.get_file_info(at)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            if info.type == fs.FileType.Directory:
                found = system.get_file_info(fs.FileSelector(at))
                files = sorted((f for f in found if f.extension == "tar" and f.is_file), key=lambda f: f.path)
                if any(f.base_name == COMMITTED for f in found):
                    with system.open_input_stream(f"{at.rstrip('/')}/{COMMITTED}") as listed:
                        written = set(listed.read().decode().split("\n"))
                    files = [f for f in files if f.base_name in written]
                prefix = path.rstrip("/")
                named = [(f"{prefix}/{f.base_name}", f.size) for f in files]
            else:
                named = [(path, info.size)]
            for name, size in named:
                for first in range(0, max(size, 1), self.split):
                    out.append(TarRange(name, first, first + self.split))
        return out or [TarRange("", 0, 0)]

    def read(self, partition: TarRange):
        if not partition.path:
            return
        rows, held = [], 0
        for row in self._members(partition):
            rows.append(row)
            held += len(row[4] or b"")
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _record_batch(rows)
                rows, held = [], 0
        if rows:
            yield _record_batch(rows)

    def _members(self, partition: TarRange):
        shard = posixpath.basename(partition.path)
        system, at = filesystem(partition.path)
        pos, at_header = 0, 0
        try:
            # Headers and payloads come from one buffer, not a request each.
            with io.BufferedReader(system.open_input_file(at), READ_AHEAD) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
                for member in tar:
                    at_header = member.offset
                    if at_header >= partition.end:
                        return
                    if not member.isfile():
                        continue
                    if at_header >= partition.first:
                        payload = tar.extractfile(member).read()
                        if len(payload) < member.size:
                            raise tarfile.ReadError("unexpected end of data")
                        key, ext = posixpath.splitext(member.name)
                        yield (shard, pos, key, ext[1:].lower(), payload, None)
                    pos += 1
                    tar.members.clear()  # keep no list of what has been read
                # A bad header ends the iteration like the zero block at the end does.
                at_header = tar.offset
                raw.seek(at_header)
                if raw.read(tarfile.BLOCKSIZE).strip(b"\0"):
                    raise tarfile.ReadError("bad header")
        except (tarfile.TarError, OSError) as e:
            # Tasks that share a shard leave the report to the one whose range it is.
            if not partition.first <= at_header < partition.end:
                return
            if self.mode == "FAILFAST":
                raise
            if self.mode == "PERMISSIVE":
                yield (shard, pos, None, None, None, f"{type(e).__name__}: {e}")


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("shard", "key", "ext", "payload")))


@dataclass
class Written(WriterCommitMessage):
    shards: list[str]
    index: list[str]


class TarWriter(DataSourceArrowWriter):
    """Each task writes its shards to their place; the driver only writes the list of them.

    A shard's bytes follow from its samples, so a repeated attempt writes the
    same.  On an object store a file appears when it is closed; on a file
    system the task renames it then.
    """

    def __init__(self, options) -> None:
        self.path = options["path"].rstrip("/")
        self.index = options.get("index", "false").lower() == "true"

    def write(self, batches) -> Written:
        system, root = filesystem(self.path)
        renames = not isinstance(system, fs.S3FileSystem)
        if renames:
            system.create_dir(root, recursive=True)
        shards, current, out, tar, part, pos = [], None, None, None, None, 0
        index, rows = f"part-{uuid.uuid4().hex}.parquet", []
        if self.index:
            system.create_dir(f"{root}/{INDEX_FOLDER}", recursive=True)
            listed_to = system.open_output_stream(f"{root}/{INDEX_FOLDER}/{index}")
            listed = pq.ParquetWriter(listed_to, INDEX_SCHEMA)

        def note(row: tuple | None) -> None:
            rows.extend([row] if row else [])
            if rows and (row is None or len(rows) == 10_000):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), INDEX_SCHEMA.types)]
                listed.write_table(pa.Table.from_arrays(columns, schema=INDEX_SCHEMA))
                rows.clear()

        def finish() -> None:
            if tar is not None:
                tar.close()
                out.close()
                if renames:
                    system.move(part, f"{root}/{current}")

        for shard, key, ext, payload in _rows(batches):
            if shard != current:
                finish()
                current, part = shard, f"{root}/_part-{uuid.uuid4().hex}" if renames else f"{root}/{shard}"
                shards.append(shard)
                pos = 0
                out = system.open_output_stream(part)
                # One member after the other, straight to the output.
                tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.GNU_FORMAT)
            info = tarfile.TarInfo(f"{key}.{ext}")
            info.size = len(payload)
            header = tar.offset
            tar.addfile(info, io.BytesIO(payload))
            if self.index:
                # The payload, filled up to whole blocks, is what stands last.
                blocks = -(-info.size // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
                name, suffix = posixpath.splitext(info.name)
                note((shard, pos, name, suffix[1:].lower(), header, tar.offset - blocks, info.size))
            pos += 1
        finish()
        if self.index:
            note(None)
            listed.close()
            listed_to.close()
        return Written(shards, [index] if self.index else [])

    def commit(self, messages) -> None:
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{COMMITTED}") as out:
            out.write("\n".join(sorted(s for m in messages if m for s in m.shards)).encode())
        if self.index:
            system.create_dir(f"{root}/{INDEX_FOLDER}", recursive=True)
            with system.open_output_stream(f"{root}/{INDEX_FOLDER}/{COMMITTED}") as out:
                out.write("\n".join(sorted(n for m in messages if m for n in m.index)).encode())

    def abort(self, messages) -> None:
        """What was written has no list and is in nobody's way: the next write must overwrite it."""


def read_tar(spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Members of the shards in a folder, of one tar file, or of a list of both."""
    spark.dataSource.register(TarSource)
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.format(FORMAT).option("mode", mode).option("splitBytes", split_bytes)
    return reader.option("paths", json.dumps(paths)).load()


def write_tar(members: DataFrame, path: str, prefix: str = "shard_", *, overwrite: bool = False, shards_per_task: int = 4, index: bool = False) -> None:
    """Write members ``shard, pos, key, ext, payload``; ``shard`` counts from zero.

    Without ``payload`` the members are files: each task reads them from
    ``path`` after the shuffle, which then moves names and no contents.

    A folder that has files is refused; with ``overwrite`` they are removed
    first.  One shuffle brings each shard together, into as many tasks as the number of
    shards asks for; sorting keeps one tar open at a time.  With ``index`` every
    task also writes where its members stand (see ``sources.tar_samples.tar_index``).
    """
    spark = members.sparkSession
    spark.dataSource.register(TarSource)
    system, root = filesystem(path)
    if system.get_file_info(root).type == fs.FileType.Directory and system.get_file_info(fs.FileSelector(root)):
        if not overwrite:
            raise FileExistsError(f"{path} is not empty")
        system.delete_dir_contents(root)
    shards = (members.agg(F.max("shard")).first()[0] or 0) + 1
    placed = members.repartition(max(1, -(-shards // shards_per_task)), "shard").sortWithinPartitions("shard", "pos", "ext")
    rows = placed if "payload" in members.columns else read_payloads(placed)
    (
        rows.select(shard_name("shard", prefix).alias("shard"), "key", "ext", "payload")
        .write.format(FORMAT)
        .option("index", index)
        .mode("append")
        .save(path)
    )
