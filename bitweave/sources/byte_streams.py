"""Byte streams in parts: a sink that commits whole or not at all, and a reader of byte ranges.

A stream is one file, or a folder whose parts joined in the order of their names
are the stream.  The sink writes each attempt of a task to a file of its own; the
driver moves those of the attempts that Spark accepted to their final names,
removes the rest and marks the stream with ``_SUCCESS``.  A task that is lost,
retried or run twice at a time leaves nothing behind, and a job that fails leaves
the stream as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MARK = "_SUCCESS"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its place there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parts_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of each part of a stream, in order."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != fs.FileType.Directory:
        return [(path, info.size)]
    parts = sorted((f.base_name, f.size) for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
    return [(f"{path.rstrip('/')}/{name}", size) for name, size in parts]


# -- the sink -----------------------------------------------------------------------


def joined(values: pa.Array) -> memoryview:
    """The bytes of a binary column one after the other, as they lie in memory; nulls have none."""
    values = values.drop_null().cast(pa.large_binary())
    _, offsets, data = values.buffers()
    if not len(values) or data is None:
        return memoryview(b"")
    ends = np.frombuffer(offsets, np.int64, len(values) + 1, 8 * values.offset)
    return memoryview(data)[int(ends[0]) : int(ends[-1])]


@dataclass
class Attempt(WriterCommitMessage):
    """What one accepted attempt of a task has written, and where."""

    part: int
    name: str
    n_bytes: int


class OrderedWriter(DataSourceArrowWriter):
    """Writes the first column's bytes of each partition, in the order of its rows."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.attempts = f"_attempts-{uuid.uuid4().hex}"  # of this job: others may write at the same time

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, at = opened(self.path)
        system.create_dir(f"{at}/{self.attempts}", recursive=True)
        name, n = f"{task.partitionId():06d}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(f"{at}/{self.attempts}/{name}") as f:
            for batch in iterator:
                data = joined(batch.column(0))
                n += len(data)
                f.write(data)
        return Attempt(task.partitionId(), name, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        old = [f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
        if not self.overwrite and any(f.base_name[0] not in "._" for f in old):
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds a stream already; write it with mode('overwrite')")
        for f in old:
            system.delete_file(f.path)
        for k, x in enumerate(sorted((x for x in messages if x is not None and x.n_bytes), key=lambda x: x.part)):
            system.move(f"{at}/{self.attempts}/{x.name}", f"{at}/part-{k:06d}.bin")
        self._forget(system, at)
        with system.open_output_stream(f"{at}/{MARK}"):
            pass

    def abort(self, messages: list[Attempt | None]) -> None:
        self._forget(*opened(self.path))

    def _forget(self, system: fs.FileSystem, at: str) -> None:
        if system.get_file_info(f"{at}/{self.attempts}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.attempts}")


def write_stream(rows: DataFrame, path: str, order: list[str], data: str, overwrite: bool = False) -> list[tuple[str, int]]:
    """Writes a binary column in the order of others; returns (path, bytes) of each part.

    Range partitioning keeps each part contiguous, so no task holds more than its range.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ByteStream)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(data)
    ordered.write.format("byte_stream").mode("overwrite" if overwrite else "append").save(path)
    return parts_of(path)


# -- the reader -----------------------------------------------------------------------


#: A task reads ranges of so many bytes in all, or one; where ranges are few, tasks take fewer.
TASK_BYTES = 16 << 20


@dataclass
class Range:
    """Bytes [start, start + own) of a stream and up to ``ahead`` bytes more; pieces: (path, first byte, bytes)."""

    split: int
    start: int
    own: int
    total: int
    pieces: list[tuple[str, int, int]]


class Ranges(InputPartition):
    """What one task reads, range after range."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size, self.ahead = int(options.get("split_bytes", 64 << 20)), int(options.get("ahead", 0))
        self.tasks = int(options.get("tasks", 1))
        wanted = options.get("splits", "")
        self.wanted = {int(x) for x in wanted.split(",")} if wanted else None
        if self.size < 1 or self.size + self.ahead >= 1 << 31:
            raise ValueError("split_bytes must be from 1 to 2 GB")

    def partitions(self) -> list[Ranges]:
        files, base = [], 0
        for path, size in parts_of(self.path):
            files.append((path, base, base + size))
            base += size
        out, first = [], 0
        for split, start in enumerate(range(0, base, self.size)):
            end, pieces = min(base, start + self.size + self.ahead), []
            while files[first][2] <= start:
                first += 1
            for path, low, high in files[first:]:
                if low >= end:
                    break
                if max(low, start) < min(high, end):
                    pieces.append((path, max(low, start) - low, min(high, end) - max(low, start)))
            if self.wanted is None or split in self.wanted:
                out.append(Range(split, start, min(self.size, base - start), base, pieces))
        each = max(1, min(TASK_BYTES // self.size, len(out) // self.tasks))
        return [Ranges(out[k : k + each]) for k in range(0, len(out), each)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        name = f = None
        try:
            for x in partition.ranges:
                data = []
                for path, first, n in x.pieces:
                    if path != name:
                        if f:
                            f.close()
                        system, at = opened(path)
                        name, f = path, system.open_input_file(at)
                    got = f.read_at(n, first)
                    if len(got) != n:
                        raise OSError(f"{path}: {len(got)} of {n} bytes at {first}")
                    data.append(got)
                longs = [pa.array([v], pa.int64()) for v in (x.split, x.start, x.own, x.total)]
                yield pa.record_batch([*longs, pa.array([b"".join(data) if len(data) > 1 else data[0]], pa.binary())], names=["split", "start", "own", "total", "data"])
        finally:
            if f:
                f.close()


class ByteStream(DataSource):
    """``format("byte_stream")``, read: split, start, own (bytes), total (bytes of the stream), data (own bytes and up to ``ahead`` more); written: one binary column."""

    @classmethod
    def name(cls) -> str:
        return "byte_stream"

    def schema(self) -> str:
        return "split long, start long, own long, total long, data binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> OrderedWriter:
        if [f.dataType.typeName() for f in schema.fields] != ["binary"]:
            raise ValueError("a byte stream is written from one binary column")
        return OrderedWriter(self.options["path"], overwrite)


def read_ranges(spark: SparkSession, path: str, split_bytes: int = 64 << 20, ahead: int = 0, splits: list[int] | None = None) -> DataFrame:
    """A row for each byte range of a stream, or for those of ``splits`` only. Small ranges share tasks."""
    spark.dataSource.register(ByteStream)
    reader = spark.read.format("byte_stream").option("split_bytes", split_bytes).option("ahead", ahead).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    return (reader if splits is None else reader.option("splits", ",".join(map(str, splits)))).load(path)
