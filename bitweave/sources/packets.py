"""Scans of fixed-length packets: format probe, and a data source with packet-range pushdown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .byte_streams import opened, parts_of

#: (name, packet size, bytes before the sync byte), in the order of the probe.
FORMATS = [("ts188", 188, 0), ("ts204", 204, 0), ("ts208", 208, 0), ("m2ts192", 192, 4)]
# File extensions and the format they stand for.
EXTENSIONS = {"ts": "ts", "m2ts": "m2ts192", "mts": "m2ts192", "tts": "m2ts192", "mp4": "isobmff", "m4a": "isobmff", "m4v": "isobmff", "mov": "isobmff", "heic": "isobmff", "heif": "isobmff", "mkv": "matroska", "mka": "matroska", "mks": "matroska", "webm": "matroska", "mmts": "mmt", "tlv": "mmt", "vob": "ps", "mpg": "ps", "mpeg": "ps", "m2v": "mpv", "mpv": "mpv", "h264": "avc", "264": "avc", "avc": "avc", "h265": "hevc", "265": "hevc", "hevc": "hevc", "h266": "vvc", "266": "vvc", "vvc": "vvc", "obu": "av1", "av1": "av1", "ivf": "ivf", "aac": "adts", "adts": "adts", "loas": "loas", "latm": "loas", "aif": "aiff", "aiff": "aiff", "aifc": "aiff"}


def format_by_extension(path: Column) -> Column:
    """The format that a file name's extension stands for, in whatever case; null if it has none that is known."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def probe(head: bytes, whole: bool = False) -> str | None:
    """The packet format that the first bytes fit: a sync byte where each of the first packets should have one. whole: the file ends with ``head``."""
    for name, size, lead in FORMATS:
        at = range(lead, len(head), size)
        if len(head) > lead and head[lead] == 0x47 and all(head[k] == 0x47 for k in at) and (len(at) > 1 or whole):
            return name
    return None


class PacketPartition(InputPartition):
    """Packets [first, last) of one file, whose first packet is number ``base`` of the stream."""

    def __init__(self, path: str, first: int, last: int, base: int = 0):
        self.path, self.first, self.last, self.base = path, first, last, base


class PacketReader(DataSourceReader):
    """Splits a file, or the parts of a folder in the order of their names, by packet ranges; ranges that a filter on pkt_idx excludes are never read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("packet_size", 188))
        self.first, self.last = int(options.get("start", 0)), int(options["end"]) if "end" in options else None
        self.split = max(1, int(options.get("split_bytes", 64 << 20)) // self.size)

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("pkt_idx",) and isinstance(value, int):
                if isinstance(f, GreaterThanOrEqual):
                    self.first = max(self.first, value)
                elif isinstance(f, GreaterThan):
                    self.first = max(self.first, value + 1)
                elif isinstance(f, LessThan):
                    self.last = value if self.last is None else min(self.last, value)
                elif isinstance(f, LessThanOrEqual):
                    self.last = value + 1 if self.last is None else min(self.last, value + 1)
            yield f  # Spark checks every row again

    def partitions(self) -> list[PacketPartition]:
        out, base = [], 0
        for path, size in parts_of(self.path):
            n = size // self.size
            first, last = max(0, self.first - base), n if self.last is None else max(0, min(n, self.last - base))
            out += [PacketPartition(path, k, min(last, k + self.split), base) for k in range(first, last, self.split)]
            base += n
        return out or [PacketPartition(self.path, 0, 0)]

    def read(self, partition: PacketPartition) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        system, at = opened(partition.path)
        with system.open_input_file(at) as f:
            for k in range(partition.first, partition.last, 8192):
                n = min(8192, partition.last - k)
                data = f.read_at(n * self.size, k * self.size)
                n = len(data) // self.size
                rows = pa.Array.from_buffers(pa.binary(self.size), n, [None, pa.py_buffer(data)]).cast(pa.binary())
                yield pa.record_batch([pa.array(range(partition.base + k, partition.base + k + n), pa.int64()), rows], names=["pkt_idx", "raw"])


class PacketSource(DataSource):
    """``spark.read.format("packets").option("packet_size", 192).load(path)``: pkt_idx, raw."""

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return "pkt_idx long, raw binary"

    def reader(self, schema) -> PacketReader:
        return PacketReader(dict(self.options))


def read_packets(spark: SparkSession, path: str, packet_size: int = 188, start: int = 0, end: int | None = None) -> DataFrame:
    spark.dataSource.register(PacketSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("packets").option("packet_size", packet_size).option("start", start)
    return (reader.option("end", end) if end is not None else reader).load(path)

