"""Split-parallel scans of streams whose packets have no fixed length.

Where a packet starts depends on all packets before it, so a range of bytes alone
doesn't tell.  But every place of a range where a packet *could* start (a
candidate) says where the scan would go on after it, hence where it would leave
the range: a scan that comes in at any byte takes the first candidate from there.
A range is thus a map from entries to exits, constant between candidates and, as
scans that start apart soon fall into step, of a few pieces only.  Such maps
compose.  The scan has levels: ranges, blocks of ``FAN`` ranges, blocks of ``FAN``
such blocks, up to the stream; maps go up (each level's exits from the one below),
entries come down, and a range that knows its entry keeps the candidates that the
scan really visits.

Bytes are read once, by as many tasks as there are ranges; only candidates, pieces
and entries are shuffled.  No task sees more than the candidates of one range, the
pieces of the ``FAN`` parts of one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.byte_streams import read_ranges
from .ordered import with_lag, with_last_known, with_rank
from .shared import written

BLOCK = 1024
FAN = 32

#: (data with bytes ahead, own bytes, bytes from its start to the stream's end) to (places of candidates below own, where the scan goes on after each, columns of the grammar).
Grammar = Callable[[np.ndarray, int, int], tuple[np.ndarray, np.ndarray, list]]


def exits(places: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """Where a scan that takes the candidate at each place leaves [.., end); places ascend, and after[k] > places[k]."""
    n, out, following = len(places), after.tolist(), np.searchsorted(places, after).tolist()
    for k in range(n - 1, -1, -1):
        if out[k] < end:
            out[k] = out[following[k]] if following[k] < n else end
    return np.array(out, after.dtype)


def walk(places: np.ndarray, after: np.ndarray, entry: int, end: int) -> Iterator[tuple[int, int]]:
    """(index of each candidate that a scan from ``entry`` takes, where it came from)."""
    k, n = int(np.searchsorted(places, entry)), int(np.searchsorted(places, end))
    following, after = np.searchsorted(places, after).tolist(), after.tolist()
    while k < n:
        yield k, entry
        entry, k = after[k], following[k]


def _telling(out: np.ndarray) -> np.ndarray:
    """Candidates whose exit differs from the next one's, and the last: entries up to them leave as they do."""
    return np.append(out[1:] != out[:-1], True) if len(out) else np.zeros(0, bool)


_OWN = [T.StructField("split", T.LongType()), T.StructField("at", T.LongType()), T.StructField("after", T.LongType()), T.StructField("exit", T.LongType()), T.StructField("telling", T.BooleanType())]


def _candidates(grammar: Grammar, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                split, start, own, total = (batch.column(c)[k].as_py() for c in ("split", "start", "own", "total"))
                data = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8)
                places, after, columns = grammar(data, own, total - start)
                out = exits(places, after, own)
                own_columns = [pa.array(np.full(len(places), split)), *(pa.array(x.astype(np.int64) + start) for x in (places, after, out)), pa.array(_telling(out))]
                whole = pa.record_batch([*own_columns, *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns)], names=schema.names).cast(schema)
                yield from (whole.slice(a, 10_000) for a in range(0, whole.num_rows, 10_000))

    return run


def _sorted(table: pa.Table, column: str) -> pa.Table:
    return table.sort_by(column) if table.num_rows else table


_MAPS = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("exit", pa.int64())])


def _compose(size: int):
    """A block's map from those of its ranges. A scan that finds no candidate before the block's end leaves at that end."""

    def run(pieces: pa.Table) -> pa.Table:
        pieces = _sorted(pieces, "at")
        block = pieces.column("block")[0].as_py()
        at = pieces.column("at").to_numpy()
        out = exits(at, pieces.column("exit").to_numpy(), (block + 1) * size)
        told = _telling(out)
        return pa.table([np.full(int(told.sum()), block), at[told], out[told]], schema=_MAPS)

    return run


_ENTRIES = pa.schema([("block", pa.int64()), ("entry", pa.int64())])


def _block_entries(size: int):
    def run(maps: pa.Table) -> pa.Table:
        maps = _sorted(maps, "at")
        at, after = maps.column("at").to_numpy(), maps.column("exit").to_numpy()
        found = [(int(at[k]) // size, entry) for k, entry in walk(at, after, 0, np.iinfo(np.int64).max)]
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=_ENTRIES)

    return run


def _split_entries(size: int):
    def run(pieces: pa.Table, entries: pa.Table) -> pa.Table:
        if not entries.num_rows or not pieces.num_rows:
            return _ENTRIES.empty_table()
        pieces = _sorted(pieces, "at")
        at, after = pieces.column("at").to_numpy(), pieces.column("exit").to_numpy()
        found = [(int(at[k]) // size, entry) for k, entry in walk(at, after, entries.column("entry")[0].as_py(), np.iinfo(np.int64).max)]
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=_ENTRIES)

    return run


def _entries(pieces: DataFrame, size: int) -> DataFrame:
    """split, entry of the ranges of ``size`` bytes that a scan from byte 0 comes into. pieces: at, exit of the ranges' maps."""
    inside = lambda maps, n: maps.select(F.expr(f"at div {n}").alias("block"), "at", "exit").groupBy("block")
    last, levels = pieces.agg(F.max("at")).first()[0] or 0, [pieces]
    while last // size >= FAN:
        size *= FAN
        levels.append(written(inside(levels[-1], size).applyInArrow(_compose(size), "block long, at long, exit long").select("at", "exit")))
    entries = inside(levels.pop(), size * FAN).applyInArrow(_block_entries(size), "block long, entry long")  # one group
    for maps in reversed(levels):
        entries = inside(maps, size).cogroup(entries.groupBy("block")).applyInArrow(_split_entries(size // FAN), "block long, entry long")
        size //= FAN
    return entries.withColumnRenamed("block", "split")


def _visited(schema: pa.Schema):
    def run(candidates: pa.Table, entries: pa.Table) -> pa.Table:
        if not entries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        candidates = _sorted(candidates, "at")
        at, after = candidates.column("at").to_numpy(), candidates.column("after").to_numpy()
        taken = [k for k, _ in walk(at, after, entries.column("entry")[0].as_py(), np.iinfo(np.int64).max)]
        return candidates.take(pa.array(taken, pa.int64())).select(schema.names).cast(schema)

    return run


def split_scan(chunks: DataFrame, grammar: Grammar, ddl: str, split_bytes: int) -> DataFrame:
    """Rows of the packets that a scan from byte 0 meets: idx, byte_off, byte_len, skipped (bytes before it that belong to none), and ``ddl``.

    chunks: the rows of ``read_ranges`` with ranges of ``split_bytes``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(ddl).fields
    schema, kept = T.StructType([*_OWN, *fields]), T.StructType([_OWN[0], _OWN[1], _OWN[2], *fields])
    candidates = written(chunks.mapInArrow(_candidates(grammar, to_arrow_schema(schema)), schema))
    splits = _entries(candidates.where("telling").select("at", "exit"), split_bytes)
    packets = written(candidates.drop("exit", "telling").groupBy("split").cogroup(splits.groupBy("split")).applyInArrow(_visited(to_arrow_schema(kept)), kept))

    inside = Window.partitionBy("split").orderBy("at")
    ends = packets.groupBy("split").agg(F.count(F.lit(1)).alias("_n"), F.max("after").alias("_end"))
    before = Window.partitionBy(F.expr(f"split div {BLOCK}")).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    tops = ends.groupBy(F.expr(f"split div {BLOCK}").alias("_block")).agg(F.sum("_n").alias("_bn"), F.max("_end").alias("_bend"))
    above = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    tops = tops.select("_block", F.sum("_bn").over(above).alias("_bn"), F.max("_bend").over(above).alias("_bend"))
    ends = ends.select("split", F.expr(f"split div {BLOCK}").alias("_block"), F.sum("_n").over(before).alias("_n"), F.max("_end").over(before).alias("_end")).join(tops, "_block")
    zero = F.lit(0).cast("bigint")
    ends = ends.select("split", (F.coalesce("_n", zero) + F.coalesce("_bn", zero)).alias("_n"), F.coalesce("_end", "_bend", zero).alias("_end"))
    rows = packets.withColumns({"_k": F.row_number().over(inside) - 1, "_before": F.lag("after").over(inside)}).join(ends, "split")
    return rows.select((F.col("_n") + F.col("_k")).alias("idx"), F.col("at").alias("byte_off"), (F.col("after") - F.col("at")).alias("byte_len"), (F.col("at") - F.coalesce("_before", "_end")).alias("skipped"), *(f.name for f in fields))


# -- grammars -----------------------------------------------------------------------

TLV_AHEAD = 3
TLV_FIELDS = "type int, len long"
_TLV_KIND = np.zeros(256, bool)
_TLV_KIND[[0x01, 0x02, 0x03, 0xFE, 0xFF]] = True  # IPv4, IPv6, header-compressed IP, signalling, null


def tlv_grammar(data: np.ndarray, own: int, left: int) -> tuple[np.ndarray, np.ndarray, list]:
    """0x7F, a known type, two bytes of length; a packet that doesn't fit is none."""
    n = max(0, min(own, len(data) - 3))
    at = np.flatnonzero((data[:n] == 0x7F) & _TLV_KIND[data[1 : n + 1]])
    size = data[at + 2].astype(np.int64) << 8 | data[at + 3]
    fits = at + 4 + size <= left
    at, size = at[fits], size[fits]
    return at, at + 4 + size, [data[at + 1].astype(np.int32), size]


PS_AHEAD = 6 + 3 + 255 + 1
PS_FIELDS = "stream_id int, scr long, pts long, dts long, sub_stream int, payload_at int"
# Stream ids without a PES header (ISO/IEC 13818-1 table 2-21).
_BARE = np.zeros(256, bool)
_BARE[[0xBB, 0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF, 0xF2, 0xF8]] = True


def ps_grammar(data: np.ndarray, own: int, left: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Packs, program ends and packets of a program stream by start code; the last packet may break off at the stream's end."""
    have, n = len(data), max(0, min(own, len(data) - 3))
    at = np.flatnonzero((data[:n] == 0) & (data[1 : n + 1] == 0) & (data[2 : n + 2] == 1) & (data[3 : n + 3] >= 0xB9))
    byte = lambda k: data[np.minimum(at + k, have - 1)].astype(np.int64)
    stamp = lambda k: (byte(k) >> 1 & 7) << 30 | (byte(k + 1) << 7 | byte(k + 2) >> 1) << 15 | byte(k + 3) << 7 | byte(k + 4) >> 1
    at = at[(byte(3) != 0xBA) | (at + 14 <= have) & (byte(4) >> 6 == 1)]
    sid = byte(3)
    pack, packet = sid == 0xBA, sid > 0xBA
    v = byte(4) << 40 | byte(5) << 32 | byte(6) << 24 | byte(7) << 16 | byte(8) << 8 | byte(9)
    scr = ((v >> 43 & 7) << 30 | (v >> 27 & 0x7FFF) << 15 | v >> 11 & 0x7FFF) * 300 + (v >> 1 & 0x1FF)
    said = np.where(at + 6 <= have, byte(4) << 8 | byte(5), np.where(at + 5 <= have, byte(4), 0))
    size = np.where(packet, 6 + said, np.where(pack, 14 + (byte(13) & 7), 4))
    header, flags = packet & ~_BARE[sid] & (at + 9 <= have) & (byte(6) >> 6 == 2), byte(7) >> 6
    body = np.where(header, 9 + byte(8), 6)
    found = {  # value, where there is one
        "scr": (scr, pack), "pts": (stamp(9), header & (flags & 2 > 0) & (at + 14 <= have)), "dts": (stamp(14), header & (flags == 3) & (at + 19 <= have)),
        "sub_stream": (byte(body).astype(np.int32), (sid == 0xBD) & (at + body < have)), "payload_at": (body.astype(np.int32), packet),
    }
    return at, np.minimum(left, at + size), [sid.astype(np.int32), *(pa.array(x, mask=~there) for x, there in found.values())]


START_AHEAD = 3
START_FIELDS = "code int, ink long"


def start_code_grammar(data: np.ndarray, own: int, left: int) -> tuple[np.ndarray, np.ndarray, list]:
    """00 00 01 and the byte after it (-1 at the stream's end), and how far back the last byte of this range before it is that isn't zero.

    The range's last byte is a candidate too (code -2), so that a range of zeros or
    without start codes tells as much; it stands for nothing else.
    """
    n = max(0, min(own, len(data) - 2))
    at = np.flatnonzero((data[:n] == 0) & (data[1 : n + 1] == 0) & (data[2 : n + 2] == 1))
    code = np.array([int(data[p + 3]) if p + 3 < len(data) else -1 for p in at.tolist()], np.int32)
    after, ink = at + 3, np.flatnonzero(data[:own])
    upto = at
    if own and not (len(at) and at[-1] == own - 1):
        at, after, code, upto = np.append(at, own - 1), np.append(after, own), np.append(code, np.int32(-2)), np.append(at, own)
    k = np.searchsorted(ink, upto) - 1
    back = at - ink[np.maximum(k, 0)] if len(ink) else np.zeros(len(at), np.int64)
    return at, after, [code, pa.array(back, pa.int64(), mask=(k < 0) | (len(ink) == 0))]


def scan_start_codes(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Units between start codes of a stream of any size: unit_no, byte_off (after the start code), byte_len without trailing zeros, code (first byte). Empty units are none."""
    rows = split_scan(read_ranges(spark, path, split_bytes, START_AHEAD), start_code_grammar, START_FIELDS, split_bytes)
    rows = with_last_known(written(rows.select("idx", "byte_off", "code", "ink")), {"_ink": F.col("byte_off") - F.col("ink")}, "idx")
    marks = with_last_known(rows.withColumn("_back", -F.col("idx")), {"_stop": F.when(F.col("code") > -2, F.struct("idx", "byte_off", "_ink"))}, "_back")
    # the next start code, if any, ends a unit; the stream's last byte otherwise
    last = rows.agg(F.max_by("_ink", "idx").alias("_last"))  # one row
    following = with_lag(marks, {"_next": "_stop"}, "_back").crossJoin(F.broadcast(last))
    end = F.coalesce(F.col("_next._ink"), F.when(F.col("_next").isNull(), F.col("_last"))) + 1
    units = following.where("code > -2").select("idx", (F.col("byte_off") + 3).alias("byte_off"), (end - F.col("byte_off") - 3).alias("byte_len"), "code").where("byte_len > 0")
    return with_rank(units, "unit_no", ["byte_off"]).select("unit_no", "byte_off", "byte_len", "code")


def scan_tlv(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """TLV packets of a stream of any size."""
    return split_scan(read_ranges(spark, path, split_bytes, TLV_AHEAD), tlv_grammar, TLV_FIELDS, split_bytes)


def scan_program_stream(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Packs and packets of a program stream of any size; payload_at counts from the packet's first byte."""
    return split_scan(read_ranges(spark, path, split_bytes, PS_AHEAD), ps_grammar, PS_FIELDS, split_bytes)
