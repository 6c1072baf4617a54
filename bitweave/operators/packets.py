"""Transport packets: header, adaptation field and PES stamps as built-in expressions; filters and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# PIDs with an assigned use (ISO/IEC 13818-1, ARIB STD-B10).
PID_NAMES = {
    0x0000: "PAT", 0x0001: "CAT", 0x0010: "NIT", 0x0011: "SDT/BAT", 0x0012: "EIT", 0x0013: "RST", 0x0014: "TDT/TOT", 0x0017: "DCT", 0x001E: "DIT", 0x001F: "SIT", 0x0020: "LIT",
    0x0021: "ERT", 0x0022: "PCAT", 0x0023: "SDTT", 0x0024: "BIT", 0x0025: "NBIT/LDT", 0x0026: "EIT", 0x0027: "EIT", 0x0028: "SDTT", 0x0029: "CDT", 0x002F: "Multiple frame header information", 0x1FFF: "Null packet",
}
#: Stream ids whose PES packets have no optional header: map, padding, private 2, ECM, EMM, directory, DSM-CC, H.222.1 type E.
PLAIN_STREAM_IDS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF, 0xF2, 0xF8)
NULL_PID = 0x1FFF


def number(raw: Column, at: Column | int, size: int) -> Column:
    """Big-endian unsigned integer of up to 7 bytes at a 0-based offset."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(raw, at + 1, F.lit(size))), 16, 10).cast("bigint")


def _stamp(raw: Column, at: Column) -> Column:
    """A 33-bit PTS or DTS with its marker bits."""
    top, middle, low = number(raw, at, 1), number(raw, at + 1, 2), number(raw, at + 3, 2)
    return F.shiftright(top, 1).bitwiseAND(F.lit(7)) * (1 << 30) + F.shiftright(middle, 1) * (1 << 15) + F.shiftright(low, 1)


def parse_packets(packets: DataFrame, prefix: int = 0, raw_col: str = "raw") -> DataFrame:
    """Adds pid, atc (null without a prefix), tei, pusi, priority, tsc, afc, cc, payload_at, pcr27, opcr27, stream_id, pts90, dts90."""
    raw = F.col(raw_col)
    head = packets.withColumn("_h", number(raw, prefix, 4))
    bits = lambda shift, mask: F.shiftright(F.col("_h"), shift).bitwiseAND(F.lit(mask))
    head = head.select(
        "*", (number(raw, 0, 4).bitwiseAND(F.lit(0x3FFFFFFF)) if prefix == 4 else F.lit(None).cast("bigint")).alias("atc"), (bits(24, 0xFF) == 0x47).alias("in_sync"), (bits(23, 1) == 1).alias("tei"), (bits(22, 1) == 1).alias("pusi"),
        (bits(21, 1) == 1).alias("priority"), bits(8, 0x1FFF).cast("int").alias("pid"), bits(6, 3).cast("int").alias("tsc"), bits(4, 3).cast("int").alias("afc"), bits(0, 15).cast("int").alias("cc"),
    )
    base = prefix + 4
    field_size = F.when(F.col("afc").bitwiseAND(F.lit(2)) > 0, number(raw, base, 1) + 1).otherwise(F.lit(0))
    head = head.withColumn("payload_at", (F.lit(base) + field_size).cast("int")).withColumn("_flags", F.when((F.col("afc") >= 2) & (number(raw, base, 1) > 0), number(raw, base + 1, 1)).otherwise(F.lit(0)))

    def clock(at: int | Column) -> Column:
        value = number(raw, at, 6)
        return F.shiftright(value, 15) * 300 + value.bitwiseAND(F.lit(511))

    has_pcr, has_opcr = F.col("_flags").bitwiseAND(F.lit(0x10)) > 0, F.col("_flags").bitwiseAND(F.lit(0x08)) > 0
    at = F.col("payload_at")
    has_payload = F.col("afc").bitwiseAND(F.lit(1)) > 0
    pes = F.col("pusi") & has_payload & (number(raw, at, 3) == 1)
    stream_id = F.when(pes, number(raw, at + 3, 1)).cast("int")
    out = head.withColumn("pcr27", F.when(has_pcr, clock(base + 2))).withColumn("opcr27", F.when(has_opcr, clock(F.lit(base + 2) + F.when(has_pcr, 6).otherwise(0)))).withColumn("stream_id", stream_id)
    coded = F.col("stream_id").isNotNull() & ~F.col("stream_id").isin(*PLAIN_STREAM_IDS)
    flags, mark = F.shiftright(number(raw, at + 7, 1), 6), F.shiftright(number(raw, at + 9, 1), 4)
    has_pts = coded & (((flags == 2) & (mark == 2)) | ((flags == 3) & (mark == 3)))
    out = out.withColumn("pts90", F.when(has_pts, _stamp(raw, at + 9))).withColumn("dts90", F.when(has_pts & (flags == 3) & (F.shiftright(number(raw, at + 14, 1), 4) == 1), _stamp(raw, at + 14)))
    return out.drop("_h", "_flags")


def pid_name(pid: Column) -> Column:
    """The assigned use of a PID, or null."""
    out = F.when(pid == -1, F.lit(None).cast("string"))
    for k, name in PID_NAMES.items():
        out = out.when(pid == k, name)
    return out


def packet_range(packets: DataFrame, start: int | None = None, end: int | None = None, pids: list[int] | None = None) -> DataFrame:
    """Packets of [start, end), and of some PIDs: a plain conjunction that reaches the scan."""
    if start is not None:
        packets = packets.where(F.col("pkt_idx") >= start)
    if end is not None:
        packets = packets.where(F.col("pkt_idx") < end)
    return packets.where(F.col("pid").isin(*pids)) if pids else packets


def strip_prefix(raw: Column, prefix: int = 4) -> Column:
    return F.substring(raw, prefix + 1, 188)


def remap_pid(raw: Column, mapping: dict[int, int], prefix: int = 0) -> Column:
    """The packet with its PID replaced; other PIDs stay."""
    head = number(raw, prefix + 1, 2)
    pid, rest = head.bitwiseAND(F.lit(0x1FFF)), head.bitwiseAND(F.lit(0xE000))
    new = F.when(pid == -1, pid)
    for k, v in mapping.items():
        new = new.when(pid == k, F.lit(v))
    word = F.unhex(F.lpad(F.hex(rest + new.otherwise(pid)), 4, "0"))
    return F.concat(F.substring(raw, 1, prefix + 1), word, F.substring(raw, prefix + 4, 10_000))


def arrival_prefix(idx: Column) -> Column:
    """The 30-bit arrival clock that a rewrite gives its n-th packet."""
    return (F.lit(0x1951D2E) + idx * 0x1F2).bitwiseAND(F.lit(0x3FFFFFFF))


def add_prefix(raw: Column, idx: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(arrival_prefix(idx)), 8, "0")), raw)


def null_packets(spark, count: int, first_idx: int) -> DataFrame:
    """Padding to a whole aligned unit of 32 packets."""
    n = (-count) % 32
    return spark.range(n).select((F.col("id") + first_idx).alias("pkt_idx"), F.unhex(F.lit("471FFF10" + "FF" * 184)).alias("raw"))
