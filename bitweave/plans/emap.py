"""The event map: the ``events`` table seen as a transport stream, directly and as packed 192-byte packets.

Two views of the same stream: ``direct`` computes each field from an event, and
``packed`` builds the bytes of real packets, which the parser must read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATC_WRAP = 1 << 30
PTS_WRAP = 1 << 33
PCR_WRAP = (1 << 33) * 300


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pkt_idx, pid, atc, pusi, pcr27, pts90, dts90, payload."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = micros(F.col("ts"))
    pusi = F.col("event_type") == "signup"
    pts = F.when(pusi, F.pmod(F.expr("us * 9 div 100"), F.lit(PTS_WRAP)))
    rows = events.select(F.col("event_id").alias("pkt_idx"), (F.lit(256) + F.col("user_id") % 16).cast("int").alias("pid"), us.alias("us"), "event_type", "props")
    ticks = F.expr("us div 1000") * 27
    return rows.select(
        "pkt_idx", "pid", F.pmod(ticks, F.lit(ATC_WRAP)).alias("atc"), pusi.alias("pusi"), F.when(F.col("event_type") == "click", F.pmod(ticks, F.lit(PCR_WRAP))).alias("pcr27"),
        pts.alias("pts90"), F.when(F.col("pkt_idx") % 2 == 0, F.pmod(pts - 3003, F.lit(PTS_WRAP))).alias("dts90"), F.col("props").cast("binary").alias("payload"),
    )


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def _stamp(value: Column, mark: int) -> Column:
    """Five bytes of a 33-bit stamp with marker bits."""
    v = value.cast("bigint")
    top = F.shiftright(v, 30) * 2 + (mark * 16 + 1)
    middle = F.shiftright(v, 15).bitwiseAND(F.lit(0x7FFF)) * 2 + 1
    low = v.bitwiseAND(F.lit(0x7FFF)) * 2 + 1
    return F.concat(_hex(top, 2), _hex(middle, 4), _hex(low, 4))


def pack(rows: DataFrame) -> DataFrame:
    """pkt_idx, raw: 192-byte packets with an arrival prefix, a PCR or a PES header where the row has one."""
    header = F.concat(F.lit("47"), _hex(F.col("pusi").cast("int") * 0x4000 + F.col("pid"), 4), _hex(F.when(F.col("pcr27").isNotNull(), 0x30).otherwise(0x10) + F.col("pkt_idx") % 16, 2))
    base, ext = F.expr("pcr27 div 300"), F.col("pcr27") % 300
    adaptation = F.concat(F.lit("0710"), _hex(base * 2**15 + 0x7E00 + ext, 12))
    both = F.col("dts90").isNotNull()
    pes = F.concat(
        F.lit("000001E0000080"), F.when(both, "C00A").otherwise("8005"), F.when(both, _stamp(F.col("pts90"), 3)).otherwise(_stamp(F.col("pts90"), 2)),
        F.when(both, _stamp(F.col("dts90"), 1)).otherwise(""),
    )
    body = F.concat(F.when(F.col("pcr27").isNotNull(), adaptation).otherwise(""), F.when(F.col("pusi"), pes).otherwise(""), F.hex("payload"))
    return rows.select("pkt_idx", F.unhex(F.rpad(F.concat(_hex(F.col("atc"), 8), header, body), 384, "F")).alias("raw"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns as ``direct`` (payload apart), read back from packed packets."""
    from ..operators.packets import parse_packets

    return parse_packets(pack(direct(spark, sf_dir)), prefix=4)


#: The same map for the SQL oracles.
SQL = """packets AS (
  SELECT event_id AS pkt_idx, CAST(256 + user_id % 16 AS INTEGER) AS pid, (epoch_us(ts) // 1000 * 27) % 1073741824 AS atc, event_type = 'signup' AS pusi,
         CASE WHEN event_type = 'click' THEN (epoch_us(ts) // 1000 * 27) % 2576980377600 END AS pcr27,
         CASE WHEN event_type = 'signup' THEN (epoch_us(ts) * 9 // 100) % 8589934592 END AS pts90,
         CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN ((epoch_us(ts) * 9 // 100) % 8589934592 - 3003 + 8589934592) % 8589934592 END AS dts90
  FROM events)"""
