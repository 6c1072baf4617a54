"""MMT across its tables: packages with their assets, and media units with the times of their MPU."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crc import crc_hex
from ..sources import mmt
from ..sources.blobs import parse_blobs


def package_layout(messages: DataFrame, keys: tuple[str, ...], data_col: str = "data") -> DataFrame:
    """Every package of the package lists with its assets: package, table_packet_id, ordinal, asset_id, asset_type, packet_id. A package without a package table keeps nulls.

    Of repeated tables only the distinct contents count.
    """
    tables = parse_blobs(messages, mmt.pa_tables, mmt.TABLE_ROWS, keys, data_col)
    packages = parse_blobs(tables, mmt.plt_packages, mmt.PACKAGE_ROWS, keys, "body").select("package", F.col("packet_id").alias("table_packet_id")).distinct()
    assets = parse_blobs(tables, mmt.mpt_assets, mmt.ASSET_ROWS, keys, "body").select("package", "ordinal", "asset_id", "asset_type", "packet_id").distinct()
    return packages.join(assets, "package", "left")


def unit_times(units: DataFrame, times: DataFrame, keys: tuple[str, ...] = ("packet_id", "mpu_seq")) -> DataFrame:
    """Media units with the presentation time of their MPU (90 kHz), where one was signalled; the latest by NTP time counts."""
    from ..functions.clocks import ntp_to_90k

    latest = times.groupBy(*keys).agg(F.max(F.struct("ntp_sec", "ntp_frac")).alias("t"))
    return units.join(latest.select(*keys, ntp_to_90k(F.col("t.ntp_sec"), F.col("t.ntp_frac")).alias("present90")), list(keys), "left")


def asset_counts(packets: DataFrame, layout: DataFrame) -> DataFrame:
    """Packets per context and packet id, with the asset types that the package tables give the id."""
    counts = packets.groupBy("cid", "packet_id").agg(F.count(F.lit(1)).alias("n"))
    types = layout.where("packet_id is not null").groupBy("packet_id").agg(F.array_join(F.array_sort(F.collect_set("asset_type")), ",").alias("asset_types"))
    return counts.join(types, "packet_id", "left")


# Messages whose section ends with a CRC, and the last table (EMT) that is checked.
CHECKED_MESSAGES, LAST_CHECKED = ("8000", "8002", "8003", "8004"), "A6"


def message_checks(messages: DataFrame, data_col: str = "data") -> DataFrame:
    """Whole signalling messages that carry a checked section, with message_id, table_id, stored and computed CRC (hex) and whether they agree.

    Other messages, tables beyond the last checked one and sections that the
    message doesn't hold in full have no row.
    """
    data = F.col(data_col)
    head = messages.withColumn("_head", F.hex(F.substring(data, 1, 6))).where(F.substring("_head", 1, 4).isin(*CHECKED_MESSAGES) & (F.length("_head") == 12))
    head = head.withColumn("_size", F.conv(F.substring("_head", 7, 4), 16, 10).cast("int")).where((F.col("_size") >= 5) & (F.length(data) >= F.col("_size") + 5) & (F.substring("_head", 11, 2) <= LAST_CHECKED))
    section = F.substring(data, F.lit(6), F.col("_size") - 4)
    stored = F.hex(F.substring(data, F.col("_size") + 2, F.lit(4)))
    checked = head.select(*messages.columns, F.substring("_head", 1, 4).alias("message_id"), F.substring("_head", 11, 2).alias("table_id"), stored.alias("stored"), crc_hex(section, "crc-32-mpeg").alias("computed"))
    return checked.withColumn("ok", F.col("stored") == F.col("computed"))


def select_packets(packets: DataFrame, cid: int | None = None, packet_id: int | None = None, mpu_seq: int | None = None, first_seq: int | None = None, last_seq: int | None = None) -> DataFrame:
    """Packets of a context, packet id and MPU, with sequence numbers from ``first_seq`` to below ``last_seq``; None: any."""
    for name, value in (("cid", cid), ("packet_id", packet_id), ("mpu_seq", mpu_seq)):
        if value is not None:
            packets = packets.where(F.col(name) == value)
    if first_seq is not None:
        packets = packets.where(F.col("seq") >= first_seq)
    return packets if last_seq is None else packets.where(F.col("seq") < last_seq)
