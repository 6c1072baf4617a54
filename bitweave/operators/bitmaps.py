"""Sets of small numbers as bitmaps that merge: packet identifiers and continuity counters seen in windows of a stream.

A set of PIDs is one bitmap of 4,096 bytes, however many packets it stands for;
sets of windows, files or days merge by ``bitmap_or_agg`` without the packets.
Counters are 16 bits of an integer.  Both are made by partial aggregation, so a
PID that carries most of a stream is no more work to shuffle than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1024


def window_of(order: str, size: int) -> Column:
    """The window that a position lies in."""
    return F.expr(f"`{order}` div {size}").alias("window")


def pid_sets(packets: DataFrame, size: int, order: str = "pkt_idx", pid: str = "pid") -> DataFrame:
    """window, n_packets, pids (a bitmap) of each window of ``size`` positions that has packets."""
    bit = F.bitmap_bit_position(F.col(pid).cast("bigint") + 1)  # bits count from number 1
    return packets.groupBy(window_of(order, size)).agg(F.count(F.lit(1)).alias("n_packets"), F.bitmap_construct_agg(bit).alias("pids"))


def merged(sets: DataFrame, by: Column, name: str = "window") -> DataFrame:
    """The sets of larger windows (or of anything else) from those of smaller ones."""
    return sets.groupBy(by.alias(name)).agg(F.sum("n_packets").alias("n_packets"), F.bitmap_or_agg("pids").alias("pids"))


def with_seen(sets: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds ``seen``, the union of a window's set and all earlier ones, and n_pids, n_new (never seen before), n_seen."""
    spans = sets.select(F.expr(f"window div {span}").alias("_span"), "window", "n_packets", "pids")
    whole = spans.groupBy("_span").agg(F.bitmap_or_agg("pids").alias("_own"))
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    carried = whole.select("_span", F.lit(None).cast("bigint").alias("window"), F.lit(None).cast("bigint").alias("n_packets"), F.bitmap_or_agg("_own").over(earlier).alias("pids"))
    inside = Window.partitionBy("_span").orderBy(F.asc_nulls_first("window"))
    rows = spans.unionByName(carried.where("pids IS NOT NULL")).withColumn("seen", F.bitmap_or_agg("pids").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_known", F.lag("seen").over(inside)).where("window IS NOT NULL")
    n = lambda c: F.coalesce(F.bitmap_count(c), F.lit(0))
    return rows.select("window", "n_packets", "pids", "seen", n(F.col("pids")).alias("n_pids"), (n(F.col("seen")) - n(F.col("_known"))).alias("n_new"), n(F.col("seen")).alias("n_seen"))


def members(sets: DataFrame, bitmap: str = "pids", most: int = 8192) -> DataFrame:
    """A row for each PID of each set."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.expr("cast(pid div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    rows = sets.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    return rows.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(pid % 8 as int))")) != 0)


def counter_sets(packets: DataFrame, size: int, order: str = "pkt_idx", pid: str = "pid", counter: str = "cc") -> DataFrame:
    """window, pid, n_packets, counters (16 bits), n_repeated (packets with a counter that the window has already), first and last missing counter."""
    mask = F.bit_or(F.expr(f"shiftleft(1, cast(`{counter}` as int))"))
    rows = packets.groupBy(window_of(order, size), F.col(pid).alias("pid")).agg(F.count(F.lit(1)).alias("n_packets"), mask.alias("counters"))
    lacking = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: F.expr("counters").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) == 0)
    rows = rows.withColumns({"n_repeated": F.col("n_packets") - F.bit_count("counters"), "_lacking": lacking})
    return rows.withColumns({"first_missing": F.get("_lacking", F.lit(0)), "last_missing": F.get("_lacking", F.size("_lacking") - 1)}).drop("_lacking")
