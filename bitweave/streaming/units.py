"""Streaming: payload units closed by the next start, version changes, header windows, and windowed statistics.

The first three keep per-PID state and are closed by data, not by time.  What they
still hold when a stream ends (or pauses) is read from the state in the query's
checkpoint, by ``open_units`` and ``open_headers``: what came out and what is open
are together the batch result, however the stream was cut into batches.  Reading
changes nothing, so the query may go on afterwards.  The last one adds event time
and watermarks, which packet files have no use for, as an extension for live
sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UNITS = "pid int, unit long, first_pkt long, last_pkt long, n_packets long, elapsed27 long"
_WRAP = 1 << 30


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: number of the open unit (0: none yet), its first and last packet, its packets, ticks so far, last arrival."""
    unit, first, last, n, ticks, atc = state.get if state.exists else (0, -1, -1, 0, 0, -1)
    out = []
    for r in pd.concat(list(batches)).sort_values("pkt_idx").itertuples(index=False):
        if atc >= 0:
            ticks += (int(r.atc) - atc) % _WRAP
        atc = int(r.atc)
        if r.pusi:
            if unit:
                out.append((key[0], unit, first, last, n, ticks))
            unit, first, n, ticks = unit + 1, int(r.pkt_idx), 0, 0
        if unit:
            last, n = int(r.pkt_idx), n + 1
    state.update((unit, first, last, n, ticks, atc))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in UNITS.split(", ")])


def payload_units(packets: DataFrame) -> DataFrame:
    """Each unit of a PID once the next one starts; packets (pkt_idx, pid, pusi, atc) of a PID must arrive in order across batches."""
    state = "unit long, first long, last long, n long, ticks long, atc long"
    rows = packets.select("pkt_idx", "pid", "pusi", "atc")
    return rows.groupBy("pid").applyInPandasWithState(_advance, UNITS, state, "append", GroupStateTimeout.NoTimeout)


def _held(spark: SparkSession, checkpoint: str, batch: int | None) -> DataFrame:
    """The state of each PID after a batch (the last one that was committed if none is named), read by Spark's state source in as many tasks as it has partitions."""
    reader = spark.read.format("statestore").option("path", checkpoint)
    return (reader if batch is None else reader.option("batchId", batch)).load().select("key.pid", "value.groupState.*").where("unit > 0")


def open_units(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The unit of each PID that ``payload_units`` has begun and no later start has closed; elapsed27 is null, as nothing follows."""
    columns = (F.col(a).alias(b) for a, b in (("first", "first_pkt"), ("last", "last_pkt"), ("n", "n_packets")))
    return _held(spark, checkpoint, batch).select("pid", "unit", *columns, F.lit(None).cast("bigint").alias("elapsed27"))


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (known,) = state.get if state.exists else (-1,)
    out = []
    for r in pd.concat(list(batches)).sort_values("pkt_idx").itertuples(index=False):
        if int(r.version) != known:
            out.append((key[0], int(r.pkt_idx), None if known < 0 else known, int(r.version)))
            known = int(r.version)
    state.update((known,))
    yield pd.DataFrame({"pid": pd.Series([x[0] for x in out], dtype="int32"), "pkt_idx": pd.Series([x[1] for x in out], dtype="int64"), "before": pd.Series([x[2] for x in out], dtype="Int64"), "version": pd.Series([x[3] for x in out], dtype="int64")})


def version_changes(tables: DataFrame) -> DataFrame:
    """tables (pid, pkt_idx, version): a row whenever a PID's table changes its version."""
    return tables.select("pid", "pkt_idx", F.col("version").cast("long")).groupBy("pid").applyInPandasWithState(_changes, "pid int, pkt_idx long, before long, version long", "known long", "append", GroupStateTimeout.NoTimeout)


HEADERS = "pid int, unit long, first_pkt long, head binary"


def header_windows(packets: DataFrame, size: int = 1024) -> DataFrame:
    """The first ``size`` bytes of each payload unit, as soon as they are there or the next unit starts.

    packets (pkt_idx, pid, pusi, payload) of a PID must arrive in order across
    batches.  A PID's state is one window; what follows a full one isn't kept.
    """

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit, first, held, done = state.get if state.exists else (0, -1, b"", True)
        out = []
        for r in pd.concat(list(batches)).sort_values("pkt_idx").itertuples(index=False):
            if r.pusi:
                if not done:
                    out.append((key[0], unit, first, bytes(held)))
                unit, first, held, done = unit + 1, int(r.pkt_idx), b"", False
            if not done:
                held = bytes(held) + (r.payload or b"")[: size - len(held)]
                if done := len(held) >= size:
                    out.append((key[0], unit, first, held))
                    held = b""
        state.update((unit, first, bytes(held), done))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in HEADERS.split(", ")])

    rows = packets.select("pkt_idx", "pid", "pusi", "payload")
    return rows.groupBy("pid").applyInPandasWithState(collect, HEADERS, "unit long, first long, held binary, done boolean", "append", GroupStateTimeout.NoTimeout)


def open_headers(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """What ``header_windows`` has of units that are shorter than a window so far."""
    return _held(spark, checkpoint, batch).where("not done").select("pid", "unit", F.col("first").alias("first_pkt"), F.col("held").alias("head"))


def windowed_counts(packets: DataFrame, time_col: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Extension: packets and bytes per PID and tumbling window of event time, late packets up to the watermark."""
    rows = packets.withWatermark(time_col, late)
    return rows.groupBy(F.window(time_col, window), "pid").agg(F.count(F.lit(1)).alias("n_packets")).select(F.col("window.start").alias("start"), "pid", "n_packets", (F.col("n_packets") * 188).alias("n_bytes"))
