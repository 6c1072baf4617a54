"""Presentation times of media units, and the buffer model of a decoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import with_lag, with_running_max, with_running_sum


def mpu_times(units: DataFrame, order: str | None = None) -> DataFrame:
    """units (asset, mpu, present90, decode_offset, offsets ARRAY<STRUCT<dts_pts, pts>>): one row per access unit with dts90 and pts90.

    The first decoding time is the presentation time less the decode offset; each
    next one adds the pts offset of the unit before; presentation adds dts_pts.
    Of repeated units (same asset and number) the latest by ``order`` counts, or
    without an order the one with the latest presentation time.
    """
    columns = ["present90", "decode_offset", "offsets"]
    latest = F.max_by(F.struct(*columns), F.struct(*([order] if order else []), "present90", "decode_offset"))
    once = units.groupBy("asset", "mpu").agg(latest.alias("u")).select("asset", "mpu", *(f"u.{c}" for c in columns))
    flat = once.select("asset", "mpu", (F.col("present90") - F.col("decode_offset")).alias("start"), F.posexplode("offsets").alias("au", "o"))
    w = Window.partitionBy("asset", "mpu").orderBy("au").rowsBetween(Window.unboundedPreceding, -1)
    dts = F.col("start") + F.coalesce(F.sum("o.pts").over(w), F.lit(0))
    return flat.select("asset", "mpu", "au", dts.alias("dts90"), (dts + F.col("o.dts_pts")).alias("pts90"))


def buffer_model(units: DataFrame) -> DataFrame:
    """units (stream, au, n_bytes, starts, removal, delay, delay_offset, tick, bit_rate, cbr): arrival, removal and underflow of each access unit, in 90 kHz ticks.

    ``starts``: the unit begins a buffering period; ``removal``: removal delay in
    clock ticks of ``tick`` 90 kHz units since the last period's start.

    A unit's last byte arrives its own duration after the later of the last byte
    before it and its earliest arrival.  That recurrence has a closed form: with S
    the running sum of durations, the end is S plus the running maximum of
    (earliest arrival - S before the unit).  So a stream of any length is sums and
    a maximum over ordered spans, and none is a task by itself.
    """
    first = units.groupBy("stream").agg(F.min("au").alias("_first"), F.min_by("delay", "au").alias("_delay"))
    rows = units.join(first, "stream").withColumn("_took", F.expr("n_bytes * 8 * 90000 div bit_rate")).withColumn("_opens", F.col("au") == F.col("_first"))
    step = F.col("tick") * F.col("removal")
    rows = with_running_sum(rows, {"_sum": F.col("_took"), "_base": F.when(F.col("starts") & ~F.col("_opens"), step)}, "au", ("stream",))
    rows = rows.withColumn("t_r", F.col("_delay") + F.col("_base") + F.when(F.col("starts") | F.col("_opens"), 0).otherwise(step))
    earliest = F.greatest(F.lit(0), F.col("t_r") - F.col("delay") - F.when(F.col("starts"), 0).otherwise(F.col("delay_offset")))
    after = F.when(F.col("_opens"), 0).when(~F.col("cbr"), earliest)
    rows = with_running_max(rows, {"_top": after - (F.col("_sum") - F.col("_took"))}, "au", ("stream",))
    t_af = F.col("_sum") + F.col("_top")
    return rows.select("stream", "au", (t_af - F.col("_took")).alias("t_ai"), t_af.alias("t_af"), "t_r", (F.col("t_r") < t_af).alias("underflow"))


def reassemble(pieces: DataFrame) -> DataFrame:
    """pieces (flow, seq, part, data): whole messages by fragmentation indicator 0 complete, 1 first, 2 middle, 3 last.

    Pieces whose message lacks its first or last part are dropped.
    """
    numbered = with_running_sum(pieces, {"message": F.col("part").isin(0, 1).cast("int")}, "seq", ("flow",))
    groups = numbered.where("message > 0").groupBy("flow", "message").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("part", "seq").alias("_a"), F.max_by("part", "seq").alias("_b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]), "").alias("data")
    )
    whole = ((F.col("_a") == 0) & (F.col("_b") == 0)) | ((F.col("_a") == 1) & (F.col("_b") == 3))
    counted = with_running_sum(groups.where(whole).drop("message"), {"message": F.lit(1)}, "first_seq", ("flow",))
    return counted.select("flow", F.col("message").cast("int").alias("message"), "first_seq", "last_seq", "data")


def changed_only(rows: DataFrame, order: str, data: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose payload differs from the row before (with the same ``by``), by SHA-1."""
    marked = with_lag(rows.withColumn("_sha", F.sha1(F.col(data).cast("binary"))), {"_before": "_sha"}, order, by)
    return marked.where(~F.col("_sha").eqNullSafe(F.col("_before"))).withColumn("sha1", F.col("_sha")).drop("_sha", "_before")

