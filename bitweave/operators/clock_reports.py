"""Reports over packet clocks: arrival differences, PCR intervals, payload units, stamps, diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import ATC_WRAP, PCR_WRAP, rate_bps, step, to_27m
from .ordered import with_lag, with_last_known, with_running_sum

PACKET_BYTES = 192


def atc_diff(packets: DataFrame, compat: bool = False) -> DataFrame:
    """Adds diff (null for the first packet) and elapsed (its running sum)."""
    rows = with_lag(packets, {"_atc": "atc"}, "pkt_idx")
    rows = rows.withColumn("diff", step(F.col("atc"), F.col("_atc"), ATC_WRAP, compat)).drop("_atc")
    return with_running_sum(rows, {"elapsed": F.col("diff")}, "pkt_idx")


def atc_diff_of_pid(packets: DataFrame, pid: int) -> DataFrame:
    """pkt_idx, since: ticks since the previous packet of the PID, over all packets between."""
    own = with_lag(atc_diff(packets).where(F.col("pid") == pid), {"_before": "elapsed"}, "pkt_idx")
    return own.select("pkt_idx", (F.col("elapsed") - F.col("_before")).alias("since"))


def payload_units(packets: DataFrame) -> DataFrame:
    """One row per payload unit of a PID: unit, first_pkt, last_pkt, n_packets, bytes, duration (to the next unit's start), pure (ticks right after its packets)."""
    rows = with_lag(atc_diff(packets).withColumn("_next", F.lit(None).cast("bigint")), {"_pid": "pid"}, "pkt_idx")
    # the step after a packet belongs to that packet's PID
    following = with_lag(rows.withColumn("_rev", -F.col("pkt_idx")), {"_step": "diff"}, "_rev").withColumn("after", F.coalesce("_step", F.lit(0)))
    numbered = with_running_sum(following, {"unit": F.col("pusi").cast("int")}, "pkt_idx", ("pid",)).where("unit > 0")
    units = numbered.groupBy("pid", "unit").agg(F.min("pkt_idx").alias("first_pkt"), F.max("pkt_idx").alias("last_pkt"), F.count(F.lit(1)).alias("n_packets"), F.min_by("elapsed", "pkt_idx").alias("_start"), F.sum("after").alias("pure"))
    units = with_lag(units.withColumn("_rev", -F.col("unit")), {"_end": "_start"}, "_rev", ("pid",))
    return units.select("pid", "unit", "first_pkt", "last_pkt", "n_packets", (F.col("n_packets") * PACKET_BYTES).alias("bytes"), (F.col("_end") - F.col("_start")).alias("duration"), "pure")


def pcr_intervals(packets: DataFrame) -> DataFrame:
    """One row per PCR: pkt_idx, pid, pcr27, delta27, rate_bps (since the PCR before, of whatever PID), atc_delta27."""
    rows = with_lag(atc_diff(packets).where("pcr27 is not null"), {"_pcr": "pcr27", "_idx": "pkt_idx", "_elapsed": "elapsed"}, "pkt_idx")
    rows = rows.withColumn("delta27", step(F.col("pcr27"), F.col("_pcr"), PCR_WRAP))
    return rows.select("pkt_idx", "pid", "pcr27", "delta27", rate_bps((F.col("pkt_idx") - F.col("_idx")) * PACKET_BYTES, F.col("delta27")).alias("rate_bps"), (F.col("elapsed") - F.col("_elapsed")).alias("atc_delta27"))


def pcr_summary(packets: DataFrame) -> DataFrame:
    """max_rate_bps, avg_rate_bps (null when no time passed), max_deviation27 of arrival against PCR intervals."""
    a = pcr_intervals(packets).agg(F.max("rate_bps").alias("max_rate_bps"), F.max(F.abs(F.col("atc_delta27") - F.col("delta27"))).alias("max_deviation27"))
    b = atc_diff(packets).agg(rate_bps(F.count(F.lit(1)) * PACKET_BYTES, F.sum("diff")).alias("avg_rate_bps"))
    return a.join(b)  # one row each


def first_stamps(packets: DataFrame) -> DataFrame:
    """Per PID: the first PTS and DTS (27 MHz), and how long after the stream's first PCR they are due."""
    first = packets.groupBy("pid").agg(F.min_by(to_27m(F.col("pts90")), F.when(F.col("pts90").isNotNull(), F.col("pkt_idx"))).alias("first_pts27"), F.min_by(to_27m(F.col("dts90")), F.when(F.col("dts90").isNotNull(), F.col("pkt_idx"))).alias("first_dts27"))
    pcr = packets.agg(F.min_by("pcr27", F.when(F.col("pcr27").isNotNull(), F.col("pkt_idx"))).alias("first_pcr27"))
    return first.join(pcr).withColumn("delay27", F.coalesce("first_dts27", "first_pts27") - F.col("first_pcr27"))  # pcr is one row


def clock_points(packets: DataFrame) -> DataFrame:
    """Long form: spn, kind, pid, ticks27 for every arrival, PCR, PTS and DTS."""
    points = F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("ticks27")) for kind, value in (("ATC", F.col("atc")), ("PCR", F.col("pcr27")), ("PTS", to_27m(F.col("pts90"))), ("DTS", to_27m(F.col("dts90"))))))
    return packets.select(F.col("pkt_idx").alias("spn"), "pid", F.explode(points).alias("p")).where("p.ticks27 is not null").select("spn", "p.kind", F.when(F.col("p.kind") == "ATC", None).otherwise(F.col("pid")).alias("pid"), "p.ticks27")


def clock_diagram(packets: DataFrame, pids: list[int], full: bool = False) -> DataFrame:
    """Wide form, one row per packet with a PCR or stamp (or every packet): spn, atc27, pcr27, then pts27 and dts27 of each PID.

    A packet carries the clocks of its own PID only, so the pivot needs no shuffle.
    """
    columns = [F.when(F.col("pid") == p, to_27m(F.col(c))).alias(f"{c[:3]}27_0x{p:04x}") for p in pids for c in ("pts90", "dts90")]
    rows = packets if full else packets.where(F.col("pcr27").isNotNull() | (F.col("pid").isin(*pids) & (F.col("pts90").isNotNull() | F.col("dts90").isNotNull())))
    return rows.select(F.col("pkt_idx").alias("spn"), F.col("atc").alias("atc27"), "pcr27", *columns)


def arrival_against_decoding(packets: DataFrame, a: int, b: int) -> DataFrame:
    """At each stamped unit start of PIDs a and b: latest arrival and decoding time of either, and their differences (27 MHz)."""
    rows = atc_diff(packets).where(F.col("pusi") & F.col("pid").isin(a, b) & F.col("pts90").isNotNull())
    due = F.coalesce("dts90", "pts90")
    when = lambda p, x: F.when(F.col("pid") == p, x)
    known = with_last_known(rows, {"atc_a": when(a, F.col("elapsed")), "atc_b": when(b, F.col("elapsed")), "dts_a": when(a, due), "dts_b": when(b, due)}, "pkt_idx")
    known = known.where("atc_a is not null and atc_b is not null")
    delta_atc, delta_dts = F.col("atc_a") - F.col("atc_b"), (F.col("dts_a") - F.col("dts_b")) * 300
    return known.select("pkt_idx", "pid", delta_atc.alias("delta_atc27"), delta_dts.alias("delta_dts27"), (delta_dts - delta_atc).alias("delta27"))


def program_sequences(packets: DataFrame, version_col: str = "version") -> DataFrame:
    """Adds progseq: how many times the version in force has changed so far."""
    rows = with_lag(packets, {"_before": version_col}, "pkt_idx")
    changed = F.col("_before").isNotNull() & (F.col("_before") != F.col(version_col))
    return with_running_sum(rows, {"progseq": changed.cast("int")}, "pkt_idx").drop("_before")


def sequence_copy(packets: DataFrame, progseq: int, table_pids: list[int], version_col: str = "version") -> DataFrame:
    """The packets of one program sequence, after the last packet of each table PID from before it: a stream that can be played by itself."""
    rows = program_sequences(packets, version_col)
    tables = rows.where(F.col("pid").isin(*table_pids) & (F.col("progseq") < progseq))
    held = tables.groupBy("pid").agg(F.max_by(F.struct(*rows.columns), "pkt_idx").alias("x")).select("x.*")  # a packet for each table PID
    return rows.where(F.col("progseq") == progseq).withColumn("deferred", F.lit(False)).unionByName(held.withColumn("deferred", F.lit(True)))


def discontinuities(packets: DataFrame, most_ms: int = 100) -> DataFrame:
    """PCRs of a PID that don't follow from the one before: further than ``most_ms`` after it, or back (which is nearly a whole wrap on)."""
    clocks = with_lag(packets.where("pcr27 is not null"), {"_pcr": "pcr27"}, "pkt_idx", ("pid",))
    gap = step(F.col("pcr27"), F.col("_pcr"), PCR_WRAP)
    return clocks.where(gap > most_ms * 27_000).select("pkt_idx", "pid", F.col("_pcr").alias("before27"), "pcr27", gap.alias("gap27"))


def unit_edges(packets: DataFrame) -> DataFrame:
    """Payload units as rows: pid, unit, edge (start or end), pkt_idx, elapsed (27 MHz ticks since the first packet)."""
    rows = with_running_sum(atc_diff(packets).withColumn("elapsed", F.coalesce("elapsed", F.lit(0))), {"unit": F.col("pusi").cast("int")}, "pkt_idx", ("pid",)).where("unit > 0")
    ends = rows.groupBy("pid", "unit").agg(F.min(F.struct("pkt_idx", "elapsed")).alias("start"), F.max(F.struct("pkt_idx", "elapsed")).alias("end"))
    return ends.select("pid", "unit", F.explode(F.array(F.struct(F.lit("start").alias("edge"), "start.*"), F.struct(F.lit("end").alias("edge"), "end.*"))).alias("x")).select("pid", "unit", "x.*")


def versions_in_force(packets: DataFrame, tables: DataFrame) -> DataFrame:
    """Packets with the version of the latest table at or before them. tables (pkt_idx, version)."""
    both = packets.join(tables.groupBy("pkt_idx").agg(F.max("version").alias("_version")), "pkt_idx", "left")
    return with_last_known(both, {"version": F.col("_version")}, "pkt_idx").drop("_version")
