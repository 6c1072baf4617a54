"""Queries over the event map as a transport stream, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clock_reports as reports
from ..operators import packets as ts
from . import emap

PIDS = [256, 259, 262]
REMAP = {256: 4096, 257: 4113, 265: 18}


def pid_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = emap.packed(spark, sf)
    out = p.groupBy("pid").agg(F.count(F.lit(1)).alias("n_packets"), F.sum(F.col("pusi").cast("int")).alias("n_units"), F.count("pcr27").alias("n_pcr"))
    role = F.coalesce(ts.pid_name(F.col("pid")), F.when(F.col("n_pcr") > 0, "PCR").otherwise("ES"))
    return out.select("pid", "n_packets", "n_units", "n_pcr", role.alias("role")).orderBy("pid")


def partial(spark: SparkSession, sf: str) -> DataFrame:
    p = ts.packet_range(ts.parse_packets(emap.pack(emap.direct(spark, sf)), prefix=4), 1000, 8000, PIDS)
    out = ts.strip_prefix(F.col("raw"))
    return p.select("pkt_idx", "pid", F.length(out).cast("bigint").alias("n_bytes"), F.hex(F.substring(out, 1, 4)).alias("head"))


def remap(spark: SparkSession, sf: str) -> DataFrame:
    p = emap.pack(emap.direct(spark, sf)).select("pkt_idx", ts.add_prefix(ts.strip_prefix(ts.remap_pid(F.col("raw"), REMAP, 4)), F.col("pkt_idx")).alias("raw"))
    return ts.parse_packets(p, prefix=4).select("pkt_idx", "pid", "atc", "pusi", "cc")


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("pkt_idx"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) div 864000000000").alias("version"))


def program_sequence(spark: SparkSession, sf: str) -> DataFrame:
    p = reports.program_sequences(_versions(spark, sf))
    return p.groupBy("progseq").agg(F.min("pkt_idx").alias("first_pkt"), F.max("pkt_idx").alias("last_pkt"), F.count(F.lit(1)).alias("n"))


def packed_fields(spark: SparkSession, sf: str) -> DataFrame:
    return emap.packed(spark, sf).select("pkt_idx", "pid", "atc", "pusi", "pcr27", "pts90", "dts90")


def clock_points(spark: SparkSession, sf: str) -> DataFrame:
    return reports.clock_points(emap.packed(spark, sf))


def atc_diff(spark: SparkSession, sf: str) -> DataFrame:
    return reports.atc_diff(emap.packed(spark, sf)).select("pkt_idx", "atc", "diff", "elapsed")


def atc_diff_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return reports.atc_diff(emap.direct(spark, sf)).where("diff > 35000000").select("pkt_idx", "diff")


def atc_diff_compat(spark: SparkSession, sf: str) -> DataFrame:
    return reports.atc_diff(emap.direct(spark, sf), compat=True).select("pkt_idx", "diff")


def atc_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return reports.atc_diff(emap.direct(spark, sf)).agg(F.min("diff").alias("min_diff"), F.max("diff").alias("max_diff"), F.count("diff").alias("n"))


def atc_diff_per_pid(spark: SparkSession, sf: str) -> DataFrame:
    return reports.atc_diff_of_pid(emap.direct(spark, sf), 260)


def payload_unit_span(spark: SparkSession, sf: str) -> DataFrame:
    return reports.payload_units(emap.direct(spark, sf))


def pcr_interval_rate(spark: SparkSession, sf: str) -> DataFrame:
    return reports.pcr_intervals(emap.packed(spark, sf)).select("pkt_idx", "pid", "pcr27", "delta27", "rate_bps")


def pcr_vs_atc_violations(spark: SparkSession, sf: str) -> DataFrame:
    jittered = emap.direct(spark, sf).withColumn("pcr27", F.pmod(F.col("pcr27") + F.col("pkt_idx") % 7 * 100, F.lit(emap.PCR_WRAP)))
    return reports.pcr_intervals(jittered).where("abs(atc_delta27 - delta27) > 300").select("pkt_idx", "delta27", "atc_delta27")


def pcr_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.pcr_summary(emap.direct(spark, sf))


def first_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return reports.first_stamps(emap.packed(spark, sf)).select("pid", "first_pts27", "first_dts27")


def initial_delay(spark: SparkSession, sf: str) -> DataFrame:
    return reports.first_stamps(emap.packed(spark, sf)).agg(F.min("first_pcr27").alias("first_pcr27"), F.min(F.least("first_pts27", "first_dts27")).alias("first_stamp27"), F.min("delay27").alias("least_delay27"))


def clock_diagram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.clock_diagram(emap.direct(spark, sf), PIDS)


def clock_diagram_full(spark: SparkSession, sf: str) -> DataFrame:
    return reports.clock_diagram(emap.direct(spark, sf), PIDS, full=True)


def atc_dts_asof(spark: SparkSession, sf: str) -> DataFrame:
    return reports.arrival_against_decoding(emap.packed(spark, sf), 256, 259)


def null_padding(spark: SparkSession, sf: str) -> DataFrame:
    n = emap.direct(spark, sf).count()
    pad = ts.parse_packets(ts.null_packets(spark, n, n))
    return pad.agg(F.count(F.lit(1)).alias("n_null"), F.coalesce(F.sum((F.col("pid") == ts.NULL_PID).cast("int")), F.lit(0)).alias("n_null_pid"), F.lit(n).cast("bigint").alias("n_packets"))


_WITH = f"WITH {emap.SQL}"
_DIFF = f"""{_WITH}, d AS (SELECT *, (atc - lag(atc) OVER (ORDER BY pkt_idx) + 1073741824) % 1073741824 AS diff FROM packets),
  e AS (SELECT *, coalesce(sum(diff) OVER (ORDER BY pkt_idx), 0) AS elapsed FROM d)"""
_PCR = f"""{_DIFF}, k AS (SELECT *, lag(pcr27) OVER w AS pcr0, lag(pkt_idx) OVER w AS idx0, lag(elapsed) OVER w AS elapsed0 FROM e WHERE pcr27 IS NOT NULL WINDOW w AS (ORDER BY pkt_idx)),
  r AS (SELECT pkt_idx, pid, pcr27, (pcr27 - pcr0 + 2576980377600) % 2576980377600 AS delta27, CAST(elapsed - elapsed0 AS BIGINT) AS atc_delta27, pkt_idx - idx0 AS n FROM k),
  s AS (SELECT *, CASE WHEN delta27 > 0 THEN CAST((CAST(n AS HUGEINT) * 192 * 216000000) // delta27 AS BIGINT) END AS rate_bps FROM r)"""
_JITTER = _PCR.replace("lag(pcr27) OVER w AS pcr0", "(pcr27 + pkt_idx % 7 * 100) % 2576980377600 AS j27, lag((pcr27 + pkt_idx % 7 * 100) % 2576980377600) OVER w AS pcr0").replace("(pcr27 - pcr0 +", "(j27 - pcr0 +")
_ROLE = "CASE " + " ".join(f"WHEN pid = {k} THEN '{v}'" for k, v in ts.PID_NAMES.items())
_WIDE = ", ".join(f"CASE WHEN pid = {p} THEN {c} * 300 END AS {c[:3]}27_0x{p:04x}" for p in PIDS for c in ("pts90", "dts90"))
_LIST = "(" + ", ".join(map(str, PIDS)) + ")"

QUERIES = {
    "ts_pid_counts": pid_counts, "ts_packed_fields": packed_fields, "ts_partial_range_pids": partial, "ts_pid_remap": remap, "ts_program_sequence": program_sequence, "ts_null_padding": null_padding, "clock_points": clock_points,
    "atc_diff": atc_diff, "atc_diff_compat": atc_diff_compat, "atc_diff_threshold": atc_diff_threshold, "atc_diff_per_pid": atc_diff_per_pid, "atc_minmax": atc_minmax, "payload_unit_span": payload_unit_span,
    "pcr_interval_rate": pcr_interval_rate, "pcr_vs_atc_violations": pcr_vs_atc_violations, "pcr_summary": pcr_summary, "first_pts_dts_per_pid": first_stamps, "initial_delay": initial_delay,
    "clock_diagram": clock_diagram, "clock_diagram_full": clock_diagram_full, "atc_dts_asof": atc_dts_asof,
}

ORACLES = {
    "ts_pid_counts": f"""{_WITH} SELECT pid, count(*) AS n_packets, CAST(sum(CAST(pusi AS INT)) AS BIGINT) AS n_units, count(pcr27) AS n_pcr,
        {_ROLE} WHEN count(pcr27) > 0 THEN 'PCR' ELSE 'ES' END AS role FROM packets GROUP BY pid ORDER BY pid""",
    "ts_packed_fields": f"{_WITH} SELECT * FROM packets",
    "ts_partial_range_pids": f"""{_WITH} SELECT pkt_idx, pid, CAST(188 AS BIGINT) AS n_bytes,
        printf('47%04X%02X', CAST(pusi AS INT) * 16384 + pid, CASE WHEN pcr27 IS NULL THEN 16 ELSE 48 END + pkt_idx % 16) AS head FROM packets WHERE pkt_idx >= 1000 AND pkt_idx < 8000 AND pid IN {_LIST}""",
    "ts_pid_remap": f"""{_WITH} SELECT pkt_idx, CAST(CASE pid {" ".join(f"WHEN {k} THEN {v}" for k, v in REMAP.items())} ELSE pid END AS INT) AS pid,
        (26549550 + pkt_idx * 498) % 1073741824 AS atc, pusi, CAST(pkt_idx % 16 AS INT) AS cc FROM packets""",
    "ts_program_sequence": """WITH v AS (SELECT event_id AS pkt_idx, epoch_us(ts) // 864000000000 AS version FROM events),
        c AS (SELECT *, CASE WHEN lag(version) OVER (ORDER BY pkt_idx) <> version THEN 1 ELSE 0 END AS changed FROM v),
        s AS (SELECT *, CAST(sum(changed) OVER (ORDER BY pkt_idx) AS BIGINT) AS progseq FROM c)
        SELECT progseq, min(pkt_idx) AS first_pkt, max(pkt_idx) AS last_pkt, count(*) AS n FROM s GROUP BY progseq""",
    "ts_null_padding": f"{_WITH} SELECT (32 - count(*) % 32) % 32 AS n_null, (32 - count(*) % 32) % 32 AS n_null_pid, count(*) AS n_packets FROM packets",
    "clock_points": f"""{_WITH} SELECT pkt_idx AS spn, 'ATC' AS kind, CAST(NULL AS INT) AS pid, atc AS ticks27 FROM packets
        UNION ALL SELECT pkt_idx, 'PCR', pid, pcr27 FROM packets WHERE pcr27 IS NOT NULL
        UNION ALL SELECT pkt_idx, 'PTS', pid, pts90 * 300 FROM packets WHERE pts90 IS NOT NULL
        UNION ALL SELECT pkt_idx, 'DTS', pid, dts90 * 300 FROM packets WHERE dts90 IS NOT NULL""",
    "atc_diff": f"{_DIFF} SELECT pkt_idx, atc, diff, CAST(elapsed AS BIGINT) AS elapsed FROM e",
    "atc_diff_compat": f"""{_WITH}, l AS (SELECT pkt_idx, atc, lag(atc) OVER (ORDER BY pkt_idx) AS b FROM packets)
        SELECT pkt_idx, CASE WHEN b IS NULL THEN NULL WHEN atc > b THEN atc - b ELSE atc - b + 1073741824 END AS diff FROM l""",
    "atc_diff_threshold": f"{_DIFF} SELECT pkt_idx, diff FROM d WHERE diff > 35000000",
    "atc_diff_per_pid": f"{_DIFF} SELECT pkt_idx, CAST(elapsed - lag(elapsed) OVER (ORDER BY pkt_idx) AS BIGINT) AS since FROM e WHERE pid = 260",
    "atc_minmax": f"{_DIFF} SELECT min(diff) AS min_diff, max(diff) AS max_diff, count(diff) AS n FROM d",
    "payload_unit_span": f"""{_DIFF}, a AS (SELECT *, coalesce(lead(diff) OVER (ORDER BY pkt_idx), 0) AS after, sum(CAST(pusi AS INT)) OVER (PARTITION BY pid ORDER BY pkt_idx) AS unit FROM e),
        u AS (SELECT pid, CAST(unit AS BIGINT) AS unit, min(pkt_idx) AS first_pkt, max(pkt_idx) AS last_pkt, count(*) AS n_packets, arg_min(elapsed, pkt_idx) AS t, CAST(sum(after) AS BIGINT) AS pure FROM a WHERE unit > 0 GROUP BY pid, unit)
        SELECT pid, unit, first_pkt, last_pkt, n_packets, n_packets * 192 AS bytes, CAST(lead(t) OVER (PARTITION BY pid ORDER BY unit) - t AS BIGINT) AS duration, pure FROM u""",
    "pcr_interval_rate": f"{_PCR} SELECT pkt_idx, pid, pcr27, delta27, rate_bps FROM s",
    "pcr_vs_atc_violations": f"{_JITTER} SELECT pkt_idx, delta27, atc_delta27 FROM s WHERE abs(atc_delta27 - delta27) > 300",
    "pcr_summary": f"""{_PCR} SELECT max(rate_bps) AS max_rate_bps, max(abs(atc_delta27 - delta27)) AS max_deviation27,
        (SELECT CAST((CAST(count(*) AS HUGEINT) * 192 * 216000000) // sum(diff) AS BIGINT) FROM d) AS avg_rate_bps FROM s""",
    "first_pts_dts_per_pid": f"{_WITH} SELECT pid, arg_min(pts90 * 300, pkt_idx) AS first_pts27, arg_min(dts90 * 300, pkt_idx) AS first_dts27 FROM packets GROUP BY pid",
    "initial_delay": f"""{_WITH}, f AS (SELECT pid, arg_min(pts90 * 300, pkt_idx) AS pts, arg_min(dts90 * 300, pkt_idx) AS dts FROM packets GROUP BY pid),
        g AS (SELECT arg_min(pcr27, pkt_idx) AS pcr FROM packets)
        SELECT min(pcr) AS first_pcr27, min(least(pts, dts)) AS first_stamp27, min(coalesce(dts, pts) - pcr) AS least_delay27 FROM f, g""",
    "clock_diagram": f"{_WITH} SELECT pkt_idx AS spn, atc AS atc27, pcr27, {_WIDE} FROM packets WHERE pcr27 IS NOT NULL OR pid IN {_LIST} AND (pts90 IS NOT NULL OR dts90 IS NOT NULL)",
    "clock_diagram_full": f"{_WITH} SELECT pkt_idx AS spn, atc AS atc27, pcr27, {_WIDE} FROM packets",
    "atc_dts_asof": f"""{_DIFF}, q AS (SELECT *, coalesce(dts90, pts90) AS due FROM e WHERE pusi AND pid IN (256, 259)),
        k AS (SELECT pkt_idx, pid, last_value(CASE WHEN pid = 256 THEN elapsed END IGNORE NULLS) OVER w AS aa, last_value(CASE WHEN pid = 259 THEN elapsed END IGNORE NULLS) OVER w AS ab,
            last_value(CASE WHEN pid = 256 THEN due END IGNORE NULLS) OVER w AS da, last_value(CASE WHEN pid = 259 THEN due END IGNORE NULLS) OVER w AS db FROM q WINDOW w AS (ORDER BY pkt_idx ROWS UNBOUNDED PRECEDING))
        SELECT pkt_idx, pid, CAST(aa - ab AS BIGINT) AS delta_atc27, (da - db) * 300 AS delta_dts27, CAST((da - db) * 300 - (aa - ab) AS BIGINT) AS delta27 FROM k WHERE aa IS NOT NULL AND ab IS NOT NULL""",
}
