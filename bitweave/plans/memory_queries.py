"""Queries over what a stream remembers: sets of identifiers, slots, defaults and offsets that are carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bitmaps, fragments, slots
from ..operators.shared import written


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("pkt_idx"), (F.col("user_id") * 7 % 8192).alias("pid"), (F.col("event_id") * 3 % 16).alias("cc"))


def pid_windows(spark: SparkSession, sf: str) -> DataFrame:
    """PIDs of each 50 packets, and those never seen before."""
    return bitmaps.with_seen(bitmaps.pid_sets(_packets(spark, sf), 50), 16).drop("pids", "seen")


def pid_set_members(spark: SparkSession, sf: str) -> DataFrame:
    """The PIDs of each thousand packets, from the merged sets of fifties."""
    sets = bitmaps.merged(bitmaps.pid_sets(_packets(spark, sf), 50), F.expr("window div 20"))
    return bitmaps.members(sets).select("window", "n_packets", "pid")


def counter_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Continuity counters of each PID in each 2,000 packets."""
    return bitmaps.counter_sets(_packets(spark, sf), 2000)


def slot_references(spark: SparkSession, sf: str) -> DataFrame:
    """Ten streams of frames that write the slots of a mask and read two others."""
    events = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 10).alias("stream"), F.col("event_id").alias("frame"), F.when(F.col("event_type") == "signup", 255).otherwise(F.col("event_id") * 37 % 256).alias("mask"))
    held = slots.with_slots(events.withColumn("mask", F.when(F.col("frame") % 3 == 0, 0).otherwise(F.col("mask"))), F.col("mask"), F.col("frame"), "frame", ("stream",), span=1000)
    read = slots.read_slots(F.col("before"), F.array(F.col("frame") % 8, F.expr("frame div 8 % 8")))
    return held.select("stream", "frame", read[0].alias("first_ref"), read[1].alias("second_ref"), F.array_join("after", ",", "-").alias("after"))


def fragment_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as fragments, lines as runs, with whatever a line lacks left out."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("run", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    lines = lines.select(F.col("l_orderkey").alias("fragment"), (F.col("l_suppkey") % 2).alias("traf"), "run", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), (F.col("l_quantity") % 3).cast("int").alias("last"))
    lines = written(lines)  # read three times
    o = F.col("fragment")
    tracks = lines.select("fragment", "traf").distinct().select(
        "fragment", "traf", (F.col("traf") + 1).alias("track_id"), (o * 100_000).alias("fragment_at"), F.when(o % 5 == 0, o * 100_000 + 50 + F.col("traf")).alias("base_offset"), (o % 3 == 0).alias("from_fragment"),
        F.when(o % 2 == 0, 40).alias("duration"), F.when(o % 4 == 0, 9).alias("size"), F.when(o % 7 == 0, 5).alias("flags"), F.when(o % 6 == 0, 2).alias("description"), F.when(o % 11 == 0, o * 1000).alias("decode_time"),
    )
    runs = lines.select("fragment", "traf", "run", F.when(F.col("p") % 3 == 1, F.col("run") * 1000).alias("data_offset"), F.when(F.col("p") % 4 == 0, 77).alias("first_flags"))
    samples = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
    k = F.col("k")
    samples = samples.select("fragment", "traf", "run", "k", F.when(k != 1, F.col("run") + k).alias("duration"), F.when(k != 2, F.col("p") % 100 + 1).alias("size"), F.when(F.col("s") % 3 == 0, 3).alias("flags"), F.when(F.col("run") % 2 == 0, k * 2).alias("offset"))
    defaults = spark.createDataFrame([(1, 33, 8, 1, 1), (2, 21, 4, 0, 1)], "track_id long, duration long, size long, flags int, description int")
    return fragments.fragment_samples(defaults, tracks, runs, samples, span=5000)


QUERIES = {"pid_windows": pid_windows, "pid_set_members": pid_set_members, "counter_windows": counter_windows, "slot_references": slot_references, "fragment_samples": fragment_samples}

_SLOT = "last_value(CASE WHEN (mask >> {k}) & 1 = 1 THEN frame END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND {to})"
ORACLES = {
    "pid_windows": """WITH e AS (SELECT event_id // 50 AS w, user_id * 7 % 8192 AS pid FROM events), f AS (SELECT pid, min(w) AS w FROM e GROUP BY pid)
        SELECT w AS "window", count(*) AS n_packets, count(DISTINCT pid) AS n_pids, (SELECT count(*) FROM f WHERE f.w = e.w) AS n_new, (SELECT count(*) FROM f WHERE f.w <= e.w) AS n_seen FROM e GROUP BY w""",
    "pid_set_members": """WITH e AS (SELECT event_id // 1000 AS w, user_id * 7 % 8192 AS pid FROM events)
        SELECT w AS "window", (SELECT count(*) FROM e x WHERE x.w = e.w) AS n_packets, CAST(pid AS INTEGER) AS pid FROM e GROUP BY w, pid""",
    "counter_windows": """WITH c AS (SELECT event_id // 2000 AS w, user_id * 7 % 8192 AS pid, count(*) AS n, CAST(sum(DISTINCT 1 << CAST(event_id * 3 % 16 AS INT)) AS INTEGER) AS m, count(DISTINCT event_id * 3 % 16) AS d, list_sort(list_filter(range(16), lambda k: NOT list_contains(list(DISTINCT event_id * 3 % 16), k))) AS lack FROM events GROUP BY 1, 2)
        SELECT w AS "window", pid, n AS n_packets, m AS counters, n - d AS n_repeated, CAST(lack[1] AS INTEGER) AS first_missing, CAST(lack[-1] AS INTEGER) AS last_missing FROM c""",
    "slot_references": f"""WITH e AS (SELECT user_id % 10 AS stream, event_id AS frame, CAST(CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_type = 'signup' THEN 255 ELSE event_id * 37 % 256 END AS BIGINT) AS mask FROM events),
        s AS (SELECT *, [{", ".join(_SLOT.format(k=k, to="1 PRECEDING") for k in range(8))}] AS b, [{", ".join(_SLOT.format(k=k, to="CURRENT ROW") for k in range(8))}] AS a FROM e)
        SELECT stream, frame, b[frame % 8 + 1] AS first_ref, b[frame // 8 % 8 + 1] AS second_ref, array_to_string(list_transform(a, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS after FROM s""",
    "fragment_samples": """WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_suppkey % 2 AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS run, l_partkey AS p, l_suppkey AS s, CAST(l_quantity % 3 AS INT) AS n FROM lineitem),
        x AS (SELECT o, t, run, p, s, unnest(range(0, n + 1)) AS k FROM l),
        y AS (SELECT *, coalesce(CASE WHEN k <> 1 THEN run + k END, CASE WHEN o % 2 = 0 THEN 40 END, CASE t WHEN 0 THEN 33 ELSE 21 END) AS d,
          coalesce(CASE WHEN k <> 2 THEN p % 100 + 1 END, CASE WHEN o % 4 = 0 THEN 9 END, CASE t WHEN 0 THEN 8 ELSE 4 END) AS z,
          coalesce(CASE WHEN k = 0 AND p % 4 = 0 THEN 77 END, CASE WHEN s % 3 = 0 THEN 3 END, CASE WHEN o % 7 = 0 THEN 5 END, CASE t WHEN 0 THEN 1 ELSE 0 END) AS f,
          row_number() OVER (PARTITION BY o, t ORDER BY run, k) AS i FROM x),
        w AS (SELECT *, CASE WHEN i = 1 OR k = 0 AND p % 3 = 1 THEN CASE WHEN p % 3 = 1 THEN run * 1000 ELSE 0 END END AS mark, sum(z) OVER (PARTITION BY o, t ORDER BY i) - z AS before FROM y),
        v AS (SELECT *, before + last_value(mark - before IGNORE NULLS) OVER (PARTITION BY o, t ORDER BY i) AS pos FROM w),
        h AS (SELECT o, t, arg_max(pos + z, i) AS bytes, sum(d) AS lasts, row_number() OVER (ORDER BY o, t) AS n, row_number() OVER (PARTITION BY o ORDER BY t) AS place FROM v GROUP BY o, t),
        b AS (SELECT *, CASE WHEN o % 5 = 0 THEN o * 100000 + 50 + t WHEN o % 3 = 0 OR place = 1 THEN o * 100000 ELSE o * 100000 + lag(bytes) OVER (ORDER BY n) END AS base,
          sum(lasts) OVER (PARTITION BY t ORDER BY n) - lasts AS since FROM h),
        c AS (SELECT *, since + coalesce(last_value(CASE WHEN o % 11 = 0 THEN o * 1000 - since END IGNORE NULLS) OVER (PARTITION BY t ORDER BY n), 0) AS time FROM b),
        q AS (SELECT v.*, base, time + sum(d) OVER (PARTITION BY v.o, v.t ORDER BY i) - d AS dts, row_number() OVER (PARTITION BY v.t ORDER BY n, i) AS sample_no FROM v JOIN c ON c.o = v.o AND c.t = v.t)
        SELECT t + 1 AS track_id, sample_no, CAST(dts AS BIGINT) AS dts, CAST(dts + CASE WHEN run % 2 = 0 THEN k * 2 ELSE 0 END AS BIGINT) AS cts, CAST(base + pos AS BIGINT) AS byte_off, CAST(z AS BIGINT) AS size, CAST(f AS INTEGER) AS flags, CAST(CASE WHEN o % 6 = 0 THEN 2 ELSE 1 END AS INTEGER) AS description FROM q""",
}
