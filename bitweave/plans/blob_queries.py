"""Parser queries: media bytes are built from the tables in SQL, read back by the parsers, and compared with what the tables say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import psi, table_functions
from ..operators.packets import parse_packets
from ..operators.sequences import number_sequences
from ..operators.shared import written
from ..sources import audio, containers, video
from ..sources.blobs import parse_blobs
from . import emap


def _order_blobs(spark: SparkSession, sf: str, unit: Column) -> DataFrame:
    """One blob per order: its lines' units in order."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    return joined(items, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], F.hex(unit))


def joined(rows: DataFrame, key: str, order: list[str], digits: Column) -> DataFrame:
    """key, data: the bytes that the hex digits of a key's rows spell, in order."""
    grouped = rows.select(key, F.struct(*order, digits.alias("_digits")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select(key, F.unhex(F.array_join(F.transform("xs", lambda x: x["_digits"]), "")).alias("data"))


def _by_flag(n: str, r: str, a: str) -> Column:
    """Hex digits by return flag."""
    return F.when(F.col("l_returnflag") == "N", n).when(F.col("l_returnflag") == "R", r).otherwise(a)


def _body() -> Column:
    return F.hex(F.col("l_partkey").cast("string"))


def nal_units(spark: SparkSession, sf: str) -> DataFrame:
    """H.264 units: slices by N, IDR slices by R, access unit delimiters by A; none is the first slice of a picture by itself."""
    unit = F.unhex(F.concat(F.lit("00000001"), _by_flag("41", "65", "09"), _body()))
    return parse_blobs(_order_blobs(spark, sf, unit), video.nal_units("avc"), video.NAL_ROWS, ("l_orderkey",)).select("l_orderkey", "au_no", "nu_no", "byte_off", "byte_len", "nal_type", "kind", "is_vcl")


def av1_obus(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.unhex(F.concat(_by_flag("32", "0A", "12"), F.lpad(F.hex(F.length(F.col("l_partkey").cast("string"))), 2, "0"), _body()))
    return parse_blobs(_order_blobs(spark, sf, unit), video.av1_obus, video.OBU_ROWS, ("l_orderkey",)).select("l_orderkey", "tu", "obu", "obu_type", "byte_off", "byte_len")


def tlv_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line is preceded by a byte that belongs to no packet."""
    unit = F.unhex(F.concat(F.when(F.col("l_linenumber") == 3, "00").otherwise(""), F.lit("7F"), _by_flag("03", "02", "FF"), F.lpad(F.hex(F.length(F.col("l_partkey").cast("string"))), 4, "0"), _body()))
    return parse_blobs(_order_blobs(spark, sf, unit), containers.tlv_packets, containers.TLV_ROWS, ("l_orderkey",))


def adts_frames(spark: SparkSession, sf: str) -> DataFrame:
    """One stream per user: a frame for each event, its properties as payload."""
    size = F.length("props") + 7
    head = F.concat(F.lit("FFF14C"), F.lpad(F.hex(F.lit(128) + F.shiftright(size, 11)), 2, "0"), F.lpad(F.hex(F.shiftright(size, 3).bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(size.bitwiseAND(F.lit(7)) * 32 + 31), 2, "0"), F.lit("FC"))
    blobs = joined(spark.read.parquet(f"{sf}/events.parquet"), "user_id", ["event_id"], F.concat(head, F.hex("props")))
    return parse_blobs(blobs, audio.adts_frames, audio.FRAME_ROWS, ("user_id",)).select("user_id", "frame", "byte_off", "byte_len", "sample_rate", "channels")


def _box(kind: str, body: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body) + 8), 8, "0")), F.lit(kind).cast("binary"), body)


def mp4_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """One file per nation: ftyp, then moov with a trak for each customer, which holds a tkhd with the customer's name."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    trak = _box("trak", _box("tkhd", F.col("c_name").cast("binary")))
    files = joined(c, "c_nationkey", ["c_custkey"], F.hex(trak)).select("c_nationkey", F.concat(_box("ftyp", F.lit("isom").cast("binary")), _box("moov", F.col("data"))).alias("data"))
    return parse_blobs(files, containers.boxes, containers.BOX_ROWS, ("c_nationkey",)).select("c_nationkey", "node_id", "parent_id", "level", "type", "ordinal", "offset", "size")


def pes_units(spark: SparkSession, sf: str) -> DataFrame:
    packets = parse_packets(emap.pack(emap.direct(spark, sf)), prefix=4)
    return psi.pes_units(packets).select("pid", "unit", "first_pkt", "last_pkt", "stream_id", "pts90", "dts90", F.length("es").cast("bigint").alias("es_len"))


def _programs(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as programs with a table each, nations as their streams, as packets."""
    word = lambda x: F.lpad(F.hex(x.cast("bigint")), 4, "0")
    region, nation = spark.read.parquet(f"{sf}/region.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    row = lambda place, pid, kind, extension, body: (place.alias("place"), pid.alias("pid"), F.lit(kind).alias("table_id"), extension.alias("extension"), F.lit(0).alias("version"), F.unhex(body).alias("body"))
    listed = region.agg(F.array_join(F.array_sort(F.collect_list(F.concat(word(r + 1), word(r + 0xE100)))), "").alias("x"))
    pat = listed.select(*row(F.lit(0), F.lit(0), 0, F.lit(1), F.col("x")))
    stream = F.struct(n.alias("n"), F.concat(F.when(n % 2 == 1, "1B").otherwise("0F"), word(n + 0xE200), F.lit("F0060A04656E6700")).alias("x"))
    streams = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(stream)), lambda s: s["x"]), "").alias("x"))
    pmt = region.join(streams, r == F.col("n_regionkey"), "left").select(*row(r + 1, r + 0x100, 2, r + 1, F.concat(F.lit("E200F000"), F.coalesce("x", F.lit("")))))
    return parse_packets(psi.pack_sections(pat.unionByName(pmt)))


def _streams(found: DataFrame) -> DataFrame:
    listed = psi.pat_entries(found).select("program_number", "pmt_pid")
    return psi.pmt_streams(found).join(listed, ["program_number", "pmt_pid"]).select("program_number", "pmt_pid", "pcr_pid", "es_pid", "stream_type", F.hex("descriptors").alias("descriptors"))


def psi_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Sections packed, reassembled and joined to the PAT."""
    return _streams(written(psi.sections(_programs(spark, sf), [0, *range(0x100, 0x105)])))


def psi_streams_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with the sections from a table function."""
    table_functions.register(spark)
    found = spark.sql("SELECT * FROM psi_sections(TABLE({p}) PARTITION BY pid ORDER BY pkt_idx)", p=table_functions.payloads(_programs(spark, sf)))
    return _streams(written(found))


def unit_spans_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Payload units of the events from a table function."""
    table_functions.register(spark)
    return spark.sql("SELECT * FROM payload_unit_spans(TABLE({p}) PARTITION BY pid ORDER BY pkt_idx)", p=emap.direct(spark, sf).select("pkt_idx", "pid", "pusi"))


def mmt_packet_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Packets per context and packet id: every event is one MMTP packet in header-compressed IP, a file per user."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    hexed = lambda x, n: F.lpad(F.hex(x), n, "0")
    mmtp = F.concat(F.lit("0001"), hexed(F.lit(0xF100) + F.col("user_id") % 3, 4), hexed(F.col("event_id"), 8), hexed(F.col("event_id"), 8), F.hex("props"))
    body = F.concat(hexed(F.col("event_id") % 4 * 16 + F.col("event_id") % 16, 4), F.lit("61"), mmtp)
    blobs = joined(e, "user_id", ["event_id"], F.concat(F.lit("7F03"), hexed(F.shiftright(F.length(body), 1), 4), body))
    rows = parse_blobs(blobs, containers.mmtp_packets, containers.MMTP_ROWS, ("user_id",))
    return rows.groupBy("cid", "packet_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def tlv_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tlv_packets(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("n_bytes"), F.sum("skipped").alias("skipped"))


def video_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as streams, their orders as access units whose format follows priority and status."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.col("o_orderkey")
    wide = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    none = F.lit(None).cast("int")
    timed = F.col("o_orderstatus") != "P"
    units = o.select(
        F.col("o_custkey").alias("stream"), key.alias("au_no"), F.when(wide, 1920).otherwise(1280).alias("width"), F.when(wide, 1080).otherwise(720).alias("height"), F.when(timed, 255).alias("aspect_ratio_idc"), F.when(key % 2 == 0, 2).otherwise(4).alias("sar_width"), F.when(key % 2 == 0, 1).otherwise(2).alias("sar_height"),
        none.alias("primaries"), none.alias("transfer"), none.alias("matrix"), F.when(timed, F.when(key % 3 == 0, 1001).otherwise(2002)).alias("num_units_in_tick"), F.when(timed, F.when(key % 3 == 0, 30_000).otherwise(60_000)).alias("time_scale"), (F.col("o_orderstatus") == "F").alias("is_idr"), (key % 5 == 0).alias("all_intra"), (key % 2 == 0).alias("has_sps"),
    )
    return number_sequences(units, ("stream",)).select("stream", "au_no", "vseq", "cvs")


QUERIES = {"mmt_packet_counts": mmt_packet_counts, "tlv_type_counts": tlv_type_counts, "video_sequences": video_sequences, "nal_units": nal_units, "av1_obus": av1_obus, "tlv_packets": tlv_packets, "adts_frames": adts_frames, "mp4_boxes": mp4_boxes, "pes_units": pes_units, "psi_streams": psi_streams, "psi_streams_by_sql": psi_streams_by_sql, "unit_spans_by_sql": unit_spans_by_sql}

_LINES = "l AS (SELECT l_orderkey, l_returnflag AS f, l_linenumber AS ln, length(CAST(l_partkey AS VARCHAR)) AS n, row_number() OVER w - 1 AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag))"
_BEFORE = "OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

ORACLES = {
    "mmt_packet_counts": "SELECT CAST(event_id % 4 AS INT) AS cid, CAST(61696 + user_id % 3 AS INT) AS packet_id, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY ALL",
    "tlv_type_counts": f"""WITH {_LINES} SELECT CASE f WHEN 'N' THEN 'HeaderCompressedIP' WHEN 'R' THEN 'IPv6' ELSE 'Null' END AS name, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(sum(CASE WHEN ln = 3 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM l GROUP BY f""",
    "video_sequences": """WITH u AS (SELECT o_custkey AS stream, o_orderkey AS au_no, o_orderpriority IN ('1-URGENT', '2-HIGH') AS wide, o_orderstatus = 'F' OR o_orderkey % 10 = 0 AS key FROM orders),
        l AS (SELECT *, lag(wide) OVER (PARTITION BY stream ORDER BY au_no) AS before FROM u), v AS (SELECT *, before IS NULL OR wide <> before AS fresh FROM l),
        s AS (SELECT *, sum(CAST(fresh AS INT)) OVER w AS vs, sum(CAST(fresh OR key AS INT)) OVER w AS cs FROM v WINDOW w AS (PARTITION BY stream ORDER BY au_no))
        SELECT stream, au_no, CAST(vs - 1 AS BIGINT) AS vseq, CAST(cs - min(cs) OVER (PARTITION BY stream, vs) AS BIGINT) AS cvs FROM s""",
    "nal_units": f"""WITH {_LINES}, t AS (SELECT *, CASE f WHEN 'N' THEN 1 WHEN 'R' THEN 5 ELSE 9 END AS kind, lag(f) OVER (PARTITION BY l_orderkey ORDER BY k) AS before FROM l)
        SELECT l_orderkey, CAST(sum(CASE WHEN kind = 9 AND before IN ('N', 'R') THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS BIGINT) AS au_no, k AS nu_no,
            CAST(coalesce(sum(n + 5) {_BEFORE}, 0) + 4 AS BIGINT) AS byte_off, n + 1 AS byte_len, kind AS nal_type, CASE kind WHEN 1 THEN 'non-IDR' WHEN 5 THEN 'IDR' ELSE 'AUD' END AS kind, kind <> 9 AS is_vcl FROM t""",
    "av1_obus": f"""WITH {_LINES} SELECT l_orderkey, CAST(greatest(sum(CASE WHEN f = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k) - 1, 0) AS BIGINT) AS tu, k AS obu,
        CASE f WHEN 'N' THEN 6 WHEN 'R' THEN 1 ELSE 2 END AS obu_type, CAST(coalesce(sum(n + 2) {_BEFORE}, 0) AS BIGINT) AS byte_off, n + 2 AS byte_len FROM l""",
    "tlv_packets": f"""WITH {_LINES}, g AS (SELECT *, CASE WHEN ln = 3 THEN 1 ELSE 0 END AS gap FROM l)
        SELECT l_orderkey, k AS idx, CAST(coalesce(sum(n + 4 + gap) {_BEFORE}, 0) + gap AS BIGINT) AS byte_off, CASE f WHEN 'N' THEN 3 WHEN 'R' THEN 2 ELSE 255 END AS type,
            CASE f WHEN 'N' THEN 'HeaderCompressedIP' WHEN 'R' THEN 'IPv6' ELSE 'Null' END AS name, n AS len, CAST(gap AS BIGINT) AS skipped FROM g""",
    "adts_frames": """WITH e AS (SELECT user_id, event_id, length(props) + 7 AS n FROM events) SELECT user_id, row_number() OVER w - 1 AS frame,
        CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_off, n AS byte_len, 48000 AS sample_rate, 2 AS channels FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "mp4_boxes": """WITH c AS (SELECT c_nationkey, length(c_name) + 16 AS n, row_number() OVER w - 1 AS k FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
        t AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY c_nationkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 20 AS BIGINT) AS pos FROM c)
        SELECT c_nationkey, CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS level, 'ftyp' AS type, CAST(0 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS "offset", CAST(12 AS BIGINT) AS size FROM c GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 1, NULL, 0, 'moov', 0, 12, CAST(sum(n) + 8 AS BIGINT) FROM c GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 2 + 2 * k, 1, 1, 'trak', k, pos, n FROM t
        UNION ALL SELECT c_nationkey, 3 + 2 * k, 2 + 2 * k, 2, 'tkhd', 0, pos + 8, n - 8 FROM t""",
    "pes_units": f"""WITH {emap.SQL}, u AS (SELECT *, sum(CAST(pusi AS INT)) OVER (PARTITION BY pid ORDER BY pkt_idx) AS unit FROM packets)
        SELECT pid, CAST(unit AS BIGINT) AS unit, min(pkt_idx) AS first_pkt, max(pkt_idx) AS last_pkt, 224 AS stream_id, max(pts90) AS pts90, max(dts90) AS dts90,
            CAST(sum(CASE WHEN pcr27 IS NULL THEN 184 ELSE 176 END) - CASE WHEN max(dts90) IS NULL THEN 14 ELSE 19 END AS BIGINT) AS es_len FROM u WHERE unit > 0 GROUP BY pid, unit""",
    "psi_streams": "SELECT r_regionkey + 1 AS program_number, r_regionkey + 256 AS pmt_pid, 512 AS pcr_pid, n_nationkey + 512 AS es_pid, CASE WHEN n_nationkey % 2 = 1 THEN 27 ELSE 15 END AS stream_type, '0A04656E6700' AS descriptors FROM nation JOIN region ON n_regionkey = r_regionkey",
}
ORACLES["psi_streams_by_sql"] = ORACLES["psi_streams"]
ORACLES["unit_spans_by_sql"] = f"""WITH {emap.SQL}, u AS (SELECT *, sum(CAST(pusi AS INT)) OVER (PARTITION BY pid ORDER BY pkt_idx) AS n FROM packets)
    SELECT pid, CAST(n AS BIGINT) AS unit, min(pkt_idx) AS first_pkt, max(pkt_idx) AS last_pkt, count(*) AS n_packets FROM u WHERE n > 0 GROUP BY pid, n"""
