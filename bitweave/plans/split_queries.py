"""Streams that are cut into byte ranges: tables written as one stream, and scanned by ranges that know nothing of its packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crc
from ..operators import split_scan
from ..operators.shared import shared_folder
from ..sources.byte_streams import write_stream

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
#: Far smaller than in use, so that the tables take many ranges and packets lie across their ends.
SPLIT = 40_000


def _lines_stream(spark: SparkSession, sf: str, digits: Column) -> str:
    """All lines as one stream; returns where it is."""
    at = shared_folder(spark)
    write_stream(spark.read.parquet(f"{sf}/lineitem.parquet").select(*_ORDER, F.unhex(digits).alias("_data")), at, _ORDER, "_data")
    return at


def _by_flag(n: str, r: str, a: str) -> Column:
    return F.when(F.col("l_returnflag") == "N", n).when(F.col("l_returnflag") == "R", r).otherwise(a)


def tlv_split_scan(spark: SparkSession, sf: str) -> DataFrame:
    """TLV packets; what stands before a third line belongs to none, though its first bytes look like a packet that never fits."""
    body = F.col("l_partkey").cast("string")
    unit = F.concat(F.when(F.col("l_linenumber") == 3, "7F7F7F0055").otherwise(""), F.lit("7F"), _by_flag("03", "02", "FF"), F.lpad(F.hex(F.length(body)), 4, "0"), F.hex(body))
    return split_scan.scan_tlv(spark, _lines_stream(spark, sf, unit), SPLIT)


def ps_split_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A pack for each first line, a packet for every line; payloads hold start codes, which only the true boundaries tell from packets."""
    key, digits = F.col("l_orderkey"), F.lpad(F.hex(F.col("l_partkey")), 8, "0")
    base = F.lit(0x440004000401) + F.shiftright(key, 15).bitwiseAND(F.lit(0x7FFF)) * 134217728 + key.bitwiseAND(F.lit(0x7FFF)) * 2048
    pack = F.concat(F.lit("000001BA"), F.lpad(F.hex(base), 12, "0"), F.lit("00000300"))
    body = F.concat(F.lit("800000"), F.lit("000001E0FFFF"), digits)
    packet = F.concat(F.lit("000001"), _by_flag("E0", "C0", "BD"), F.lpad(F.hex((F.length(body) / 2).cast("int")), 4, "0"), body)
    found = split_scan.scan_program_stream(spark, _lines_stream(spark, sf, F.concat(F.when(F.col("l_linenumber") == 1, pack).otherwise(""), packet)), SPLIT)
    return found.select("idx", "byte_off", "byte_len", "skipped", "stream_id", "scr", "sub_stream", "payload_at")


def nal_split_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Units between start codes, with zeros at the end of every third one."""
    unit = F.concat(F.lit("000001"), _by_flag("41", "65", "09"), F.hex(F.col("l_partkey").cast("string")), F.when(F.col("l_linenumber") == 3, F.repeat(F.lit("00"), F.col("l_suppkey").cast("int") % 50)).otherwise(""))
    return split_scan.scan_start_codes(spark, _lines_stream(spark, sf, unit), SPLIT)


def stream_crcs(spark: SparkSession, sf: str) -> DataFrame:
    """All 41 checks of the properties of all events, one after the other."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("props").cast("binary").alias("_data"))
    return crc.crc_in_order(events, "_data", "event_id")


def user_crcs(spark: SparkSession, sf: str) -> DataFrame:
    """Three checks, as published, of each user's stream of properties."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("props").cast("binary").alias("_data"))
    return crc.crc_in_order(events, "_data", "event_id", ("user_id",), ("crc-32", "crc-16-maxim", "crc-64-we"), standard=True)


QUERIES = {"stream_crcs": stream_crcs, "user_crcs": user_crcs, "tlv_split_scan": tlv_split_scan, "ps_split_scan": ps_split_scan, "nal_split_scan": nal_split_scan}



def crc_sql(by: str, names: list[str], standard: bool) -> str:
    """Byte by byte over each whole stream, in registers of which the check has the top bits."""
    rows = []
    for name in names:
        width, poly, init, last, reflected = crc.parameters()[name]
        if standard:
            init, last = crc.PUBLISHED.get(name, (init, last))
        rows.append(f"('{name}', {width}, {poly << (64 - width)}, {init << (64 - width)}, {last}, {str(reflected).lower()})")
    top, low = 1 << 63, (1 << 56) - 1
    return f"""WITH p AS (SELECT name, width, CAST(poly AS UBIGINT) AS poly, CAST(init AS UBIGINT) AS init, CAST(last AS UBIGINT) AS last, reflected FROM (VALUES {", ".join(rows)}) p(name, width, poly, init, last, reflected)),
        t AS (SELECT name, list(r ORDER BY i) AS t FROM (SELECT name, i, list_reduce(list_prepend(CAST(i AS UBIGINT) * CAST({1 << 56} AS UBIGINT), list_transform(range(8), lambda k: poly)), lambda r, y: CASE WHEN r >= CAST({top} AS UBIGINT) THEN xor((r - CAST({top} AS UBIGINT)) * 2, y) ELSE r * 2 END) AS r FROM p, range(256) x(i)) GROUP BY name),
        m AS (SELECT list(CAST(list_sum(list_transform(range(8), lambda k: ((i >> CAST(k AS INT)) & 1) << CAST(7 - k AS INT))) AS UBIGINT) ORDER BY i) AS m FROM range(256) x(i)),
        s AS (SELECT {by or "0 AS one"}, list_transform(regexp_extract_all(hex(encode(string_agg(props, '' ORDER BY event_id))), '..'), lambda h: CAST('0x' || h AS INT)) AS bytes FROM events GROUP BY {by or "1"}),
        r AS (SELECT s.*, p.*, list_reduce(list_prepend(init, list_transform(bytes, lambda b: CASE WHEN reflected THEN m[b + 1] ELSE CAST(b AS UBIGINT) END)), lambda r, b: xor((r & CAST({low} AS UBIGINT)) * 256, t[CAST(xor(r >> 56, b) AS INT) + 1])) AS r FROM s, p JOIN t USING (name), m)
        SELECT {by + ", " if by else ""}name, CAST(len(bytes) AS BIGINT) AS n_bytes, lpad(hex(xor(CASE WHEN reflected THEN CAST(list_sum(list_transform(range(64), lambda k: CAST((r >> CAST(k AS UBIGINT)) & 1 AS UBIGINT) << CAST(63 - k AS UBIGINT))) AS UBIGINT) ELSE r >> CAST(64 - width AS UBIGINT) END, last)), width // 4, '0') AS check FROM r"""


_W = "OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag ROWS UNBOUNDED PRECEDING)"
ORACLES = {
    "stream_crcs": crc_sql("", list(crc.parameters()), False),
    "user_crcs": crc_sql("user_id", ["crc-32", "crc-16-maxim", "crc-64-we"], True),
    "tlv_split_scan": f"""WITH l AS (SELECT *, CAST(strlen(CAST(l_partkey AS VARCHAR)) AS BIGINT) AS n, CAST(CASE WHEN l_linenumber = 3 THEN 5 ELSE 0 END AS BIGINT) AS gap FROM lineitem)
        SELECT row_number() {_W} - 1 AS idx, CAST(sum(gap + 4 + n) {_W} - 4 - n AS BIGINT) AS byte_off, 4 + n AS byte_len, gap AS skipped, CAST(CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 2 ELSE 255 END AS INTEGER) AS type, n AS len FROM l""",
    "ps_split_scan": f"""WITH l AS (SELECT *, CAST(6 + 3 + 6 + 4 AS BIGINT) AS n, unnest(CASE WHEN l_linenumber = 1 THEN [0, 1] ELSE [1] END) AS k FROM lineitem),
        o AS (SELECT *, CAST(CASE k WHEN 0 THEN 14 ELSE n END AS BIGINT) AS size FROM l)
        SELECT row_number() OVER w - 1 AS idx, CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS byte_off, size AS byte_len, CAST(0 AS BIGINT) AS skipped,
          CAST(CASE WHEN k = 0 THEN 186 WHEN l_returnflag = 'N' THEN 224 WHEN l_returnflag = 'R' THEN 192 ELSE 189 END AS INTEGER) AS stream_id,
          CASE WHEN k = 0 THEN ((l_orderkey >> 15) & 32767) * 32768 * 300 + (l_orderkey & 32767) * 300 END AS scr,
          CAST(CASE WHEN k = 1 AND l_returnflag NOT IN ('N', 'R') THEN 0 END AS INTEGER) AS sub_stream, CAST(CASE WHEN k = 1 THEN 9 END AS INTEGER) AS payload_at
        FROM o WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, k)""",
    "nal_split_scan": f"""WITH l AS (SELECT *, CAST(1 + strlen(CAST(l_partkey AS VARCHAR)) AS BIGINT) AS n, CAST(CASE WHEN l_linenumber = 3 THEN l_suppkey % 50 ELSE 0 END AS BIGINT) AS zeros FROM lineitem)
        SELECT row_number() {_W} - 1 AS unit_no, CAST(sum(3 + n + zeros) {_W} - n - zeros AS BIGINT) AS byte_off, n AS byte_len, CAST(CASE l_returnflag WHEN 'N' THEN 65 WHEN 'R' THEN 101 ELSE 9 END AS INTEGER) AS code FROM l""",
}
