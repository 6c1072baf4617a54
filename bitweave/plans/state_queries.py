"""Queries over what carries state: AV1 reference slots, header windows, event-time windows, message checks and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.crc import crc_hex
from ..operators import mmt, psi
from ..operators.packets import parse_packets
from ..operators.shared import shared_folder
from ..sources import audio, av1_state, containers
from ..sources import mmt as mmt_sources
from ..sources import packets as packet_sources
from ..sources.blobs import parse_blobs
from ..streaming import units as streaming
from . import emap
from .blob_queries import joined
from .parser_queries import _digits, _packed, _read
from .syntax_queries import mmt_packet_list

# A temporal delimiter, a sequence header (512 x 512 at most, order hints of seven bits) and a key frame with hint 0.
_SEQUENCE = "000" + "0" * 2 + "0" * 2 + "0" * 5 + "0" * 12 + "00101" + "1000" * 2 + "1" * 18 + "0" + "000" + "0000" + "100" + "1" + "1" + "110" + "0" * 8
_KEY = "0" + "00" + "1" + "000" + "0" * 7 + "0" * 8


def _obu(kind: int, bit_text: str) -> str:
    whole = bit_text.ljust(-(-len(bit_text) // 8) * 8, "0")
    return f"{kind << 3 | 2:02X}{len(whole) // 8:02X}{int(whole, 2):0{len(whole) // 4}X}"


def av1_references(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as streams of a key frame and a frame for each line: what they refer to and what the slots hold."""
    p, hint = F.col("l_partkey"), F.lpad(F.bin(F.col("l_suppkey") % 128), 7, F.lit("0"))
    refresh = F.lpad(F.bin(p % 255), 8, F.lit("0"))
    refs = F.concat(*(F.lpad(F.bin((p + k) % 8), 3, F.lit("0")) for k in range(7)))
    bits = F.when(p % 5 == 0, F.concat(F.lit("0" + "10" + "1" + "0" + "000"), hint, refresh)).otherwise(F.concat(F.lit("0" + "01" + "1" + "0" + "000"), hint, F.lit("000"), refresh, F.lit("0"), refs))
    body = _packed(F.concat(bits, F.lit("00000000")))
    blobs = joined(_read(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], F.concat(F.lit("32"), _digits(F.length(body) / 2, 2), body))
    start = "1200" + _obu(1, _SEQUENCE) + _obu(6, _KEY)
    rows = parse_blobs(blobs.select("l_orderkey", F.concat(F.unhex(F.lit(start)), "data").alias("data")), av1_state.av1_reference_state, av1_state.STATE_ROWS, ("l_orderkey",))
    text = lambda name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
    return rows.select("l_orderkey", "obu", "frame", "frame_type", "order_hint", "refresh", text("refs"), text("slots"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """A packet per event: a message of its own, or one of two of an aggregated payload; one checksum in four is wrong."""
    e = _read(spark, sf, "events")
    k = F.col("event_id")
    section = F.concat(F.when(k % 5 == 0, "A7").otherwise("8B"), F.hex("props"))
    check = F.when(k % 4 == 0, "00000001").otherwise(crc_hex(F.unhex(section), "crc-32-mpeg"))
    message = F.concat(_digits(k % 5 + 0x8000, 4), F.lit("00"), _digits(F.length("props") + 5, 4), section, check)
    size = F.length("props") + 10
    payload = F.when(k % 2 == 0, F.concat(F.lit("0100"), _digits(F.lit(3), 4), F.lit("000100"), _digits(size, 4), message)).otherwise(F.concat(F.lit("0000"), message))
    body = F.concat(F.lit("001061"), F.lit("0002"), F.lit("8000"), _digits(k, 8), _digits(k, 8), payload)
    return joined(e, "user_id", ["event_id"], F.concat(F.lit("7F03"), _digits(F.length(body) / 2, 4), body))


def mmt_message_checks(spark: SparkSession, sf: str) -> DataFrame:
    units = parse_blobs(_messages(spark, sf), mmt_sources.mmtp_units, mmt_sources.UNIT_ROWS, ("user_id",)).where("kind = 'message'")
    return mmt.message_checks(units).select("user_id", "seq", "ordinal", "message_id", "table_id", "computed", "ok")


def mmt_data_units(spark: SparkSession, sf: str) -> DataFrame:
    """A packet per event: two aggregated timed units, or one of an item."""
    e = _read(spark, sf, "events")
    k, text = F.col("event_id"), F.hex("props")
    timed = F.concat(_digits(k, 8), _digits(k * 2, 8), _digits(k * 3, 8), _digits(k % 256, 2), _digits(k % 7, 2), text)
    part = F.concat(_digits(F.length(timed) / 2, 4), timed)
    two = F.concat(F.lit("29"), F.lit("00"), _digits(k % 50, 8), part, part)
    one = F.concat(F.lit("20"), F.lit("00"), _digits(k % 50, 8), _digits(k + 7, 8), text)
    unit = F.when(k % 2 == 0, two).otherwise(one)
    body = F.concat(F.lit("002061"), F.lit("0000"), _digits(F.lit(0xF100), 4), _digits(k, 8), _digits(k, 8), _digits(F.length(unit) / 2, 4), unit)
    rows = parse_blobs(joined(e, "user_id", ["event_id"], F.concat(F.lit("7F03"), _digits(F.length(body) / 2, 4), body)), mmt_sources.mmtp_units, mmt_sources.UNIT_ROWS, ("user_id",))
    return rows.select("user_id", "cid", "seq", "ordinal", "mpu_seq", "movie_fragment", "sample", "offset", "priority", "dependency", "item_id", F.decode("data", "UTF-8").alias("text"))


def mmt_events(spark: SparkSession, sf: str) -> DataFrame:
    """A message with one event per order: its day, a time and a duration, and its text as a short event descriptor."""
    o = _read(spark, sf, "orders")
    k, bcd = F.col("o_orderkey"), lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.datediff(F.col("o_orderdate"), F.lit("1858-11-17").cast("date"))
    name = F.hex(F.concat(F.lit("Nr "), k.cast("string")))
    short = F.concat(F.lit("6A706E"), _digits(F.length(name) / 2, 2), name, _digits(F.length("o_orderpriority"), 4), F.hex("o_orderpriority"))
    loop = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("80040100"), F.lit("F001"), _digits(F.length(short) / 2, 4), short))
    event = F.concat(_digits(k % 65536, 4), _digits(day, 4), bcd(k % 24), bcd(k % 60), F.lit("30"), F.when(k % 5 == 0, "FFFFFF").otherwise(F.concat(F.lit("01"), bcd(k % 59), F.lit("00"))), _digits(F.length(loop) / 2 + (k % 8) * 8192 + (k % 2) * 4096, 4), loop)
    body = F.concat(_digits(F.col("o_custkey") % 65536, 4), F.lit("C7"), F.lit("0000"), F.lit("0007"), F.lit("0004"), F.lit("008B"), event, F.lit("00000000"))
    section = F.concat(F.lit("8B"), _digits(F.length(body) / 2 + 0xB000, 4), body)
    message = F.concat(F.lit("800000"), _digits(F.length(section) / 2 + 3, 4), F.lit("8C0000"), section)
    rows = parse_blobs(o.select("o_orderkey", F.unhex(message).alias("data")), mmt_sources.events, mmt_sources.EVENT_ROWS, ("o_orderkey",))
    return rows.withColumn("day", scalars.mjd_date(F.col("start_mjd")).cast("string")).drop("start_mjd")


def mmt_access(spark: SparkSession, sf: str) -> DataFrame:
    """A CA message per part: an access control descriptor, and another with a length of two bytes."""
    k = F.col("p_partkey")
    control = F.concat(F.lit("8004"), F.lit("06"), _digits(k % 65536, 4), F.lit("00"), _digits(k % 8192, 4), F.lit("AA"))
    other = F.concat(F.lit("F123"), _digits(F.length("p_name"), 4), F.hex("p_name"))
    table = F.concat(control, other)
    message = F.concat(F.lit("0001"), _digits(k % 256, 2), _digits(F.length(table) / 2 + 4, 4), F.lit("86"), _digits(k % 7, 2), _digits(F.length(table) / 2, 4), table)
    rows = parse_blobs(_read(spark, sf, "part").select("p_partkey", F.unhex(message).alias("data")), mmt_sources.ca_descriptors, mmt_sources.CA_ROWS, ("p_partkey",))
    return rows.withColumn("body", F.hex("body"))


def mmt_filters(spark: SparkSession, sf: str) -> DataFrame:
    return mmt.select_packets(mmt_packet_list(spark, sf), 2, 0xF101, 7, 100, 9000).select("user_id", "idx", "cid", "packet_id", "mpu_seq", "seq")


def pes_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Units of private streams by stream_id and stream_id_extension; one of four has none and matches any."""
    k = F.col("event_id")
    extended = F.concat(F.lit("000001FD0000800103" + "0F81"), F.when(k % 4 == 0, "55").otherwise("60"))
    pes = F.concat(F.when(k % 4 < 2, extended).when(k % 4 == 2, "000001FD0000800000").otherwise("000001E00000800000"), F.hex("props"))
    raw = F.concat(F.lit("47"), _digits(0x4000 + 256 + F.col("user_id") % 16, 4), F.lit("10"), pes)
    packets = _read(spark, sf, "events").select(k.alias("pkt_idx"), F.unhex(F.rpad(raw, 376, "F")).alias("raw"))
    return psi.pes_units(parse_packets(packets), None, 0xFD, 0x55).select("pid", "unit", "first_pkt", "stream_id", "stream_id_extension")


def streamed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The first 24 bytes of each payload unit by the streaming operator."""
    source, sink = shared_folder(spark), shared_folder(spark)
    emap.direct(spark, sf).select("pkt_idx", "pid", "pusi", "payload").write.parquet(source)
    stream = spark.readStream.schema("pkt_idx long, pid int, pusi boolean, payload binary").parquet(source)
    streaming.header_windows(stream, 24).writeStream.format("parquet").option("path", sink).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streaming.HEADERS).parquet(sink).withColumn("head", F.decode("head", "UTF-8"))


def drained_units(spark: SparkSession, sf: str) -> DataFrame:
    """Every payload unit: those that the stream closed, and those still open in its state at the end."""
    source, sink, state = shared_folder(spark), shared_folder(spark), shared_folder(spark)
    emap.packed(spark, sf).select("pkt_idx", "pid", "pusi", "atc").write.parquet(source)
    stream = spark.readStream.schema("pkt_idx long, pid int, pusi boolean, atc long").parquet(source)
    streaming.payload_units(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema(streaming.UNITS).parquet(sink)
    return closed.withColumn("open", F.lit(False)).unionByName(streaming.open_units(spark, state).withColumn("open", F.lit(True)))


def drained_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 bytes of every payload unit, of the last and of shorter ones too."""
    source, sink, state = shared_folder(spark), shared_folder(spark), shared_folder(spark)
    emap.direct(spark, sf).select("pkt_idx", "pid", "pusi", "payload").write.parquet(source)
    stream = spark.readStream.schema("pkt_idx long, pid int, pusi boolean, payload binary").parquet(source)
    streaming.header_windows(stream, 200).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(streaming.HEADERS).parquet(sink).unionByName(streaming.open_headers(spark, state))
    return rows.withColumn("head", F.decode("head", "UTF-8"))


def streamed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Packets per PID and ten minutes of event time, of the windows that the watermark closes."""
    source, sink = shared_folder(spark), shared_folder(spark)
    rows = _read(spark, sf, "events").select((F.lit(256) + F.col("user_id") % 16).cast("int").alias("pid"), F.timestamp_micros(emap.micros(F.col("ts"))).alias("ts"))
    rows.write.parquet(source)
    stream = spark.readStream.schema("pid int, ts timestamp").parquet(source)
    streaming.windowed_counts(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, pid int, n_packets long, n_bytes long").parquet(sink).select(F.unix_micros("start").alias("start_us"), "pid", "n_packets", "n_bytes")


def file_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats by file name, for extensions in any case, unknown ones and none."""
    names = F.array(*(F.lit(x) for x in ("clip.TS", "a.b/c.m2ts", "x.Mp4", "x.webm", "x.tlv", "x.265", "x.obu", "x.aifc", "x.vob", "x.txt", "mkv", "dir.mkv/none")))
    path = F.concat(F.lit("s3a://b/"), F.col("p_partkey").cast("string"), F.lit("/"), F.get(names, (F.col("p_partkey") % 12).cast("int")))
    return _read(spark, sf, "part").select("p_partkey", packet_sources.format_by_extension(path).alias("format"))


def aiff_fields(spark: SparkSession, sf: str) -> DataFrame:
    """An AIFF-C file per part, with a version, a marker of the part's name, a comment and an instrument."""
    k, size = F.col("p_partkey"), F.length("p_name")
    chunk = lambda name, body: F.concat(F.hex(F.lit(name)), _digits(F.length(body) / 2, 8), body, F.when(F.length(body) / 2 % 2 == 1, "00").otherwise(""))
    version = F.lit("A2805140")
    marks = F.concat(F.lit("0002"), F.lit("FFFF"), _digits(k, 8), F.lit("00" + "00"), F.lit("0001"), _digits(k * 3, 8), _digits(size, 2), F.hex("p_name"), F.when(size % 2 == 0, "00").otherwise(""))
    comment = F.concat(F.lit("0001"), _digits(k + 3000000000, 8), F.lit("FFFF"), _digits(F.length("p_type"), 4), F.hex("p_type"), F.when(F.length("p_type") % 2 == 1, "00").otherwise(""))
    instrument = F.concat(_digits(k % 128, 2), F.lit("FE"), F.lit("007F017F"), F.lit("FFFA"), F.lit("0001"), _digits(k % 100, 4), F.lit("0002" + "0000" * 3))
    body = F.concat(F.hex(F.lit("AIFC")), chunk("FVER", version), chunk("MARK", marks), chunk("COMT", comment), chunk("INST", instrument))
    data = F.unhex(F.concat(F.hex(F.lit("FORM")), _digits(F.length(body) / 2, 8), body))
    return parse_blobs(_read(spark, sf, "part").select("p_partkey", data.alias("data")), containers.aiff_fields, containers.AIFF_FIELD_ROWS, ("p_partkey",))


def dts_hd_frames(spark: SparkSession, sf: str) -> DataFrame:
    """A stream per user: every event is an extension substream, with static fields unless its number divides by seven."""
    k = F.col("event_id")
    number = lambda x, n: F.lpad(F.bin(x), n, F.lit("0"))
    asset = F.concat(F.lit("0" * 9 + "000"), F.when(k % 2 == 0, "10101").otherwise("0"), F.when(k % 3 == 0, F.lit("1" + "011001010110111001100111")).otherwise("0"), F.lit("0"), F.lit("10111"), number(k % 16, 4), number(k % 8, 8), F.lit("0" * 16))
    static = F.concat(F.lit("1" + "00" + "001"), F.when(k % 5 == 0, F.lit("1" + "0" * 36)).otherwise("0"), F.lit("000" + "000" + "1" + "00000001" + "0"), F.lit("0" * 20), asset)
    fields = F.when(k % 7 == 0, "0" * 64).otherwise(static)
    text = F.hex("props")
    head = (F.ceil((4 * 8 + 8 + 2 + 1 + 12 + 20 + F.length(fields)) / 8)).cast("bigint")
    size = head + F.length("props")
    bits = F.concat(F.lit("0" * 8 + "00" + "1"), number(head - 1, 12), number(size - 1, 20), fields)
    frame = F.concat(F.lit("64582025"), _packed(bits), text)
    rows = parse_blobs(joined(_read(spark, sf, "events"), "user_id", ["event_id"], frame), audio.dts_hd_frames, audio.FRAME_ROWS, ("user_id",))
    return rows.select("user_id", "frame", "codec", "sample_rate", "channels")


QUERIES = {
    "dts_hd_frames": dts_hd_frames,
    "file_formats": file_formats, "aiff_fields": aiff_fields,
    "av1_references": av1_references, "mmt_message_checks": mmt_message_checks, "mmt_data_units": mmt_data_units, "mmt_filters": mmt_filters, "mmt_events": mmt_events, "mmt_access": mmt_access,
    "pes_filters": pes_filters, "streamed_headers": streamed_headers, "streamed_windows": streamed_windows, "drained_units": drained_units, "drained_headers": drained_headers,
}

_CRC = """t AS (SELECT list(list_reduce(list_prepend(CAST(i * 16777216 AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda r, k: CASE WHEN r >= 2147483648 THEN xor((r * 2) & 4294967295, CAST(79764919 AS UBIGINT)) ELSE r * 2 END) ORDER BY i) AS crc FROM range(256) r(i))"""

ORACLES = {
    "av1_references": """WITH l AS (SELECT l_orderkey, l_partkey AS p, l_suppkey AS s, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
        b AS (SELECT l_orderkey, p, s, k, i, coalesce(max(CASE WHEN ((p % 255) >> i) & 1 = 1 THEN k END) OVER (PARTITION BY l_orderkey, i ORDER BY k), 0) AS held FROM l, range(8) r(i)),
        f AS (SELECT l_orderkey, p, s, k, list(held ORDER BY i) AS slots FROM b GROUP BY ALL), g AS (SELECT *, coalesce(lag(slots) OVER (PARTITION BY l_orderkey ORDER BY k), [0, 0, 0, 0, 0, 0, 0, 0]) AS prior FROM f)
        SELECT l_orderkey, k + 2 AS obu, k AS frame, CASE WHEN p % 5 = 0 THEN 'INTRA_ONLY' ELSE 'INTER' END AS frame_type, CAST(s % 128 AS INT) AS order_hint, CAST(p % 255 AS INT) AS refresh,
            CASE WHEN p % 5 <> 0 THEN array_to_string(list_transform(range(7), lambda j: prior[CAST((p + j) % 8 + 1 AS INT)]), ',') END AS refs, array_to_string(slots, ',') AS slots FROM g
        UNION ALL SELECT DISTINCT l_orderkey, 2, 0, 'KEY', 0, 255, NULL, '0,0,0,0,0,0,0,0' FROM lineitem""",
    "mmt_message_checks": f"""WITH {_CRC}, e AS (SELECT user_id, event_id, CAST(list_prepend(139, list_transform(regexp_extract_all(hex(encode(props)), '..'), lambda x: CAST('0x' || x AS INT))) AS UBIGINT[]) AS bytes FROM events WHERE event_id % 5 IN (2, 3, 4)),
        c AS (SELECT user_id, event_id, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda r, b: xor((r * 256) & 4294967295, crc[CAST(xor(r >> 24, b) AS INT) + 1])) AS crc FROM e, t)
        SELECT user_id, event_id AS seq, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS ordinal, '800' || event_id % 5 AS message_id, '8B' AS table_id, lpad(hex(crc), 8, '0') AS computed, event_id % 4 <> 0 OR crc = 1 AS ok FROM c""",
    "mmt_data_units": """WITH e AS (SELECT *, event_id AS k FROM events)
        SELECT user_id, 2 AS cid, k AS seq, CAST(o AS INT) AS ordinal, k % 50 AS mpu_seq, k AS movie_fragment, k * 2 AS sample, k * 3 AS "offset", CAST(k % 256 AS INT) AS priority, CAST(k % 7 AS INT) AS dependency, CAST(NULL AS BIGINT) AS item_id, props AS text FROM e, range(2) r(o) WHERE k % 2 = 0
        UNION ALL SELECT user_id, 2, k, 0, k % 50, NULL, NULL, NULL, NULL, NULL, k + 7, props FROM e WHERE k % 2 = 1""",
    "mmt_filters": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
        SELECT user_id, k AS idx, 2 AS cid, 61697 AS packet_id, CAST(7 AS BIGINT) AS mpu_seq, event_id AS seq FROM e WHERE user_id % 5 = 2 AND user_id % 3 = 1 AND event_id % 50 = 7 AND event_id >= 100 AND event_id < 9000""",
    "mmt_events": """SELECT o_orderkey, CAST(o_custkey % 65536 AS INT) AS service_id, 3 AS version, 0 AS section, 7 AS stream_id, 4 AS network_id, CAST(o_orderkey % 65536 AS INT) AS event_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + 30 AS INT) AS start_sec,
        CAST(CASE WHEN o_orderkey % 5 <> 0 THEN 3600 + o_orderkey % 59 * 60 END AS INT) AS duration_sec, CAST(o_orderkey % 8 AS INT) AS running_status, o_orderkey % 2 = 1 AS free_ca,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'jpn' END AS language, CASE WHEN o_orderkey % 3 <> 0 THEN 'Nr ' || o_orderkey END AS name, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS text FROM orders""",
    "mmt_access": """SELECT p_partkey, CAST(p_partkey % 256 AS INT) AS message_version, CAST(p_partkey % 7 AS INT) AS table_version, 0 AS ordinal, 32772 AS tag, lpad(hex(p_partkey % 65536), 4, '0') || '00' || lpad(hex(p_partkey % 8192), 4, '0') || 'AA' AS body, CAST(p_partkey % 65536 AS INT) AS ca_system_id, CAST(p_partkey % 8192 AS INT) AS packet_id FROM part
        UNION ALL SELECT p_partkey, CAST(p_partkey % 256 AS INT), CAST(p_partkey % 7 AS INT), 1, 61731, hex(encode(p_name)), NULL, NULL FROM part""",
    "file_formats": "SELECT p_partkey, ['ts', 'm2ts192', 'isobmff', 'matroska', 'mmt', 'hevc', 'av1', 'aiff', 'ps', NULL, NULL, NULL][CAST(p_partkey % 12 + 1 AS INT)] AS format FROM part",
    "aiff_fields": """WITH p AS (SELECT *, p_partkey AS k FROM part), f AS (
        SELECT k, 'FVER' AS chunk, 0 AS ordinal, 'timestamp' AS field, 2726318400 AS number, NULL AS text FROM p
        UNION ALL SELECT k, 'MARK', o, f, CASE WHEN f = 'id' THEN 2 * o - 1 WHEN f = 'position' THEN k * (2 * o + 1) END, CASE WHEN f = 'text' THEN CASE WHEN o = 1 THEN p_name ELSE '' END END FROM p, range(2) r(o), unnest(['id', 'position', 'text']) u(f)
        UNION ALL SELECT k, 'COMT', 0, f, CASE WHEN f = 'time' THEN k + 3000000000 WHEN f = 'marker' THEN -1 END, CASE WHEN f = 'text' THEN p_type END FROM p, unnest(['time', 'marker', 'text']) u(f)
        UNION ALL SELECT k, 'INST', 0, f, CASE f WHEN 'base_note' THEN k % 128 WHEN 'detune' THEN -2 WHEN 'high_note' THEN 127 WHEN 'low_velocity' THEN 1 WHEN 'high_velocity' THEN 127 WHEN 'gain' THEN -6 WHEN 'sustain_mode' THEN 1 WHEN 'sustain_begin' THEN k % 100 WHEN 'sustain_end' THEN 2 ELSE 0 END, NULL
            FROM p, unnest(['base_note', 'detune', 'low_note', 'high_note', 'low_velocity', 'high_velocity', 'gain', 'sustain_mode', 'sustain_begin', 'sustain_end', 'release_mode', 'release_begin', 'release_end']) u(f))
        SELECT k AS p_partkey, chunk, CAST(ordinal AS INT) AS ordinal, field, CAST(number AS BIGINT) AS number, CAST(text AS VARCHAR) AS text FROM f""",
    "dts_hd_frames": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, 'DTS-HD' AS codec, CASE WHEN event_id % 7 <> 0 THEN [8000, 16000, 32000, 64000, 128000, 22050, 44100, 88200, 176400, 352800, 12000, 24000, 48000, 96000, 192000, 384000][CAST(event_id % 16 + 1 AS INT)] END AS sample_rate,
        CAST(CASE WHEN event_id % 7 <> 0 THEN event_id % 8 + 1 END AS INT) AS channels FROM events""",
    "pes_filters": """WITH e AS (SELECT event_id, CAST(256 + user_id % 16 AS INT) AS pid, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS unit FROM events)
        SELECT pid, unit, event_id AS first_pkt, 253 AS stream_id, CAST(CASE WHEN event_id % 4 = 0 THEN 85 END AS INT) AS stream_id_extension FROM e WHERE event_id % 4 IN (0, 2)""",
    "streamed_headers": """WITH p AS (SELECT event_id AS k, CAST(256 + user_id % 16 AS INT) AS pid, props, event_type = 'signup' AS pusi FROM events), u AS (SELECT *, sum(CAST(pusi AS INT)) OVER (PARTITION BY pid ORDER BY k) AS unit FROM p),
        g AS (SELECT pid, CAST(unit AS BIGINT) AS unit, min(k) AS first_pkt, string_agg(props, '' ORDER BY k) AS whole, max(unit) OVER (PARTITION BY pid) AS newest FROM u WHERE unit > 0 GROUP BY pid, u.unit)
        SELECT pid, unit, first_pkt, whole[1:24] AS head FROM g WHERE length(whole) >= 24 OR unit < newest""",
    "drained_units": f"""WITH {emap.SQL}, d AS (SELECT *, (atc - lag(atc) OVER w + 1073741824) % 1073741824 AS step, sum(CAST(pusi AS INT)) OVER w AS unit FROM packets WINDOW w AS (PARTITION BY pid ORDER BY pkt_idx)),
        r AS (SELECT *, CAST(sum(coalesce(step, 0)) OVER (PARTITION BY pid ORDER BY pkt_idx) AS BIGINT) AS t FROM d),
        u AS (SELECT pid, CAST(unit AS BIGINT) AS unit, min(pkt_idx) AS first_pkt, max(pkt_idx) AS last_pkt, count(*) AS n_packets, min(t) AS t FROM r WHERE unit > 0 GROUP BY pid, unit)
        SELECT pid, unit, first_pkt, last_pkt, n_packets, lead(t) OVER w - t AS elapsed27, lead(t) OVER w IS NULL AS open FROM u WINDOW w AS (PARTITION BY pid ORDER BY unit)""",
    "drained_headers": """WITH p AS (SELECT event_id AS k, CAST(256 + user_id % 16 AS INT) AS pid, props, event_type = 'signup' AS pusi FROM events), u AS (SELECT *, sum(CAST(pusi AS INT)) OVER (PARTITION BY pid ORDER BY k) AS unit FROM p)
        SELECT pid, CAST(unit AS BIGINT) AS unit, min(k) AS first_pkt, string_agg(props, '' ORDER BY k)[1:200] AS head FROM u WHERE unit > 0 GROUP BY pid, u.unit""",
    "streamed_windows": """WITH w AS (SELECT epoch_us(ts) // 600000000 * 600000000 AS start_us, CAST(256 + user_id % 16 AS INT) AS pid, count(*) AS n FROM events GROUP BY ALL)
        SELECT start_us, pid, n AS n_packets, n * 188 AS n_bytes FROM w WHERE start_us + 600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 1800000000 FROM events)""",
}
