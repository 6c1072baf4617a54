"""More parsers read back what SQL built: streams, containers, audio, MMT and text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio_layout, bits, clocks, huffman, literals, text
from ..operators import codec_info, mmt, psi
from ..operators.packets import parse_packets
from ..operators.shared import shared_folder, written
from ..sources import audio, containers, video
from ..sources.blobs import parse_blobs
from ..streaming import units as streaming
from . import emap
from .blob_queries import joined


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _digits(value: Column | int, n: int) -> Column:
    return F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("bigint")), n, "0")


def _ue(value: Column) -> Column:
    """Exp-Golomb bits."""
    code = F.bin(value + 1)
    return F.lpad(code, F.length(code) * 2 - 1, F.lit("0"))


def _packed(bit_text: Column) -> Column:
    """Bits as hex digits, the last byte filled up with zeros."""
    whole = F.rpad(bit_text, (F.ceil(F.length(bit_text) / 8) * 8).cast("int"), F.lit("0"))
    return F.array_join(F.transform(F.regexp_extract_all(whole, F.lit(".{8}"), F.lit(0)), lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), "")


def _sps(width16: Column, height16: Column) -> Column:
    """An H.264 baseline sequence parameter set, level 3, of so many macroblocks."""
    return F.concat(F.lit("67"), _packed(F.concat(F.lit("010000100000000000011110" + "1" + "1" + "011" + "010" + "0"), _ue(width16 - 1), _ue(height16 - 1), F.lit("1" + "1" + "0" + "0" + "1"))))


# -- streams ------------------------------------------------------------------


def ps_packets(spark: SparkSession, sf: str) -> DataFrame:
    """One program stream per user: a video packet for each event, or private stream 1 for every third."""
    e = _read(spark, sf, "events")
    sid = F.when(F.col("event_id") % 3 == 0, "BD").otherwise("E0")
    pts = F.pmod(F.col("event_id") * 3003, F.lit(1 << 33))
    body = F.concat(F.lit("808005"), emap._stamp(pts, 2), F.hex("props"))
    blobs = joined(e, "user_id", ["event_id"], F.concat(F.lit("000001"), sid, _digits(F.length(body) / 2, 4), body))
    return parse_blobs(blobs, containers.program_stream, containers.PS_ROWS, ("user_id",)).select("user_id", "unit", "stream_id", "byte_off", "byte_len", "pts90", "sub_stream", "payload_len")


def mpeg2_elements(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    kind = F.when(flag == "N", F.concat(F.lit("0030"), _digits((F.col("l_linenumber") % 3 + 1) * 8, 2))).when(flag == "R", "01").otherwise("B3")
    blobs = joined(_read(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], F.concat(F.lit("000001"), kind, F.hex(F.col("l_partkey").cast("string"))))
    return parse_blobs(blobs, video.mpeg2_elements, video.MPV_ROWS, ("l_orderkey",)).select("l_orderkey", "start_code", "name", "byte_off", "byte_len", "picture_type")


def av1_annexb_obus(spark: SparkSession, sf: str) -> DataFrame:
    """An order is one temporal unit of one frame unit, its lines are OBUs."""
    flag = F.col("l_returnflag")
    key = F.hex(F.col("l_partkey").cast("string"))
    unit = F.concat(_digits(F.length(key) / 2 + 1, 2), F.when(flag == "N", "30").when(flag == "R", "08").otherwise("10"), key)
    blobs = joined(_read(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], unit)
    size = lambda n: F.unhex(F.concat(_digits(n % 128 + 128, 2), _digits(F.floor(n / 128), 2)))
    blobs = blobs.select("l_orderkey", F.concat(size(F.length("data") + 2), size(F.length("data")), "data").alias("data"))
    return parse_blobs(blobs, video.av1_annexb, video.OBU_ROWS, ("l_orderkey",)).select("l_orderkey", "tu", "obu", "obu_type", "name", "byte_off", "byte_len")


def _container(data: bytes):
    yield (video.av1_container(data),)


def av1_containers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    data = F.when(k == 0, F.concat(F.hex(F.lit("DKIF")), F.lit("00002000"), F.hex(F.lit("AV01")))).when(k == 1, "04030110FF").otherwise("12000A01FF")
    return parse_blobs(_read(spark, sf, "part").select("p_partkey", F.unhex(data).alias("data")), _container, "container string", ("p_partkey",))


def ivf_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events")
    head = F.concat(F.hex(F.lit("DKIF")), F.lit("00002000"), F.hex(F.lit("AV01")), F.lit("00" * 20))
    frame = F.concat(_digits(text.swap_bytes(F.length("props"), 4), 8), _digits(text.swap_bytes(F.col("event_id"), 4), 8), F.lit("00000000"), F.hex("props"))
    blobs = joined(e, "user_id", ["event_id"], frame).select("user_id", F.concat(F.unhex(head), "data").alias("data"))
    return parse_blobs(blobs, video.ivf_frames, video.IVF_ROWS, ("user_id",))


def avc_sps(spark: SparkSession, sf: str) -> DataFrame:
    c = _read(spark, sf, "customer")
    data = F.unhex(_sps(F.col("c_custkey") % 120 + 1, F.col("c_custkey") % 67 + 1))

    def read(unit: bytes):
        f = video.avc_sps(unit)
        yield f["profile_idc"], f["level_idc"], f["width"], f["height"], f["max_num_ref_frames"]

    return parse_blobs(c.select("c_custkey", data.alias("data")), read, "profile_idc int, level_idc int, width int, height int, ref_frames int", ("c_custkey",))


def sei_messages(spark: SparkSession, sf: str) -> DataFrame:
    """One SEI unit per user: every event is a message, its properties unregistered user data."""
    blobs = joined(_read(spark, sf, "events"), "user_id", ["event_id"], F.concat(F.lit("05"), _digits(F.length("props"), 2), F.hex("props")))
    blobs = blobs.select("user_id", F.concat(F.unhex(F.lit("0000000106")), "data", F.unhex(F.lit("80"))).alias("data"))
    return parse_blobs(blobs, video.sei_messages("avc"), video.SEI_ROWS, ("user_id",)).select("user_id", "msg_no", "payload_type", "payload_size", "name", F.decode("payload", "UTF-8").alias("payload"))


def _again(data: bytes):
    raw = bits.unescape_nal(data)
    yield raw.hex().upper(), bits.escape_nal(raw).hex().upper()


def rbsp(spark: SparkSession, sf: str) -> DataFrame:
    """Emulation prevention taken out, and put in again."""
    data = F.unhex(F.concat(F.hex("p_name"), F.lit("000003"), _digits(F.col("p_partkey") % 4, 2), F.hex("p_type")))
    return parse_blobs(_read(spark, sf, "part").select("p_partkey", data.alias("data")), _again, "rbsp string, escaped string", ("p_partkey",))


# -- audio --------------------------------------------------------------------


def loas_frames(spark: SparkSession, sf: str) -> DataFrame:
    frame = F.concat(_digits((F.length("props") + 4) + 0x2B7 * 8192, 6), F.lit("20001190"), F.hex("props"))
    return parse_blobs(joined(_read(spark, sf, "events"), "user_id", ["event_id"], frame), audio.loas_frames, audio.FRAME_ROWS, ("user_id",)).select("user_id", "frame", "byte_off", "byte_len", "sample_rate", "channels", "profile")


def ac3_frames(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    frame = F.rpad(F.concat(F.lit("0B770000"), _digits(k * 2, 2), F.lit("4040"), F.hex("props")), ((k * 32 + 128) * 2).cast("int"), F.lit("F"))
    return parse_blobs(joined(_read(spark, sf, "events"), "user_id", ["event_id"], frame), audio.ac3_frames, audio.FRAME_ROWS, ("user_id",)).select("user_id", "frame", "byte_off", "byte_len", "codec", "sample_rate", "channels", "bit_rate")


def mpeg_audio_frames(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    size = F.when(k == 0, 417).when(k == 1, 522).otherwise(626)
    frame = F.rpad(F.concat(F.lit("FFFB"), F.when(k == 0, "90").when(k == 1, "A0").otherwise("B0"), F.lit("00"), F.hex("props")), size * 2, F.lit("0"))
    return parse_blobs(joined(_read(spark, sf, "events"), "user_id", ["event_id"], frame), audio.mpeg_audio_frames, audio.FRAME_ROWS, ("user_id",)).select("user_id", "frame", "byte_off", "byte_len", "codec", "sample_rate", "channels", "bit_rate")


def aiff_chunks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    rate = F.when(k == 0, "400EAC44000000000000").when(k == 1, "400EBB80000000000000").otherwise("400BFA00000000000000")
    name = F.hex("p_name")
    even = F.concat(name, F.when(F.length("p_name") % 2 == 1, "00").otherwise(""))
    body = F.concat(F.hex(F.lit("AIFFCOMM")), F.lit("00000012"), _digits(k + 1, 4), _digits(F.col("p_partkey"), 8), F.lit("0010"), rate, F.hex(F.lit("NAME")), _digits(F.length("p_name"), 8), even)
    data = F.unhex(F.concat(F.hex(F.lit("FORM")), _digits(F.length(body) / 2, 8), body))
    return parse_blobs(_read(spark, sf, "part").select("p_partkey", data.alias("data")), containers.aiff_chunks, containers.AIFF_ROWS, ("p_partkey",))


def channel_layouts(spark: SparkSession, sf: str) -> DataFrame:
    bitmap = F.pmod(F.col("p_partkey") * 2654435, F.lit(1 << 22)).cast("int")
    return _read(spark, sf, "part").select("p_partkey", audio_layout.channel_layout(bitmap).alias("layout"))


# -- containers ---------------------------------------------------------------

_LACED = {0: "80", 1: "020105", 2: "0401", 3: "060284C0"}


def _mkv(spark: SparkSession, sf: str) -> DataFrame:
    """A file per nation: a cluster for each customer with a block whose lacing goes round."""
    c, k, name = _read(spark, sf, "customer"), F.col("c_custkey") % 4, F.hex("c_name")
    flags = F.when(k == 0, _LACED[0]).when(k == 1, _LACED[1]).when(k == 2, _LACED[2]).otherwise(_LACED[3])
    payload = F.concat(F.lit("810000"), flags, name, F.when(k == 2, name).otherwise(""))
    content = F.concat(F.lit("E784"), _digits(F.col("c_custkey"), 8), F.lit("A3"), _digits(F.length(payload) / 2 + 0x4000, 4), payload)
    files = joined(c, "c_nationkey", ["c_custkey"], F.concat(F.lit("1F43B675"), _digits(F.length(content) / 2 + 0x10000000, 8), content))
    head = F.concat(F.lit("1A45DFA387428284"), F.hex(F.lit("webm")), F.lit("18538067"), _digits(F.length("data") + (1 << 56), 16))
    return files.select("c_nationkey", F.concat(F.unhex(head), "data").alias("data"))


def mkv_elements(spark: SparkSession, sf: str) -> DataFrame:
    return parse_blobs(_mkv(spark, sf), containers.ebml, containers.EBML_ROWS, ("c_nationkey",)).select("c_nationkey", "node_id", "parent_id", "level", "name", "ordinal", "offset", "size", "value")


def mkv_frames(spark: SparkSession, sf: str) -> DataFrame:
    return parse_blobs(_mkv(spark, sf), containers.blocks, containers.BLOCK_ROWS, ("c_nationkey",)).select("c_nationkey", "cluster", "frame", "track", "is_key", "lacing", "offset", "size")


def mp4_track_units(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of length-prefixed units as Annex B: an order is a sample, its lines are units."""
    unit = F.concat(F.lit("65"), F.hex(F.col("l_partkey").cast("string")))
    blobs = joined(_read(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], F.concat(_digits(F.length(unit) / 2, 8), unit))

    def annex_b(sample: bytes):
        yield (containers.length_to_start_code(sample, 4, b"").hex().upper(),)

    return parse_blobs(blobs, annex_b, "es string", ("l_orderkey",))


# -- tables of transport streams -------------------------------------------------


def _programs(spark: SparkSession, sf: str) -> DataFrame:
    """Packets: a PAT, a PMT for each region, whose streams are the event map's PIDs dealt out, then the events."""
    word = lambda x: _digits(x, 4)
    r = F.col("r_regionkey")
    region = _read(spark, sf, "region")
    pat = region.agg(F.array_join(F.array_sort(F.collect_list(F.concat(word(r + 1), word(r + 0xF000)))), "").alias("body")).select(F.lit(0).alias("place"), F.lit(0).alias("pid"), F.lit(0).alias("table_id"), F.lit(1).alias("extension"), F.lit(0).alias("version"), F.unhex("body").alias("body"))
    mine = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda p: p % 5 == F.col("r_regionkey"))
    streams = F.array_join(F.transform(mine, lambda p: F.concat(F.when(p % 2 == 1, "1B").otherwise("0F"), word(p + 0xE100), F.lit("F000"))), "")
    pmt = region.select((r + 1).alias("place"), (r + 0x1000).alias("pid"), F.lit(2).alias("table_id"), (r + 1).alias("extension"), F.lit(0).alias("version"), F.unhex(F.concat(word(r + 0xE100), F.lit("F000"), streams)).alias("body"))
    events = emap.pack(emap.direct(spark, sf)).select((F.col("pkt_idx") + 1000).alias("pkt_idx"), F.substring("raw", 5, 188).alias("raw"))
    return parse_packets(psi.pack_sections(pat.unionByName(pmt)).unionByName(events))


def ts_pid_report(spark: SparkSession, sf: str) -> DataFrame:
    packets = _programs(spark, sf)
    found = written(psi.sections(packets, [0, *range(0x1000, 0x1005)]))
    return psi.pid_report(packets, found)


def _streams(spark: SparkSession, sf: str) -> DataFrame:
    """Packets: a PMT of one program with a stream for each nation, and a PES unit of each stream's own kind."""
    n, nation = F.col("n_nationkey"), _read(spark, sf, "nation")
    word, k = (lambda x: _digits(x, 4)), F.col("n_nationkey") % 4
    kind = F.when(k == 0, "0F").when(k == 1, "1B").when(k == 2, "02").otherwise("81")
    listed = nation.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.concat(kind, word(n + 0xE200), F.lit("F000")).alias("x")))), lambda s: s["x"]), "").alias("body"))
    pmt = listed.select(F.lit(0).alias("place"), F.lit(0x100).alias("pid"), F.lit(2).alias("table_id"), F.lit(1).alias("extension"), F.lit(0).alias("version"), F.unhex(F.concat(F.lit("E200F000"), "body")).alias("body"))
    adts = F.concat(F.lit("FFF14C8001FFFC"), F.hex("n_name"))
    sps = F.concat(F.lit("00000001"), _sps(n + 20, n % 7 + 10))
    sequence = F.concat(F.lit("000001B3"), _digits((n * 16 + 320) * 4096 + 240, 6), F.lit("340FFF"))
    ac3 = F.lit("0B77000000404000")
    es = F.when(k == 0, adts).when(k == 1, sps).when(k == 2, sequence).otherwise(ac3)
    pes = F.concat(F.lit("47"), word(n + 0x4200), F.lit("10"), F.lit("000001E00000808005"), emap._stamp(n * 3003, 2), es)
    units = nation.select((n + 1000).cast("bigint").alias("pkt_idx"), F.unhex(F.rpad(pes, 376, "F")).alias("raw"))
    return parse_packets(psi.pack_sections(pmt).unionByName(units))


def ts_codec_info(spark: SparkSession, sf: str) -> DataFrame:
    packets = _streams(spark, sf)
    streams = psi.pmt_streams(psi.sections(packets, [0x100]))
    return codec_info.codec_info(psi.pes_units(packets.where("pid <> 256")), streams).drop("profile", "level")


def psi_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional access, stream description and selection information tables: a section per nation of the table's kind."""
    n = F.col("n_nationkey")
    name = F.hex("n_name")
    loop = F.concat(F.lit("0A"), _digits(F.length("n_name"), 2), name)
    k = n % 3
    kind, pid = F.when(k == 0, 1).when(k == 1, 3).otherwise(0x7F), F.when(k == 0, 1).when(k == 1, 2).otherwise(0x1F)
    body = F.when(k < 2, loop).otherwise(F.concat(F.lit("F000"), _digits(n + 1, 4), _digits(F.length(loop) / 2 + 0xC000, 4), loop))
    tables = _read(spark, sf, "nation").select(n.alias("place"), pid.alias("pid"), kind.alias("table_id"), F.lit(0xFFFF).alias("extension"), (n % 32).alias("version"), F.unhex(body).alias("body"))
    found = psi.sections(parse_packets(psi.pack_sections(tables)), [1, 2, 0x1F])
    plain = psi.table_descriptors(found, 1).select(F.lit(1).alias("table_id"), "version", F.lit(None).cast("int").alias("service_id"), F.decode("content", "UTF-8").alias("content"))
    more = psi.table_descriptors(found, 3).select(F.lit(3).alias("table_id"), "version", F.lit(None).cast("int").alias("service_id"), F.decode("content", "UTF-8").alias("content"))
    sit = psi.sit_services(found).where("service_id is not null").select(F.lit(0x7F).alias("table_id"), "version", "service_id", F.decode(F.expr("substring(descriptors, 3)"), "UTF-8").alias("content"))
    return plain.unionByName(more).unionByName(sit)


# -- MMT ----------------------------------------------------------------------


def mmt_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as packages, nations as their assets; the last region's package table is missing."""
    region, nation = _read(spark, sf, "region"), _read(spark, sf, "nation")
    table = lambda kind, body: F.concat(F.lit(kind + "00"), _digits(F.length(body) / 2, 4), body)
    one = F.concat(F.lit("01"), _digits(F.col("r_regionkey"), 2), F.lit("00"), _digits(F.col("r_regionkey") + 0x100, 4))
    listed = region.agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("x"), F.count(F.lit(1)).alias("n"))
    plt = listed.select(F.lit(-1).cast("bigint").alias("message"), table("80", F.concat(_digits(F.col("n"), 2), "x")).alias("table"))
    asset = F.concat(F.lit("0000000000"), F.lit("01"), _digits(F.col("n_nationkey"), 2), F.hex(F.when(F.col("n_nationkey") % 2 == 0, "hev1").otherwise("mp4a")), F.lit("00"), F.lit("01"), F.lit("00"), _digits(F.col("n_nationkey") + 0x200, 4), F.lit("0000"))
    assets = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", asset.alias("a")))).alias("xs"))
    body = F.concat(F.lit("00"), F.lit("01"), _digits(F.col("n_regionkey"), 2), F.lit("0000"), _digits(F.size("xs"), 2), F.array_join(F.transform("xs", lambda x: x["a"]), ""))
    mpt = assets.where("n_regionkey < 4").select(F.col("n_regionkey").cast("bigint").alias("message"), table("20", body).alias("table"))
    size = F.length("table") / 2
    messages = plt.unionByName(mpt).select("message", F.unhex(F.concat(F.lit("000000"), _digits(size + 5, 8), F.lit("01"), F.substring("table", 1, 4), _digits(size, 4), "table")).alias("data"))
    return mmt.package_layout(messages, ("message",))


def mmt_unit_times(spark: SparkSession, sf: str) -> DataFrame:
    """Events as media fragment units; every other MPU has a time."""
    e = _read(spark, sf, "events")
    seq = F.col("event_id") % 50
    unit = F.concat(F.lit("00000000"), F.hex("props"))
    payload = F.concat(_digits(F.length("props") + 6, 4), F.lit("2000"), _digits(seq, 8), F.hex("props"))
    mmtp = F.concat(F.lit("0000"), _digits(F.col("user_id") % 3 + 0xF100, 4), _digits(F.col("event_id"), 8), _digits(F.col("event_id"), 8), payload)
    body = F.concat(F.lit("001061"), mmtp)
    rows = parse_blobs(joined(e, "user_id", ["event_id"], F.concat(F.lit("7F03"), _digits(F.length(body) / 2, 4), body)), containers.mmtp_packets, containers.MMTP_ROWS, ("user_id",))
    times = rows.where("mpu_seq % 2 = 0").select("packet_id", "mpu_seq", (F.col("mpu_seq") * 10 + 3_900_000_000 + F.col("packet_id")).alias("ntp_sec"), (F.col("mpu_seq") * 80_000_003).alias("ntp_frac"))
    return mmt.unit_times(rows, times).select("user_id", "seq", "packet_id", "mpu_seq", "present90")


def ntp_times(spark: SparkSession, sf: str) -> DataFrame:
    seconds, fraction = F.col("event_id") * 37 + 3_900_000_000, F.pmod(F.col("event_id") * 2_654_435_761, F.lit(1 << 32))
    return _read(spark, sf, "events").select("event_id", clocks.ntp_to_hns(seconds, fraction).alias("hns"), clocks.ntp_to_90k(seconds, fraction).alias("t90k"))


# -- text and books ---------------------------------------------------------------


def codebook_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A book per customer, the text of a code per order with mixed delimiters, read back."""
    k = F.col("o_orderkey")
    line = F.concat(F.lit("{"), k.cast("string"), F.when(k % 2 == 0, ", ").otherwise(" | "), (F.length(F.bin(k + 1)) * 2 - 1).cast("string"), F.lit(";\t0x"), F.lower(F.hex(k + 1)), F.lit("}\n"))
    texts = _read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "").alias("book"))
    return huffman.codebook_rows(texts, "book", ("o_custkey",))


def uris(spark: SparkSession, sf: str) -> DataFrame:
    pages = _read(spark, sf, "pages").select("page_id", F.concat("url", F.lit("%C3%A9+%20")).alias("url"))
    part = {k: text.uri_part(F.col("url"), k) for k in ("scheme", "authority", "path", "query", "fragment")}
    return pages.select(
        "page_id", *(v.alias(k) for k, v in part.items()), (text.uri_join(*part.values()) == F.col("url")).alias("same"), text.percent_decode(F.col("url")).alias("decoded"),
        text.starts_with(F.col("url"), "HTTPS://", True).alias("secure"), text.starts_with(F.col("url"), "HTTP").alias("upper"), text.ends_with(F.col("url"), "%c3%a9+%20", True).alias("tail"),
    )


def swapped_bytes(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_orderkey") * 7919 + 1
    return _read(spark, sf, "orders").select("o_orderkey", text.swap_bytes(x % 65536, 2).alias("two"), text.swap_bytes(x, 4).alias("four"), text.swap_bytes(x * 65536, 6).alias("six"))


def split_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of pages, some with delimiters after them, in parts; and numbers of parts as fractions."""
    pages = _read(spark, sf, "pages").select(F.lit("set").alias("kind"), F.col("page_id").alias("id"), F.concat("url", F.element_at(F.array(*map(F.lit, ("", ".", ",,"))), (F.col("page_id") % 3 + 1).cast("int"))).alias("text"))
    k = F.col("p_partkey")
    forms = [F.concat((k * 1000).cast("string"), F.lit("/1001")), F.col("p_size").cast("string"), F.concat(F.lit(" -"), F.col("p_retailprice").cast("decimal(12,3)").cast("string")), F.concat(F.col("p_size").cast("string"), F.lit(" : "), (k % 4).cast("string")), F.col("p_name")]
    parts = _read(spark, sf, "part").select(F.lit("rational").alias("kind"), k.alias("id"), F.element_at(F.array(*forms), (k % 5 + 1).cast("int")).alias("text"))
    number = literals.rational_value(F.col("text"))
    sets = pages.withColumn("value", F.array_join(literals.split_parts(F.col("text")), "|"))
    return sets.unionByName(parts.withColumn("value", F.concat(number["n"].cast("string"), F.lit("/"), number["d"].cast("string"))))


# -- streaming ----------------------------------------------------------------


def streamed_units(spark: SparkSession, sf: str) -> DataFrame:
    """Payload units by the streaming operator, over packets that arrive as files."""
    source, sink = shared_folder(spark), shared_folder(spark)
    emap.packed(spark, sf).select("pkt_idx", "pid", "pusi", "atc").write.parquet(source)
    stream = spark.readStream.schema("pkt_idx long, pid int, pusi boolean, atc long").parquet(source)
    query = streaming.payload_units(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(streaming.UNITS).parquet(sink)


QUERIES = {
    "ps_packets": ps_packets, "mpeg2_elements": mpeg2_elements, "av1_annexb_obus": av1_annexb_obus, "av1_containers": av1_containers, "ivf_frames": ivf_frames, "avc_sps": avc_sps, "sei_messages": sei_messages, "rbsp": rbsp,
    "loas_frames": loas_frames, "ac3_frames": ac3_frames, "mpeg_audio_frames": mpeg_audio_frames, "aiff_chunks": aiff_chunks, "channel_layouts": channel_layouts, "mkv_elements": mkv_elements, "mkv_frames": mkv_frames, "mp4_track_units": mp4_track_units,
    "ts_pid_report": ts_pid_report, "ts_codec_info": ts_codec_info, "psi_descriptors": psi_descriptors, "mmt_layout": mmt_layout, "mmt_unit_times": mmt_unit_times, "ntp_times": ntp_times,
    "codebook_scan": codebook_scan, "uris": uris, "swapped_bytes": swapped_bytes, "split_sets": split_sets, "streamed_units": streamed_units,
}

_LINES = "l AS (SELECT *, l_returnflag AS f, l_linenumber AS ln, length(CAST(l_partkey AS VARCHAR)) AS n, row_number() OVER w - 1 AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag))"
_EVENTS = "e AS (SELECT *, length(props) AS n, row_number() OVER w - 1 AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


def _before(size: str, key: str) -> str:
    return f"CAST(coalesce(sum({size}) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


_MKV = """c AS (SELECT *, c_custkey % 4 AS z, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, length(c_name) AS m FROM customer),
    s AS (SELECT *, 3 + CASE z WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 4 END + CASE z WHEN 2 THEN 2 ELSE 1 END * m AS p FROM c),
    t AS (SELECT *, p + 17 AS size, CAST(coalesce(sum(p + 17) OVER (PARTITION BY c_nationkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 24 AS BIGINT) AS pos FROM s)"""
_URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
_POSITIONS = ", ".join(f"'{x}'" for x in audio_layout.POSITIONS)

ORACLES = {
    "ps_packets": f"""WITH {_EVENTS} SELECT user_id, k AS unit, CASE WHEN event_id % 3 = 0 THEN 189 ELSE 224 END AS stream_id, {_before("n + 14", "user_id")} AS byte_off, n + 14 AS byte_len, event_id * 3003 % 8589934592 AS pts90,
        CASE WHEN event_id % 3 = 0 THEN ascii(props) END AS sub_stream, n AS payload_len FROM e""",
    "mpeg2_elements": f"""WITH {_LINES}, t AS (SELECT *, CASE f WHEN 'N' THEN ['I', 'P', 'B'][CAST(ln % 3 + 1 AS INT)] END AS pt, CASE f WHEN 'N' THEN 6 ELSE 4 END + n AS size FROM l)
        SELECT l_orderkey, CASE f WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 179 END AS start_code, CASE f WHEN 'N' THEN 'picture_header' WHEN 'R' THEN 'slice1' ELSE 'sequence_header' END AS name,
            {_before("size", "l_orderkey")} AS byte_off, size AS byte_len, CASE WHEN f <> 'A' THEN last_value(pt IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS picture_type FROM t""",
    "av1_annexb_obus": f"""WITH {_LINES} SELECT l_orderkey, CAST(0 AS BIGINT) AS tu, k AS obu, CASE f WHEN 'N' THEN 6 WHEN 'R' THEN 1 ELSE 2 END AS obu_type, CASE f WHEN 'N' THEN 'Frame' WHEN 'R' THEN 'Sequence header' ELSE 'Temporal delimiter' END AS name,
        {_before("n + 2", "l_orderkey")} + 5 AS byte_off, n + 1 AS byte_len FROM l""",
    "av1_containers": "SELECT p_partkey, ['ivf', 'annexb', 'obu'][CAST(p_partkey % 3 + 1 AS INT)] AS container FROM part",
    "ivf_frames": f"WITH {_EVENTS} SELECT user_id, k AS frame, event_id AS pts, {_before('n + 12', 'user_id')} + 44 AS byte_off, n AS byte_len FROM e",
    "avc_sps": "SELECT c_custkey, 66 AS profile_idc, 30 AS level_idc, CAST((c_custkey % 120 + 1) * 16 AS INT) AS width, CAST((c_custkey % 67 + 1) * 16 AS INT) AS height, 1 AS ref_frames FROM customer",
    "sei_messages": f"WITH {_EVENTS} SELECT user_id, k AS msg_no, CAST(5 AS BIGINT) AS payload_type, n AS payload_size, 'user_data_unregistered' AS name, props AS payload FROM e",
    "rbsp": "SELECT p_partkey, hex(encode(p_name)) || '00000' || (p_partkey % 4) || hex(encode(p_type)) AS rbsp, hex(encode(p_name)) || '0000030' || (p_partkey % 4) || hex(encode(p_type)) AS escaped FROM part",
    "loas_frames": f"WITH {_EVENTS} SELECT user_id, k AS frame, {_before('n + 7', 'user_id')} AS byte_off, n + 7 AS byte_len, 48000 AS sample_rate, 2 AS channels, 2 AS profile FROM e",
    "ac3_frames": f"WITH {_EVENTS}, t AS (SELECT *, event_id % 3 * 32 + 128 AS size FROM e) SELECT user_id, k AS frame, {_before('size', 'user_id')} AS byte_off, size AS byte_len, 'AC-3' AS codec, 48000 AS sample_rate, 2 AS channels, CAST((event_id % 3 * 8 + 32) * 1000 AS INT) AS bit_rate FROM t",
    "mpeg_audio_frames": f"""WITH {_EVENTS}, t AS (SELECT *, [417, 522, 626][CAST(event_id % 3 + 1 AS INT)] AS size FROM e)
        SELECT user_id, k AS frame, {_before('size', 'user_id')} AS byte_off, CAST(size AS BIGINT) AS byte_len, 'MPEG audio layer 3' AS codec, 44100 AS sample_rate, 2 AS channels, [128000, 160000, 192000][CAST(event_id % 3 + 1 AS INT)] AS bit_rate FROM t""",
    "aiff_chunks": """SELECT p_partkey, 'COMM' AS id, CAST(12 AS BIGINT) AS "offset", CAST(18 AS BIGINT) AS size, CAST(p_partkey % 3 + 1 AS INT) AS channels, p_partkey AS frames, 16 AS sample_size, CAST([44100, 48000, 8000][CAST(p_partkey % 3 + 1 AS INT)] AS DOUBLE) AS sample_rate, NULL AS text FROM part
        UNION ALL SELECT p_partkey, 'NAME', 38, length(p_name), NULL, NULL, NULL, NULL, p_name FROM part""",
    "channel_layouts": f"""WITH b AS (SELECT p_partkey, p_partkey * 2654435 % 4194304 AS x FROM part), n AS (SELECT p_partkey, (x >> 3 & 1) + (x >> 21 & 1) AS lfe, list_filter([{_POSITIONS}], lambda s, i: (x >> (i - 1) & 1) = 1) AS names FROM b)
        SELECT p_partkey, (len(names) - lfe) || '.' || lfe || 'ch(' || array_to_string(names, ', ') || ')' AS layout FROM n""",
    "mkv_elements": f"""WITH {_MKV}
        SELECT c_nationkey, CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS level, 'EBML' AS name, CAST(0 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS "offset", CAST(12 AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS value FROM c GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 1, 0, 1, 'DocType', 0, 5, 7, 'webm' FROM c GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 2, NULL, 0, 'Segment', 0, 12, CAST(sum(size) + 12 AS BIGINT), NULL FROM t GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 3 + 3 * k, 2, 1, 'Cluster', k, pos, size, NULL FROM t
        UNION ALL SELECT c_nationkey, 4 + 3 * k, 3 + 3 * k, 2, 'Timestamp', 0, pos + 8, 6, CAST(c_custkey AS VARCHAR) FROM t
        UNION ALL SELECT c_nationkey, 5 + 3 * k, 3 + 3 * k, 2, 'SimpleBlock', 0, pos + 14, p + 3, NULL FROM t""",
    "mkv_frames": f"""WITH {_MKV}, x AS (SELECT *, unnest(CASE z WHEN 0 THEN [m] WHEN 1 THEN [5, m - 5] WHEN 2 THEN [m, m] ELSE [4, 5, m - 9] END) AS n, unnest(range(CASE z WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END)) AS frame FROM t)
        SELECT c_nationkey, k AS cluster, frame, CAST(1 AS BIGINT) AS track, z = 0 AS is_key, CAST(z AS INT) AS lacing,
            CAST(pos + 20 + CASE z WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 4 END + coalesce(sum(n) OVER (PARTITION BY c_nationkey, k ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", n AS size FROM x""",
    "mp4_track_units": "SELECT l_orderkey, string_agg('0000000165' || hex(encode(CAST(l_partkey AS VARCHAR))), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS es FROM lineitem GROUP BY l_orderkey",
    "ts_pid_report": f"""WITH {emap.SQL}, c AS (SELECT pid, count(*) AS n_packets, CAST(sum(CAST(pusi AS INT)) AS BIGINT) AS n_units FROM packets GROUP BY pid)
        SELECT pid, n_packets, n_units, CASE WHEN pid % 2 = 1 THEN '0x1B' ELSE '0x0F' END AS stream_types, pid < 261 AS is_pcr, false AS is_pmt, 'ES' AS use FROM c
        UNION ALL SELECT 0, 1, 1, NULL, false, false, 'PAT' UNION ALL SELECT CAST(4096 + r_regionkey AS INT), 1, 1, NULL, false, true, 'PMT' FROM region""",
    "ts_codec_info": """SELECT CAST(n_nationkey + 512 AS INT) AS pid, [15, 27, 2, 129][k] AS stream_type, ['AAC ADTS', 'H.264', 'MPEG-2 video', 'AC-3'][k] AS codec, CASE k WHEN 2 THEN (n_nationkey + 20) * 16 WHEN 3 THEN n_nationkey * 16 + 320 END AS width, CASE k WHEN 2 THEN (n_nationkey % 7 + 10) * 16 WHEN 3 THEN 240 END AS height,
        CAST(CASE k WHEN 3 THEN 30000 END AS BIGINT) AS rate_num, CAST(CASE k WHEN 3 THEN 1001 END AS BIGINT) AS rate_den, CASE WHEN k IN (1, 4) THEN 48000 END AS sample_rate, CASE WHEN k IN (1, 4) THEN 2 END AS channels, CAST(CASE k WHEN 3 THEN (4095 * 256 + 255) // 64 * 400 WHEN 4 THEN 32000 END AS BIGINT) AS bit_rate FROM (SELECT *, CAST(n_nationkey % 4 + 1 AS INT) AS k FROM nation)""",
    "psi_descriptors": "SELECT CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 127 END AS table_id, CAST(n_nationkey % 32 AS INT) AS version, CAST(CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey + 1 END AS INT) AS service_id, n_name AS content FROM nation",
    "mmt_layout": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation WHERE n_regionkey < 4)
        SELECT lpad(lower(hex(r_regionkey)), 2, '0') AS package, CAST(r_regionkey + 256 AS INT) AS table_packet_id, CAST(k AS INT) AS ordinal, lpad(lower(hex(n_nationkey)), 2, '0') AS asset_id, CASE WHEN n_nationkey % 2 = 0 THEN 'hev1' WHEN n_nationkey % 2 = 1 THEN 'mp4a' END AS asset_type, CAST(n_nationkey + 512 AS INT) AS packet_id FROM region LEFT JOIN a ON n_regionkey = r_regionkey""",
    "mmt_unit_times": """WITH t AS (SELECT user_id, event_id, CAST(user_id % 3 + 61696 AS INT) AS packet_id, event_id % 50 AS q FROM events)
        SELECT user_id, event_id AS seq, packet_id, q AS mpu_seq, CASE WHEN q % 2 = 0 THEN CAST(((q * 10 + 3900000000 + packet_id) * 90000 + q * 80000003 * 90000 // 4294967296) % 8589934592 AS BIGINT) END AS present90 FROM t""",
    "ntp_times": """WITH t AS (SELECT event_id, event_id * 37 + 3900000000 AS s, CAST(event_id AS HUGEINT) * 2654435761 % 4294967296 AS f FROM events)
        SELECT event_id, CAST(s * 10000000 + f * 10000000 // 4294967296 AS BIGINT) AS hns, CAST((s * 90000 + f * 90000 // 4294967296) % 8589934592 AS BIGINT) AS t90k FROM t""",
    "codebook_scan": "SELECT o_custkey, o_orderkey AS value, CAST(2 * length(bin(o_orderkey + 1)) - 1 AS INT) AS bit_len, o_orderkey + 1 AS codeword FROM orders",
    "uris": f"""WITH u AS (SELECT page_id, url || '%C3%A9+%20' AS url FROM pages), p AS (SELECT *, {", ".join(f"regexp_extract(url, '{_URI}', {k}) AS g{k}" for k in range(1, 10))} FROM u)
        SELECT page_id, CASE WHEN g1 <> '' THEN g2 END AS scheme, CASE WHEN g3 <> '' THEN g4 END AS authority, g5 AS path, CASE WHEN g6 <> '' THEN g7 END AS query, CASE WHEN g8 <> '' THEN g9 END AS fragment, true AS same,
            url_decode(url) AS decoded, url LIKE 'https://%' AS secure, false AS upper, true AS tail FROM p""",
    "swapped_bytes": """WITH t AS (SELECT o_orderkey, o_orderkey * 7919 + 1 AS x FROM orders), h AS (SELECT o_orderkey, lpad(hex(x % 65536), 4, '0') AS two, lpad(hex(x), 8, '0') AS four, lpad(hex(x * 65536), 12, '0') AS six FROM t)
        SELECT o_orderkey, """
    + ", ".join(f"CAST('0x' || {' || '.join(f'substr({c}, {2 * k + 1}, 2)' for k in reversed(range(n)))} AS BIGINT) AS {c}" for c, n in (("two", 2), ("four", 4), ("six", 6)))
    + " FROM h",
    "split_sets": """WITH t AS (SELECT page_id, url || ['', '.', ',,'][page_id % 3 + 1] AS text FROM pages),
        p AS (SELECT p_partkey AS k, p_size AS z, CAST(p_retailprice AS DECIMAL(12, 3)) AS price, p_name FROM part),
        r AS (SELECT k, CASE k % 5 WHEN 0 THEN k * 1000 || '/1001' WHEN 1 THEN CAST(z AS VARCHAR) WHEN 2 THEN ' -' || price WHEN 3 THEN z || ' : ' || k % 4 ELSE p_name END AS text,
            CASE k % 5 WHEN 0 THEN k * 1000 WHEN 1 THEN z WHEN 2 THEN -CAST(price * 1000 AS BIGINT) WHEN 3 THEN z END AS n, CASE k % 5 WHEN 0 THEN 1001 WHEN 1 THEN 1 WHEN 2 THEN 1000 WHEN 3 THEN nullif(k % 4, 0) END AS d FROM p)
        SELECT 'set' AS kind, page_id AS id, text, regexp_replace(regexp_replace(text, '[,;.:]$', ''), '[,;.:]', '|', 'g') AS value FROM t
        UNION ALL SELECT 'rational', k, text, n // gcd(abs(n), d) || '/' || d // gcd(abs(n), d) FROM r""",
    "streamed_units": f"""WITH {emap.SQL}, d AS (SELECT *, (atc - lag(atc) OVER w + 1073741824) % 1073741824 AS step, sum(CAST(pusi AS INT)) OVER w AS unit FROM packets WINDOW w AS (PARTITION BY pid ORDER BY pkt_idx)),
        r AS (SELECT *, CAST(sum(coalesce(step, 0)) OVER (PARTITION BY pid ORDER BY pkt_idx) AS BIGINT) AS t FROM d),
        u AS (SELECT pid, CAST(unit AS BIGINT) AS unit, min(pkt_idx) AS first_pkt, max(pkt_idx) AS last_pkt, count(*) AS n_packets, min(t) AS t FROM r WHERE unit > 0 GROUP BY pid, unit),
        n AS (SELECT *, lead(t) OVER (PARTITION BY pid ORDER BY unit) - t AS elapsed27 FROM u)
        SELECT pid, unit, first_pkt, last_pkt, n_packets, elapsed27 FROM n WHERE elapsed27 IS NOT NULL""",
}
