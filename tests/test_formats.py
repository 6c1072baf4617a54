"""Parsers on hand-built bytes, the locator language, codebooks and scalar functions."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from bitweave.functions import huffman, literals, scalars
from bitweave.functions.audio_layout import channel_layout
from bitweave.functions.bits import Bits, escape_nal, extended_float, unescape_nal
from bitweave.operators.locator import LocatorError, compile_locator
from bitweave.operators.samples import moved_offsets, sample_table
from bitweave.operators.timing import reassemble
from bitweave.sources import audio, containers, video
from bitweave.sources.blobs import parse_blobs, read_files


class Writer:
    def __init__(self):
        self.bits = ""

    def u(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""
        return self

    def ue(self, value):
        body = format(value + 1, "b")
        self.bits += "0" * (len(body) - 1) + body
        return self

    def bytes(self):
        bits = self.bits + "1"
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_bit_reader():
    r = Bits(Writer().u(5, 3).ue(0).ue(7).ue(3).ue(4).u(0x1FF, 9).bytes())
    assert (r.u(3), r.ue(), r.ue(), r.se(), r.se(), r.peek(9), r.u(9)) == (5, 0, 7, 2, -2, 511, 511)
    assert Bits(b"\xe5\x8e\x26").leb128() == 624485 and Bits(b"\x40\x7f").vint() == 127 and Bits(b"\xff").vint() is None and Bits(b"\x1a\x45\xdf\xa3").vint(True) == 0x1A45DFA3
    assert Bits(b"\xfe").s(8) == -2 and Bits(b"\x34\x12").le(2) == 0x1234 and Bits(b"\x80").ns(5) == 2
    with pytest.raises(EOFError):
        Bits(b"\x00").u(9)
    r = random.Random(1)
    for _ in range(200):
        data = bytes(r.choice([0, 0, 0, 1, 2, 3, 4, 255]) for _ in range(r.randint(0, 30)))
        assert unescape_nal(escape_nal(data)) == data and b"\0\0\1" not in escape_nal(data)
    assert extended_float(bytes.fromhex("400EBB80000000000000")) == 48000.0


def avc_sps(width, height):
    w = Writer().u(100, 8).u(0, 8).u(40, 8).ue(0).ue(1).ue(0).ue(0).u(0, 1).u(0, 1).ue(4).ue(0).ue(4).ue(4).u(0, 1)
    mbs, rows = -(-width // 16), -(-height // 16)
    w.ue(mbs - 1).ue(rows - 1).u(1, 1).u(1, 1).u(1, 1).ue(0).ue((mbs * 16 - width) // 2).ue(0).ue((rows * 16 - height) // 2)
    w.u(1, 1).u(1, 1).u(1, 8).u(0, 1).u(0, 1).u(0, 1).u(1, 1).u(1001, 32).u(60000, 32).u(1, 1)
    w.u(1, 1).ue(0).u(2, 4).u(3, 4).ue(99).ue(49).u(1, 1).u(23, 5).u(23, 5).u(23, 5).u(24, 5).u(0, 1)
    return b"\x67" + escape_nal(w.bytes())


def test_avc():
    sps = video.avc_sps(avc_sps(1920, 1080))
    assert (sps["width"], sps["height"], sps["level_idc"], sps["num_units_in_tick"], sps["time_scale"]) == (1920, 1080, 40, 1001, 60000)
    assert sps["cpb"]["buckets"] == [{"bit_rate": 100 << 8, "cpb_size": 50 << 7, "cbr": True}]
    idr, more = b"\x65" + Writer().ue(0).ue(7).ue(0).u(3, 4).bytes(), b"\x41" + Writer().ue(0).ue(5).ue(0).u(4, 4).bytes()
    second = b"\x41" + Writer().ue(99).ue(6).ue(0).u(4, 4).bytes()
    sei = b"\x06" + bytes([5, 3]) + b"abc" + bytes([255, 1, 2]) + b"de" + b"\x80"
    data = b"\0\0\0\1\x09\xf0" + b"\0\0\1" + avc_sps(64, 64) + b"\0\0\1" + sei + b"\0\0\0\1" + idr + b"\0\0\1" + more + b"\0\0\1" + second + b"\0\0"
    rows = list(video.nal_units("avc")(data))
    assert [(r[0], r[2], r[6]) for r in rows] == [(0, 0, "AUD"), (0, 1, "SPS"), (0, 2, "SEI"), (0, 3, "IDR"), (1, 0, "non-IDR"), (1, 1, "non-IDR")]
    assert all(data[r[3] - 3 : r[3]] == b"\0\0\1" for r in rows) and rows[-1][4] == len(second)
    assert [r[2:6] for r in video.sei_messages("avc")(data)] == [(5, 3, "user_data_unregistered", b"abc"), (256, 2, "reserved_sei_message", b"de")]
    assert video.avc_slice(idr) == {"first_mb": 0, "slice_type": "I", "pps_id": 0, "frame_num": 3}
    assert [video.picture_type(x) for x in (["I"], ["I", "P"], ["P", "B"], ["SI"], ["SP", "SI"])] == ["I", "P", "B", "SI", "SP"]


def test_mpeg2_and_av1():
    code = lambda k, body=b"": b"\0\0\1" + bytes([k]) + body
    picture = lambda kind: code(0, bytes([0, kind << 3, 0, 0]))
    data = code(0xB3, b"s") + code(0xB8, b"g") + picture(1) + code(1) + code(2) + picture(2) + code(1) + code(0xB8) + picture(3) + code(0xB7) + code(0xB3) + code(0xB8) + picture(1)
    rows = list(video.mpeg2_elements(data))
    assert [(r[0], r[1], r[2], r[5]) for r in rows] == [(0, 0, 0, "sequence_header"), (0, 0, 0, "group_of_pictures_header"), (0, 0, 0, "picture_header"), (0, 0, 0, "slice1"), (0, 0, 0, "slice2"), (0, 0, 1, "picture_header"), (0, 0, 1, "slice1"), (0, 1, 2, "group_of_pictures_header"), (0, 1, 2, "picture_header"), (0, 1, 2, "sequence_end"), (1, 0, 3, "sequence_header"), (1, 0, 3, "group_of_pictures_header"), (1, 0, 3, "picture_header")]
    assert [r[8] for r in rows if r[5] == "picture_header"] == ["I", "P", "B", "I"]
    header = Writer().u(0, 3).u(0, 1).u(0, 1).u(0, 1).u(0, 1).u(0, 5).u(0, 12).u(8, 5).u(0, 1).u(10, 4).u(10, 4).u(1919, 11).u(1079, 11).bytes()
    assert {k: video.av1_sequence_header(header)[k] for k in ("level", "max_width", "max_height")} == {"level": 8, "max_width": 1920, "max_height": 1080}
    obu = lambda kind, body: bytes([kind << 3 | 2, len(body)]) + body
    unit = obu(2, b"") + obu(1, header) + obu(6, b"frame")
    assert [(r[0], r[1], r[3]) for r in video.av1_obus(unit * 2)] == [(0, 0, "Temporal delimiter"), (0, 1, "Sequence header"), (0, 2, "Frame"), (1, 3, "Temporal delimiter"), (1, 4, "Sequence header"), (1, 5, "Frame")]
    bare = lambda kind, body: bytes([kind << 3]) + body
    sized = lambda x: bytes([len(x)]) + x
    annexb = sized(sized(sized(bare(2, b"")) + sized(bare(6, b"abc")))) * 2
    assert [(r[0], r[2], r[7]) for r in video.av1_annexb(annexb)] == [(0, 2, 1), (0, 6, 4), (1, 2, 1), (1, 6, 4)]
    ivf = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 64, 64, 30, 1, 1, 0) + struct.pack("<IQ", len(unit), 7) + unit
    assert list(video.ivf_frames(ivf)) == [(0, 7, 44, len(unit))]
    assert [video.av1_container(x) for x in (ivf, annexb, unit)] == ["ivf", "annexb", "obu"]


def box(kind, body=b""):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_isobmff():
    full = lambda kind, *numbers: box(kind, struct.pack(f">{len(numbers) + 1}I", 0, *numbers))
    stbl = box(b"stbl", full(b"stsc", 2, 1, 2, 1, 3, 1, 1) + full(b"stco", 3, 100, 200, 300) + full(b"stsz", 0, 5, 10, 20, 30, 40, 50) + full(b"stss", 2, 1, 4) + full(b"stts", 1, 5, 512))
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", stbl))) + box(b"trak")) + struct.pack(">I4sQ", 1, b"mdat", 20) + b"data" + box(b"wxyz", b"?")
    rows = list(containers.boxes(data))
    assert [(r[2], r[3], r[4]) for r in rows] == [(0, "ftyp", 0), (0, "moov", 0), (1, "trak", 0), (2, "mdia", 0), (3, "minf", 0), (4, "stbl", 0), (5, "stsc", 0), (5, "stco", 0), (5, "stsz", 0), (5, "stss", 0), (5, "stts", 0), (1, "trak", 1), (0, "mdat", 0), (0, "wxyz", 0)]
    assert sum(r[6] for r in rows if r[1] is None) == len(data)
    table = [(r[1], *r[3:6]) for r in containers.box_tables(data)]
    assert table[:2] == [("stsc", 1, 2, 1), ("stsc", 3, 1, 1)] and [x[1] for x in table if x[0] == "stsz"] == [10, 20, 30, 40, 50]
    assert containers.length_to_start_code(b"\0\0\0\2ab\0\0\0\1c", 4, b"P") == b"P\0\0\0\1ab\0\0\0\1c"
    assert list(containers.boxes(data[:-3]))[-1][3] == "mdat"


def test_sample_table(spark):
    f = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = sample_table(f([(1, 1, 2), (1, 3, 1)], "track int, first_chunk long, per_chunk int"), f([(1, 1, 100), (1, 2, 200), (1, 3, 300)], "track int, chunk long, chunk_offset long"), f([(1, k, 10 * k) for k in range(1, 6)], "track int, sample long, size long"), f([(1, 1), (1, 4)], "track int, sample long"))
    assert [tuple(r)[1:] for r in got.orderBy("sample").collect()] == [(1, 1, 100, 10, True), (2, 1, 110, 20, False), (3, 2, 200, 30, False), (4, 2, 230, 40, True), (5, 3, 300, 50, False)]
    boxes = f([("ftyp", 0, 20), ("free", 20, 100), ("mdat", 120, 50)], "box string, offset long, size long")
    assert [(r["box"], r["new_offset"], r["shift"]) for r in moved_offsets(boxes, f([("free",)], "box string")).orderBy("offset").collect()] == [("ftyp", 0, 0), ("mdat", 20, 100)]


def test_matroska():
    def el(kind, body, unknown=False):
        head = kind.to_bytes((kind.bit_length() + 7) // 8, "big")
        return head + (b"\xff" if unknown else bytes([0x40 | len(body) >> 8, len(body) & 255])) + body

    block = lambda flags, body: b"\x81\x00\x05" + bytes([flags]) + body
    xiph = block(0x02, bytes([2, 3, 4]) + b"aaa" + b"bbbb" + b"cc")
    fixed = block(0x84, bytes([1]) + b"ddee")
    laced = block(0x06, bytes([2]) + b"\x83" + bytes([0x80 | 63 + 1]) + b"fff" + b"gggg" + b"hh")
    cluster = lambda k, *blocks: el(0x1F43B675, el(0xE7, bytes([k])) + b"".join(blocks), unknown=True)
    data = el(0x1A45DFA3, el(0x4282, b"matroska")) + el(0x18538067, cluster(1, el(0xA3, xiph), el(0xA0, el(0xA1, fixed))) + cluster(2, el(0xA3, laced), el(0x1234 | 0x4000, b"zz")), unknown=True)
    rows = list(containers.ebml(data))
    assert [(r[2], r[4], r[6]) for r in rows] == [(0, "EBML", 0), (1, "DocType", 0), (0, "Segment", 0), (1, "Cluster", 0), (2, "Timestamp", 0), (2, "SimpleBlock", 0), (2, "BlockGroup", 0), (3, "Block", 0), (1, "Cluster", 1), (2, "Timestamp", 0), (2, "SimpleBlock", 0), (2, "unknown", 0)]
    assert rows[1][11] == "matroska" and rows[2][8] == len(data) - rows[2][7]
    frames = list(containers.blocks(data))
    assert [data[r[9] : r[9] + r[10]] for r in frames] == [b"aaa", b"bbbb", b"cc", b"dd", b"ee", b"fff", b"gggg", b"hh"]
    assert [(r[1], r[8], r[5]) for r in frames][::3] == [(0, 1, False), (0, 2, None), (1, 3, False)]


def test_mmt(spark):
    mmtp = bytes([0x00, 0x00]) + (0xF100).to_bytes(2, "big") + (7).to_bytes(4, "big") + (9).to_bytes(4, "big") + b"\0\0" + bytes([0x28 | 1 << 1, 0]) + (77).to_bytes(4, "big") + b"data"
    tlv = lambda kind, body: bytes([0x7F, kind]) + len(body).to_bytes(2, "big") + body
    ip = bytes(6) + bytes([17, 0x20]) + bytes(32) + (456).to_bytes(2, "big") + (123).to_bytes(2, "big") + bytes(4) + bytes(40) + struct.pack(">II", 5, 6)
    data = b"xy" + tlv(3, (0x0015).to_bytes(2, "big") + b"\x61" + mmtp) + tlv(0xFF, b"pad") + b"\x7f" + tlv(2, ip)
    assert [(r[1], r[3], r[5]) for r in containers.tlv_packets(data)] == [(2, "HeaderCompressedIP", 2), (33, "Null", 0), (41, "IPv6", 1)]
    row = next(containers.mmtp_packets(data))
    assert row[2:8] == (1, 5, 0xF100, 9, 7, 0) and row[9:11] == (1, 77) and data[row[11] : row[11] + row[12]] == b"data"
    assert [(r[1], r[2], r[3]) for r in containers.ntp_packets(data)] == [(5, 6, 0x20)]
    rows = [(1, 0, 0, "whole"), (1, 1, 1, "a"), (1, 2, 2, "b"), (1, 3, 3, "c"), (1, 4, 2, "lost"), (1, 5, 1, "open"), (2, 1, 3, "tail"), (2, 2, 1, "x"), (2, 4, 3, "y")]
    got = reassemble(spark.createDataFrame(rows, "flow int, seq int, part int, data string")).orderBy("flow", "message").collect()
    assert [(r["flow"], r["message"], r["data"]) for r in got if r["data"] != "abclost"] == [(1, 1, "whole"), (2, 1, "xy")]


def test_aiff_ps_and_audio(spark, tmp_path):
    comm = struct.pack(">hIh", 2, 1000, 16) + bytes.fromhex("400EBB80000000000000")
    aiff = b"FORM" + struct.pack(">I", 100) + b"AIFF" + b"COMM" + struct.pack(">I", len(comm)) + comm + b"NAME" + struct.pack(">I", 3) + b"abc\0" + b"SSND" + struct.pack(">I", 4) + b"data"
    assert [(r[0], r[2], r[3], r[6], r[7]) for r in containers.aiff_chunks(aiff)] == [("COMM", 18, 2, 48000.0, None), ("NAME", 3, None, None, "abc"), ("SSND", 4, None, None, None)]
    pack = b"\0\0\1\xba\x44\0\4\0\4\1\0\0\3\xf8"
    pes = b"\0\0\1\xe0\0\x0a\x80\x80\x05\x21\0\x01\0\x03es"
    rows = list(containers.program_stream(pack + pes + b"\0\0\1\xb9"))
    assert [(r[1], r[3]) for r in rows] == [(0xBA, 14), (0xE0, 16), (0xB9, 4)] and rows[1][5] == 1 and (pack + pes)[rows[1][8] :][: rows[1][9]] == b"es"
    adts = bytes.fromhex("FFF14C80015FFC") + b"abc"
    assert [r[1:6] for r in audio.adts_frames(b"?" + adts * 2)] == [(1, 10, "AAC ADTS", 48000, 2), (11, 10, "AAC ADTS", 48000, 2)]
    mp3 = bytes.fromhex("FFFB9000") + bytes(413)
    assert [r[1:7] for r in audio.mpeg_audio_frames(mp3 * 2)] == [(0, 417, "MPEG audio layer 3", 44100, 2, 128000), (417, 417, "MPEG audio layer 3", 44100, 2, 128000)]
    ac3 = bytes.fromhex("0B77000014404300") + bytes(760)
    assert next(audio.ac3_frames(ac3))[3:5] == ("AC-3", 48000)
    loas = lambda body: ((0x2B7 << 13) | len(body)).to_bytes(3, "big") + body
    config = Writer().u(0, 1).u(0, 1).u(1, 1).u(0, 6).u(0, 4).u(0, 3).u(2, 5).u(3, 4).u(2, 4).bytes()
    assert [r[4:6] for r in audio.loas_frames(loas(config) + loas(b"\x80xx"))] == [(48000, 2), (48000, 2)]
    assert next(audio.hdmv_lpcm(bytes([0, 8, 0x31, 0x40])))[4:] == (48000, 2, 48000 * 2 * 16, 16)
    wav = audio.lpcm_to_wav(b"\x01\x02\x03\x04\x05", 48000, 2, 16)
    assert wav[-4:] == b"\x02\x01\x04\x03" and struct.unpack("<I", wav[4:8])[0] == len(wav) - 8
    (tmp_path / "a.aiff").write_bytes(aiff)
    got = parse_blobs(read_files(spark, str(tmp_path)), containers.aiff_chunks, containers.AIFF_ROWS).select("id").collect()
    assert [r["id"] for r in got] == ["COMM", "NAME", "SSND"]


def test_parsers_survive_noise():
    r = random.Random(5)
    parsers = [containers.boxes, containers.box_tables, containers.ebml, containers.blocks, containers.tlv_packets, containers.mmtp_packets, containers.ntp_packets, containers.aiff_chunks, containers.program_stream, video.mpeg2_elements, video.av1_obus, video.av1_annexb, video.ivf_frames, audio.adts_frames, audio.loas_frames, audio.mpeg_audio_frames, audio.ac3_frames, audio.dts_frames, audio.dts_hd_frames, audio.hdmv_lpcm, *(video.nal_units(c) for c in ("avc", "hevc", "vvc")), *(video.sei_messages(c) for c in ("avc", "hevc", "vvc"))]
    for parser in parsers:
        for _ in range(40):
            data = bytes(r.choice([0, 0, 1, 3, 0x47, 0x7F, 0x0B, 0x77, 255, r.randrange(256)]) for _ in range(r.randint(0, 200)))
            try:
                list(parser(data))
            except (EOFError, IndexError):
                pass  # parse_blobs takes these as the end of the blob


def test_broken_messages_and_streams():
    """Every cut and every changed byte of a valid object is survived."""
    from bitweave.sources import av1_state, mmt
    from bitweave.sources.blobs import BROKEN

    short = b"jpn\x02hi\x00\x03abc"
    loop = b"\x80\x04\x01\x00" + b"\xf0\x01" + len(short).to_bytes(2, "big") + short
    event = b"\x00\x09\xe0\x00\x12\x34\x56\xff\xff\xff" + (0x8000 + len(loop)).to_bytes(2, "big") + loop
    body = b"\x00\x05\xc7\x00\x00\x00\x07\x00\x04\x00\x8b" + event * 2 + bytes(4)
    section = b"\x8b" + (0xB000 + len(body)).to_bytes(2, "big") + body
    message = b"\x80\x00\x00" + len(section).to_bytes(2, "big") + section
    assert list(mmt.events(message)) == [(5, 3, 0, 7, 4, 9, 0xE000, 45296, None, 4, False, "jpn", "hi", "abc")] * 2
    access = b"\0\1\0" + b"\0\x0d" + b"\x86\x01\0\x09" + b"\x80\x04\x06\x00\x05\x00\x01\x02\xaa"
    assert [x[5:] for x in mmt.ca_descriptors(access)] == [(5, 0x102)]
    stream = _av1((1, AV1_SEQUENCE), (6, "0" + "00" + "1" + "000" + f"{5:07b}" + "0" * 8))
    assert len(list(av1_state.av1_reference_state(stream))) == 1
    r = random.Random(8)
    marks = b"\0\3" + b"\xff\xff\0\0\0\7\2hi\0" + b"\0\1\0\0\0\x09\3abc" + b"\0\2\0\0\0\0\x50x"
    aiff = b"FORM\0\0\1\0AIFCCOMM" + (28).to_bytes(4, "big") + bytes(18) + b"sowt\4Soft\0" + b"MARK" + len(marks).to_bytes(4, "big") + marks + b"\0" * (len(marks) % 2) + b"SSND\0\0\0\x08\0\0\0\1\0\0\0\2"
    assert [x[2:] for x in containers.aiff_fields(aiff)] == [("compression", None, "sowt"), ("compression_name", None, "Soft"), ("id", -1, None), ("position", 7, None), ("text", None, "hi"), ("id", 1, None), ("position", 9, None), ("text", None, "abc"), ("offset", 1, None), ("block_size", 2, None)]
    core = bytes.fromhex("7FFE8001FC3C0FF0B5E000000000000000")
    assert [x[3] for x in audio.dts_any_frames(bytes.fromhex("64582025003FFFFFFFFF") + core)] == ["DTS-HD", "DTS"]
    for parser, whole in ((containers.aiff_fields, aiff), (mmt.events, message), (mmt.ca_descriptors, access), (av1_state.av1_reference_state, stream)):
        broken = [whole[:k] for k in range(len(whole))] + [whole[:k] + bytes([r.randrange(256)]) + whole[k + 1 :] for k in range(len(whole)) for _ in range(4)]
        for data in broken:
            try:
                list(parser(data))
            except BROKEN:
                pass  # parse_blobs takes these as the end of the blob


@pytest.mark.parametrize("uri", ["au5.nu1", "nu1.vcl0", "bogus1", "http://au1", "au1-x"])
def test_locator_errors(uri):
    with pytest.raises(LocatorError):
        compile_locator(uri, "nal")


def test_locator_forms():
    s = compile_locator("~~nu0x10-.~AU-3.cvs", "nal")
    assert [(x.name, x.first, x.last, x.inverted) for x in s] == [("cvs", 0, None, False), ("au", 0, 3, True), ("nu", 16, None, False)]
    assert [x.level for x in compile_locator("MSE://vcl2.au/path?x#y", "nal")] == ["au", "nu"]
    assert [x.name for x in compile_locator("slice1.gop0", "mpv")] == ["gop", "slice"]


def test_literals():
    assert [literals.parse_int(x) for x in ("10", "010", "0x1F", "1Fh", "0b101", "17o", "ff", "-12", "zz")] == [10, 8, 31, 31, 5, 15, 255, -12, None]
    assert literals.parse_ranges("1,4-6,10-,-3,x") == [(1, 1), (4, 6), (10, None), (0, 3)]
    assert literals.split_set("1,2;;3.") == ["1", "2", "", "3"] and str(literals.parse_rational("30000/1001")) == "30000/1001"


def test_codebooks(spark, tmp_path):
    (tmp_path / "book.txt").write_text("0 1 0   1,2,2\n 2|3|6   3 3 7\n")
    book = huffman.read_codebook(spark, str(tmp_path / "book.txt"))
    codes = sorted(tuple(r) for r in book.collect())
    assert codes == [(0, 1, 0), (1, 2, 2), (2, 3, 6), (3, 3, 7)] == sorted(huffman.parse_codebook("0 1 0   1,2,2\n 2|3|6   3 3 7\n"))
    stats = huffman.codebook_stats(book).first()
    assert (stats["n_codes"], stats["min_len"], stats["max_len"], stats["kraft"], stats["n_prefix_clashes"], stats["n_nodes"]) == (4, 1, 3, 1 << 60, 0, 7)
    tree = huffman.Codebook(codes)
    assert tree.decode("0" + "10" + "111" + "110" + "0") == [0, 1, 3, 2, 0] and tree.kraft() == 1 and len(tree.search_rows()) == 7


def test_scalars(spark):
    row = spark.range(1).select(channel_layout(F.lit(63)).alias("a"), channel_layout(F.lit(3)).alias("b"), scalars.human_readable(F.lit(1_999_999)).alias("c"), scalars.gcd(F.lit(12), F.lit(18)).alias("d"), scalars.hex_lines(F.lit(bytearray(b"0123456789abcdefX"))).alias("e")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("5.1ch(L, R, C, LFE, Ls, Rs)", "2.0ch(L, R)", "1.99M", 6)
    assert [x["hex"] for x in row["e"]][1] == "58"


def test_mmt_signalling(spark):
    from bitweave.sources import mmt

    stamp = struct.pack(">HB", 1, 24) + struct.pack(">IIIIII", 7, 100, 5, 8, 101, 6)
    extended = struct.pack(">HB", 0x8026, 1 + 8 + 8) + bytes([2 << 1]) + struct.pack(">IBHB", 7, 0, 300, 2) + struct.pack(">HHHH", 1, 1501, 2, 1502)
    descriptors = stamp + extended
    asset = bytes([0]) + bytes(4) + b"\x02\xaa\xbb" + b"hev1" + bytes([0xFE, 1, 0]) + struct.pack(">H", 0xF100) + struct.pack(">H", len(descriptors)) + descriptors
    body = b"\0" + b"\x01\x11" + b"\0\0" + b"\x01" + asset
    table = bytes([0x20, 3]) + struct.pack(">H", len(body)) + body
    packages = b"\x01" + b"\x01\x11" + b"\0" + struct.pack(">H", 0x8000) + b"\0"
    listing = bytes([0x80, 0]) + struct.pack(">H", len(packages)) + packages
    message = b"\0\0\x05" + struct.pack(">I", 0) + b"\x02" + bytes([0x80, 0]) + struct.pack(">H", len(listing)) + bytes([0x20, 3]) + struct.pack(">H", len(table)) + listing + table
    tables = list(mmt.pa_tables(message))
    assert [(t[3], t[4]) for t in tables] == [(0x80, 0), (0x20, 3)]
    assert list(mmt.plt_packages(tables[0][5])) == [("11", 0x8000)]
    assets = list(mmt.mpt_assets(tables[1][5]))
    assert assets[0][:6] == ("11", 0, "aabb", "hev1", 0xF100, False)
    assert list(mmt.mpu_times(assets[0][6])) == [(7, 100, 5, 90_000, 300, [{"dts_pts": 1, "pts": 1501}, {"dts_pts": 2, "pts": 1502}]), (8, 101, 6, 90_000, None, None)]
    times = parse_blobs(spark.createDataFrame([("a", bytearray(assets[0][6]))], "path string, data binary"), mmt.mpu_times, mmt.TIME_ROWS)
    assert times.where("mpu_seq = 7").first()["offsets"][1]["pts"] == 1502


def test_syntax_view(spark):
    from bitweave.sources import syntax

    for declaration in [*syntax.STRUCTURES.values(), *(x.partition(" ")[2] for x in syntax.DESCRIPTORS.values())]:
        assert syntax.compiled(declaration)
        list(syntax.fields(bytes(range(64)), declaration))
        list(syntax.fields(b"", declaration))
    rows = list(syntax.fields(bytes([0x40 | 2 << 3, 0xF8]) + b"?", syntax.STRUCTURES["avc_aud"]))
    assert [(r[1], r[2], r[3]) for r in rows] == [("forbidden", 0, 1), ("nal_ref_idc", 1, 2), ("nal_unit_type", 3, 5), ("primary_pic_type", 8, 3)] and rows[3][5] == 7
    loop = b"\x05\x04HDMV" + b"\x0a\x08eng\0fra\x01" + b"\x48\x09\x01\x03abc\x03xyz" + b"\x99\x02\xab\xcd" + b"\x0e\x03\xc0\x01\x00"
    got = [(r[0], r[2], r[4], r[7]) for r in syntax.descriptor_fields(loop)]
    assert (0, "registration", "format_identifier", "HDMV") in got and (1, "iso_639_language", "language[1]", "fra") in got
    assert (2, "service", "name", "xyz") in got and (3, "unknown", "bytes", "abcd") in got and (4, "maximum_bitrate", "maximum_bitrate", "256") in got
    avcc = bytes([1, 100, 0, 40, 0xFF, 0xE1, 0, 2]) + b"\x67\x64" + bytes([1, 0, 1]) + b"\x68"
    assert {r[1]: r[4] for r in syntax.fields(avcc, syntax.STRUCTURES["box_avcC"])} | {} == {"version": "1", "profile_idc": "100", "constraints": "0", "level_idc": "40", "length_size_minus1": "3", "n_sps": "1", "sps_length[0]": "2", "sps[0]": "6764", "n_pps": "1", "pps_length[0]": "1", "pps[0]": "68"}
    obu = list(syntax.fields(bytes([0x0E, 0x20, 0x05]), syntax.STRUCTURES["obu_header"]))
    assert {r[1]: r[5] for r in obu} == {"forbidden": 0, "type": 1, "extension": 1, "has_size": 1, "temporal_id": 1, "spatial_id": 0, "size": 5}
    blobs = spark.createDataFrame([("a", bytearray(struct.pack(">HHHHHHHHII", *range(8), 9, 10)))], "path string, data binary")
    seen = {r["path"]: r["number"] for r in parse_blobs(blobs.withColumnRenamed("path", "file"), syntax.structure("sei_mastering_display"), syntax.FIELD_ROWS, ("file",)).collect()}
    assert (seen["gx"], seen["white_y"], seen["max_luminance"]) == (0, 7, 9)


def test_broken_objects_are_bounded_and_reported(spark):
    def box(kind, body):
        return (len(body) + 8).to_bytes(4, "big") + kind + body

    claim = (200_000).to_bytes(4, "big")
    for kind, held in ((b"stss", 3), (b"stco", 3), (b"stts", 1), (b"ctts", 1), (b"stsc", 1), (b"elst", 1)):
        assert len(list(containers.box_tables(box(kind, b"\0\0\0\0" + claim + b"\1" * 12) + box(b"free", b"x" * 100)))) == held, kind
    assert len(list(containers.box_tables(box(b"stsz", b"\0" * 8 + claim + b"\1" * 8)))) == 2
    assert len(list(containers.box_tables(box(b"trun", b"\0\0\3\0" + claim + b"\1" * 16)))) == 2

    deep = b""
    for _ in range(20_000):
        deep = box(b"moov", deep)
        if len(deep) > 60_000:
            break
    assert len(list(containers.boxes(deep))) == len(deep) // 8
    segment = b"\x18\x53\x80\x67\xff" + b"\x1f\x43\xb6\x75\xff" * 3000
    assert len(list(containers.ebml(segment))) == 3001
    nested = b"\xae\xff" * 3000
    assert [x[2] for x in containers.ebml(nested)][-1] == 2999

    def parser(data):
        yield (len(data),)
        if data.startswith(b"bad"):
            raise ValueError("odd")

    blobs = spark.createDataFrame([("a", bytearray(b"good")), ("b", bytearray(b"bad"))], "path string, data binary")
    got = [(r["path"], r["n"], r["error"]) for r in parse_blobs(blobs, parser, "n int", error_col="error").collect()]
    assert sorted(got, key=str) == sorted([("a", 4, None), ("b", 3, None), ("b", None, "ValueError: odd")], key=str)
    assert parse_blobs(blobs, parser, "n int").count() == 2


def _av1(*units):
    """OBUs of (type, bits)."""
    out = b"\x12\x00"
    for kind, bits in units:
        body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        out += bytes([kind << 3 | 2, len(body)]) + body
    return out


AV1_SEQUENCE = "000" + "0" * 2 + "0" * 2 + "0" * 5 + "0" * 12 + "00101" + "1000" * 2 + "1" * 18 + "0" + "000" + "0000" + "100" + "1" + "1" + "110" + "0" * 8


def test_av1_reference_state():
    from bitweave.sources.av1_state import av1_reference_state, short_references

    assert short_references([0, 8, 2, 1, 3, 6, 5, 7], 4, 7, 4, 0) == [4, 2, 3, 0, 6, 5, 1]
    assert short_references([0] * 8, 1, 7, 0, 0) == [0, 7, 6, 0, 5, 4, 3]
    assert short_references([127] * 8, 1, 7, 0, 0)[0] == 0  # hints wrap round
    assert short_references([9] * 8, 1, 7, 2, 5) == [2, 0, 0, 5, 0, 1, 7]  # nothing behind: the earliest is the first slot
    key = "0" + "00" + "1" + "000" + f"{5:07b}"
    inter = lambda hint, refresh, refs, resilient="": "0" + "01" + "1" + ("1" if resilient else "0") + "000" + f"{hint:07b}" + ("" if resilient else "000") + f"{refresh:08b}" + resilient + refs + "0" * 8
    plain = "0" + "".join(f"{k:03b}" for k in range(7))
    shown = "1" + f"{3:03b}" + "0000"
    rows = list(av1_reference_state(_av1((1, AV1_SEQUENCE), (6, key), (6, inter(6, 0b1000, plain)), (3, shown), (6, inter(7, 1, "1" + "000" + "011")), (3, "1" + f"{7:03b}" + "0000"))))
    assert [r[2:8] for r in rows] == [(0, "KEY", True, None, 5, 255), (1, "INTER", True, None, 6, 8), (1, "INTER", True, 3, 6, 0), (2, "INTER", True, None, 7, 1), (0, "KEY", True, 7, 5, 255)]
    assert rows[1][8] == [0] * 7 and rows[1][9] == [0, 0, 0, 1, 0, 0, 0, 0]
    assert rows[3][8] == [0, 0, 0, 1, 0, 0, 0] and rows[3][9] == [2, 0, 0, 1, 0, 0, 0, 0]
    assert rows[4][9] == [0] * 8  # a key frame shown again fills every slot
    hints = "".join(f"{5 if k else 9:07b}" for k in range(8))  # slot 0 should hold hint 9: that frame is missing
    rows = list(av1_reference_state(_av1((1, AV1_SEQUENCE), (6, key), (6, inter(6, 0b10, plain, hints)))))
    assert rows[1][8] == [None, 0, 0, 0, 0, 0, 0] and rows[1][9] == [None, 1, 0, 0, 0, 0, 0, 0]
    assert list(av1_reference_state(_av1((6, key)))) == [] == list(av1_reference_state(b""))


def test_message_checks_and_units(spark):
    from bitweave.functions.crc import crc
    from bitweave.operators import mmt
    from bitweave.sources.mmt import mmtp_units

    def message(kind, section, size=None):
        whole = section + crc(section, "crc-32-mpeg").to_bytes(4, "big")
        return kind.to_bytes(2, "big") + b"\0" + (len(whole) if size is None else size).to_bytes(2, "big") + whole

    good = message(0x8000, b"\x8bxyz")
    cases = [good, good[:-1] + b"?", message(0x8001, b"\x8bxyz"), message(0x8004, b"\xa6"), message(0x8004, b"\xa7x"), message(0x8002, b"\x8bxyz", 4000), message(0x8002, b"", 4), b"", b"\x80", None, good]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, data binary")
    assert [(r.k, r.ok) for r in mmt.message_checks(df).orderBy("k").collect()] == [(0, True), (1, False), (3, True), (10, True)]
    assert mmt.message_checks(df.limit(0)).count() == 0

    def packet(kind, payload):
        body = b"\x00\x10\x61" + b"\0" + bytes([kind]) + b"\xf1\x00" + bytes(8) + payload
        return b"\x7f\x03" + len(body).to_bytes(2, "big") + body

    long = b"\x03\x00" + (2).to_bytes(4, "big") + b"ab" + (900).to_bytes(4, "big") + b"lost"
    assert [(r[4], r[6], r[-1]) for r in mmtp_units(packet(2, long) + packet(2, b"\x00\x00whole"))] == [("message", 0, b"ab"), ("message", 0, b"whole")]
    short = b"\0\0" + b"\x28\0" + bytes(4) + b"too short"
    assert list(mmtp_units(packet(0, short))) == []


def test_header_windows_across_batches(spark, tmp_path):
    from bitweave.streaming import units

    source, rows = str(tmp_path / "in"), [(0, False, b"lost"), (1, True, b"abc"), (2, False, None), (3, False, b"defgh"), (4, False, b"more"), (5, True, b"xy"), (6, True, b""), (7, True, b"0123456789")]
    schema = "pid int, pkt_idx long, pusi boolean, payload binary"
    out, batches = [], [rows[:2], rows[2:5], rows[5:]]
    for k, batch in enumerate(batches):
        spark.createDataFrame([(9, *r) for r in batch], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run = units.header_windows(stream, 6).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        out = [(r.unit, r.first_pkt, bytes(r.head)) for r in spark.read.schema(units.HEADERS).parquet(str(tmp_path / "out")).orderBy("unit").collect()]
        assert len(out) == [0, 1, 4][k]
    assert out == [(1, 1, b"abcdef"), (2, 5, b"xy"), (3, 6, b""), (4, 7, b"012345")]
