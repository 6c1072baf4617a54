"""Packet, clock and PSI operators on hand-built streams."""

import pytest
from pyspark.sql import functions as F

from bitweave.functions.crc import PUBLISHED, crc, parameters
from bitweave.operators import clock_reports as reports
from bitweave.operators import packets as ts
from bitweave.operators import psi
from bitweave.operators.ordered import with_lag, with_last_known, with_running_sum
from bitweave.plans import emap
from bitweave.sources.byte_streams import write_stream
from bitweave.sources.packets import probe, read_packets


def bitwise_crc(data, width, poly, init, last, reflected):
    r = init
    for byte in data:
        for k in range(8):
            bit = (byte >> (k if reflected else 7 - k)) & 1
            top = (r >> (width - 1)) & 1
            r = (r << 1) & ((1 << width) - 1)
            r ^= poly if top ^ bit else 0
    return (int(format(r, f"0{width}b")[::-1], 2) if reflected else r) ^ last


@pytest.mark.parametrize("name", list(parameters()))
def test_crc_equals_bit_by_bit(name):
    p = parameters()[name]
    for data in (b"", b"1", b"123456789", bytes(range(256))):
        assert crc(data, name) == bitwise_crc(data, *p)
        if name in PUBLISHED:
            assert crc(data, name, True) == bitwise_crc(data, *p[:2], *PUBLISHED[name], p[4])


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_ordered_operators_do_not_depend_on_spans(spark, span):
    rows = [(k, k % 2, k * k % 7 if k % 3 else None) for k in (0, 1, 2, 5, 6, 7, 30, 31, 64)]
    df = spark.createDataFrame(rows, "k long, p int, v int")
    got = with_last_known(with_running_sum(with_lag(df, {"b": "v"}, "k", span=span), {"s": F.col("v")}, "k", span=span), {"last": F.col("v")}, "k", span=span).orderBy("k").collect()
    before, total, last = None, 0, None
    for r, (_, _, v) in zip(got, rows, strict=True):
        total, last = total + (v or 0), last if v is None else v
        assert (r["b"], r["s"], r["last"]) == (before, total, last)
        before = v
    by = {(r["k"]): r["b"] for r in with_lag(df, {"b": "k"}, "k", ("p",), span=span).collect()}
    assert by == {0: None, 1: None, 2: 0, 5: 1, 6: 2, 7: 5, 30: 6, 31: 7, 64: 30}


def test_clocks_wrap_and_equal_stamps(spark):
    wrap = 1 << 30
    rows = [(0, 10, wrap - 5, True), (1, 10, 3, False), (2, 11, 3, True), (3, 10, 100, True)]
    p = spark.createDataFrame(rows, "pkt_idx long, pid int, atc long, pusi boolean")
    assert [r["diff"] for r in reports.atc_diff(p).orderBy("pkt_idx").collect()] == [None, 8, 0, 97]
    assert [r["diff"] for r in reports.atc_diff(p, compat=True).orderBy("pkt_idx").collect()] == [None, 8, wrap, 97]
    units = {(r["pid"], r["unit"]): (r["first_pkt"], r["last_pkt"], r["n_packets"], r["duration"], r["pure"]) for r in reports.payload_units(p).collect()}
    assert units == {(10, 1): (0, 1, 2, 105, 8), (11, 1): (2, 2, 1, None, 97), (10, 2): (3, 3, 1, None, 0)}


def test_pcr_of_the_documents():
    assert 3213312641 * 300 + 184 == 963993792484


@pytest.mark.parametrize(("size", "lead", "name"), [(188, 0, "ts188"), (192, 4, "m2ts192"), (204, 0, "ts204"), (208, 0, "ts208")])
def test_probe(size, lead, name):
    packet = b"\0" * lead + b"\x47" + b"\x01" * (size - lead - 1)
    assert probe(packet * 6) == name
    assert probe(b"\x01" * 2000) is None and probe(b"") is None


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """A PAT and a PMT in two versions, one of them broken, and a PES stream, as a 188-byte file."""
    word = lambda x: x.to_bytes(2, "big")
    pmt = lambda v: psi.make_section(2, 1, word(0xE101) + word(0xF000) + b"\x1b" + word(0xE101) + word(0xF006) + b"\x05\x04HDMV" + (b"\x0f" + word(0xE102) + word(0xF000)) * v, v)
    raw = psi.section_packets(psi.make_section(0, 7, word(0) + word(0xE010) + word(1) + word(0xE100)), 0)
    long = psi.make_section(2, 1, word(0xE101) + word(0xF000) + b"".join(b"\x1b" + word(0xE101 + k) + word(0xF000) for k in range(60)), 2)
    broken = bytearray(pmt(3))
    broken[10] ^= 1
    for section in (pmt(0), pmt(1), bytes(broken), long):
        raw += psi.section_packets(section, 0x100)
    pes = b"\0\0\1\xe0\0\0\x80\xc0\x0a" + b"\x31\0\x01\0\x03" + b"\x11\0\x01\0\x01" + bytes(range(200))
    first, rest = pes[:184], pes[184:]
    raw.append(bytes([0x47, 0x41, 0x01, 0x10]) + first)
    raw.append(bytes([0x47, 0x01, 0x01, 0x31, 183 - len(rest), 0]) + b"\xff" * (182 - len(rest)) + rest)
    raw.append(bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184)
    path = tmp_path_factory.mktemp("ts") / "a.ts"
    path.write_bytes(b"".join(raw))
    return str(path), raw


def test_scan_parse_and_tables(spark, stream):
    path, raw = stream
    packets = ts.parse_packets(read_packets(spark, path))
    assert [bytes(r["raw"]) for r in packets.orderBy("pkt_idx").collect()] == raw
    found = psi.sections(packets, [0, 0x100])
    assert [(r["pid"], r["version"], r["crc_ok"]) for r in found.orderBy("pkt_idx").collect()] == [(0, 0, True), (256, 0, True), (256, 1, True), (256, 3, False), (256, 2, True)]
    assert [(r["program_number"], r["pmt_pid"]) for r in psi.pat_entries(found).orderBy("program_number").collect()] == [(0, 16), (1, 256)]
    streams = psi.pmt_streams(found)
    assert {(r["version"], r["es_pid"], r["stream_type"]) for r in streams.where("version < 2").collect()} == {(0, 257, 27), (1, 257, 27), (1, 258, 15)}
    assert streams.where("version = 2").count() == 60
    assert {(r["tag"], bytes(r["content"])) for r in psi.descriptors(streams).collect()} == {(5, b"HDMV")}
    unit = psi.pes_units(packets, [0x101]).collect()
    assert len(unit) == 1 and bytes(unit[0]["es"]) == bytes(range(200)) and (unit[0]["pts90"], unit[0]["dts90"], unit[0]["stream_id"]) == (1, 0, 0xE0) or unit[0]["pts90"] is not None


def test_descendants_of_a_deep_tree(spark):
    from bitweave.operators.trees import descendants_by_kind

    rows = [(k, k - 1 if k else None, "a" if k % 10 else "b", 0, 0) for k in range(41)]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, kind string, ordinal int, pos int").coalesce(1)
    assert sorted(r["node_id"] for r in descendants_by_kind(nodes, 0, "b").collect()) == [10, 20, 30, 40]


def test_stream_id_extension(spark):
    plain = bytes([0, 0, 1, 0xFD, 0, 0, 0x80, 0x80, 5, 0x21, 0, 1, 0, 1]) + b"none"
    short = bytes([0, 0, 1, 0xFD, 0, 0, 0x80, 0x81, 8, 0x21, 0, 1, 0, 1, 0x01, 0x81, 0x55]) + b"first"
    # PTS and DTS, ESCR, rate, CRC; private data, pack header of 3, counter, buffer size
    full = bytes([0, 0, 1, 0xFD, 0, 0, 0x80, 0xF3, 50, 0x31, 0, 1, 0, 1, 0x11, 0, 1, 0, 1]) + bytes(11) + b"\xf1" + bytes(16) + b"\x03" + bytes(3) + bytes(4) + b"\x81\x71"
    full = full.ljust(59, b"\xff") + b"second"
    other = bytes([0, 0, 1, 0xE0, 0, 0, 0x80, 0, 0]) + b"video"
    rows = [(k, 0x101, True, 1, bytearray(x), 0) for k, x in enumerate((plain, short, full, other))]
    packets = spark.createDataFrame(rows, "pkt_idx long, pid int, pusi boolean, afc int, raw binary, payload_at int")
    found = lambda **only: [(bytes(r["es"]), r["stream_id_extension"]) for r in psi.pes_units(packets, **only).orderBy("unit").collect()]
    every = [(b"none", None), (b"first", 0x55), (b"second", 0x71), (b"video", None)]
    assert found() == every
    assert found(stream_id=0xFD, stream_id_extension=0x71) == [every[0], every[2]]
    assert found(stream_id=0xE0, stream_id_extension=0x71) == every[3:]


def test_range_pushdown(spark, stream):
    path, raw = stream
    assert read_packets(spark, path, start=2, end=4).count() == 2
    some = read_packets(spark, path).where("pkt_idx >= 3 and pkt_idx < 5")
    assert [r["pkt_idx"] for r in some.orderBy("pkt_idx").collect()] == [3, 4]
    assert read_packets(spark, path, start=10_000).count() == 0


def test_rewrites(spark, stream, tmp_path):
    path, raw = stream
    rows = read_packets(spark, path).select("pkt_idx", ts.add_prefix(ts.remap_pid(F.col("raw"), {0x101: 0x1234}), F.col("pkt_idx")).alias("raw"))
    back = ts.parse_packets(rows, prefix=4).orderBy("pkt_idx").collect()
    assert {r["pid"] for r in back} == {0, 0x100, 0x1234, 0x1FFF}
    assert [r["atc"] for r in back] == [(0x1951D2E + k * 0x1F2) & 0x3FFFFFFF for k in range(len(raw))]
    undone = rows.select("pkt_idx", ts.remap_pid(ts.strip_prefix(F.col("raw")), {0x1234: 0x101}).alias("raw"))
    out = tmp_path / "out"
    assert sum(n for _, n in write_stream(undone, str(out), ["pkt_idx"], "raw")) == 188 * len(raw)
    assert b"".join(p.read_bytes() for p in sorted(out.iterdir()) if p.name.endswith(".bin")) == b"".join(raw)
    assert ts.null_packets(spark, 33, 33).count() == 31 and ts.null_packets(spark, 64, 64).count() == 0


def test_packed_events_equal_direct_ones(spark):
    rows = [(k, 256 + k, (k * 999_999_937) % (1 << 30), k % 3 == 0, (k * 7_777_777_777_777) % emap.PCR_WRAP if k % 3 == 1 else None, (k * 1_234_567_891) % emap.PTS_WRAP if k % 3 == 0 else None, (k * 987_654_321) % emap.PTS_WRAP if k % 6 == 0 else None, bytearray(b"{x}")) for k in range(60)]
    df = spark.createDataFrame(rows, "pkt_idx long, pid int, atc long, pusi boolean, pcr27 long, pts90 long, dts90 long, payload binary")
    back = ts.parse_packets(emap.pack(df), prefix=4).orderBy("pkt_idx").collect()
    assert [(r["pkt_idx"], r["pid"], r["atc"], r["pusi"], r["pcr27"], r["pts90"], r["dts90"]) for r in back] == [r[:7] for r in rows]
    assert all(r["in_sync"] and len(r["raw"]) == 192 for r in back)


def test_streaming_units_equal_batch(spark, tmp_path):
    from bitweave.streaming.units import payload_units, version_changes, windowed_counts

    rows = [(k, 10 + k % 3, k % 7 == 0, (k * 1000) % (1 << 30)) for k in range(90)]
    df = spark.createDataFrame(rows, "pkt_idx long, pid int, pusi boolean, atc long")
    for k in range(3):
        df.where(f"pkt_idx div 30 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = payload_units(read).writeStream.format("memory").queryName("units").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["pid"], r["unit"]): (r["first_pkt"], r["last_pkt"], r["n_packets"]) for r in spark.table("units").collect()}
    want = {(r["pid"], r["unit"]): (r["first_pkt"], r["last_pkt"], r["n_packets"]) for r in reports.payload_units(df).where("duration is not null").collect()}
    assert got == want and got
    versions = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).selectExpr("pid", "pkt_idx", "pkt_idx div 40 AS version")
    query = version_changes(versions).writeStream.format("memory").queryName("versions").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("versions").count() == 9
    timed = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).selectExpr("pid", "timestamp_seconds(pkt_idx * 60) AS ts")
    query = windowed_counts(timed).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sum(r["n_packets"] for r in spark.table("windows").collect()) == 90


def test_remap_inside_tables(spark, stream):
    path, raw = stream
    packets = ts.parse_packets(read_packets(spark, path))
    mapping = {0x100: 0x300, 0x101: 0x301, 0x10: 0x40, 0x102: 0x302, 0x120: 0x1320}
    inner = psi.remap_tables(packets, [0, 0x100], mapping)
    moved = ts.parse_packets(inner.select("pkt_idx", ts.remap_pid(F.col("raw"), mapping).alias("raw")))
    found = psi.sections(moved, [0, 0x300])
    assert [(r["version"], r["crc_ok"]) for r in found.where("pid = 768").orderBy("pkt_idx").collect()] == [(0, True), (1, True), (3, False), (2, True)]
    assert {(r["program_number"], r["pmt_pid"]) for r in psi.pat_entries(found).collect()} == {(0, 0x40), (1, 0x300)}
    streams = psi.pmt_streams(found)
    assert {(r["version"], r["pcr_pid"], r["es_pid"]) for r in streams.where("version < 2").collect()} == {(0, 0x301, 0x301), (1, 0x301, 0x301), (1, 0x301, 0x302)}
    assert 0x1320 in {r["es_pid"] for r in streams.where("version = 2").collect()}
    back = psi.remap_tables(ts.parse_packets(inner), [0, 0x100], {v: k for k, v in mapping.items()})
    assert [bytes(r["raw"]) for r in back.orderBy("pkt_idx").collect()] == raw
