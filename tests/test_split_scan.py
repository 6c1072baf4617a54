"""Byte ranges of streams, the sink that commits whole, and checks that are joined from chunks."""

import os
import random
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from bitweave.functions import crc
from bitweave.operators import split_scan
from bitweave.sources import byte_streams, containers, video
from bitweave.sources.byte_streams import MARK, parts_of, read_ranges, write_stream

SIZES = [5, 64, 1000, 1 << 22]


def tlv_bytes(r):
    out = b"\x7f\x7f"
    for _ in range(150):
        n = r.choice([0, 3, 20, 300])
        out += bytes([0x7F, r.choice([1, 2, 3, 254, 255])]) + n.to_bytes(2, "big") + bytes(r.choice([0x7F, 3, 0, 0, 1]) for _ in range(n))
        if r.random() < 0.2:
            out += bytes(r.choice([0x7F, 0x7F, 5, 3, 0, 0]) for _ in range(r.randint(1, 30)))
    return out + b"\x7f\x03\xff"


def ps_bytes(r):
    out = b"junk\x00\x00\x01\x05"
    for _ in range(120):
        body = bytes(r.choice([0, 0, 1, 0xBA, 0xE0, 0x85, 0xC0]) for _ in range(r.randint(0, 60)))
        out += r.choice([b"\x00\x00\x01\xba\x44" + bytes(8) + b"\xfa" + bytes(2), b"\x00\x00\x01\xb9", b"\x00\x00\x01\xba\x21" + bytes(7), b"\x00\x00\x00"])
        out += b"\x00\x00\x01" + bytes([r.choice([0xBB, 0xBD, 0xC0, 0xE0, 0xFF])]) + len(body).to_bytes(2, "big") + body
    return out + b"\x00\x00\x01\xe0\xff"


def start_code_bytes(r):
    return bytes(r.choice([0, 0, 0, 0, 1, 1, 9]) for _ in range(3000)) + bytes(200) + b"\x00\x00\x01\x00\x00\x00\x01ab" + bytes(90)


@pytest.fixture
def stream(tmp_path):
    def write(data, parts=3):
        cuts = [0, *sorted(random.Random(5).sample(range(1, len(data)), parts - 1)), len(data)]
        (tmp_path / "s").mkdir()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            (tmp_path / "s" / f"part-{k}").write_bytes(data[a:b])
        return str(tmp_path / "s")

    return write


@pytest.mark.parametrize("size", SIZES)
def test_tlv_by_ranges_equals_one_scan(spark, stream, monkeypatch, size):
    monkeypatch.setattr(split_scan, "BLOCK", 8)
    data = tlv_bytes(random.Random(1))[: 900 if size == 5 else None]
    got = sorted(map(tuple, split_scan.scan_tlv(spark, stream(data), size).collect()))
    assert got == [(n, at, 4 + size, skipped, kind, size) for n, at, kind, _, size, skipped in containers.tlv_packets(data)]


@pytest.mark.parametrize("size", SIZES)
def test_program_stream_by_ranges_equals_one_scan(spark, stream, monkeypatch, size):
    monkeypatch.setattr(split_scan, "BLOCK", 16)
    data = ps_bytes(random.Random(2))[: 700 if size == 5 else None]
    got = sorted(split_scan.scan_program_stream(spark, stream(data), size).collect())
    want = list(containers.program_stream(data))
    assert [(r.idx, r.stream_id, r.byte_off, r.byte_len, r.scr, r.pts, r.dts, r.sub_stream) for r in got] == [x[:8] for x in want]


@pytest.mark.parametrize("size", SIZES)
def test_start_codes_by_ranges_equal_one_scan(spark, stream, size):
    data = start_code_bytes(random.Random(3))
    data = data[2600:] if size == 5 else data
    got = sorted(map(tuple, split_scan.scan_start_codes(spark, stream(data), size).collect()))
    assert got == [(k, a, b - a, data[a]) for k, (a, b) in enumerate(video.nal_bounds(data))]


def test_streams_without_packets(spark, stream, tmp_path):
    assert split_scan.scan_tlv(spark, stream(bytes(100)), 16).collect() == []
    (tmp_path / "empty").write_bytes(b"")
    assert split_scan.scan_tlv(spark, str(tmp_path / "empty"), 16).collect() == []
    assert split_scan.scan_start_codes(spark, str(tmp_path / "empty"), 16).collect() == []


def test_exits_and_walks_agree():
    r = random.Random(4)
    for _ in range(50):
        at = np.array(sorted(r.sample(range(200), r.randint(0, 40))), np.int64)
        after = at + np.array([r.randint(1, 60) for _ in at], np.int64)
        out = split_scan.exits(at, after, 200)
        for entry in range(0, 200, 7):
            last = [int(after[k]) for k, _ in split_scan.walk(at, after, entry, 200)]
            k = int(np.searchsorted(at, entry))
            assert (out[k] if k < len(at) else 200) == (last[-1] if last and last[-1] >= 200 else 200)


# -- the sink ---------------------------------------------------------------------


def test_stream_is_written_once_and_in_order(spark, tmp_path):
    rows = [(k, bytes([k % 256] * (k % 7))) for k in range(500)]
    df = spark.createDataFrame(random.Random(1).sample(rows, 500), "k long, data binary").repartition(6)
    at = str(tmp_path / "out")
    parts = write_stream(df, at, ["k"], "data")
    joined = lambda: b"".join(Path(p).read_bytes() for p, _ in parts_of(at))
    assert joined() == b"".join(x for _, x in rows) and sum(n for _, n in parts) == len(joined())
    assert {x for x in os.listdir(at) if x[0] in "._"} <= {MARK, f".{MARK}.crc"}
    with pytest.raises(Exception, match="holds a stream already"):
        write_stream(df, at, ["k"], "data")
    assert joined() == b"".join(x for _, x in rows) and not [x for x in os.listdir(at) if x.startswith("_attempts")]
    write_stream(df.where("k < 9"), at, ["k"], "data", overwrite=True)
    assert joined() == b"".join(x for _, x in rows[:9])


FAULT = """
import os, sys
from pyspark.sql import SparkSession
from bitweave.sources.byte_streams import ByteStream, parts_of
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.sql.adaptive.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
spark.dataSource.register(ByteStream)
at, always = sys.argv[1], sys.argv[2] == "always"
def breaks(batches):
    from pyspark import TaskContext
    task = TaskContext.get()
    for k, batch in enumerate(batches):
        yield batch
        if task.partitionId() == 1 and k == 2 and (always or task.attemptNumber() == 0):
            raise RuntimeError("lost")
df = spark.range(300).selectExpr("id", "cast(lpad(id, 3, '0') as binary) as data").repartitionByRange(3, "id").sortWithinPartitions("id").select("data")
try:
    df.mapInArrow(breaks, "data binary").write.format("byte_stream").mode("overwrite").save(at)
    print("written")
except Exception:
    print("failed")
"""


@pytest.mark.parametrize("how", ["once", "always"])
def test_sink_survives_a_failing_task(tmp_path, how):
    at = tmp_path / "out"
    at.mkdir()
    (at / "part-000000.bin").write_bytes(b"before")
    said = subprocess.run([sys.executable, "-c", textwrap.dedent(FAULT), str(at), how], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent)})
    data = b"".join(Path(p).read_bytes() for p, _ in parts_of(str(at)))
    if how == "once":
        assert "written" in said.stdout and data == b"".join(b"%03d" % k for k in range(300))
    else:
        assert "failed" in said.stdout and data == b"before"
    assert not [x for x in os.listdir(at) if x.startswith("_attempts")]


def test_ranges_are_the_stream(spark, stream):
    data = bytes(random.Random(6).randrange(256) for _ in range(1000))
    path = stream(data, 7)
    rows = read_ranges(spark, path, 97, ahead=10).orderBy("start").collect()
    assert b"".join(bytes(r.data[: r.own]) for r in rows) == data and all(bytes(r.data) == data[r.start : r.start + r.own + 10] for r in rows)
    assert [r.split for r in read_ranges(spark, path, 97, splits=[3, 5]).orderBy("split").collect()] == [3, 5]


def test_small_ranges_share_tasks(spark, stream):
    data = bytes(random.Random(9).randrange(256) for _ in range(10_000))
    path = stream(data, 7)
    ranges = read_ranges(spark, path, 10, ahead=3)
    assert ranges.rdd.getNumPartitions() <= 5 * spark.sparkContext.defaultParallelism
    rows = ranges.orderBy("start").collect()
    assert [r.split for r in rows] == list(range(1000)) and all(bytes(r.data) == data[r.start : r.start + r.own + 3] for r in rows)


def test_bytes_of_a_column_are_joined():
    values = [b"a", None, b"", b"bcd", None, b"e" * 300, b"f"]
    for a in range(8):
        for b in range(a, 8):
            for kind in (pa.binary(), pa.large_binary()):
                assert bytes(byte_streams.joined(pa.array(values, kind)[a:b])) == b"".join(x or b"" for x in values[a:b])


# -- checks -------------------------------------------------------------------------


@pytest.mark.parametrize("standard", [False, True])
def test_joined_checks_equal_whole_ones(spark, standard):
    r = random.Random(7)
    chunks = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 300]))) for _ in range(40)]
    df = spark.createDataFrame([(k, c if c else None) for k, c in enumerate(chunks)], "k long, data binary").repartition(5)
    got = {x.name: (x.n_bytes, x.check) for x in crc.crc_in_order(df, "data", "k", standard=standard).collect()}
    whole = b"".join(chunks)
    assert got == {name: (len(whole), format(crc.crc(whole, name, standard), f"0{crc.parameters()[name][0] // 4}X")) for name in crc.parameters()}


def test_checks_of_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(k % 3, k, b"%d" % k) for k in range(20)], "g long, k long, data binary")
    got = {x.g: x.check for x in crc.crc_in_order(df, "data", "k", ("g",), ("crc-32c",)).collect()}
    assert got == {g: format(crc.crc(b"".join(b"%d" % k for k in range(20) if k % 3 == g), "crc-32c"), "08X") for g in range(3)}
    empty = crc.crc_in_order(df.limit(0), "data", "k", (), ("crc-32",)).collect()
    assert [(x.n_bytes, x.check) for x in empty] == [(0, "00000000")]


def test_file_check_does_not_depend_on_ranges(spark, stream):
    data = bytes(random.Random(8).randrange(256) for _ in range(70_000))
    path = stream(data)
    want = {n: format(crc.crc(data, n), f"0{crc.parameters()[n][0] // 4}X") for n in ("crc-16", "crc-32", "crc-64-jones", "crc-8-wcdma")}
    for size in (999, 1 << 20):
        assert {x.name: x.check for x in crc.file_crc(spark, path, tuple(want), size).collect()} == want


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_entries_do_not_depend_on_levels(spark, monkeypatch, fan):
    r, size = random.Random(fan), 10
    monkeypatch.setattr(split_scan, "FAN", fan)
    places = np.array(sorted(r.sample(range(400), 130)))
    after = places + np.array([r.randint(1, 60) for _ in places])
    pieces = []
    for k in range(40):
        own = (places >= k * size) & (places < (k + 1) * size)
        pieces += zip(places[own].tolist(), split_scan.exits(places[own], after[own], (k + 1) * size).tolist(), strict=True)
    want, entry = {}, 0
    for p, stop in zip(places.tolist(), after.tolist(), strict=True):
        if p >= entry:
            want.setdefault(p // size, entry)
            entry = stop
    got = split_scan._entries(spark.createDataFrame(pieces, "at long, exit long"), size).collect()
    # a range's entry may be given as any place from which its first packet is the same
    first = lambda e: int(places[np.searchsorted(places, e)])
    assert {x.split: first(x.entry) for x in got} == {k: first(e) for k, e in want.items()}
