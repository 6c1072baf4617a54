"""Removal of boxes: bytes written, read again, and every chunk's bytes where the new tables say."""

import random
import struct

import pytest

from bitweave.operators.rewrite import shifted, without_boxes, write_without
from bitweave.sources import containers


def _box(kind, body, wide=False):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def _table(offsets, wide=False):
    return _box(b"co64" if wide else b"stco", struct.pack(">II", 0, len(offsets)) + b"".join(struct.pack(">Q" if wide else ">I", x) for x in offsets))


def _file(seed, tracks=3, first=False):
    """A file with tracks of chunks, free space between, and the offsets that its own layout gives; returns (bytes, chunk payloads by track)."""
    rnd = random.Random(seed)
    payloads = [[bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 30))) for _ in range(rnd.randrange(0, 9))] for _ in range(tracks)]
    media = b"".join(x for p in payloads for x in p)
    ftyp, free = _box(b"ftyp", b"isom\0\0\0\0"), _box(b"free", bytes(rnd.randrange(1, 90)))

    def moov(at):
        traks = []
        for t, p in enumerate(payloads):
            offsets, here = [], at + sum(len(x) for q in payloads[:t] for x in q)
            for x in p:
                offsets.append(here)
                here += len(x)
            stbl = _box(b"stbl", _table(offsets, wide=t == 2))
            traks.append(_box(b"trak", _box(b"udta", bytes(2 * t + 1)) + _box(b"mdia", _box(b"minf", stbl)) + _box(b"free", bytes(t))))
        return _box(b"moov", b"".join(traks) + _box(b"free", bytes(5)))

    head = ftyp + free
    mdat = _box(b"mdat", media, wide=seed % 2 == 1)
    inner = len(mdat) - len(media)
    if first:
        return head + mdat + _box(b"free", bytes(3)) + moov(len(head) + inner), payloads
    return head + moov(len(head) + len(moov(0)) + inner) + mdat + b"", payloads


def _rows(spark, data):
    found = list(containers.boxes(data))
    boxes = [(int(r[0]), r[3], int(r[5]), int(r[6]), int(r[7])) for r in found]
    chunks = []
    for box, kind, at, _, header in boxes:
        if kind in ("stco", "co64"):
            (n,) = struct.unpack_from(">I", data, at + header + 4)
            form, w = (">I", 4) if kind == "stco" else (">Q", 8)
            chunks += [(box, k, struct.unpack_from(form, data, at + header + 8 + w * k)[0]) for k in range(n)]
    return spark.createDataFrame(boxes, "box long, kind string, offset long, size long, header int"), spark.createDataFrame(chunks, "box long, k long, chunk_offset long"), boxes


def _offsets(data):
    out = []
    for r in containers.boxes(data):
        if r[3] in ("stco", "co64"):
            at, (form, w) = r[5] + r[7], (">I", 4) if r[3] == "stco" else (">Q", 8)
            out.append([struct.unpack_from(form, data, at + 8 + w * k)[0] for k in range(struct.unpack_from(">I", data, at + 4)[0])])
    return out


@pytest.mark.parametrize("seed,first,limit,kinds", [(1, False, 1 << 32, {"free"}), (2, False, 300, {"free", "udta"}), (4, False, 1, {"udta"}), (3, True, 120, {"free"}), (6, False, 1 << 32, set())])
def test_payloads_survive(spark, tmp_path, seed, first, limit, kinds):
    data, payloads = _file(seed, first=first)
    (tmp_path / "in.mp4").write_bytes(data)
    boxes, chunks, rows = _rows(spark, data)
    removed = boxes.where(boxes["kind"].isin(*kinds)).select("box") if kinds else boxes.select("box").limit(0)
    parts = write_without(spark, str(tmp_path / "in.mp4"), str(tmp_path / "out"), boxes, removed, chunks, limit, split_bytes=37, span=64)
    out = b"".join(open(p, "rb").read() for p, _ in parts)
    again = list(containers.boxes(out))
    names = ["co64" if r[3] in ("stco", "co64") else r[3] for r in again]
    assert names == ["co64" if k in ("stco", "co64") else k for _, k, *_ in rows if k not in kinds]
    assert sum(r[6] for r in again if r[2] == 0) == len(out)  # whole boxes, end to end
    found = _offsets(out)
    assert [[out[a : a + len(x)] for a, x in zip(o, p, strict=True)] for o, p in zip(found, payloads, strict=True)] == payloads
    if not kinds:
        assert out == data or limit < 1 << 32
    for r, o in zip([r for r in again if r[3] in ("stco", "co64")], found, strict=True):
        assert r[3] == "co64" or max(o, default=0) < limit
    assert all(r[7] == 16 or r[6] < limit for r in again)


def test_nested_removals_lost_chunks_and_several_files(spark):
    boxes = [("a", 1, "moov", 0, 100, 8), ("a", 2, "trak", 8, 50, 8), ("a", 3, "udta", 16, 20, 8), ("a", 4, "stco", 58, 32, 8), ("a", 5, "mdat", 100, 60, 8), ("a", 6, "mdat", 160, 40, 8), ("b", 1, "stco", 0, 20, 8), ("b", 2, "mdat", 20, 30, 8)]
    removed = [("a", 2), ("a", 3), ("a", 6), ("a", 99)]
    chunks = [("a", 4, 0, 108), ("a", 4, 1, 168), ("a", 4, 2, 159), ("b", 1, 0, 28)]
    new, moved, edits = without_boxes(spark.createDataFrame(boxes, "file string, box long, kind string, offset long, size long, header int"), spark.createDataFrame(removed, "file string, box long"), spark.createDataFrame(chunks, "file string, box long, k long, chunk_offset long"), ("file",), span=10)
    assert sorted((r["file"], r["box"], r["new_offset"], r["new_size"]) for r in new.collect()) == [("a", 1, 0, 50), ("a", 4, 8, 32), ("a", 5, 50, 60), ("b", 1, 0, 20), ("b", 2, 20, 30)]
    assert sorted((r["file"], r["k"], r["new_chunk_offset"]) for r in moved.collect()) == [("a", 0, 58), ("a", 1, None), ("a", 2, 109), ("b", 0, 28)]
    assert sorted((r["file"], r["at"], r["delta"]) for r in edits.collect()) == [("a", 58, -50), ("a", 200, -40)]


def test_places_far_apart_make_no_spans_in_small_groups(spark):
    points = spark.createDataFrame([(f, k * 10**9) for f in range(20) for k in range(30)], "file long, at long")
    edits = spark.createDataFrame([(f, k * 10**9, f + 1) for f in range(20) for k in (3, 7)], "file long, at long, delta long")
    for large in (points.select("file").where("false"), points.select("file").where("file = 4").distinct()):
        got = shifted(points, edits, ("file",), "at", 100, large).collect()
        assert sorted(map(tuple, got)) == sorted((f, k * 10**9, (f + 1) * ((k >= 3) + (k >= 7))) for f in range(20) for k in range(30))
