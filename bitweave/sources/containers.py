"""Container formats as rows: ISO base media boxes, Matroska elements and blocks, TLV and MMTP packets, AIFF chunks, program streams."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..functions.bits import Bits, extended_float

# -- ISO base media -------------------------------------------------------------

# Boxes that hold boxes, and how many bytes of their own come first.
_BOX_PARENTS = dict.fromkeys("moov trak mdia minf dinf stbl edts udta mvex moof traf mfra skip strk sinf schi ipro iprp ipco hnti hinf gmhd wave".split(), 0) | {"meta": 4, "dref": 8, "stsd": 8} | dict.fromkeys("avc1 avc3 hvc1 hev1 vvc1 vvi1 av01 mp4v encv".split(), 78) | dict.fromkeys("mp4a ac-3 ec-3 enca fLaC Opus".split(), 28)
BOX_ROWS = "node_id long, parent_id long, level int, type string, ordinal long, offset long, size long, header_size int, payload_at long"


def boxes(data: bytes) -> Iterator[tuple]:
    """The box tree, parents before children; ``ordinal`` counts siblings of one type. A box that doesn't fit its parent ends the parent."""
    serial = 0
    open_boxes: list[list] = [[0, len(data), None, 0, {}]]  # next offset, end, node, level, siblings by type
    while open_boxes:
        at, end, parent, level, seen = open_boxes[-1]
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        kind = data[at + 4 : at + 8].decode("latin-1")
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        head += 16 if kind == "uuid" else 0
        if at + 8 > end or size < head or at + size > end:
            open_boxes.pop()
            continue
        ordinal = seen.get(kind, 0)
        seen[kind] = ordinal + 1
        yield serial, parent, level, kind, ordinal, at, size, head, at + head
        open_boxes[-1][0] = at + size
        if kind in _BOX_PARENTS:
            own = _BOX_PARENTS[kind]
            if kind == "meta" and data[at + head + 4 : at + head + 8] == b"hdlr":
                own = 0  # the QuickTime form has no version and flags
            open_boxes.append([at + head + own, at + size, serial, level + 1, {}])
        serial += 1


#: Runs of the sample tables: box type, the row's ordinal in its box, and up to four numbers.
TABLE_ROWS = "node_id long, type string, row long, a long, b long, c long, d long"


def box_tables(data: bytes) -> Iterator[tuple]:
    """Rows of stts, ctts, stsc, stsz, stz2, stco, co64, stss, sdtp, elst and trun boxes.

    A box yields no more rows than its bytes hold, whatever it claims; rows that
    take no bytes (samples of one size) are as many as the file may hold.
    """
    for node, _, _, kind, _, at, size, head, _ in boxes(data):
        body, end = at + head, at + size
        word = lambda k, n=4: int.from_bytes(data[k : k + n], "big")
        signed = lambda k: int.from_bytes(data[k : k + 4], "big", signed=True)
        version = data[body] if body < end else 0

        def claimed(at: int, first: int, row_bits: int) -> range:
            """Rows by the count at ``at``, as far as the box holds them from ``first`` on."""
            if at + 4 > end:  # noqa: B023
                return range(0)
            return range(min(word(at), max(0, end - first) * 8 // row_bits if row_bits else len(data)))  # noqa: B023

        if kind in ("stts", "ctts"):
            for k in claimed(body + 4, body + 8, 64):
                p = body + 8 + 8 * k
                yield node, kind, k, word(p), signed(p + 4) if kind == "ctts" and version else word(p + 4), None, None
        elif kind == "stsc":
            for k in claimed(body + 4, body + 8, 96):
                p = body + 8 + 12 * k
                yield node, kind, k, word(p), word(p + 4), word(p + 8), None
        elif kind == "stsz":
            fixed = word(body + 4)
            for k in claimed(body + 8, body + 12, 0 if fixed else 32):
                yield node, kind, k, fixed or word(body + 12 + 4 * k), None, None, None
        elif kind == "stz2" and body + 12 <= end and data[body + 7] in (4, 8, 16):
            r = Bits(data[body + 12 : end])
            for k in claimed(body + 8, body + 12, data[body + 7]):
                yield node, kind, k, r.u(data[body + 7]), None, None, None
        elif kind in ("stco", "stss", "co64"):
            n = 8 if kind == "co64" else 4
            for k in claimed(body + 4, body + 8, 8 * n):
                yield node, kind, k, word(body + 8 + n * k, n), None, None, None
        elif kind == "sdtp":
            for k in range(body + 4, end):
                yield node, kind, k - body - 4, data[k] >> 6, (data[k] >> 4) & 3, (data[k] >> 2) & 3, data[k] & 3
        elif kind == "elst":
            n = 8 if version else 4
            for k in claimed(body + 4, body + 8, 8 * (2 * n + 4)):
                p = body + 8 + (2 * n + 4) * k
                yield node, kind, k, word(p, n), int.from_bytes(data[p + n : p + 2 * n], "big", signed=True), word(p + 2 * n, 2), None
        elif kind == "trun":
            flags, p = word(body + 1, 3), body + 8
            p += 4 * bool(flags & 1) + 4 * bool(flags & 4)
            for k in claimed(body + 4, p, 32 * (flags >> 8 & 15).bit_count()):
                row = []
                for bit in (0x100, 0x200, 0x400, 0x800):
                    row.append(word(p) if flags & bit else None)
                    p += 4 * bool(flags & bit)
                yield node, kind, k, *row


def length_to_start_code(sample: bytes, length_size: int = 4, lead: bytes = b"") -> bytes:
    """A sample of length-prefixed units as Annex B, with parameter sets in front of it if given."""
    out, at = bytearray(lead), 0
    while at + length_size <= len(sample):
        n = int.from_bytes(sample[at : at + length_size], "big")
        out += b"\x00\x00\x00\x01" + sample[at + length_size : at + length_size + n]
        at += length_size + n
    return bytes(out)


SAMPLE_ROWS = "track int, sample long, chunk long, offset long, size long, dts long, is_key boolean"


def _tracks(data: bytes) -> list[dict]:
    """Per track: its sample tables by box type, its length size and its parameter sets."""
    parents: dict[int, int | None] = {}
    homes: dict[int, dict] = {}
    out: list[dict] = []
    for node, parent, _, kind, _, at, size, _, body in boxes(data):
        parents[node] = parent
        if kind == "trak":
            out.append({"rows": {}, "length_size": 4, "sets": b"", "fixed": 0})
            homes[node] = out[-1]
        elif parent in homes:
            homes[node] = homes[parent]
            if kind == "avcC":
                homes[node]["length_size"], homes[node]["sets"] = _avc_sets(data[body : at + size])
    for node, kind, _, *row in box_tables(data):
        if node in homes:
            homes[node]["rows"].setdefault(kind, []).append(row)
    return out


def _avc_sets(config: bytes) -> tuple[int, bytes]:
    """Length size, and the parameter sets of an avcC box as Annex B."""
    if len(config) < 7:
        return 4, b""
    out, at = b"", 5
    for mask in (31, 255):
        n, at = config[at] & mask if at < len(config) else 0, at + 1
        for _ in range(n):
            size = int.from_bytes(config[at : at + 2], "big")
            out += b"\0\0\0\1" + config[at + 2 : at + 2 + size]
            at += 2 + size
    return (config[4] & 3) + 1, out


def _samples(rows: dict) -> Iterator[tuple]:
    """(sample, chunk, offset, size, dts, is_key) from one track's tables, samples and chunks from 1."""
    sizes = [r[0] for r in rows.get("stsz", rows.get("stz2", []))]
    offsets = [r[0] for r in rows.get("stco", rows.get("co64", []))]
    keys = {r[0] for r in rows["stss"]} if "stss" in rows else None
    runs = sorted((r[0], r[1]) for r in rows.get("stsc", []))
    deltas = iter([(n, d) for n, d, *_ in rows.get("stts", [])])
    left, delta, dts, sample, run = 0, 0, 0, 0, 0
    for chunk, at in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
            run += 1
        for _ in range(runs[run][1] if runs and runs[run][0] <= chunk else 0):
            if sample >= len(sizes):
                return
            while not left:
                left, delta = next(deltas, (len(sizes), delta))
            yield sample + 1, chunk, at, sizes[sample], dts, keys is None or sample + 1 in keys
            at, dts, left, sample = at + sizes[sample], dts + delta, left - 1, sample + 1


def mp4_samples(data: bytes) -> Iterator[tuple]:
    """Every sample of every track of one file."""
    for track, own in enumerate(_tracks(data), 1):
        for sample, chunk, at, size, dts, key in _samples(own["rows"]):
            yield track, sample, chunk, at, size, dts, key


def mp4_track_es(track: int):
    """Parser of one track's elementary stream, a row per sample: H.264 samples as Annex B, parameter sets again before each key sample."""

    def parse(data: bytes) -> Iterator[tuple]:
        tracks = _tracks(data)
        if track > len(tracks):
            return
        own = tracks[track - 1]
        for sample, _, at, size, _, key in _samples(own["rows"]):
            body = data[at : at + size]
            yield sample, length_to_start_code(body, own["length_size"], own["sets"] if key else b"") if own["sets"] else body

    return parse


ES_ROWS = "sample long, es binary"


def mkv_track_es(track: int):
    """Parser of one Matroska track's elementary stream, a row per frame: H.264 frames as Annex B, parameter sets before key frames; others as they are."""

    def parse(data: bytes) -> Iterator[tuple]:
        size, sets, mine = 4, b"", False
        for _, _, _, kind, _, _, _, _, _, at, n, value in ebml(data):
            if kind == 0xAE:
                mine = False
            elif kind == 0xD7:
                mine = value == str(track)
            elif kind == 0x63A2 and mine and data[at : at + 1] == b"\1":
                size, sets = _avc_sets(data[at : at + n])
        for k, row in enumerate(r for r in blocks(data) if r[0] == track):
            body = data[row[9] : row[9] + row[10]]
            yield k + 1, length_to_start_code(body, size, sets if row[5] else b"") if sets else body

    return parse


# -- Matroska -------------------------------------------------------------------

# Master elements (id: name) and the named leaves that queries use.
_MASTERS = {0x1A45DFA3: "EBML", 0x18538067: "Segment", 0x114D9B74: "SeekHead", 0x4DBB: "Seek", 0x1549A966: "Info", 0x1F43B675: "Cluster", 0xA0: "BlockGroup", 0x75A1: "BlockAdditions", 0xA6: "BlockMore", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0xE0: "Video", 0xE1: "Audio", 0x55B0: "Colour", 0x6D80: "ContentEncodings", 0x6240: "ContentEncoding", 0x5034: "ContentCompression", 0x1C53BB6B: "Cues", 0xBB: "CuePoint", 0xB7: "CueTrackPositions", 0x1941A469: "Attachments", 0x61A7: "AttachedFile", 0x1043A770: "Chapters", 0x45B9: "EditionEntry", 0xB6: "ChapterAtom", 0x80: "ChapterDisplay", 0x1254C367: "Tags", 0x7373: "Tag", 0x63C0: "Targets", 0x67C8: "SimpleTag"}
_LEAVES = {0x4286: ("EBMLVersion", "uint"), 0x4282: ("DocType", "ascii"), 0x4287: ("DocTypeVersion", "uint"), 0x2AD7B1: ("TimestampScale", "uint"), 0x4489: ("Duration", "float"), 0x4461: ("DateUTC", "date"), 0x7BA9: ("Title", "utf8"), 0x4D80: ("MuxingApp", "utf8"), 0x5741: ("WritingApp", "utf8"), 0xE7: ("Timestamp", "uint"), 0xA3: ("SimpleBlock", "binary"), 0xA1: ("Block", "binary"), 0x9B: ("BlockDuration", "uint"), 0xD7: ("TrackNumber", "uint"), 0x73C5: ("TrackUID", "uint"), 0x83: ("TrackType", "uint"), 0x86: ("CodecID", "ascii"), 0x63A2: ("CodecPrivate", "binary"), 0x22B59C: ("Language", "ascii"), 0xB0: ("PixelWidth", "uint"), 0xBA: ("PixelHeight", "uint"), 0xB5: ("SamplingFrequency", "float"), 0x9F: ("Channels", "uint"), 0xEC: ("Void", "binary"), 0xBF: ("CRC-32", "binary"), 0x23E383: ("DefaultDuration", "uint"), 0xFB: ("ReferenceBlock", "int")}
EBML_ROWS = "node_id long, parent_id long, level int, ebml_id long, name string, data_type string, ordinal long, offset long, size long, payload_at long, payload_size long, value string"
_TOP = frozenset({0x1A45DFA3, 0x18538067})
_LEVEL_1 = frozenset({0x114D9B74, 0x1549A966, 0x1F43B675, 0x1654AE6B, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367})


def ebml(data: bytes) -> Iterator[tuple]:
    """The element tree, parents before children; elements of unknown size end where their kind of sibling begins.

    Rows wait only while an element of unknown size is open above them.
    """
    serial, unknown = 0, 0
    rows: list[list] = []
    # next offset, end, node, level, kinds that end it, siblings by kind, and of an element of unknown size its row
    open_elements: list[list] = [[0, len(data), None, 0, frozenset(), {}, None]]
    while open_elements:
        at, end, parent, level, stop, seen, waiting = open_elements[-1]
        kind = size = None
        if at < end:
            r = Bits(data, at * 8)
            try:
                kind, size = r.vint(keep_marker=True), r.vint()
            except EOFError:
                kind = None
        if kind is None or kind in stop:
            open_elements.pop()
            if waiting is not None:
                waiting[8], waiting[10] = at - waiting[7], at - waiting[9]
                open_elements[-1][0] = at
                unknown -= 1
        else:
            body = r.at >> 3
            last = end if size is None else min(end, body + size)
            name, form = (_MASTERS[kind], "master") if kind in _MASTERS else _LEAVES.get(kind, ("unknown", "binary"))
            ordinal = seen.get(kind, 0)
            seen[kind] = ordinal + 1
            rows.append([serial, parent, level, kind, name, form, ordinal, at, last - at, body, last - body, None if form == "master" else _value(form, data[body:last])])
            open_elements[-1][0] = last
            if form == "master":
                # an open element is closed by the next one of its level
                ends = stop if size is not None else _TOP if level == 0 else _TOP | _LEVEL_1
                open_elements.append([body, last, serial, level + 1, ends, {}, rows[-1] if size is None else None])
                unknown += size is None
            serial += 1
        if not unknown:
            yield from map(tuple, rows)
            rows = []


def _value(form: str, data: bytes) -> str | None:
    if form == "uint":
        return str(int.from_bytes(data, "big"))
    if form in ("int", "date"):
        return str(int.from_bytes(data, "big", signed=True))
    if form == "float":
        import struct

        return repr(struct.unpack(">f" if len(data) == 4 else ">d", data)[0]) if len(data) in (4, 8) else "0.0"
    return data.rstrip(b"\0").decode("utf-8", "replace") if form in ("ascii", "utf8") else None


BLOCK_ROWS = "track long, cluster long, block long, frame long, time_code long, is_key boolean, invisible boolean, discardable boolean, lacing int, offset long, size long"


def blocks(data: bytes) -> Iterator[tuple]:
    """Frames of every block; the last frame of a lace is what is left, headers not counted."""
    cluster, block = -1, 0
    for _, _, _, kind, _, _, _, _, _, at, size, _ in ebml(data):
        if kind == 0x1F43B675:
            cluster, block = cluster + 1, 0
        if kind not in (0xA3, 0xA1):
            continue
        r = Bits(data, at * 8)
        track, time, flags = r.vint(), r.s(16), r.u(8)
        lacing, sizes = (flags >> 1) & 3, []
        if lacing:
            n = r.u(8) + 1
            if lacing == 1:
                for _ in range(n - 1):
                    total = 0
                    while (x := r.u(8)) == 255:
                        total += 255
                    sizes.append(total + x)
            elif lacing == 3:
                sizes.append(r.vint())
                for _ in range(n - 2):
                    start = r.at
                    raw = r.vint()
                    bits = 7 * ((r.at - start) // 8)
                    sizes.append(sizes[-1] + raw - ((1 << (bits - 1)) - 1))
                sizes = sizes[: n - 1]
            left = at + size - (r.at >> 3)
            sizes = [left // n] * n if lacing == 2 else [*sizes, left - sum(sizes)]
        else:
            sizes = [at + size - (r.at >> 3)]
        p, simple = r.at >> 3, kind == 0xA3
        for k, x in enumerate(sizes):
            yield track, cluster, block, k, time, bool(flags & 0x80) if simple else None, bool(flags & 8), bool(flags & 1) if simple else None, lacing, p, x
            p += x
        block += 1


# -- TLV and MMT ------------------------------------------------------------------

TLV_TYPES = {0x01: "IPv4", 0x02: "IPv6", 0x03: "HeaderCompressedIP", 0xFE: "Signalling", 0xFF: "Null"}
TLV_ROWS = "idx long, byte_off long, type int, name string, len long, skipped long"
MOST_SYNC_TRIES = 10


def tlv_packets(data: bytes) -> Iterator[tuple]:
    """Packets from 0x7F on; bytes that don't fit are skipped one at a time."""
    at, n, skipped = 0, 0, 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at] != 0x7F or data[at + 1] not in TLV_TYPES or at + 4 + size > len(data):
            at, skipped = at + 1, skipped + 1
            continue
        yield n, at, data[at + 1], TLV_TYPES[data[at + 1]], size, skipped
        at, n, skipped = at + 4 + size, n + 1, 0


MMTP_ROWS = "idx long, byte_off long, cid int, sn int, packet_id int, seq long, timestamp long, payload_type int, rap boolean, fragment int, mpu_seq long, payload_at long, payload_len long"


def mmtp_packets(data: bytes) -> Iterator[tuple]:
    """MMTP packets inside header-compressed IP: the context id, the packet's fields, and, of an MPU or a message, how it is fragmented."""
    for n, at, kind, _, size, _ in tlv_packets(data):
        if kind != 0x03 or size < 3:
            continue
        body, end = at + 4, at + 4 + size
        cid, sn, header = int.from_bytes(data[body : body + 2], "big") >> 4, data[body + 1] & 15, data[body + 2]
        p = body + 3 + {0x20: 16, 0x21: 0, 0x60: 42, 0x61: 0}.get(header, 0)
        if p + 12 > end:
            continue
        r = Bits(data[:end], p * 8)
        r.skip(2)
        counter, _fec, _x, extension, rap = r.flag(), r.u(2), r.u(1), r.flag(), r.flag()
        r.skip(2)
        payload_type, packet_id, stamp, seq = r.u(6), r.u(16), r.u(32), r.u(32)
        if counter:
            r.skip(32)
        if extension:
            r.skip(16)
            r.skip(8 * r.u(16))
        fragment = mpu = None
        q = r.at >> 3
        if payload_type == 0 and r.left() >= 64:
            r.skip(16 + 4 + 1)
            fragment = r.u(2)
            r.skip(1 + 8)
            mpu = r.u(32)
            q = r.at >> 3
        elif payload_type == 2 and r.left() >= 16:
            fragment = r.u(2)
            r.skip(6 + 8)
            q = r.at >> 3
        yield n, at, cid, sn, packet_id, seq, stamp, payload_type, rap, fragment, mpu, q, end - q


ASSET_ES_ROWS = "seq long, payload binary"


def mmt_asset(cid: int, packet_id: int):
    """Parser of the payloads of one asset, in order of arrival."""

    def parse(data: bytes) -> Iterator[tuple]:
        for row in mmtp_packets(data):
            if row[2] == cid and row[4] == packet_id:
                yield row[5], data[row[11] : row[11] + row[12]]

    return parse


NTP_ROWS = "idx long, ntp_sec long, ntp_frac long, hop_limit int, origin_sec long, origin_frac long"


def ntp_packets(data: bytes) -> Iterator[tuple]:
    """Transmit and origin times of NTP over IPv6: hop limit 0x11 or 0x20, UDP 456 or 123 to 123."""
    for n, at, kind, _, size, _ in tlv_packets(data):
        b = at + 4
        if kind == 0x02 and size >= 96 and data[b + 6] == 17 and data[b + 7] in (0x11, 0x20) and int.from_bytes(data[b + 42 : b + 44], "big") == 123:
            origin, sent = (struct.unpack_from(">II", data, b + 48 + k) for k in (24, 40))
            yield n, *sent, data[b + 7], *origin


# -- AIFF -------------------------------------------------------------------------

AIFF_ROWS = "id string, offset long, size long, channels int, frames long, sample_size int, sample_rate double, text string"


def aiff_chunks(data: bytes) -> Iterator[tuple]:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        return
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 8 : at + 8 + size]
        common = (int.from_bytes(body[:2], "big"), int.from_bytes(body[2:6], "big"), int.from_bytes(body[6:8], "big"), extended_float(body[8:18])) if kind == "COMM" and size >= 18 else (None,) * 4
        yield kind, at, size, *common, body.decode("latin-1") if kind in ("NAME", "AUTH", "(c) ", "ANNO") else None
        at += 8 + size + (size & 1)


AIFF_FIELD_ROWS = "chunk string, ordinal int, field string, number long, text string"
_NOTES = ["base_note", "detune", "low_note", "high_note", "low_velocity", "high_velocity"]
_LOOPS = [f"{loop}_{name}" for loop in ("sustain", "release") for name in ("mode", "begin", "end")]


def _signed(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


def aiff_fields(data: bytes) -> Iterator[tuple]:
    """Fields of format version, compression, sound data, marker, comment and instrument chunks; ordinal counts markers and comments.

    An entry that its chunk doesn't hold in full is left out.
    """
    for kind, at, size, *_ in aiff_chunks(data):
        body = data[at + 8 : at + 8 + size]
        number = lambda a, n: int.from_bytes(body[a : a + n], "big")  # noqa: E731, B023
        if kind == "FVER" and len(body) >= 4:
            yield kind, 0, "timestamp", number(0, 4), None
        elif kind == "COMM" and len(body) >= 23:
            yield kind, 0, "compression", None, body[18:22].decode("latin-1")
            yield kind, 0, "compression_name", None, body[23 : 23 + body[22]].decode("latin-1")
        elif kind == "SSND" and len(body) >= 8:
            yield kind, 0, "offset", number(0, 4), None
            yield kind, 0, "block_size", number(4, 4), None
        elif kind in ("MARK", "COMT") and len(body) >= 2:
            p = 2
            for k in range(number(0, 2)):
                head, length = (p + 7, number(p + 6, 1)) if kind == "MARK" else (p + 8, number(p + 6, 2))
                if head + length > len(body):
                    break
                if kind == "MARK":
                    fields, p = (("id", _signed(body[p : p + 2])), ("position", number(p + 2, 4))), head + length + (length + 1) % 2
                else:
                    fields, p = (("time", number(p, 4)), ("marker", _signed(body[p + 4 : p + 6]))), head + length + length % 2
                for name, value in fields:
                    yield kind, k, name, value, None
                yield kind, k, "text", None, body[head : head + length].decode("latin-1")
        elif kind == "INST" and len(body) >= 20:
            for k, name in enumerate(_NOTES):
                yield kind, 0, name, _signed(body[k : k + 1]), None
            for k, name in enumerate(["gain", *_LOOPS]):
                yield kind, 0, name, _signed(body[6 + 2 * k : 8 + 2 * k]), None


# -- program streams ----------------------------------------------------------------

PS_ROWS = "unit long, stream_id int, byte_off long, byte_len long, scr27 long, pts90 long, dts90 long, sub_stream int, payload_at long, payload_len long"


def _stamp(b: bytes) -> int:
    return ((b[0] >> 1) & 7) << 30 | (int.from_bytes(b[1:3], "big") >> 1) << 15 | int.from_bytes(b[3:5], "big") >> 1


def program_stream(data: bytes) -> Iterator[tuple]:
    """Packs, system headers and PES packets by start code."""
    at, n = 0, 0
    while (at := data.find(b"\x00\x00\x01", at)) >= 0 and at + 4 <= len(data):
        sid = data[at + 3]
        scr = pts = dts = sub = None
        if sid == 0xBA and at + 14 <= len(data) and data[at + 4] >> 6 == 1:
            v = int.from_bytes(data[at + 4 : at + 10], "big")
            base = ((v >> 43) & 7) << 30 | ((v >> 27) & 0x7FFF) << 15 | (v >> 11) & 0x7FFF
            scr = base * 300 + ((v >> 1) & 0x1FF)
            size, start = 14 + (data[at + 13] & 7), 0
        elif sid == 0xB9:
            size, start = 4, 0
        elif sid >= 0xBB:
            size = 6 + int.from_bytes(data[at + 4 : at + 6], "big")
            start = at + 6
            if sid not in (0xBB, 0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF, 0xF2, 0xF8) and at + 9 <= len(data) and data[at + 6] >> 6 == 2:
                flags = data[at + 7] >> 6
                start = at + 9 + data[at + 8]
                pts = _stamp(data[at + 9 : at + 14]) if flags & 2 else None
                dts = _stamp(data[at + 14 : at + 19]) if flags == 3 else None
            sub = data[start] if sid == 0xBD and start < len(data) else None
        else:
            at += 3
            continue
        end = min(len(data), at + size)
        yield n, sid, at, end - at, scr, pts, dts, sub, start, max(0, end - start) if start else 0
        at, n = end, n + 1
