"""MMT signalling: package access messages, package lists, package tables with their assets, MPU times; data units and messages of packets."""

from __future__ import annotations

from collections.abc import Iterator

from ..functions.bits import Bits
from .containers import mmtp_packets

PLT, MPT = 0x80, range(0x11, 0x21)
MPU_TIMESTAMP, MPU_EXTENDED = 0x0001, 0x8026


def _location(r: Bits) -> int | None:
    """A general location; its packet id where it has one."""
    kind = r.u(8)
    if kind == 0:
        return r.u(16)
    if kind == 1:
        r.skip(32 + 32 + 16)
        return r.u(16)
    if kind == 2:
        r.skip(128 + 128 + 16)
        return r.u(16)
    if kind == 3:
        r.skip(16 + 16 + 3)
        return r.u(13)
    if kind == 4:
        r.skip(128 + 128 + 16 + 3)
        return r.u(13)
    if kind == 5:
        r.skip(8 * r.u(8))
    return None


TABLE_ROWS = "message_id int, message_version int, ordinal int, table_id int, version int, body binary"


def pa_tables(message: bytes) -> Iterator[tuple]:
    """Tables of a PA message (id 0), with their headers."""
    if len(message) < 8 or message[:2] != b"\0\0":
        return
    n = message[7]
    at = 8 + 4 * n
    for k in range(n):
        head = message[8 + 4 * k : 12 + 4 * k]
        size = int.from_bytes(head[2:4], "big")
        yield 0, message[2], k, head[0], head[1], message[at : at + size]
        at += size


PACKAGE_ROWS = "package string, packet_id int"


def plt_packages(table: bytes) -> Iterator[tuple]:
    """Packages of a package list table, and the packet id where each one's messages are."""
    if not table or table[0] != PLT:
        return
    r = Bits(table, 32)
    for _ in range(r.u(8)):
        name = r.bytes(r.u(8)).hex()
        yield name, _location(r)


ASSET_ROWS = "package string, ordinal int, asset_id string, asset_type string, packet_id int, clock_relation boolean, descriptors binary"


def mpt_assets(table: bytes) -> Iterator[tuple]:
    """Assets of an MMT package table."""
    if not table or table[0] not in MPT:
        return
    r = Bits(table, 32)
    r.skip(8)
    package = r.bytes(r.u(8)).hex()
    r.skip(8 * r.u(16))
    for k in range(r.u(8)):
        r.skip(8 + 32)
        asset = r.bytes(r.u(8)).hex()
        kind = r.bytes(4).decode("latin-1")
        r.skip(7)
        clock = r.flag()
        if clock:
            r.skip(8 + 7)
            if r.flag():
                r.skip(32)
        ids = [_location(r) for _ in range(r.u(8))]
        yield package, k, asset, kind, next((x for x in ids if x is not None), None), clock, r.bytes(r.u(16))


TIME_ROWS = "mpu_seq long, ntp_sec long, ntp_frac long, timescale long, decode_offset int, offsets array<struct<dts_pts:int,pts:int>>"


def mpu_times(descriptors: bytes) -> Iterator[tuple]:
    """Presentation times of MPUs, completed by the extended descriptor of the same sequence number (the latest wins).

    pts offsets are explicit (type 2), a default (type 1) or zero.
    """
    at, stamps, extended = 0, {}, {}
    while at + 3 <= len(descriptors):
        tag, size = int.from_bytes(descriptors[at : at + 2], "big"), descriptors[at + 2]
        body = descriptors[at + 3 : at + 3 + size]
        at += 3 + size
        if tag == MPU_TIMESTAMP:
            for k in range(0, len(body) - 11, 12):
                seq, sec, frac = (int.from_bytes(body[k + 4 * j : k + 4 * j + 4], "big") for j in range(3))
                stamps.setdefault(seq, (sec, frac))
        elif tag == MPU_EXTENDED:
            r = Bits(body)
            r.skip(5)
            kind, scaled = r.u(2), r.flag()
            scale = r.u(32) if scaled else 90_000
            default = r.u(16) if kind == 1 else 0
            while r.left() >= 64:
                seq = r.u(32)
                r.skip(8)
                decode, n = r.u(16), r.u(8)
                extended[seq] = scale, decode, [{"dts_pts": r.u(16), "pts": r.u(16) if kind == 2 else default} for _ in range(n)]
    for seq, (sec, frac) in stamps.items():
        yield seq, sec, frac, *extended.get(seq, (90_000, None, None))


UNIT_ROWS = "idx long, cid int, packet_id int, seq long, kind string, fragment int, ordinal int, mpu_seq long, movie_fragment long, sample long, offset long, priority int, dependency int, item_id long, data binary"


def mmtp_units(data: bytes) -> Iterator[tuple]:
    """Data units of media fragments and signalling messages, one row each; what an aggregated payload claims beyond its end is left out."""
    for idx, _, cid, _, packet_id, seq, _, payload_type, _, fragment, mpu, at, size in mmtp_packets(data):
        head = idx, cid, packet_id, seq
        if payload_type == 2 and fragment is not None:
            flags = data[at - 2]
            for k, message in enumerate(_parts(data, at, at + size, bool(flags & 1), 4 if flags & 2 else 2)):
                yield *head, "message", fragment, k, *(None,) * 7, message
        elif payload_type == 0 and mpu is not None and data[at - 6] >> 4 == 2:
            timed, aggregated = data[at - 6] & 8, data[at - 6] & 1
            for k, unit in enumerate(_parts(data, at, at + size, bool(aggregated), 2)):
                r = Bits(unit)
                if len(unit) < (14 if timed else 4):
                    break
                fields = (r.u(32), r.u(32), r.u(32), r.u(8), r.u(8), None) if timed else (*(None,) * 5, r.u(32))
                yield *head, "unit", fragment, k, mpu, *fields, unit[r.at >> 3 :]


def _parts(data: bytes, at: int, end: int, aggregated: bool, width: int) -> Iterator[bytes]:
    """The one part of a payload, or each that an aggregated one leads with its length."""
    if not aggregated:
        yield data[at:end]
        return
    while at + width < end:
        size = int.from_bytes(data[at : at + width], "big")
        at += width
        if at + size > end:
            return
        yield data[at : at + size]
        at += size


CA_TABLE, EVENT_TABLE = 0x86, 0x8B
ACCESS_CONTROL, SHORT_EVENT = 0x8004, 0xF001
CA_ROWS = "message_version int, table_version int, ordinal int, tag int, body binary, ca_system_id int, packet_id int"
EVENT_ROWS = "service_id int, version int, section int, stream_id int, network_id int, event_id int, start_mjd int, start_sec int, duration_sec int, running_status int, free_ca boolean, language string, name string, text string"


def si_descriptors(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, body); the tag's range says how wide the length is. One that the bytes don't hold in full ends the list."""
    at = 0
    while at + 3 <= len(data):
        tag = int.from_bytes(data[at : at + 2], "big")
        width = 2 if 0x4000 <= tag < 0x7000 or tag >= 0xF000 else 4 if 0x7000 <= tag < 0x8000 else 1
        start = at + 2 + width
        at = start + int.from_bytes(data[at + 2 : start], "big")
        if at > len(data):
            return
        yield tag, data[start:at]


def ca_descriptors(message: bytes) -> Iterator[tuple]:
    """Descriptors of the conditional-access table in a CA message (id 1)."""
    if len(message) < 9 or message[:2] != b"\0\1" or message[5] != CA_TABLE:
        return
    size = int.from_bytes(message[7:9], "big")
    for k, (tag, body) in enumerate(si_descriptors(message[9 : 9 + size])):
        system = packet = None
        if tag == ACCESS_CONTROL and len(body) >= 3:
            system, packet = int.from_bytes(body[:2], "big"), _location(Bits(body, 16))
        yield message[2], message[6], k, tag, body, system, packet


def _bcd_seconds(value: int) -> int | None:
    """Six decimal digits of hours, minutes and seconds; all ones: unknown."""
    digits = f"{value:06X}"
    return int(digits[:2]) * 3600 + int(digits[2:4]) * 60 + int(digits[4:]) if digits.isdecimal() else None


def events(message: bytes) -> Iterator[tuple]:
    """Events of the event information sections in an M2 section message (id 0x8000), with the first short event descriptor of each."""
    if message[:2] != b"\x80\0":
        return
    at, end = 5, min(len(message), 5 + int.from_bytes(message[3:5], "big"))
    while at + 3 <= end:
        table, size = message[at], int.from_bytes(message[at + 1 : at + 3], "big") & 0xFFF
        section, at = message[at : at + 3 + size], at + 3 + size
        if at > end:
            return
        if table != EVENT_TABLE or size < 15:
            continue
        r = Bits(section[:-4], 24)
        service = r.u(16)
        r.skip(2)
        version = r.u(5)
        r.skip(1)
        number = r.u(8)
        r.skip(8)
        stream, network = r.u(16), r.u(16)
        r.skip(16)
        while r.left() >= 96:
            event, mjd, start, duration, status, free = r.u(16), r.u(16), r.u(24), r.u(24), r.u(3), r.flag()
            language = name = text = None
            for tag, body in si_descriptors(r.bytes(r.u(12))):
                if tag == SHORT_EVENT and len(body) >= 6 and name is None:
                    split = 4 + body[3]
                    language, name = body[:3].decode("latin-1"), body[4:split].decode("utf-8", "replace")
                    text = body[split + 2 : split + 2 + int.from_bytes(body[split : split + 2], "big")].decode("utf-8", "replace")
            known = (mjd, start) != (0xFFFF, 0xFFFFFF)
            yield service, version, number, stream, network, event, mjd if known else None, _bcd_seconds(start), _bcd_seconds(duration), status, free, language, name, text
