"""Program tables and PES units: reassembly of sections and payload units from packets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crc import crc, crc_hex
from ..sources.blobs import parse_blobs
from .ordered import with_running_sum
from .packets import pid_name
from .shared import written

SECTIONS = "pkt_idx long, pid int, table_id int, extension int, version int, current boolean, section_number int, last_section int, crc_ok boolean, body binary"


def _sections(rows: list[tuple[int, bool, bytes, bool]], pid: int) -> Iterator[tuple]:
    """Sections of one PID from (packet, starts a unit, payload, only ends what came before): a section ends where its length says, stuffing is 0xFF."""
    held = bytearray()

    def drain(idx: int) -> Iterator[tuple]:
        nonlocal held
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if size - 3 > (4093 if 0x38 <= held[0] <= 0x3F or 0x40 <= held[0] <= 0xFE else 1021):
                held = bytearray()
                return
            if len(held) < size:
                return
            s = bytes(held[:size])
            held = held[size:]
            if size >= 12:
                yield idx, pid, s[0], s[3] << 8 | s[4], (s[5] >> 1) & 31, bool(s[5] & 1), s[6], s[7], crc(s, "crc-32-mpeg") == 0, s[8:-4]
        if held and held[0] == 0xFF:
            held = bytearray()

    for idx, start, payload, tail in rows:
        if start:
            pointer = payload[0] if payload else 0
            if held:
                held += payload[1 : 1 + pointer]
                yield from drain(idx)
            if tail:
                return
            held = bytearray(payload[1 + pointer :])
        elif held:
            held += payload
        yield from drain(idx)


UNITS = 1024


def _stretches(rows: DataFrame, lead: bool) -> DataFrame:
    """Rows of table PIDs with ``stretch``, which holds ``UNITS`` units of a PID, and ``context``: rows of the neighbours that a stretch needs, too.

    Those are the packet that starts the next stretch, which may end this one's
    last section, and, if ``lead``, the last unit before.
    """
    rows = with_running_sum(rows, {"unit": F.col("pusi").cast("int")}, "pkt_idx", ("pid",)).where("unit > 0")
    own, place = F.floor(F.col("unit") / UNITS).cast("bigint"), F.col("unit") % UNITS
    to = lambda k, context: F.struct((own + k).alias("stretch"), F.lit(context).alias("context"))
    homes = [to(0, False), F.when(F.col("pusi") & (place == 0), to(-1, True)), *([F.when(place == UNITS - 1, to(1, True))] if lead else [])]
    return rows.select("*", F.explode(F.array_compact(F.array(*homes))).alias("_home")).select("*", "_home.stretch", "_home.context").drop("_home", "unit")


def sections(packets: DataFrame, pids: list[int]) -> DataFrame:
    """Sections of some table PIDs, a stretch of each PID at a time."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pkt_idx")
        pid = table.column("pid")[0].as_py()
        rows = list(_sections(list(zip(*(table.column(c).to_pylist() for c in ("pkt_idx", "pusi", "payload", "context")), strict=True)), pid))
        names = [x.split()[0] for x in SECTIONS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})

    chosen = packets.where(F.col("pid").isin(*pids) & (F.col("afc").bitwiseAND(F.lit(1)) > 0))
    chosen = chosen.select("pkt_idx", "pid", "pusi", F.expr("substring(raw, payload_at + 1)").alias("payload"))
    return _stretches(chosen, False).groupBy("pid", "stretch").applyInArrow(run, SECTIONS)


def _pat(body: bytes) -> Iterator[tuple]:
    for k in range(0, len(body) - 3, 4):
        yield body[k] << 8 | body[k + 1], (body[k + 2] & 31) << 8 | body[k + 3]


def _pmt(body: bytes) -> Iterator[tuple]:
    pcr = (body[0] & 31) << 8 | body[1]
    at = 4 + ((body[2] & 15) << 8 | body[3])
    while at + 5 <= len(body):
        n = (body[at + 3] & 15) << 8 | body[at + 4]
        yield pcr, (body[at + 1] & 31) << 8 | body[at + 2], body[at], body[at + 5 : at + 5 + n]
        at += 5 + n


def _descriptors(loop: bytes) -> Iterator[tuple]:
    at, k = 0, 0
    while at + 2 <= len(loop):
        yield k, loop[at], loop[at + 1], loop[at + 2 : at + 2 + loop[at + 1]]
        at, k = at + 2 + loop[at + 1], k + 1


def _in_force(found: DataFrame, table_id: int) -> DataFrame:
    """Sections that count: right table, current, and whole."""
    return found.where((F.col("table_id") == table_id) & F.col("current") & F.col("crc_ok"))


def pat_entries(found: DataFrame) -> DataFrame:
    return parse_blobs(_in_force(found, 0), _pat, "program_number int, pmt_pid int", ("pkt_idx", "version"), "body")


def pmt_streams(found: DataFrame) -> DataFrame:
    return parse_blobs(_in_force(found, 2).withColumnRenamed("pid", "pmt_pid").withColumnRenamed("extension", "program_number"), _pmt, "pcr_pid int, es_pid int, stream_type int, descriptors binary", ("pkt_idx", "version", "pmt_pid", "program_number"), "body")


def descriptors(streams: DataFrame) -> DataFrame:
    return parse_blobs(streams, _descriptors, "ordinal int, tag int, length int, content binary", ("pmt_pid", "es_pid"), "descriptors")


def table_descriptors(found: DataFrame, table_id: int) -> DataFrame:
    """Descriptors of conditional access (1) and stream description (3) tables: pkt_idx, version, ordinal, tag, length, content."""
    return parse_blobs(_in_force(found, table_id), _descriptors, "ordinal int, tag int, length int, content binary", ("pkt_idx", "version"), "body")


def _sit(body: bytes) -> Iterator[tuple]:
    at = 2 + ((body[0] & 15) << 8 | body[1])
    yield None, None, body[2:at]
    while at + 4 <= len(body):
        n = (body[at + 2] & 15) << 8 | body[at + 3]
        yield body[at] << 8 | body[at + 1], (body[at + 2] >> 4) & 7, body[at + 4 : at + 4 + n]
        at += 4 + n


def sit_services(found: DataFrame) -> DataFrame:
    """Services of selection information tables; the first row of a section, without a service, holds the transmission's descriptors."""
    return parse_blobs(_in_force(found, 0x7F), _sit, "service_id int, running_status int, descriptors binary", ("pkt_idx", "version"), "body")


def pid_report(packets: DataFrame, found: DataFrame) -> DataFrame:
    """Every PID with its packets and units, the stream types that any PMT gives it, whether it carries a PCR or a PMT, and its use."""
    counts = packets.groupBy("pid").agg(F.count(F.lit(1)).alias("n_packets"), F.sum(F.col("pusi").cast("int")).alias("n_units"))
    streams = pmt_streams(found)
    types = streams.groupBy(F.col("es_pid").alias("pid")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("stream_type")), lambda x: F.concat(F.lit("0x"), F.lpad(F.hex(x), 2, "0"))), ",").alias("stream_types"))
    marked = streams.select(F.col("pcr_pid").alias("pid"), F.lit("pcr").alias("mark")).unionByName(pat_entries(found).select(F.col("pmt_pid").alias("pid"), F.lit("pmt").alias("mark")))
    marks = marked.groupBy("pid").agg(F.max(F.col("mark") == "pcr").alias("is_pcr"), F.max(F.col("mark") == "pmt").alias("is_pmt"))
    out = counts.join(types, "pid", "left").join(marks, "pid", "left")
    is_pcr, is_pmt = F.coalesce("is_pcr", F.lit(False)), F.coalesce("is_pmt", F.lit(False))
    use = F.coalesce(pid_name(F.col("pid")), F.when(is_pmt, "PMT"), F.when(F.col("stream_types").isNotNull(), "ES"), F.when(is_pcr, "PCR"), F.lit("other"))
    return out.select("pid", "n_packets", "n_units", "stream_types", is_pcr.alias("is_pcr"), is_pmt.alias("is_pmt"), use.alias("use"))


def pack_sections(tables: DataFrame) -> DataFrame:
    """tables (place, pid, table_id, extension, version, body BINARY): pkt_idx, raw of 188-byte packets; a table's first packet is number 64 * place."""
    digits = lambda x, n: F.lpad(F.hex(x.cast("bigint")), n, "0")
    head = F.concat(digits(F.col("table_id"), 2), digits(F.length("body") + 0xB009, 4), digits(F.col("extension"), 4), digits(F.col("version") * 2 + 0xC1, 2), F.lit("0000"), F.hex("body"))
    rows = tables.select("place", "pid", head.alias("_head"))
    rows = rows.select("place", "pid", F.concat(F.lit("00"), F.col("_head"), crc_hex(F.unhex("_head"), "crc-32-mpeg")).alias("_data"))
    parts = rows.select("place", "pid", F.posexplode(F.regexp_extract_all("_data", F.lit(".{1,368}"), F.lit(0))).alias("k", "part"))
    start = F.when(F.col("k") == 0, 0x4000).otherwise(0)
    raw = F.concat(F.lit("47"), digits(F.col("pid") + start, 4), digits(F.col("k") % 16 + 16, 2), F.rpad("part", 368, "F"))
    return parts.select((F.col("place") * 64 + F.col("k")).cast("bigint").alias("pkt_idx"), F.unhex(raw).alias("raw"))


def make_section(table_id: int, extension: int, body: bytes, version: int = 0) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + bytes([0xC1 | version << 1, 0, 0]) + body
    return head + crc(head, "crc-32-mpeg").to_bytes(4, "big")


def section_packets(section: bytes, pid: int) -> list[bytes]:
    """188-byte packets of one section."""
    data, out = b"\0" + section, []
    for k in range(0, len(data), 184):
        start = 0x40 if not k else 0
        out.append(bytes([0x47, start | pid >> 8, pid & 255, 0x10 | len(out) & 15]) + data[k : k + 184].ljust(184, b"\xff"))
    return out


PES = "stream_id int, pts90 long, dts90 long, header_len int, es binary, stream_id_extension int"


def _stream_id_extension(data: bytes, end: int) -> int | None:
    """Of a PES header that ends at end: the fields before the extension are skipped by their flags."""
    flags = data[7]
    if not flags & 1:
        return None
    at = 9 + (0, 0, 5, 10)[flags >> 6] + sum(size for bit, size in ((0x20, 6), (0x10, 3), (0x08, 1), (0x04, 1), (0x02, 2)) if flags & bit)
    head = data[:end]
    if at >= len(head):
        return None
    extension, at = head[at], at + 1
    at += 16 if extension & 0x80 else 0
    if extension & 0x40 and at < len(head):
        at += 1 + head[at]
    at += (2 if extension & 0x20 else 0) + (2 if extension & 0x10 else 0)
    if not extension & 1 or at + 1 >= len(head) or not head[at] & 127 or head[at + 1] & 128:
        return None
    return head[at + 1] & 127


def _pes(data: bytes) -> Iterator[tuple]:
    if data[:3] != b"\0\0\1":
        return
    sid, size = data[3], int.from_bytes(data[4:6], "big")
    end = 6 + size if size else len(data)
    if sid in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF, 0xF2, 0xF8):
        yield sid, None, None, 6, data[6:end], None
        return
    flags, body = data[7] >> 6, 9 + data[8]
    stamp = lambda b: ((b[0] >> 1) & 7) << 30 | (int.from_bytes(b[1:3], "big") >> 1) << 15 | int.from_bytes(b[3:5], "big") >> 1
    pts = stamp(data[9:14]) if flags & 2 and data[9] >> 4 == flags else None
    dts = stamp(data[14:19]) if flags == 3 and pts is not None else None
    yield sid, pts, dts, body, data[body:end], _stream_id_extension(data, body)


def pes_units(packets: DataFrame, pids: list[int] | None = None, stream_id: int | None = None, stream_id_extension: int | None = None) -> DataFrame:
    """pid, unit, first_pkt, last_pkt and the PES fields with the elementary stream of each unit; packets before a PID's first unit are dropped.

    A unit without stream_id_extension matches any that is asked for.
    """
    rows = packets.where(F.col("pid").isin(*pids)) if pids else packets
    rows = rows.where(F.col("afc").bitwiseAND(F.lit(1)) > 0).select("pkt_idx", "pid", "pusi", F.expr("substring(raw, payload_at + 1)").alias("payload"))
    rows = with_running_sum(rows, {"unit": F.col("pusi").cast("int")}, "pkt_idx", ("pid",)).where("unit > 0")
    units = rows.groupBy("pid", "unit").agg(F.min("pkt_idx").alias("first_pkt"), F.max("pkt_idx").alias("last_pkt"), F.array_sort(F.collect_list(F.struct("pkt_idx", F.hex("payload").alias("payload")))).alias("parts"))
    units = units.withColumn("data", F.unhex(F.array_join(F.transform("parts", lambda p: p["payload"]), "")))  # joined once: a unit costs its length
    found = parse_blobs(units, _pes, PES, ("pid", "unit", "first_pkt", "last_pkt"))
    if stream_id is not None:
        found = found.where(F.col("stream_id") == stream_id)
    if stream_id_extension is not None:
        found = found.where(F.coalesce(F.col("stream_id_extension") == stream_id_extension, F.lit(True)))
    return found


def _patch(section: bytearray, mapping: dict[int, int]) -> bool:
    """Replaces PIDs inside a PAT or PMT section and renews its checksum; False if nothing changes."""
    before = bytes(section)

    def put(at: int) -> None:
        pid = (section[at] & 31) << 8 | section[at + 1]
        if pid in mapping:
            section[at] = section[at] & 0xE0 | mapping[pid] >> 8
            section[at + 1] = mapping[pid] & 255

    if section[0] == 0:
        for k in range(8, len(section) - 7, 4):
            put(k + 2)
    elif section[0] == 2:
        put(8)
        at = 12 + ((section[10] & 15) << 8 | section[11])
        while at + 5 <= len(section) - 4:
            put(at + 1)
            at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
    if bytes(section) == before:
        return False
    section[-4:] = crc(bytes(section[:-4]), "crc-32-mpeg").to_bytes(4, "big")
    return True


def _rewrite(rows: list[tuple[int, bool, int, bytes]], mapping: dict[int, int]) -> list[tuple[int, bytes]]:
    """Packets of one table PID with the PIDs in their sections replaced, sections over several packets included."""
    data, owner, out = bytearray(), [], [bytearray(raw) for _, _, _, raw in rows]

    def flush() -> None:
        at = 0
        while at + 3 <= len(data) and data[at] != 0xFF:
            size = 3 + ((data[at + 1] & 15) << 8 | data[at + 2])
            if at + size > len(data):
                break
            section = bytearray(data[at : at + size])
            if size >= 12 and crc(bytes(section), "crc-32-mpeg") == 0 and _patch(section, mapping):
                for byte, (row, where) in zip(section, owner[at : at + size], strict=True):
                    out[row][where] = byte
            at += size

    for k, (_, start, at, raw) in enumerate(rows):
        begin = at
        if start:
            begin = at + 1 + raw[at]
            data.extend(raw[at + 1 : begin])
            owner.extend((k, x) for x in range(at + 1, begin))
            flush()
            data, owner = bytearray(), []
        data.extend(raw[begin:])
        owner.extend((k, x) for x in range(begin, len(raw)))
    flush()
    return [(idx, bytes(x)) for (idx, *_), x in zip(rows, out, strict=True)]


def remap_tables(packets: DataFrame, table_pids: list[int], mapping: dict[int, int]) -> DataFrame:
    """pkt_idx, raw of parsed packets without suffix: PIDs are replaced inside the sections of the table PIDs. Headers are not touched."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pkt_idx")
        rows = list(zip(*(table.column(c).to_pylist() for c in ("pkt_idx", "pusi", "payload_at", "raw")), strict=True))
        found = [x for x, context in zip(_rewrite(rows, mapping), table.column("context").to_pylist(), strict=True) if not context]
        return pa.table({"pkt_idx": pa.array([x for x, _ in found], pa.int64()), "raw": pa.array([x for _, x in found], pa.binary())})

    tables = F.col("pid").isin(*table_pids) & (F.col("afc").bitwiseAND(F.lit(1)) > 0)
    chosen = written(with_running_sum(packets.where(tables).select("pid", "pkt_idx", "pusi", "payload_at", "raw"), {"_unit": F.col("pusi").cast("int")}, "pkt_idx", ("pid",)))
    changed = _stretches(chosen.where("_unit > 0").drop("_unit"), True).groupBy("pid", "stretch").applyInArrow(run, "pkt_idx long, raw binary")
    return packets.where(~tables).select("pkt_idx", "raw").unionByName(chosen.where("_unit = 0").select("pkt_idx", "raw")).unionByName(changed)
