"""Elementary video streams: units of H.264, H.265, H.266, MPEG-2 video and AV1, their headers and parameter sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.bits import Bits, unescape_nal

# Short names of NAL unit types (ITU-T H.264 table 7-1, H.265 table 7-1, H.266 table 5).
AVC = {1: "non-IDR", 2: "A", 3: "B", 4: "C", 5: "IDR", 6: "SEI", 7: "SPS", 8: "PPS", 9: "AUD", 10: "EOS", 11: "EOB", 12: "FD", 13: "SPS_EXT", 14: "PREFIX_NU", 15: "SUBSET_SPS", 16: "DPS", 19: "SL_AUX", 20: "SL_EXT", 21: "SL_EXT_DVC"}
HEVC = dict(enumerate("TRAIL_N TRAIL_R TSA_N TSA_R STSA_N STSA_R RADL_N RADL_R RASL_N RASL_R".split())) | {16: "BLA_W_LP", 17: "BLA_W_RADL", 18: "BLA_N_LP", 19: "IDR_W_RADL", 20: "IDR_N_LP", 21: "CRA_NUT", 32: "VPS_NUT", 33: "SPS_NUT", 34: "PPS_NUT", 35: "AUD_NUT", 36: "EOS_NUT", 37: "EOB_NUT", 38: "FD_NUT", 39: "PREFIX_SEI_NUT", 40: "SUFFIX_SEI_NUT"}
VVC = dict(enumerate("TRAIL_NUT STSA_NUT RADL_NUT RASL_NUT".split())) | {7: "IDR_W_RADL", 8: "IDR_N_LP", 9: "CRA_NUT", 10: "GDR_NUT", 12: "OPI_NUT", 13: "DCI_NUT", 14: "VPS_NUT", 15: "SPS_NUT", 16: "PPS_NUT", 17: "PREFIX_APS_NUT", 18: "SUFFIX_APS_NUT", 19: "PH_NUT", 20: "AUD_NUT", 21: "EOS_NUT", 22: "EOB_NUT", 23: "PREFIX_SEI_NUT", 24: "SUFFIX_SEI_NUT", 25: "FD_NUT"}
NAMES = {"avc": AVC, "hevc": HEVC, "vvc": VVC}
OBU = {1: "Sequence header", 2: "Temporal delimiter", 3: "Frame header", 4: "Tile group", 5: "Metadata", 6: "Frame", 7: "Redundant frame header", 8: "Tile list", 15: "Padding"}
SEI = dict(enumerate("buffering_period pic_timing pan_scan_rect filler_payload user_data_registered_itu_t_t35 user_data_unregistered recovery_point dec_ref_pic_marking_repetition spare_pic scene_info".split())) | {19: "film_grain_characteristics", 45: "frame_packing_arrangement", 47: "display_orientation", 128: "structure_of_pictures_info", 129: "active_parameter_sets", 130: "decoding_unit_info", 132: "decoded_picture_hash", 136: "time_code", 137: "mastering_display_colour_volume", 144: "content_light_level_info", 147: "alternative_transfer_characteristics"}

_START = re.compile(rb"\x00\x00\x01")


def nal_bounds(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit between start codes of three or four bytes; trailing zeros belong to none."""
    starts = [m.end() for m in _START.finditer(data)]
    for a, b in zip(starts, [*(s - 3 for s in starts[1:]), len(data)], strict=False):
        while b > a and not data[b - 1]:
            b -= 1
        if b > a:
            yield a, b


def nal_type(unit: bytes, codec: str) -> int:
    return unit[0] & 31 if codec == "avc" else (unit[0] >> 1) & 63 if codec == "hevc" else unit[1] >> 3 if len(unit) > 1 else -1


def is_vcl(kind: int, codec: str) -> bool:
    return 1 <= kind <= 5 if codec == "avc" else 0 <= kind <= 31 if codec == "hevc" else 0 <= kind <= 11


def _first_slice(unit: bytes, kind: int, codec: str) -> bool:
    if codec == "avc":
        return bool(unit[1] & 0x80) if len(unit) > 1 else False  # first_mb_in_slice is 0
    if codec == "hevc":
        return bool(unit[2] & 0x80) if len(unit) > 2 else False
    return bool(unit[2] & 0x80) if len(unit) > 2 else False  # the slice brings its picture header


def _opens_unit(kind: int, codec: str) -> bool:
    """Kinds that start a new access unit when they follow a slice."""
    return kind in ({6, 7, 8, 9, 14, 15, 16, 17, 18} if codec == "avc" else {32, 33, 34, 35, 39, *range(41, 45), *range(48, 56)} if codec == "hevc" else {12, 13, 14, 15, 16, 17, 19, 20, 23})


NAL_ROWS = "au_no long, nu_no long, nu_in_au long, byte_off long, byte_len long, nal_type int, kind string, is_vcl boolean"


def nal_units(codec: str):
    """Parser of Annex B streams: units with the access unit that they belong to."""

    def parse(data: bytes) -> Iterator[tuple]:
        au, in_au, seen_slice = 0, 0, False
        for n, (a, b) in enumerate(nal_bounds(data)):
            unit = data[a:b]
            kind = nal_type(unit, codec)
            vcl = is_vcl(kind, codec)
            if seen_slice and (_opens_unit(kind, codec) or vcl and _first_slice(unit, kind, codec)):
                au, in_au, seen_slice = au + 1, 0, False
            seen_slice |= vcl
            yield au, n, in_au, a, b - a, kind, NAMES[codec].get(kind, "reserved"), vcl
            in_au += 1

    return parse


SEI_ROWS = "nu_no long, msg_no long, payload_type long, payload_size long, name string, payload binary"


def sei_messages(codec: str):
    header, kinds = {"avc": (1, {6}), "hevc": (2, {39, 40}), "vvc": (2, {23, 24})}[codec]

    def parse(data: bytes) -> Iterator[tuple]:
        for n, (a, b) in enumerate(nal_bounds(data)):
            if nal_type(data[a:b], codec) not in kinds:
                continue
            body, at, message = unescape_nal(data[a + header : b]), 0, 0
            while at < len(body) - 1 or at < len(body) and body[at] != 0x80:
                numbers = []
                for _ in range(2):
                    value = 0
                    while at < len(body) and body[at] == 0xFF:
                        value, at = value + 255, at + 1
                    if at >= len(body):
                        return
                    numbers.append(value + body[at])
                    at += 1
                kind, size = numbers
                yield n, message, kind, size, SEI.get(kind, "reserved_sei_message"), body[at : at + size]
                at += size
                message += 1

    return parse


def _scaling_list(r: Bits, size: int) -> None:
    last = nxt = 8
    for _ in range(size):
        if nxt:
            nxt = (last + r.se() + 256) % 256
        last = nxt or last


def avc_sps(unit: bytes) -> dict:
    """Fields of an H.264 sequence parameter set that say what the stream is."""
    r = Bits(unescape_nal(unit[1:]))
    f = {"profile_idc": r.u(8), "constraints": r.u(8), "level_idc": r.u(8), "sps_id": r.ue(), "chroma_format_idc": 1, "bit_depth_luma": 8, "bit_depth_chroma": 8}
    if f["profile_idc"] in (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135):
        f["chroma_format_idc"] = r.ue()
        if f["chroma_format_idc"] == 3:
            r.skip(1)
        f["bit_depth_luma"], f["bit_depth_chroma"] = r.ue() + 8, r.ue() + 8
        r.skip(1)
        if r.flag():
            for k in range(12 if f["chroma_format_idc"] == 3 else 8):
                if r.flag():
                    _scaling_list(r, 16 if k < 6 else 64)
    f["log2_max_frame_num"] = r.ue() + 4
    f["pic_order_cnt_type"] = r.ue()
    if f["pic_order_cnt_type"] == 0:
        f["log2_max_poc_lsb"] = r.ue() + 4
    elif f["pic_order_cnt_type"] == 1:
        r.skip(1)
        r.se(), r.se()
        for _ in range(r.ue()):
            r.se()
    f["max_num_ref_frames"] = r.ue()
    r.skip(1)
    width, height = (r.ue() + 1) * 16, r.ue() + 1
    f["frame_mbs_only"] = r.u(1)
    if not f["frame_mbs_only"]:
        r.skip(1)
    height *= 16 * (2 - f["frame_mbs_only"])
    r.skip(1)
    if r.flag():
        x = 1 if f["chroma_format_idc"] in (0, 3) else 2
        y = (2 if f["chroma_format_idc"] == 1 else 1) * (2 - f["frame_mbs_only"])
        left, right, top, bottom = r.ue(), r.ue(), r.ue(), r.ue()
        width, height = width - (left + right) * x, height - (top + bottom) * y
    f["width"], f["height"] = width, height
    f |= {"aspect_ratio_idc": None, "sar_width": None, "sar_height": None, "num_units_in_tick": None, "time_scale": None, "cpb": None}
    if r.flag():
        _vui(r, f)
    return f


def _vui(r: Bits, f: dict) -> None:
    if r.flag():
        f["aspect_ratio_idc"] = r.u(8)
        if f["aspect_ratio_idc"] == 255:
            f["sar_width"], f["sar_height"] = r.u(16), r.u(16)
    if r.flag():
        r.skip(1)
    if r.flag():
        r.skip(4)
        if r.flag():
            f["primaries"], f["transfer"], f["matrix"] = r.u(8), r.u(8), r.u(8)
    if r.flag():
        r.ue(), r.ue()
    if r.flag():
        f["num_units_in_tick"], f["time_scale"], f["fixed_frame_rate"] = r.u(32), r.u(32), r.flag()
    for name in ("nal", "vcl"):
        if r.flag():
            n, rate_scale, size_scale = r.ue() + 1, r.u(4), r.u(4)
            buckets = [{"bit_rate": (r.ue() + 1) << (6 + rate_scale), "cpb_size": (r.ue() + 1) << (4 + size_scale), "cbr": r.flag()} for _ in range(n)]
            f["cpb"] = {"kind": name, "buckets": buckets, "initial_delay_len": r.u(5) + 1, "removal_delay_len": r.u(5) + 1, "output_delay_len": r.u(5) + 1, "time_offset_len": r.u(5)}


def hevc_sps(unit: bytes) -> dict:
    r = Bits(unescape_nal(unit[2:]))
    f = {"vps_id": r.u(4), "max_sub_layers": r.u(3) + 1}
    r.skip(1)
    f["profile_space"], f["tier"], f["profile_idc"] = r.u(2), r.u(1), r.u(5)
    r.skip(80)
    f["level_idc"] = r.u(8)
    present = [(r.flag(), r.flag()) for _ in range(f["max_sub_layers"] - 1)]
    if f["max_sub_layers"] > 1:
        r.skip(2 * (9 - f["max_sub_layers"]))
    for profile, level in present:
        r.skip(88 * profile + 8 * level)
    f["sps_id"], f["chroma_format_idc"] = r.ue(), r.ue()
    if f["chroma_format_idc"] == 3:
        r.skip(1)
    f["width"], f["height"] = r.ue(), r.ue()
    if r.flag():
        x, y = (1 if f["chroma_format_idc"] in (0, 3) else 2), (2 if f["chroma_format_idc"] == 1 else 1)
        left, right, top, bottom = r.ue(), r.ue(), r.ue(), r.ue()
        f["width"], f["height"] = f["width"] - (left + right) * x, f["height"] - (top + bottom) * y
    f["bit_depth_luma"], f["bit_depth_chroma"] = r.ue() + 8, r.ue() + 8
    return f


SLICE_TYPES = "P B I SP SI".split()


def avc_slice(unit: bytes, log2_max_frame_num: int = 4) -> dict:
    r = Bits(unescape_nal(unit[1:64]))
    return {"first_mb": r.ue(), "slice_type": SLICE_TYPES[r.ue() % 5], "pps_id": r.ue(), "frame_num": r.u(log2_max_frame_num)}


SLICE_ROWS = "nu_no long, nal_type int, first_mb long, slice_type string, pps_id long, sps_id long, frame_num long, width int, height int"


def avc_slices(data: bytes) -> Iterator[tuple]:
    """Slice headers with the parameter sets that they refer to: the latest of their id before them. Without those there is no frame number and no size."""
    sps: dict[int, dict] = {}
    pps: dict[int, int] = {}
    for n, (a, b) in enumerate(nal_bounds(data)):
        unit = data[a:b]
        kind = unit[0] & 31
        if kind == 7:
            f = avc_sps(unit)
            sps[f["sps_id"]] = f
        elif kind == 8:
            r = Bits(unescape_nal(unit[1:]))
            pps[r.ue()] = r.ue()
        elif kind in (1, 2, 5):
            r = Bits(unescape_nal(unit[1:64]))
            first, slice_type, own = r.ue(), SLICE_TYPES[r.ue() % 5], r.ue()
            f = sps.get(pps.get(own, -1))
            yield n, kind, first, slice_type, own, pps.get(own), r.u(f["log2_max_frame_num"]) if f else None, f["width"] if f else None, f["height"] if f else None


PARAMETER_ROWS = "nu_no long, kind string, unit binary"


def parameter_sets(codec: str):
    """Parser of the parameter sets of a stream, whole units in order."""
    kinds = {"avc": (7, 8, 13, 15), "hevc": (32, 33, 34), "vvc": (13, 14, 15, 16, 17, 18)}[codec]

    def parse(data: bytes) -> Iterator[tuple]:
        for n, (a, b) in enumerate(nal_bounds(data)):
            kind = nal_type(data[a:b], codec)
            if kind in kinds:
                yield n, NAMES[codec][kind], data[a:b]

    return parse


def vvc_sps(unit: bytes) -> dict:
    """Fields of an H.266 sequence parameter set up to the bit depth, which subpicture data hides."""
    r = Bits(unescape_nal(unit[2:]))
    f = {"sps_id": r.u(4), "vps_id": r.u(4), "max_sublayers": r.u(3) + 1, "chroma_format_idc": r.u(2), "ctu_size": 32 << r.u(2), "profile_idc": None, "tier": None, "level_idc": None}
    if r.flag():
        f["profile_idc"], f["tier"], f["level_idc"] = r.u(7), r.u(1), r.u(8)
        r.skip(2)
        if r.flag():
            r.skip(71)
            r.skip(r.u(8))
        r.align()
        levels = [r.flag() for _ in range(f["max_sublayers"] - 1)]
        r.align()
        r.skip(8 * sum(levels))
        r.skip(32 * r.u(8))
    r.skip(1)
    if r.flag():
        r.skip(1)
    f["width"], f["height"] = r.ue(), r.ue()
    if r.flag():
        x, y = (2 if f["chroma_format_idc"] in (1, 2) else 1), (2 if f["chroma_format_idc"] == 1 else 1)
        left, right, top, bottom = r.ue(), r.ue(), r.ue(), r.ue()
        f["width"], f["height"] = f["width"] - (left + right) * x, f["height"] - (top + bottom) * y
    f["bit_depth"] = None if r.flag() else r.ue() + 8
    return f


def picture_type(slice_types: list[str]) -> str:
    """The least type that holds all slices: I, then P, then B; SI and SP alike with switching."""
    kinds = set(slice_types)
    switching = bool(kinds & {"SI", "SP"})
    base = "B" if "B" in kinds else "P" if kinds & {"P", "SP"} else "I"
    return f"S{base}" if switching and base != "B" and kinds <= {"SI", "SP"} else base


MPV_ROWS = "vseq long, gop long, au long, se long, start_code int, name string, byte_off long, byte_len long, picture_type string"
# Start codes (ISO/IEC 13818-2 table 6-1) and picture coding types.
_MPV = {0x00: "picture_header", 0xB2: "user_data", 0xB3: "sequence_header", 0xB4: "sequence_error", 0xB5: "extension", 0xB7: "sequence_end", 0xB8: "group_of_pictures_header"}
_CODING = {1: "I", 2: "P", 3: "B", 4: "D"}


def mpeg2_elements(data: bytes) -> Iterator[tuple]:
    """A video sequence starts at the first sequence header, or at one after a sequence end."""
    vseq, gop, au, se, ended, fresh = -1, -1, -1, 0, True, False
    picture = None
    starts = [m.start() for m in _START.finditer(data)]
    for a, b in zip(starts, [*starts[1:], len(data)], strict=False):
        if a + 3 >= len(data):
            return
        code = data[a + 3]
        if code == 0xB3 and ended:
            vseq, gop, ended = vseq + 1, -1, False
        if code in (0xB3, 0xB8) or code == 0 and not fresh:
            if not fresh:
                au, se = au + 1, 0
            fresh = code != 0
        elif code == 0:
            fresh = False
        if code == 0xB8:
            gop += 1
        if code == 0 and a + 5 < len(data):
            picture = _CODING.get((data[a + 5] >> 3) & 7)
        name = _MPV.get(code) or (f"slice{code}" if 1 <= code <= 0xAF else "system")
        yield max(vseq, 0), max(gop, 0), max(au, 0), se, code, name, a, b - a, picture if code <= 0xAF else None
        se += 1
        if code == 0xB7:
            ended = True


OBU_ROWS = "tu long, obu long, obu_type int, name string, temporal_id int, spatial_id int, byte_off long, byte_len long"


def _obus(data: bytes, at: int, end: int, tu: int, n: int) -> Iterator[tuple]:
    while at < end:
        start = at
        r = Bits(data, at * 8)
        if r.u(1):
            return
        kind, extended, sized = r.u(4), r.flag(), r.flag()
        r.skip(1)
        temporal, spatial = (r.u(3), r.u(2)) if extended else (0, 0)
        if extended:
            r.skip(3)
        size = r.leb128() if sized else end - (r.at >> 3)
        at = (r.at >> 3) + size
        if kind == 2:
            tu += 1
        yield max(tu, 0), n, kind, OBU.get(kind, "Reserved"), temporal, spatial, start, min(at, end) - start
        n += 1


def av1_obus(data: bytes) -> Iterator[tuple]:
    """The low-overhead format: a temporal unit begins at each temporal delimiter."""
    yield from _obus(data, 0, len(data), -1, 0)


def av1_annexb(data: bytes) -> Iterator[tuple]:
    """The length-delimited format: temporal units of frame units of OBUs."""
    r, tu, n = Bits(data), 0, 0
    while r.left() > 0:
        end = r.leb128() * 8 + r.at
        while r.at < end:
            frame_end = r.leb128() * 8 + r.at
            while r.at < frame_end:
                size = r.leb128()
                a = r.at >> 3
                for row in _obus(data, a, a + size, tu, n):
                    yield (tu, *row[1:])
                n += 1
                r.at = (a + size) * 8
        tu += 1


def ivf_frames(data: bytes) -> Iterator[tuple]:
    """frame, pts, byte_off, byte_len of an IVF file, AV1 only."""
    if data[:4] != b"DKIF" or data[8:12] != b"AV01":
        return
    at, n = int.from_bytes(data[6:8], "little"), 0
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        yield n, int.from_bytes(data[at + 4 : at + 12], "little"), at + 12, size
        at, n = at + 12 + size, n + 1


IVF_ROWS = "frame long, pts long, byte_off long, byte_len long"


def av1_container(data: bytes) -> str:
    """ivf, annexb or obu, by what parses."""
    if data[:4] == b"DKIF":
        return "ivf"
    try:
        r = Bits(data)
        unit, frame, first = r.leb128(), r.leb128(), r.leb128()
        head = r.u(8)
        if first <= frame <= unit <= len(data) and first and head >> 7 == 0 and (head >> 3) & 15 == 2 and head & 3 in (0, 2) and first <= 2:
            return "annexb"
    except EOFError:
        pass
    return "obu"


def av1_sequence_header(payload: bytes, tools: bool = False) -> dict:
    """Profile, level, timing and size; with ``tools`` also what the parsing of frame headers depends on."""
    r = Bits(payload)
    f = {"profile": r.u(3), "still_picture": r.flag(), "reduced": r.flag()}
    decoder_model = equal = False
    delay_len = removal_len = time_len = 0
    points = []
    if f["reduced"]:
        f["level"] = r.u(5)
    else:
        if r.flag():
            f["num_units_in_tick"], f["time_scale"] = r.u(32), r.u(32)
            if equal := r.flag():
                f["ticks_per_picture"] = r.uvlc() + 1
            if decoder_model := r.flag():
                delay_len = r.u(5) + 1
                r.skip(32)
                removal_len, time_len = r.u(5) + 1, r.u(5) + 1
        display = r.flag()
        for k in range(r.u(5) + 1):
            layers, level = r.u(12), r.u(5)
            tier = r.u(1) if level > 7 else 0
            if not k:
                f["level"], f["tier"] = level, tier
            modelled = decoder_model and r.flag()
            if modelled:
                r.skip(2 * delay_len + 1)
            points.append((layers, modelled))
            if display and r.flag():
                r.skip(4)
    w, h = r.u(4) + 1, r.u(4) + 1
    f["max_width"], f["max_height"] = r.u(w) + 1, r.u(h) + 1
    if not tools:
        return f
    f |= {"removal_len": removal_len, "time_len": 0 if equal or not decoder_model else time_len, "decoder_model": decoder_model, "points": points}
    f |= {"id_len": 0, "delta_id_len": 0, "screen_content": None, "integer_mv": None, "order_bits": 0}
    if not f["reduced"] and r.flag():
        f["delta_id_len"] = r.u(4) + 2
        f["id_len"] = r.u(3) + 1 + f["delta_id_len"]
    r.skip(3)
    if not f["reduced"]:
        r.skip(4)
        ordered = r.flag()
        r.skip(2 * ordered)
        if not r.flag():
            f["screen_content"] = r.u(1)
        if f["screen_content"] != 0 and not r.flag():
            f["integer_mv"] = r.u(1)
        if ordered:
            f["order_bits"] = r.u(3) + 1
    return f


AV1_FRAMES = ["KEY", "INTER", "INTRA_ONLY", "SWITCH"]
AV1_FRAME_ROWS = "tu long, fu long, obu long, frame_type string, shown boolean, existing int"


def av1_frames(data: bytes) -> Iterator[tuple]:
    """Frame headers of the low-overhead format: type, whether shown, and which stored frame is shown again; a frame unit ends with a shown frame."""
    reduced, fu, now = False, 0, 0
    for tu, n, kind, _, _, _, at, size in av1_obus(data):
        head = Bits(data, at * 8)
        head.skip(5)
        extended, sized = head.u(1), head.u(1)
        head.skip(1 + 8 * extended)
        if sized:
            head.leb128()
        if tu != now:
            now, fu = tu, 0
        if kind == 1:
            reduced = bool(data[head.at >> 3] & 8)
        elif kind in (3, 6) and head.at < (at + size) * 8:
            if reduced:
                yield tu, fu, n, "KEY", True, None
                fu += 1
            elif head.flag():
                yield tu, fu, n, None, True, head.u(3)
                fu += 1
            else:
                frame, shown = AV1_FRAMES[head.u(2)], head.flag()
                yield tu, fu, n, frame, shown, None
                fu += shown
