"""The syntax view: structures declared as text, read into rows of fields with their bit positions.

A declaration is a list of items between spaces:

* ``name:kind`` reads a field; kinds are ``u8`` (any width), ``i16``, ``ue``, ``se``, ``leb128``, ``s4`` (four bytes of text), ``h6``
  (six bytes as hex), ``s*`` and ``h*`` (what is left), ``sN:name`` with the length in an earlier field
* ``_:u2`` skips
* ``[cond| items ]`` reads the items if the condition holds: a field's name (not zero), ``!name`` or ``name=value``
* ``{name| items }`` repeats them as often as the field says, ``{*| items }`` until the data ends

A field inside a repetition is called ``name[k]`` in its path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from ..functions.bits import Bits, unescape_nal

FIELD_ROWS = "ordinal int, path string, bit_off long, bit_len long, value string, number long"

# Declarations from ISO/IEC 13818-1 (descriptors), 13818-2 (headers), ETSI EN 300 468 and ARIB STD-B10 (0x40 and up).
DESCRIPTORS = {
    0x02: "video_stream multiple_frame_rate:u1 frame_rate_code:u4 mpeg_1_only:u1 constrained_parameter:u1 still_picture:u1 [mpeg_1_only=0| profile_and_level:u8 chroma_format:u2 frame_rate_extension:u1 _:u5 ]",
    0x03: "audio_stream free_format:u1 id:u1 layer:u2 variable_rate:u1 _:u3",
    0x04: "hierarchy _:u1 no_temporal:u1 no_spatial:u1 no_quality:u1 type:u4 _:u2 layer_index:u6 tref_present:u1 _:u1 embedded_layer_index:u6 _:u2 channel:u6",
    0x05: "registration format_identifier:s4 additional:h*",
    0x06: "data_stream_alignment alignment_type:u8",
    0x07: "target_background_grid horizontal:u14 vertical:u14 aspect_ratio:u4",
    0x08: "video_window horizontal_offset:u14 vertical_offset:u14 priority:u4",
    0x09: "ca ca_system_id:u16 _:u3 ca_pid:u13 private:h*",
    0x0A: "iso_639_language {*| language:s3 audio_type:u8 }",
    0x0B: "system_clock external_reference:u1 _:u1 accuracy_integer:u6 accuracy_exponent:u3 _:u5",
    0x0C: "multiplex_buffer_utilization bound_valid:u1 ltw_lower:u15 _:u1 ltw_upper:u15",
    0x0D: "copyright identifier:u32 additional:h*",
    0x0E: "maximum_bitrate _:u2 maximum_bitrate:u22",
    0x0F: "private_data_indicator indicator:u32",
    0x10: "smoothing_buffer _:u2 leak_rate:u22 _:u2 size:u22",
    0x11: "std _:u7 leak_valid:u1",
    0x12: "ibp closed_gop:u1 identical_gop:u1 max_gop_length:u14",
    0x1B: "mpeg4_video profile_and_level:u8",
    0x1C: "mpeg4_audio profile_and_level:u8",
    0x1D: "iod scope:u8 label:u8 descriptor:h*",
    0x1E: "sl es_id:u16",
    0x1F: "fmc {*| es_id:u16 channel:u8 }",
    0x28: "avc_video profile_idc:u8 constraints:u6 compatible_flags:u2 level_idc:u8 still_present:u1 day_24_hour:u1 frame_packing_absent:u1 _:u5",
    0x2A: "avc_timing_and_hrd hrd_valid:u1 _:u6 timing_present:u1 [timing_present| is_90khz:u1 _:u7 [is_90khz=0| n:u32 k:u32 ] num_units_in_tick:u32 ] fixed_frame_rate:u1 temporal_poc:u1 conversion:u1 _:u5",
    0x2B: "mpeg2_aac_audio profile:u8 channel_configuration:u8 additional:u8",
    0x38: "hevc_video profile_space:u2 tier:u1 profile_idc:u5 compatibility:u32 progressive:u1 interlaced:u1 non_packed:u1 frame_only:u1 _:u44 level_idc:u8 temporal_subset:u1 still_present:u1 day_24_hour:u1 sub_pic_absent:u1 _:u4 [temporal_subset| temporal_id_min:u3 _:u5 temporal_id_max:u3 _:u5 ]",
    0x40: "network_name name:s*",
    0x42: "stuffing bytes:h*",
    0x47: "bouquet_name name:s*",
    0x48: "service service_type:u8 provider_length:u8 provider:sN:provider_length name_length:u8 name:sN:name_length",
    0x49: "country_availability available:u1 _:u7 {*| country:s3 }",
    0x4A: "linkage transport_stream_id:u16 original_network_id:u16 service_id:u16 linkage_type:u8 private:h*",
    0x4D: "short_event language:s3 name_length:u8 name:sN:name_length text_length:u8 text:sN:text_length",
    0x50: "component _:u4 stream_content:u4 component_type:u8 component_tag:u8 language:s3 text:s*",
    0x51: "mosaic body:h*",
    0x52: "stream_identifier component_tag:u8",
    0x53: "ca_identifier {*| ca_system_id:u16 }",
    0x54: "content {*| nibble_1:u4 nibble_2:u4 user_1:u4 user_2:u4 }",
    0x55: "parental_rating {*| country:s3 rating:u8 }",
    0x63: "partial_transport_stream _:u2 peak_rate:u22 _:u2 minimum_smoothing_rate:u22 _:u2 maximum_smoothing_buffer:u14",
    0xC1: "digital_copy_control recording_control:u2 maximum_bitrate_flag:u1 component_control_flag:u1 copy_control_type:u2 aps_control:u2 [maximum_bitrate_flag| maximum_bitrate:u8 ] rest:h*",
    0xC7: "data_content data_component_id:u16 entry_component:u8 selector_length:u8 selector:hN:selector_length rest:h*",
    0xC8: "video_decode_control still_picture:u1 sequence_end_code:u1 video_encode_format:u4 _:u2",
    0xDE: "content_availability _:u1 copy_restriction:u1 image_constraint:u1 retention_mode:u1 retention_state:u3 encryption_mode:u1 rest:h*",
}
STRUCTURES = {
    "mpv_sequence_header": "width:u12 height:u12 aspect_ratio:u4 frame_rate_code:u4 bit_rate:u18 _:u1 vbv_buffer_size:u10 constrained:u1",
    "mpv_sequence_extension": "id:u4 profile_and_level:u8 progressive:u1 chroma_format:u2 width_ext:u2 height_ext:u2 bit_rate_ext:u12 _:u1 vbv_ext:u8 low_delay:u1 frame_rate_n:u2 frame_rate_d:u5",
    "mpv_group_of_pictures": "drop_frame:u1 hours:u5 minutes:u6 _:u1 seconds:u6 pictures:u6 closed_gop:u1 broken_link:u1",
    "mpv_picture": "temporal_reference:u10 picture_coding_type:u3 vbv_delay:u16",
    "avc_aud": "forbidden:u1 nal_ref_idc:u2 nal_unit_type:u5 primary_pic_type:u3",
    "avc_pps": "forbidden:u1 nal_ref_idc:u2 nal_unit_type:u5 pps_id:ue sps_id:ue entropy_coding_mode:u1 bottom_field_pic_order:u1 num_slice_groups_minus1:ue [num_slice_groups_minus1=0| num_ref_idx_l0_minus1:ue num_ref_idx_l1_minus1:ue weighted_pred:u1 weighted_bipred_idc:u2 pic_init_qp_minus26:se pic_init_qs_minus26:se chroma_qp_index_offset:se deblocking_control:u1 constrained_intra_pred:u1 redundant_pic_cnt:u1 ]",
    "hevc_pps": "header:u16 pps_id:ue sps_id:ue dependent_slices:u1 output_flag_present:u1 num_extra_bits:u3 sign_data_hiding:u1 cabac_init_present:u1 num_ref_idx_l0_minus1:ue num_ref_idx_l1_minus1:ue init_qp_minus26:se constrained_intra_pred:u1 transform_skip:u1 cu_qp_delta:u1 [cu_qp_delta| diff_cu_qp_delta_depth:ue ] cb_qp_offset:se cr_qp_offset:se",
    "hevc_vps": "header:u16 vps_id:u4 base_layer_internal:u1 base_layer_available:u1 max_layers_minus1:u6 max_sub_layers_minus1:u3 temporal_id_nesting:u1 _:u16 profile_space:u2 tier:u1 profile_idc:u5 compatibility:u32 constraints:u48 level_idc:u8",
    "sei_recovery_point": "recovery_frame_cnt:ue exact_match:u1 broken_link:u1 changing_slice_group:u2",
    "sei_user_data_registered": "country_code:u8 payload:h*",
    "sei_user_data_unregistered": "uuid:h16 payload:h*",
    "sei_mastering_display": "gx:u16 gy:u16 bx:u16 by:u16 rx:u16 ry:u16 white_x:u16 white_y:u16 max_luminance:u32 min_luminance:u32",
    "sei_content_light_level": "max_content:u16 max_average:u16",
    "sei_alternative_transfer": "preferred_transfer:u8",
    "sei_active_parameter_sets": "vps_id:u4 self_contained_cvs:u1 no_update:u1 num_sps_minus1:ue",
    "obu_header": "forbidden:u1 type:u4 extension:u1 has_size:u1 _:u1 [extension| temporal_id:u3 spatial_id:u2 _:u3 ] [has_size| size:leb128 ]",
    "box_ftyp": "major_brand:s4 minor_version:u32 {*| compatible_brand:s4 }",
    "box_mvhd": "version:u8 flags:u24 [version| creation:u64 modification:u64 timescale:u32 duration:u64 ] [version=0| creation:u32 modification:u32 timescale:u32 duration:u32 ] rate:u32 volume:u16 _:u80 matrix:h36 _:u192 next_track_id:u32",
    "box_tkhd": "version:u8 flags:u24 [version| creation:u64 modification:u64 track_id:u32 _:u32 duration:u64 ] [version=0| creation:u32 modification:u32 track_id:u32 _:u32 duration:u32 ] _:u64 layer:i16 alternate_group:i16 volume:u16 _:u16 matrix:h36 width:u32 height:u32",
    "box_mdhd": "version:u8 flags:u24 [version| creation:u64 modification:u64 timescale:u32 duration:u64 ] [version=0| creation:u32 modification:u32 timescale:u32 duration:u32 ] _:u1 language:u15 _:u16",
    "box_hdlr": "version:u8 flags:u24 _:u32 handler_type:s4 _:u96 name:s*",
    "box_cslg": "version:u8 flags:u24 shift:i32 least:i32 greatest:i32 start:i32 end:i32",
    "box_avcC": "version:u8 profile_idc:u8 constraints:u8 level_idc:u8 _:u6 length_size_minus1:u2 _:u3 n_sps:u5 {n_sps| sps_length:u16 sps:hN:sps_length } n_pps:u8 {n_pps| pps_length:u16 pps:hN:pps_length }",
    "box_hvcC": "version:u8 profile_space:u2 tier:u1 profile_idc:u5 compatibility:u32 constraints:u48 level_idc:u8 _:u4 min_spatial_segmentation:u12 _:u6 parallelism:u2 _:u6 chroma_format:u2 _:u5 bit_depth_luma_minus8:u3 _:u5 bit_depth_chroma_minus8:u3 avg_frame_rate:u16 constant_frame_rate:u2 num_temporal_layers:u3 temporal_id_nested:u1 length_size_minus1:u2 n_arrays:u8 {n_arrays| complete:u1 _:u1 nal_type:u6 n_units:u16 {n_units| unit_length:u16 unit:hN:unit_length } }",
}


@cache
def compiled(declaration: str) -> list:
    """Items as nested lists: [name, kind] or [sign, condition, items]."""
    words = re.findall(r"[\[{][^|\s]*\||[\]}]|[^\s\[\]{}]+", declaration)

    def items(at: int) -> tuple[list, int]:
        out = []
        while at < len(words):
            w = words[at]
            if w in "]}":
                return out, at + 1
            if w[0] in "[{":
                inner, at = items(at + 1)
                out.append([w[0], w[1:-1], inner])
            else:
                out.append(w.split(":", 1))
                at += 1
        return out, at

    return items(0)[0]


def fields(data: bytes, declaration: str) -> Iterator[tuple]:
    """Rows of FIELD_ROWS; what the data no longer holds is left out."""
    r, seen, rows = Bits(data), {}, []

    def read(kind: str) -> tuple[str, int | None]:
        if kind in ("ue", "se", "leb128"):
            n = getattr(r, kind)()
            return str(n), n
        if kind[0] in "ui":
            n = r.u(int(kind[1:])) if kind[0] == "u" else r.s(int(kind[1:]))
            return str(n), n if -(2**63) <= n < 2**63 else None
        size = kind[1:]
        n = r.left() // 8 if size == "*" else seen[size[2:]] if size.startswith("N:") else int(size)
        if 8 * n > r.left():
            raise EOFError
        body = r.bytes(n)
        return (body.decode("utf-8", "replace") if kind[0] == "s" else body.hex()), None

    def walk(items: list, suffix: str) -> None:
        for item in items:
            if len(item) == 2:
                at = r.at
                text, n = read(item[1])
                if item[0] != "_":
                    seen[item[0]] = n
                    rows.append((len(rows), item[0] + suffix, at, r.at - at, text, n))
            elif item[0] == "[":
                name, _, want = item[1].lstrip("!").partition("=")
                holds = seen.get(name) == int(want) if want else bool(seen.get(name))
                if holds != item[1].startswith("!"):
                    walk(item[2], suffix)
            elif item[1] == "*":
                k = 0
                while r.left() >= 8:
                    walk(item[2], f"{suffix}[{k}]")
                    k += 1
            else:
                for k in range(seen.get(item[1]) or 0):
                    walk(item[2], f"{suffix}[{k}]")

    try:
        walk(compiled(declaration), "")
    except EOFError:
        pass
    yield from rows


def structure(name: str, escaped: bool = False, skip: int = 0):
    """Parser of one structure for parse_blobs."""

    def parse(data: bytes) -> Iterator[tuple]:
        yield from fields((unescape_nal(data) if escaped else data)[skip:], STRUCTURES[name])

    return parse


#: Fields of a sequence header that go on in the extension after it: the extension's name, and the header's bits.
_EXTENDED = {"width": ("width_ext", 12), "height": ("height_ext", 12), "bit_rate": ("bit_rate_ext", 18), "vbv_buffer_size": ("vbv_ext", 10)}


def sequence_header(data: bytes) -> Iterator[tuple]:
    """Fields of a sequence header of 8 bytes, with the high bits that a sequence extension right after it adds to them."""
    above = {row[1]: row[5] for row in structure("mpv_sequence_extension", skip=8)(data)}
    for row in structure("mpv_sequence_header")(data[:8]):
        name, bits = _EXTENDED.get(row[1], ("", 0))
        n = row[5] + (above.get(name, 0) << bits)
        yield *row[:4], str(n), n


DESCRIPTOR_ROWS = "descriptor int, tag int, name string, " + FIELD_ROWS


def descriptor_fields(loop: bytes) -> Iterator[tuple]:
    """Fields of every descriptor of a loop; an unknown tag gives its bytes."""
    at, k = 0, 0
    while at + 2 <= len(loop):
        tag, body = loop[at], loop[at + 2 : at + 2 + loop[at + 1]]
        name, _, declaration = DESCRIPTORS.get(tag, "unknown bytes:h*").partition(" ")
        for row in fields(body, declaration):
            yield k, tag, name, *row
        at, k = at + 2 + loop[at + 1], k + 1
