"""What each elementary stream of a transport stream is: the stream type says which parser reads its payload."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import audio, video
from ..sources.blobs import parse_blobs

# Stream types (ISO/IEC 13818-1 table 2-34, and those of Blu-ray and ATSC) by the parser that reads them.
_AUDIO = {0x03: audio.mpeg_audio_frames, 0x04: audio.mpeg_audio_frames, 0x0F: audio.adts_frames, 0x11: audio.loas_frames, 0x80: audio.hdmv_lpcm, 0x81: audio.ac3_frames, 0x82: audio.dts_frames, 0x83: audio.ac3_frames, 0x84: audio.ac3_frames, 0x85: audio.dts_any_frames, 0x86: audio.dts_any_frames, 0x87: audio.ac3_frames, 0xA1: audio.ac3_frames, 0xA2: audio.dts_any_frames}
_MPEG_VIDEO = {0x01: "MPEG-1 video", 0x02: "MPEG-2 video"}
_NAL_VIDEO = {0x1B: ("avc", "H.264", 7, video.avc_sps), 0x24: ("hevc", "H.265", 33, video.hevc_sps)}
_FRAME_RATES = {1: (24000, 1001), 2: (24, 1), 3: (25, 1), 4: (30000, 1001), 5: (30, 1), 6: (50, 1), 7: (60000, 1001), 8: (60, 1)}

INFO = "codec string, profile int, level int, width int, height int, rate_num long, rate_den long, sample_rate int, channels int, bit_rate long"


def stream_info(data: bytes) -> Iterator[tuple]:
    """One row, if the payload says what it is. The first byte is the stream type."""
    kind, es = data[0], data[1:]
    if kind in _AUDIO:
        for _, _, _, codec, rate, channels, bit_rate, profile in _AUDIO[kind](es):
            if rate is not None:
                yield codec, profile, None, None, None, None, None, rate, channels, bit_rate
                return
    elif kind in _MPEG_VIDEO:
        at = es.find(b"\0\0\1\xb3")
        if 0 <= at <= len(es) - 11:
            size, rate = int.from_bytes(es[at + 4 : at + 7], "big"), _FRAME_RATES.get(es[at + 7] & 15, (None, None))
            yield _MPEG_VIDEO[kind], None, None, size >> 12, size & 4095, *rate, None, None, (int.from_bytes(es[at + 8 : at + 11], "big") >> 6) * 400
    elif kind in _NAL_VIDEO:
        codec, name, sps, read = _NAL_VIDEO[kind]
        for a, b in video.nal_bounds(es):
            if video.nal_type(es[a:b], codec) == sps:
                f = read(es[a:b])
                yield name, f["profile_idc"], f["level_idc"], f["width"], f["height"], f.get("time_scale"), f.get("num_units_in_tick"), None, None, None
                return


def codec_info(units: DataFrame, streams: DataFrame) -> DataFrame:
    """units of ``pes_units``, streams of ``pmt_streams``: one row per PID, from the first unit that tells; PIDs that never do keep nulls."""
    known = streams.groupBy(F.col("es_pid").alias("pid")).agg(F.max("stream_type").alias("stream_type"))
    typed = units.join(F.broadcast(known), "pid")  # at most 8,192 PIDs
    data = F.concat(F.unhex(F.lpad(F.hex("stream_type"), 2, "0")), F.col("es"))
    rows = parse_blobs(typed.select("pid", "unit", data.alias("data")), stream_info, INFO, ("pid", "unit"))
    names = [x.split()[0] for x in INFO.split(", ")]
    first = rows.groupBy("pid").agg(F.min_by(F.struct(*names), "unit").alias("i"))
    return known.join(first, "pid", "left").select("pid", "stream_type", *(f"i.{x}" for x in names))
