"""Audio frame headers: ADTS, LOAS, MPEG audio, AC-3, E-AC-3, DTS core, HDMV LPCM, AudioSpecificConfig."""

from __future__ import annotations

from collections.abc import Iterator

from ..functions.bits import Bits

# Sampling frequencies (ISO/IEC 14496-3 table 1.16), MPEG audio bit rates and rates, AC-3 bit rates and rates.
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
_MPEG_BITRATES = {(1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448], (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384], (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256], (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160], (2, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
_MPEG_RATES = [44100, 48000, 32000]
_AC3_BITRATES = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
_AC3_RATES = [48000, 44100, 32000]
_AC3_CHANNELS = [2, 1, 2, 3, 3, 4, 4, 5]
_DTS_RATES = {1: 8000, 2: 16000, 3: 32000, 6: 11025, 7: 22050, 8: 44100, 11: 12000, 12: 24000, 13: 48000}
_DTS_CHANNELS = [1, 2, 2, 2, 2, 3, 3, 4, 4, 5, 6, 6, 6, 7, 8, 8]
_LPCM_RATES = {1: 48000, 4: 96000, 5: 192000}
_LPCM_CHANNELS = {1: 1, 3: 2, 4: 3, 5: 3, 6: 4, 7: 4, 8: 5, 9: 6, 10: 7, 11: 8}
_LPCM_BITS = {1: 16, 2: 20, 3: 24}

FRAME_ROWS = "frame long, byte_off long, byte_len long, codec string, sample_rate int, channels int, bit_rate int, profile int"


def adts_frames(data: bytes) -> Iterator[tuple]:
    at, n = 0, 0
    while at + 7 <= len(data):
        r = Bits(data, at * 8)
        if r.u(12) != 0xFFF or (r.u(4) >> 1) & 3:
            at += 1
            continue
        profile, rate = r.u(2) + 1, r.u(4)
        r.skip(1)
        channels = r.u(3)
        r.skip(4)
        size = r.u(13)
        if size < 7 or rate >= len(AAC_RATES):
            at += 1
            continue
        yield n, at, size, "AAC ADTS", AAC_RATES[rate], 8 if channels == 7 else channels, None, profile
        at, n = at + size, n + 1


def loas_frames(data: bytes) -> Iterator[tuple]:
    """LOAS sync frames; the stream configuration in force says rate and channels."""
    at, n, config = 0, 0, (None, None, None)
    while at + 3 <= len(data):
        word = int.from_bytes(data[at : at + 3], "big")
        if word >> 13 != 0x2B7:
            at += 1
            continue
        size = word & 0x1FFF
        r = Bits(data, (at + 3) * 8)
        if not r.flag():
            config = _stream_mux(r)
        yield n, at, size + 3, "AAC LATM", config[1], config[2], None, config[0]
        at, n = at + 3 + size, n + 1


def _stream_mux(r: Bits) -> tuple[int | None, int | None, int | None]:
    if r.u(1):  # version 1 is not laid out here
        return None, None, None
    r.skip(1 + 6 + 4 + 3)
    return audio_specific_config(r)


def audio_specific_config(r: Bits) -> tuple[int, int, int]:
    """(object type, sampling rate, channels)."""
    kind = r.u(5)
    kind = 32 + r.u(6) if kind == 31 else kind
    k = r.u(4)
    rate = r.u(24) if k == 15 else AAC_RATES[k]
    channels = r.u(4)
    return kind, rate, 8 if channels == 7 else channels


def mpeg_audio_frames(data: bytes) -> Iterator[tuple]:
    at, n = 0, 0
    while at + 4 <= len(data):
        h = int.from_bytes(data[at : at + 4], "big")
        version, layer, b, s, pad = (h >> 19) & 3, 4 - ((h >> 17) & 3), (h >> 12) & 15, (h >> 10) & 3, (h >> 9) & 1
        if h >> 21 != 0x7FF or version == 1 or layer == 4 or b in (0, 15) or s == 3:
            at += 1
            continue
        kbps = _MPEG_BITRATES[1 if version == 3 else 2, layer][b - 1]
        rate = _MPEG_RATES[s] >> {3: 0, 2: 1, 0: 2}[version]
        size = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else (72 if layer == 3 and version != 3 else 144) * kbps * 1000 // rate + pad
        yield n, at, size, f"MPEG audio layer {layer}", rate, 1 if (h >> 6) & 3 == 3 else 2, kbps * 1000, layer
        at, n = at + size, n + 1


def ac3_frames(data: bytes) -> Iterator[tuple]:
    """AC-3 and E-AC-3 sync frames."""
    at, n = 0, 0
    while at + 8 <= len(data):
        if data[at : at + 2] != b"\x0b\x77":
            at += 1
            continue
        bsid = data[at + 5] >> 3
        r = Bits(data, (at + 2) * 8)
        if bsid <= 10:
            r.skip(16)
            rate, code = r.u(2), r.u(6)
            if rate == 3 or code > 37:
                at += 1
                continue
            kbps = _AC3_BITRATES[code >> 1]
            words = kbps * 1000 * 1536 // 16 // _AC3_RATES[rate] + (code & 1 if rate == 1 else 0)
            r.skip(5 + 3)
            mode = r.u(3)
            r.skip(2 * bool(mode & 1 and mode != 1) + 2 * bool(mode & 4) + 2 * (mode == 2))
            yield n, at, 2 * words, "AC-3", _AC3_RATES[rate], _AC3_CHANNELS[mode] + r.u(1), kbps * 1000, bsid
            size = 2 * words
        else:
            r.skip(2 + 3)
            size, rate = 2 * (r.u(11) + 1), r.u(2)
            half = r.u(2)
            hz = _AC3_RATES[half] // 2 if rate == 3 else _AC3_RATES[rate]
            samples = 1536 if rate == 3 else 256 * [1, 2, 3, 6][half]
            mode, lfe = r.u(3), r.u(1)
            yield n, at, size, "E-AC-3", hz, _AC3_CHANNELS[mode] + lfe, size * 8 * hz // samples, bsid
        at, n = at + size, n + 1


def dts_frames(data: bytes) -> Iterator[tuple]:
    """DTS core frames."""
    at, n = 0, 0
    while (at := data.find(b"\x7f\xfe\x80\x01", at)) >= 0 and at + 14 <= len(data):
        r = Bits(data, (at + 4) * 8)
        r.skip(1 + 5 + 1 + 7)
        size, mode, rate, bits = r.u(14) + 1, r.u(6), r.u(4), r.u(5)
        r.skip(5 + 3 + 1 + 1)
        lfe = r.u(2)
        yield n, at, size, "DTS", _DTS_RATES.get(rate), (_DTS_CHANNELS[mode] if mode < 16 else 0) + (lfe in (1, 2)), None, bits
        at, n = at + max(size, 4), n + 1


# Sampling frequencies by code in an extension substream's asset descriptor (ETSI TS 102 114).
_DTS_HD_RATES = [8000, 16000, 32000, 64000, 128000, 22050, 44100, 88200, 176400, 352800, 12000, 24000, 48000, 96000, 192000, 384000]


def _first_asset(r: Bits, static: bool, index: int, size_bits: int) -> tuple[int | None, int | None]:
    """Sampling frequency and channels of the first asset, from after the substream's sizes; only static fields tell them."""
    if not static:
        return None, None
    r.skip(2 + 3)
    if r.flag():
        r.skip(36)
    presentations, assets = r.u(3) + 1, r.u(3) + 1
    masks = [r.u(index + 1) for _ in range(presentations)]
    r.skip(8 * sum(m.bit_count() for m in masks))
    if r.flag():
        r.skip(2)
        width, configs = (r.u(2) + 1) * 4, r.u(2) + 1
        r.skip(width * configs)
    r.skip(size_bits * assets)
    r.skip(9 + 3)
    if r.flag():
        r.skip(4)
    if r.flag():
        r.skip(24)
    if r.flag():
        r.skip(8 * (r.u(10) + 1))
    r.skip(5)
    rate, channels = r.u(4), r.u(8) + 1
    return _DTS_HD_RATES[rate], channels


def dts_hd_frames(data: bytes) -> Iterator[tuple]:
    """DTS-HD extension substreams, each with the sampling frequency and channels of its first asset."""
    at, n = 0, 0
    while (at := data.find(b"\x64\x58\x20\x25", at)) >= 0 and at + 10 <= len(data):
        r = Bits(data, (at + 4) * 8)
        r.skip(8)
        index, wide = r.u(2), r.flag()
        head_bits, size_bits = (12, 20) if wide else (8, 16)
        head, size = r.u(head_bits) + 1, r.u(size_bits) + 1
        try:
            rate, channels = _first_asset(Bits(data[: at + head], r.at + 1), r.flag(), index, size_bits)
        except EOFError:  # a header that is cut off or lies
            rate = channels = None
        yield n, at, size, "DTS-HD", rate, channels, None, None
        at, n = at + max(size, head, 4), n + 1


def dts_any_frames(data: bytes) -> Iterator[tuple]:
    """Extension substreams before core frames, which tell less where both are."""
    yield from dts_hd_frames(data)
    yield from dts_frames(data)


# Sampling frequencies and channel groups of the MLP major sync.
_MLP_RATES = {0: 48000, 1: 96000, 2: 192000, 8: 44100, 9: 88200, 10: 176400}
_MLP_CHANNELS = [1, 2, 3, 4, 3, 4, 5, 3, 4, 5, 4, 5, 6, 4, 5, 4, 5, 6, 5, 5, 6]
_TRUEHD_GROUPS = [2, 1, 1, 2, 2, 2, 2, 1, 1, 2, 2, 1, 1]


def mlp_frames(data: bytes) -> Iterator[tuple]:
    """Access units of MLP and TrueHD; the latest major sync says rate and channels."""
    at, n, info = 0, 0, None
    while at + 8 <= len(data):
        size, sync = (int.from_bytes(data[at : at + 2], "big") & 0xFFF) * 2, int.from_bytes(data[at + 4 : at + 8], "big")
        if sync == 0xF8726FBA and at + 14 <= len(data):
            r = Bits(data, (at + 8) * 8)
            rate = _MLP_RATES.get(r.u(4))
            r.skip(8)
            six = r.u(5)
            r.skip(2)
            groups = r.u(13) or six
            info = "TrueHD", rate, sum(c for k, c in enumerate(_TRUEHD_GROUPS) if groups >> k & 1)
        elif sync == 0xF8726FBB and at + 12 <= len(data):
            r = Bits(data, (at + 8) * 8)
            r.skip(8)
            rate = _MLP_RATES.get(r.u(4))
            r.skip(4 + 11)
            kind = r.u(5)
            info = "MLP", rate, _MLP_CHANNELS[kind] if kind < len(_MLP_CHANNELS) else None
        elif info is None:
            at += 1
            continue
        if size < 4:
            at, info = at + 1, None
            continue
        yield n, at, size, info[0], info[1], info[2], None, None
        at, n = at + size, n + 1


def latm_to_loas(element: bytes) -> bytes:
    """An audio mux element of up to 8,191 bytes with the sync header in front."""
    if len(element) >= 1 << 13:
        raise ValueError("element too long for its length field")
    return (0x2B7 << 13 | len(element)).to_bytes(3, "big") + element


def hdmv_lpcm(data: bytes) -> Iterator[tuple]:
    """The four-byte header of one HDMV LPCM payload."""
    if len(data) >= 4:
        size, a, b = int.from_bytes(data[:2], "big"), data[2], data[3]
        rate, channels, bits = _LPCM_RATES.get(a & 15), _LPCM_CHANNELS.get(a >> 4), _LPCM_BITS.get(b >> 6)
        yield 0, 0, size + 4, "HDMV LPCM", rate, channels, (rate or 0) * (channels or 0) * (bits or 0), bits


def lpcm_to_wav(payloads: bytes, rate: int, channels: int, bits: int) -> bytes:
    """Big-endian samples as a WAV file: the bytes of each sample are turned round, a 20-bit one takes three."""
    size = {16: 2, 20: 3, 24: 3}[bits]
    usable = len(payloads) - len(payloads) % (size * channels)
    body = bytearray(usable)
    for k in range(size):
        body[k::size] = payloads[:usable][size - 1 - k :: size]
    head = b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + channels.to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * channels * size).to_bytes(4, "little") + (channels * size).to_bytes(2, "little") + (8 * size).to_bytes(2, "little") + b"data" + usable.to_bytes(4, "little")
    return b"RIFF" + (len(head) + usable).to_bytes(4, "little") + head + bytes(body)
