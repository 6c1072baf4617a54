"""A bit reader over bytes, with the variable-length numbers of the media standards."""

from __future__ import annotations

import struct


class Bits:
    """Reads from a bytes object; positions are in bits."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, len(data) * 8

    def left(self) -> int:
        return self.end - self.at

    def u(self, n: int) -> int:
        """n bits as an unsigned number."""
        if not n:
            return 0
        stop = self.at + n
        if stop > self.end:
            raise EOFError
        first, last = self.at >> 3, (stop + 7) >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - stop)
        self.at = stop
        return value & ((1 << n) - 1)

    def flag(self) -> bool:
        return bool(self.u(1))

    def peek(self, n: int) -> int:
        value = self.u(n)
        self.at -= n
        return value

    def skip(self, n: int) -> None:
        self.at += n

    def align(self) -> None:
        self.at = (self.at + 7) & ~7

    def s(self, n: int) -> int:
        """Two's complement."""
        v = self.u(n)
        return v - (1 << n) if v >> (n - 1) else v

    def ue(self) -> int:
        """Exp-Golomb."""
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 63:
                raise EOFError
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)

    def uvlc(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
        return 0xFFFFFFFF if zeros >= 32 else (1 << zeros) - 1 + self.u(zeros)

    def leb128(self) -> int:
        value = 0
        for k in range(8):
            byte = self.u(8)
            value |= (byte & 0x7F) << (7 * k)
            if not byte & 0x80:
                break
        return value

    def le(self, n_bytes: int) -> int:
        return int.from_bytes(self.u(8 * n_bytes).to_bytes(n_bytes, "big"), "little")

    def ns(self, n: int) -> int:
        """A number below n, with as few bits as that allows."""
        w = n.bit_length()
        m = (1 << w) - n
        v = self.u(w - 1)
        return v if v < m else (v << 1) - m + self.u(1)

    def su(self, n: int) -> int:
        return self.s(n)

    def latm(self) -> int:
        """A LATM value: two bits say how many bytes follow, less one."""
        return self.u(8 * (self.u(2) + 1))

    def vint(self, keep_marker: bool = False) -> int | None:
        """An EBML number; None when all its bits are set (unknown size)."""
        first = self.peek(8)
        if not first:
            raise EOFError
        n = 9 - first.bit_length()
        value = self.u(8 * n)
        if keep_marker:
            return value
        value &= (1 << (7 * n)) - 1
        return None if value == (1 << (7 * n)) - 1 else value

    def bytes(self, n: int) -> bytes:
        if self.at & 7:
            return bytes(self.u(8) for _ in range(n))
        start = self.at >> 3
        self.at += 8 * n
        return self.data[start : start + n]


def unescape_nal(data: bytes) -> bytes:
    """Removes emulation prevention: in 00 00 03 the last byte goes."""
    out, at = bytearray(), 0
    while (k := data.find(b"\x00\x00\x03", at)) >= 0:
        out += data[at : k + 2]
        at = k + 3
    return bytes(out + data[at:])


def escape_nal(data: bytes) -> bytes:
    """Inserts emulation prevention."""
    out, zeros = bytearray(), 0
    for byte in data:
        if zeros >= 2 and byte <= 3:
            out.append(3)
            zeros = 0
        out.append(byte)
        zeros = zeros + 1 if not byte else 0
    return bytes(out)


def extended_float(data: bytes) -> float:
    """An 80-bit IEEE number."""
    head, mantissa = struct.unpack(">HQ", data)
    if not head & 0x7FFF and not mantissa:
        return 0.0
    value = mantissa * 2.0 ** ((head & 0x7FFF) - 16383 - 63)
    return -value if head & 0x8000 else value
