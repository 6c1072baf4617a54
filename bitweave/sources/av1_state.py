"""AV1 reference frames: what each frame header refers to, and what the eight slots hold after it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.bits import Bits
from .video import AV1_FRAMES, av1_obus, av1_sequence_header

KEY, INTER, INTRA_ONLY, SWITCH = range(4)
ALL, SLOTS = 0xFF, 8
STATE_ROWS = "tu long, obu long, frame long, frame_type string, shown boolean, existing int, order_hint int, refresh int, refs array<long>, slots array<long>"


@dataclass
class Held:
    """A decoded frame in a slot; of a missing one only the order hint is known."""

    frame: int | None
    kind: int
    hint: int


def _distance(a: int, b: int, bits: int) -> int:
    """How far order hint ``a`` lies after ``b``, both modulo 2**bits."""
    if not bits:
        return 0
    half = 1 << (bits - 1)
    return (a - b + half) % (2 * half) - half


def short_references(hints: list[int], now: int, bits: int, last: int, gold: int) -> list[int]:
    """The slots of LAST, LAST2, LAST3, GOLDEN, BWDREF, ALTREF2 and ALTREF, given only two of them (section 7.8 of the specification).

    Backward references are the furthest ahead (ALTREF) and the nearest two
    ahead, the rest go backwards in time; what finds nothing takes the earliest
    frame of all.  Of equal hints the backward search from afar and the forward
    search take the highest slot, the others the lowest.
    """
    ahead = [_distance(h, now, bits) for h in hints]
    refs: list[int | None] = [last, None, None, gold, None, None, None]
    free = set(range(SLOTS)) - {last, gold}

    def take(name: int, slots: list[int], key) -> None:
        if slots and refs[name] is None:
            refs[name] = max(slots, key=key)
            free.discard(refs[name])

    take(6, [i for i in free if ahead[i] >= 0], lambda i: (ahead[i], i))
    for name in (4, 5):
        take(name, [i for i in free if ahead[i] >= 0], lambda i: (-ahead[i], -i))
    for name in (1, 2, 4, 5, 6):
        take(name, [i for i in free if ahead[i] < 0], lambda i: (ahead[i], i))
    earliest = min(range(SLOTS), key=lambda i: (ahead[i], i))
    return [earliest if x is None else x for x in refs]


def frame_header(r: Bits, sequence: dict, slots: list[Held | None], temporal: int = 0, spatial: int = 0) -> dict:
    """The header up to its references: kind, shown, existing, hint, refresh, and refs (slots) of an inter frame.

    A slot whose order hint the header contradicts is emptied but for that hint.
    """
    f = {"kind": KEY, "shown": True, "existing": None, "hint": 0, "refresh": 0, "refs": None}
    resilient = True
    if not sequence["reduced"]:
        if r.flag():
            f["existing"] = r.u(3)
            held = slots[f["existing"]]
            if held is None or held.frame is None:
                raise ValueError("an empty slot is shown")
            return f | {"kind": held.kind, "hint": held.hint, "refresh": ALL if held.kind == KEY else 0}
        f["kind"], f["shown"] = r.u(2), r.flag()
        r.skip(sequence["time_len"] if f["shown"] else 1)
        resilient = f["kind"] == SWITCH or f["kind"] == KEY and f["shown"] or r.flag()
    intra = f["kind"] in (KEY, INTRA_ONLY)
    r.skip(1)
    screen = r.u(1) if sequence["screen_content"] is None else sequence["screen_content"]
    if screen and sequence["integer_mv"] is None:
        r.skip(1)
    r.skip(sequence["id_len"])
    if f["kind"] != SWITCH and not sequence["reduced"]:
        r.skip(1)
    f["hint"] = r.u(sequence["order_bits"])
    if not intra and not resilient:
        r.skip(3)
    if sequence["decoder_model"] and r.flag():
        for layers, modelled in sequence["points"]:
            if modelled and (not layers or layers >> temporal & 1 and layers >> (spatial + 8) & 1):
                r.skip(sequence["removal_len"])
    f["refresh"] = ALL if f["kind"] == SWITCH or f["kind"] == KEY and f["shown"] else r.u(8)
    bits = sequence["order_bits"]
    if bits and resilient and (not intra or f["refresh"] != ALL):
        for k in range(SLOTS):
            hint = r.u(bits)
            if slots[k] is None or slots[k].hint != hint:
                slots[k] = Held(None, INTER, hint)
    if not intra:
        f["refs"] = _references(r, sequence, slots, f["hint"])
    return f


def _references(r: Bits, sequence: dict, slots: list[Held | None], hint: int) -> list[int]:
    if sequence["order_bits"] and r.flag():
        last, gold = r.u(3), r.u(3)
        refs = short_references([x.hint if x else 0 for x in slots], hint, sequence["order_bits"], last, gold)
        r.skip(7 * sequence["delta_id_len"])
        return refs
    refs = []
    for _ in range(7):
        refs.append(r.u(3))
        r.skip(sequence["delta_id_len"])
    return refs


def av1_reference_state(data: bytes) -> Iterator[tuple]:
    """A row for each frame header of the low-overhead format, once a sequence header is known.

    ``frame`` counts the decoded frames; a header that shows a stored one has
    that one's number.  ``refs`` are the numbers of the frames that LAST to
    ALTREF refer to, ``slots`` those in the eight slots afterwards (null: empty).
    """
    sequence, slots, n = None, [None] * SLOTS, 0
    for tu, obu, kind, _, temporal, spatial, at, size in av1_obus(data):
        head = Bits(data, at * 8)
        head.skip(5)
        extended, sized = head.u(1), head.u(1)
        head.skip(1 + 8 * extended)
        if sized:
            head.leb128()
        body = data[head.at >> 3 : at + size]
        if kind == 1:
            sequence = av1_sequence_header(body, tools=True)
        elif kind in (3, 6) and sequence is not None:
            f = frame_header(Bits(body), sequence, slots, temporal, spatial)
            if f["existing"] is None:
                now, n = Held(n, f["kind"], f["hint"]), n + 1
            else:
                now = slots[f["existing"]]
            refs = None if f["refs"] is None else [slots[k].frame if slots[k] else None for k in f["refs"]]
            slots = [now if f["refresh"] >> k & 1 else x for k, x in enumerate(slots)]
            yield tu, obu, now.frame, AV1_FRAMES[f["kind"]], f["shown"], f["existing"], f["hint"], f["refresh"], refs, [x.frame if x else None for x in slots]
