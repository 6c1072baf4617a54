"""Numbers and values given as text: of a table's column, as Column expressions, and of options, when a plan is made."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import gcd

_DIGITS = {2: "[01]+", 8: "[0-7]+", 10: r"\d+", 16: "[0-9a-fA-F]+"}


def parse_int(text: str, radix: int | None = None) -> int | None:
    """An integer in base 2, 8, 10 or 16. Without a radix the form decides: 0x.., ..h, 0b.., ..b, leading 0 or trailing o (octal), decimal, bare hex digits."""
    text = text.strip()
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text[1:] if text[:1] == "+" else text)
    low = body.lower()
    forms = [(16, r"0x([0-9a-f]+)"), (16, r"([0-9a-f]+)h"), (2, r"0b([01]+)"), (2, r"([01]+)b"), (8, r"0o?([0-7]+)"), (8, r"([0-7]+)o"), (10, r"(\d+)"), (16, r"([0-9a-f]+)")]
    if radix is not None:
        forms = [x for x in forms if x[0] == radix] + [(radix, f"({_DIGITS[radix].lower().replace('A-F', '')})")]
    for base, form in forms:
        if m := re.fullmatch(form, low):
            return sign * int(m[1], base)
    return None


def parse_range(text: str) -> tuple[int, int | None] | None:
    """``n``, ``n-``, ``-n``, ``a-b`` (inclusive); None at the end means without end."""
    first, dash, last = text.partition("-")
    if not text:
        return 0, None
    a, b = (parse_int(first) if first else 0), (parse_int(last) if last else None)
    if first and a is None or last and b is None or not (first or last):
        return None
    return (a, b) if dash else (a, a)


def parse_ranges(text: str) -> list[tuple[int, int | None]]:
    """``1,4-6,10`` as inclusive ranges; parts that are no range are left out."""
    return [r for part in text.split(",") if part and (r := parse_range(part.strip()))]


def parse_rational(text: str) -> Fraction | None:
    """``30000/1001``, ``25`` or ``29.97`` exactly."""
    m = re.fullmatch(r"\s*([+-]?\d+(?:\.\d+)?)\s*(?:[/:]\s*(\d+))?\s*", text)
    return Fraction(m[1]) / int(m[2] or 1) if m and (m[2] is None or int(m[2])) else None


def split_set(text: str, delimiters: str = ",;.:") -> list[str]:
    """Parts between any of the delimiters; empty middle parts stay, an empty tail goes."""
    parts = re.split(f"[{re.escape(delimiters)}]", text)
    return parts[:-1] if parts and parts[-1] == "" else parts


# -- columns ------------------------------------------------------------------

# Form, base, and the most digits that surely fit 64 bits, in the order in which forms are tried.
_FORMS = [("0x([0-9a-f]+)", 16), ("([0-9a-f]+)h", 16), ("0b([01]+)", 2), ("([01]+)b", 2), ("0o?([0-7]+)", 8), ("([0-7]+)o", 8), ("([0-9]+)", 10), ("([0-9a-f]+)", 16)]
_MOST = {2: 64, 8: 21, 10: 19, 16: 16}


def int_value(text: Column, radix: int | None = None) -> Column:
    """``parse_int`` of a column as a long: null where the text is null, no number, or outside -(2**63 - 1) .. 2**63 - 1."""
    low = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    body = F.regexp_replace(low, "^[+-]", "")
    forms = [x for x in _FORMS if radix in (None, x[1])] + ([(f"({_DIGITS[radix].replace('A-F', '')})", radix)] if radix else [])
    found = F.lit(None).cast("bigint")
    for form, base in reversed(forms):
        digits = F.regexp_replace(F.regexp_extract(body, f"^{form}$", 1), "^0+(?=.)", "")
        fits = F.when(F.length(digits) <= _MOST[base], digits)
        value = (fits if base == 10 else F.conv(fits, base, 10)).try_cast("bigint")
        found = F.when(body.rlike(f"^{form}$"), value).otherwise(found)
    return F.when(low.startswith("-"), -found).otherwise(found)


def rational_value(text: Column) -> Column:
    """``parse_rational`` of a column: a struct (n, d) in lowest terms, d > 0; null where the text is none, d is 0, or a part has more than 18 digits."""
    form = r"^\s*([+-]?)([0-9]+)(?:\.([0-9]+))?\s*(?:[/:]\s*([0-9]+))?\s*$"
    part = lambda k: F.regexp_extract(text, form, k)
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+(?=.)", "")
    scale = F.rpad(F.lit("1"), F.length(part(3)) + 1, F.lit("0"))
    below = F.regexp_replace(F.concat(F.when(part(4) == "", "1").otherwise(part(4)), F.substring(scale, F.lit(2), F.length(part(3)))), "^0+(?=.)", "")
    number = lambda x: F.when(F.length(x) <= 18, x).try_cast("bigint")
    n, d = number(digits), number(below)
    common = F.greatest(gcd(d, n), F.when(n == 0, d), F.lit(1))
    over = lambda x: F.call_function("div", x, common)
    return F.when(text.rlike(form) & n.isNotNull() & (d > 0), F.struct(over(F.when(part(1) == "-", -n).otherwise(n)).alias("n"), over(d).alias("d")))


def split_parts(text: Column, delimiters: str = ",;.:") -> Column:
    """``split_set`` of a column: parts between any of the delimiters; empty middle parts stay, one empty part at the end goes."""
    parts = F.split(text, f"[{re.escape(delimiters)}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
