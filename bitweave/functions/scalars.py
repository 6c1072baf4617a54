"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: int) -> Column:
    """Integer division of non-negative numbers."""
    return ((a - a % b) / b).cast("bigint")


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def human_readable(x: Column, base: int = 1000) -> Column:
    """Truncating K, M, G: two digits after the point, never rounded up."""
    out = F.when(x < base, x.cast("string"))
    for power, unit in ((1, "K"), (2, "M"), (3, "G")):
        size = base**power
        text = F.concat(_div(x, size).cast("string"), F.lit("."), F.lpad(_div((x % size) * 100, size).cast("string"), 2, "0"), F.lit(unit))
        out = out.otherwise(text) if power == 3 else out.when(x < base ** (power + 1), text)
    return out


def ellipsis(s: Column, width: int) -> Column:
    return F.when(F.length(s) + 3 <= width, s).otherwise(F.concat(F.substring(s, 1, width - 3), F.lit("...")))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps (64-bit numbers need at most 92); 0 where b is 0."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"]))


def _bare_year(text: Column) -> Column:
    """Spark writes years of five digits with a plus sign."""
    return F.ltrim(text, F.lit("+"))


def seconds_since(base_year: int, seconds: Column) -> Column:
    """UTC date and time of seconds since the start of 1904 or 1900.

    Whole numbers are exact; doubles become microseconds as a double holds them, from 2**59 on to the nearest 128 or more.
    """
    epoch = {1904: 2_082_844_800, 1900: 2_208_988_800}[base_year]
    at = F.timestamp_micros(F.unix_micros(F.timestamp_seconds(seconds)) - epoch * 1_000_000)
    return _bare_year(F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(at, "UTC"), "UTC"), "yyyy-MM-dd HH:mm:ss"))


def mjd_date(mjd: Column) -> Column:
    """Calendar date of a modified Julian day."""
    return F.date_add(F.lit("1858-11-17").cast("date"), mjd.cast("int"))


def mjd_text(mjd: Column) -> Column:
    """The same as year-month-day, also beyond the year 9999."""
    return _bare_year(mjd_date(mjd).cast("string"))


def hex_lines(data: Column, width: int = 16) -> Column:
    """Rows of a hex view: array of (at, hex, text). Each view is made once for the whole object and cut into lines."""
    digits = F.regexp_extract_all(F.hex(data), F.lit(f".{{1,{2 * width}}}"), F.lit(0))
    shown = F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    lines = F.arrays_zip(digits.alias("digits"), F.regexp_extract_all(shown, F.lit(f".{{1,{width}}}"), F.lit(0)).alias("text"))
    spaced = lambda x: F.rtrim(F.regexp_replace(x, "(..)", "$1 "))
    return F.transform(lines, lambda x, k: F.struct((k * width).cast("bigint").alias("at"), spaced(x["digits"]).alias("hex"), x["text"].alias("text")))


def spectrum_tuple(index: Column, signed: bool, dimension: int, lav: int) -> Column:
    """Codebook index to (w, x, y, z) or (y, z)."""
    mod, low = (2 * lav + 1, lav) if signed else (lav + 1, 0)
    out, rest = [], index
    for k in reversed(range(dimension)):
        out.append((_div(rest, mod**k) - low).cast("int"))
        rest = rest % mod**k
    return F.array(*out)
