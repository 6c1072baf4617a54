"""Text helpers as Column expressions: prefixes, URIs (RFC 3986), and turned bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five parts of a URI reference (RFC 3986, appendix B); each part's group, and the group that says whether it is there.
_URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
_PARTS = {"scheme": (2, 1), "authority": (4, 3), "path": (5, None), "query": (7, 6), "fragment": (9, 8)}


def starts_with(text: Column, prefix: str, ignore_case: bool = False) -> Column:
    return F.lower(text).startswith(prefix.lower()) if ignore_case else text.startswith(prefix)


def ends_with(text: Column, suffix: str, ignore_case: bool = False) -> Column:
    return F.lower(text).endswith(suffix.lower()) if ignore_case else text.endswith(suffix)


def uri_part(uri: Column, part: str) -> Column:
    """One part; null where the reference doesn't have it, which differs from an empty one."""
    group, mark = _PARTS[part]
    found = F.regexp_extract(uri, _URI, group)
    return found if mark is None else F.when(F.regexp_extract(uri, _URI, mark) != "", found)


def uri_join(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    """The parts put together again."""
    given = lambda before, x, after="": F.coalesce(F.concat(F.lit(before), x, F.lit(after)), F.lit(""))
    return F.concat(given("", scheme, ":"), given("//", authority), F.coalesce(path, F.lit("")), given("?", query), given("#", fragment))


def percent_decode(text: Column) -> Column:
    """Percent-encoded bytes as UTF-8; a plus sign is a plus sign."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def swap_bytes(value: Column, size: int) -> Column:
    """An unsigned integer of ``size`` bytes (up to 7) with its bytes in the other order."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    turned = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.conv(turned, 16, 10).cast("bigint")


def fixed_width(columns: dict[str, tuple[Column, int]]) -> Column:
    """A line of text for a listing: each value in its width, numbers (a negative width) to the right; longer values are cut."""
    cells = [F.lpad(x.cast("string"), -n, " ") if n < 0 else F.rpad(F.coalesce(x.cast("string"), F.lit("")), n, " ") for x, n in columns.values()]
    return F.rtrim(F.concat_ws("  ", *cells))
