"""Clock arithmetic on BIGINT ticks; wrap-around is modular arithmetic, never a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ATC_WRAP = 1 << 30
PTS_WRAP = 1 << 33
PCR_WRAP = (1 << 33) * 300
#: Ticks per second of the clocks in use.
RATES = {"27M": 27_000_000, "90K": 90_000, "45K": 45_000, "hns": 10_000_000, "ms": 1000, "s": 1}


def step(now: Column, before: Column, wrap: int, compat: bool = False) -> Column:
    """Ticks from one reading to the next. compat: equal readings count as a whole wrap."""
    plain = F.pmod(now - before, F.lit(wrap))
    return F.when(now > before, now - before).otherwise(now - before + wrap) if compat else plain


def to_27m(ticks90: Column) -> Column:
    return ticks90 * 300


def ticks_to_ms(ticks27: Column) -> Column:
    """Milliseconds and the rest: ``t div 27000 . t % 27000 div 27``."""
    whole = (ticks27 - F.pmod(ticks27, F.lit(27000))) / 27000
    rest = (F.pmod(ticks27, F.lit(27000)) - F.pmod(F.pmod(ticks27, F.lit(27000)), F.lit(27))) / 27
    return F.concat(whole.cast("bigint").cast("string"), F.lit("."), F.lpad(rest.cast("bigint").cast("string"), 3, "0"))


def _whole(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative numbers. A quotient of decimals is rounded to six places, which can lift it to the next number."""
    return F.call_function("div", a, b).cast("bigint")


def convert(ticks: Column, source: str, target: str) -> Column:
    """Integer conversion between clock rates, truncating, in 38-digit arithmetic."""
    a, b = RATES[source], RATES[target]
    return F.floor(ticks.cast("decimal(38,0)") * b / F.lit(a).cast("decimal(12,0)")).cast("bigint") if a % b and b % a else (ticks * (b // a) if b >= a else F.floor((ticks - F.pmod(ticks, F.lit(a // b))) / (a // b)).cast("bigint"))


def signed_difference(a: Column, b: Column, wrap: int) -> Column:
    """a - b on a clock that wraps: the nearer way round."""
    d = F.pmod(a - b, F.lit(wrap))
    return F.when(d >= wrap // 2, d - wrap).otherwise(d)


def rate_bps(n_bytes: Column, ticks27: Column) -> Column:
    """Bits per second of bytes sent during some 27 MHz ticks; null where no time passed."""
    product = n_bytes.cast("decimal(38,0)") * (8 * 27_000_000)
    return F.when(ticks27 > 0, _whole(product, ticks27.cast("decimal(38,0)")))


def ntp_to_hns(seconds: Column, fraction: Column) -> Column:
    """100 ns units of an NTP timestamp."""
    return seconds * 10_000_000 + F.shiftright(fraction.cast("bigint") * 10_000_000, 32)


def ntp_to_90k(seconds: Column, fraction: Column) -> Column:
    return F.pmod(seconds * 90_000 + F.shiftright(fraction.cast("bigint") * 90_000, 32), F.lit(PTS_WRAP))


def same_pts(a: Column, b: Column) -> Column:
    """Equal within a tolerance of 512 ticks."""
    return F.shiftright(a, 9) == F.shiftright(b, 9)
