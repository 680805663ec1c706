"""Time offsets as columns."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import div, half_even


def epoch_us(ts: Column, dtype: str) -> Column:
    """Microseconds since 1970 of a timestamp column with or without time zone, whatever the session's zone."""
    if dtype == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.unix_micros(ts)


def day(us: Column) -> Column:
    """ISO date of an epoch offset."""
    return F.date_add(F.lit("1970-01-01").cast("date"), div(us, 86_400_000_000).cast("int")).cast("string")


def format_offset(us: Column) -> Column:
    """``HH:MM:SS.mmm``; negative: zero; hours have as many digits as they need, milliseconds round half to even."""
    ms = half_even(F.greatest(us, F.lit(0)), 1000)
    return F.format_string("%02d:%02d:%02d.%03d", div(ms, 3_600_000), F.pmod(div(ms, 60_000), F.lit(60)), F.pmod(div(ms, 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def parse_offset(text: Column) -> Column:
    """Microseconds of ``HH:MM:SS.mmm`` or of a number of seconds, whichever ``text`` is; else null."""
    parts = F.split(F.trim(text), ":")
    seconds = F.get(parts, F.size(parts) - 1).try_cast("decimal(20,6)")
    minutes = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2).try_cast("long")).otherwise(0)
    hours = F.when(F.size(parts) > 2, F.get(parts, F.size(parts) - 3).try_cast("long")).otherwise(0)
    return F.when(F.size(parts) <= 3, (hours * 3600 + minutes * 60) * 1_000_000 + (seconds * 1_000_000).cast("long"))


def to_samples(us: Column, rate: int) -> Column:
    """Sample number of an offset, halves to the even one."""
    common = gcd(rate, 1_000_000)  # keeps offsets of centuries within a long
    return half_even(us * (rate // common), 1_000_000 // common)


def one_decimal(us: Column) -> Column:
    """Microseconds as seconds with one decimal, as C and Python print the nearest double: what lies half-way goes by which side
    of it that double is on, and to the even digit where it is on neither. The double's error is found without rounding, by parts
    of 26 bits."""
    d = us / F.lit(1e6)
    wide = d * 134217729.0
    high = wide - (wide - d)
    error = (us.cast("double") - high * 1e6) - (d - high) * 1e6  # above 0: the double is below
    tenths, rest = div(us, 100_000), F.pmod(us, F.lit(100_000))
    up = (rest > 50_000) | (rest == 50_000) & ((error < 0) | (error == 0) & (tenths % 2 == 1))
    total = tenths + up.cast("long")
    return F.concat(div(total, 10).cast("string"), F.lit("."), (total % 10).cast("string"))
