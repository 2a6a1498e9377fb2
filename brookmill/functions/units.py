"""Unit scaling, size text and fixed-pattern number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp read as UTC."""
    return F.unix_millis(instant(ts))


def instant(ts: Column) -> Column:
    """A zone-less timestamp read as UTC, as a ``timestamp`` (event time needs one).

    In a UTC session this folds to a plain cast; elsewhere the wall clock is shifted first.
    """
    wall = ts.cast("timestamp_ntz")
    shifted = F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall)
    return F.when(F.current_timezone() == "UTC", wall.cast("timestamp")).otherwise(shifted.cast("timestamp"))


def whole(numerator: Column, denominator: Column | int) -> Column:
    """Truncating integer division; null when the divisor is zero."""
    den = F.lit(denominator) if isinstance(denominator, int) else denominator
    return F.call_function("div", numerator, F.nullif(den.cast("bigint"), F.lit(0).cast("bigint")))


def ms_to_s(col: Column) -> Column:
    return whole(col, 1000)


def bytes_to_mb(col: Column) -> Column:
    return whole(col, 1_000_000)


def ns_to_s(col: Column) -> Column:
    return whole(col, 1_000_000_000)


def busy_percent(idle: Column) -> Column:
    return F.lit(100.0) - idle


# fixed values: decimal size units
SIZE_UNITS = {"k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}


def size_to_bytes(text: Column) -> Column:
    """``'5G'`` -> 5000000000, ``'10k'`` -> 10000, ``'7'`` -> 7."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"^(\d+)", 1).try_cast("bigint")
    unit = F.regexp_extract(low, r"([kmgt])$", 1)
    factor = F.lit(1).cast("bigint")
    for name, size in SIZE_UNITS.items():
        factor = F.when(unit == name, F.lit(size).cast("bigint")).otherwise(factor)
    return number * factor


def bytes_to_size(count: Column) -> Column:
    """Floor to the largest unit that is strictly exceeded: 1000 -> ``1000B``, 1001 -> ``1KB``."""
    out = F.concat(count.cast("string"), F.lit("B"))
    for name, size in SIZE_UNITS.items():
        out = F.when(count > size, F.concat(whole(count, size).cast("string"), F.lit(name.upper() + "B"))).otherwise(out)
    return out


def pattern_number(col: Column, pattern: str) -> Column:
    """Format with a decimal pattern such as ``#.##``, ``#,###`` or ``#,### MB``."""
    return F.call_function("format_number", col, F.lit(pattern))
