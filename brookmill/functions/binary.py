"""Byte-array functions for fixed-width records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY_BYTES = 10
VALUE_BYTES = 90
RECORD_BYTES = KEY_BYTES + VALUE_BYTES


def record_key(record: Column) -> Column:
    return F.substring(record, 1, KEY_BYTES)


def record_value(record: Column) -> Column:
    return F.substring(record, KEY_BYTES + 1, VALUE_BYTES)


def prefix_number(key: Column, width: int = 7) -> Column:
    """The first ``width`` bytes read as an unsigned big-endian integer."""
    return F.conv(F.hex(F.substring(key, 1, width)), 16, 10).cast("bigint")


def key_hex(key: Column) -> Column:
    return F.lower(F.hex(key))


def unsigned_bytes(data: Column, width: int) -> Column:
    """The bytes as a space-separated list of numbers 0..255."""
    parts = [F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10) for i in range(width)]
    return F.concat_ws(" ", *parts)


def checksum_sum(data: Column) -> Column:
    """Aggregate: the sum of CRC-32 values, a checksum that ignores row order."""
    return F.sum(F.crc32(data).cast("decimal(28,0)")).cast("decimal(38,0)")


def wide_hex(number: Column) -> Column:
    """Lower-case hexadecimal of a decimal(38,0) of at most 110 bits without leading zeros."""
    base = F.lit(2**48).cast("decimal(38,0)")
    # the remainder is exact, and so is the division of what it leaves
    low = F.pmod(number, base)
    high = ((number - low) / base).cast("bigint")
    low = low.cast("bigint")
    text = F.when(high > 0, F.concat(F.hex(high), F.lpad(F.hex(low), 12, "0"))).otherwise(F.hex(low))
    return F.lower(text)
