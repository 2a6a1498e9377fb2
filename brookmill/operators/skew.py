"""Exact joins and groupings for keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# a key with fewer rows than this fits one task, whatever its share of the table
HEAVY_ROWS = 200_000
# a split of a heavy key is cut down to about this many rows
ROWS_PER_SALT = 2_000_000
# up to so many heavy keys (a few MB) are broadcast; beyond, joins with them are planned
# like any other, and adaptive skew joins split the keys
BROADCAST_KEYS = 65_536


def row_total(counts: DataFrame, weight: str) -> int:
    return counts.agg(F.sum(weight).alias("n")).first()["n"] or 0


def heavy_keys(counts: DataFrame, key: str, weight: str, rows: int | None = None) -> DataFrame | None:
    """``(key, salts)`` for all keys above ``rows`` rows, or None if there are none.

    ``counts`` (one row per key) should be materialised: it is read twice when heavy
    keys exist and once when not. Two numbers reach the driver.
    """
    limit = HEAVY_ROWS if rows is None else rows
    many = F.col(weight) > limit
    found = counts.agg(F.count(F.when(many, 1)).alias("n")).first()["n"]
    if not found:
        return None
    heavy = counts.filter(many).select(
        key, F.greatest(F.ceil(F.col(weight) / min(limit, ROWS_PER_SALT)), F.lit(2)).cast("int").alias("salts")
    )
    return F.broadcast(heavy) if found <= BROADCAST_KEYS else heavy


def salt_many(big: DataFrame, heavy: DataFrame, key: str, spread: Sequence[Column]) -> DataFrame:
    """Add ``_salt`` to the many side: 0 for light keys, 0..salts-1 for heavy ones."""
    return (
        big.join(heavy, key, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("salts")).cast("int"), F.lit(0)))
        .drop("salts")
    )


def salt_one(small: DataFrame, heavy: DataFrame, key: str) -> DataFrame:
    """Repeat each row of the other side once per salt of its key."""
    return (
        small.join(heavy, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
        .drop("salts")
    )


def skew_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    heavy: DataFrame | None,
    spread: Sequence[Column],
    hint: str | None = None,
) -> DataFrame:
    """Inner join of a many side with a side that is thin per key.

    ``heavy`` comes from :func:`heavy_keys` (None: the caller found no heavy key, and
    a plain join is planned). ``spread`` names what distinguishes rows of one key; ``hint``
    is a join hint for the thin side.
    """
    hinted = lambda df: df.hint(hint) if hint else df
    if heavy is None:
        return big.join(hinted(small), key)
    return salt_many(big, heavy, key, spread).join(hinted(salt_one(small, heavy, key)), [key, "_salt"]).drop("_salt")
