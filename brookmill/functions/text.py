"""Tokenising and character-level text functions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

CHARACTERS_AT_ONCE = 1 << 16


# fixed values: what the pattern \s matches
WHITE_SPACE = " \t\n\x0b\f\r"


def tokens(line: Column) -> Column:
    """Split on runs of white space the way ``java.lang.String.split`` does.

    A leading empty token is kept, trailing empty tokens are dropped, an empty line
    gives one empty token and an all-blank line gives none. Trailing blanks are cut
    without a pattern, so each line is scanned by one regular expression only.
    """
    body = F.rtrim(line, F.lit(WHITE_SPACE))
    blank = (body == "") & (line != "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(body, r"\s+"))


def fields(line: Column, mark: str) -> Column:
    """Split on one literal character (space, comma, pipe, tab, newline)."""
    return F.split(line, "\\" + mark if mark in "|.*+?^$()[]{}" else mark)


def characters(line: Column) -> Column:
    return F.split(line, "")


def _by_line(lines: pd.Series, arrange: Callable[[np.ndarray, np.ndarray, list[str]], np.ndarray]) -> pd.Series:
    """Lines with their characters rearranged; null stays null.

    ``arrange`` gets the code points of several lines, the number of the line of each, and
    the lines, and gives back the code points in an order that keeps the lines apart.
    """
    out: list[str | None] = []

    def groups() -> Iterator[list[str | None]]:
        group, n = [], 0
        for line in lines:
            group.append(line)
            n += len(line) if line is not None else 0
            if n >= CHARACTERS_AT_ONCE:
                yield group
                group, n = [], 0
        yield group

    for group in groups():
        held = [line for line in group if line is not None]
        lengths = np.array([len(line) for line in held], np.int64)
        points = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
        text = arrange(points, np.repeat(np.arange(len(held)), lengths), held).astype(np.uint32).tobytes().decode("utf-32-le")
        ends = iter(np.cumsum(lengths).tolist())
        at = 0
        for line in group:
            if line is None:
                out.append(None)
            else:
                end = next(ends)
                out.append(text[at:end])
                at = end
    return pd.Series(out, dtype=object)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute_characters(line: Column, seed: int) -> Column:
    """A pseudo-random permutation of the characters of ``line``.

    The order is a function of text, position and seed only, so a retried task
    produces the same string again. Many lines are sorted at once, by line and hash.
    """
    hash_bits, row_bits, place_bits = 24, 16, 24

    def order(points: np.ndarray, rows: np.ndarray, held: list[str]) -> np.ndarray:
        hashes = _mixed(np.array([zlib.crc32(s.encode()) for s in held], np.uint64) + (np.uint64(seed % (1 << 31)) << np.uint64(32)))
        place = np.arange(len(points), dtype=np.uint64)
        keys = _mixed(hashes[rows] + place - first(rows, len(held))) >> np.uint64(64 - hash_bits)
        keys |= rows.astype(np.uint64) << np.uint64(hash_bits)
        # equal hashes keep their order, whatever else is sorted with them
        if len(points) >= 1 << place_bits or len(held) >= 1 << row_bits:
            return points[np.argsort(keys, kind="stable")]
        keys = np.sort((keys << np.uint64(place_bits)) | place)
        return points[keys & np.uint64((1 << place_bits) - 1)]

    def first(rows: np.ndarray, n: int) -> np.ndarray:
        """The place of the first character of each one's line."""
        return np.searchsorted(rows, np.arange(n)).astype(np.uint64)[rows]

    @F.pandas_udf("string")
    def permuted(lines: pd.Series) -> pd.Series:
        return _by_line(lines, order)

    return permuted(line)


def sorted_characters(line: Column) -> Column:
    """The characters of ``line`` in byte order: equal for all permutations."""

    def order(points: np.ndarray, rows: np.ndarray, held: list[str]) -> np.ndarray:
        # byte order of UTF-8 is the order of code points
        return np.sort((rows.astype(np.uint64) << np.uint64(32)) | points) & np.uint64((1 << 32) - 1)

    @F.pandas_udf("string")
    def in_order(lines: pd.Series) -> pd.Series:
        return _by_line(lines, order)

    return in_order(line)
