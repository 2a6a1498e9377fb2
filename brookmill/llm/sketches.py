"""Mergeable sketches of fixed size, built per task and merged by a tree of shuffles."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

PIECES = 64  # a sketch travels in so many pieces, so that no task merges all of it
FAN_IN = 32  # groups of tasks merged apart before they meet
SCHEMA = "part int, piece int, data binary"


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit values (finaliser of the splitmix generator)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slots(values: np.ndarray, seed: int, bits: int) -> np.ndarray:
    """A slot in a row of ``2**bits`` counters."""
    return (mix(values, seed) >> np.uint64(64 - bits)).astype(np.int64)


class SeenTwice:
    """Rows of counters that stop at two, kept as one bit for "once" and one for "twice".

    With each value counted in all rows it is a pair of Bloom filters, and the least
    counter of a value is a count-min estimate: never below its true count (up to two).
    """

    def __init__(self, bits: int, rows: int):
        self.bits, self.rows = bits, rows
        self.once = np.zeros((rows, 2**bits // 8), np.uint8)
        self.twice = np.zeros_like(self.once)

    def add(self, values: np.ndarray) -> None:
        """Count each entry of ``values`` once more."""
        for r in range(self.rows):
            at, n = np.unique(slots(values, r, self.bits), return_counts=True)
            byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
            old = (self.once[r, byte] & bit) != 0
            again = old | (n > 1)
            np.bitwise_or.at(self.twice[r], byte[again], bit[again])
            np.bitwise_or.at(self.once[r], byte, bit)

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        once, twice = self.once.reshape(-1), self.twice.reshape(-1)
        width = len(once) // PIECES
        for k in range(PIECES):  # piece by piece, so that no second copy of the whole is made
            part = slice(k * width, (k + 1) * width)
            if once[part].any():
                yield k, zlib.compress(np.stack([once[part], twice[part]]).tobytes(), 1)


def merge_twice(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.reshape(2, -1), b.reshape(2, -1)
    return np.stack([a[0] | b[0], a[1] | b[1] | (a[0] & b[0])]).reshape(-1)


def as_table(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, piece, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(piece, pa.int32()), pa.array(data, pa.binary())], ["part", "piece", "data"])


def task_number() -> int:
    return TaskContext.get().partitionId()


def merged(parts: DataFrame, dtype: type, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """All parts of each piece merged into one, as a stream, in two levels; the pieces that
    are not empty then go to the driver (the sketch has a fixed size)."""

    def fold(batches):
        state: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, piece, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                got = np.frombuffer(zlib.decompress(data), dtype)
                old = state.get((part, piece))
                state[part, piece] = got if old is None else combine(old, got)
        for (part, piece), value in state.items():
            yield as_table([(part, piece, zlib.compress(value.tobytes(), 1))])

    for groups in (FAN_IN, 1):
        parts = parts.withColumn("part", F.pmod(F.col("part"), F.lit(groups)).cast("int"))
        parts = parts.repartition("part", "piece").mapInArrow(fold, SCHEMA)
    return {r["piece"]: np.frombuffer(zlib.decompress(r["data"]), dtype) for r in parts.collect()}


def seen_twice(values: DataFrame, bits: int, rows: int, read: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The "twice" bits, one row of bytes per counter row, over all that ``read`` gives."""

    def build(batches):
        sketch = SeenTwice(bits, rows)
        for batch in batches:
            got = read(batch)
            if len(got):
                sketch.add(got)
        for k, data in sketch.pieces():
            yield as_table([(task_number(), k, data)])

    pieces = merged(values.mapInArrow(build, SCHEMA), np.uint8, merge_twice)
    out = np.zeros(rows * 2**bits // 8, np.uint8)
    width = len(out) // PIECES
    for k, piece in pieces.items():
        out[k * width:(k + 1) * width] = piece.reshape(2, -1)[1]
    return out.reshape(rows, -1)


def repeated(twice: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    """Whether each value's estimate is two: true for all that were counted twice."""
    found = np.ones(len(values), bool)
    for r in range(len(twice)):
        at = slots(values, r, bits)
        found &= (twice[r][at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
    return found
