"""Deterministic 100-byte sort-benchmark records.

Each record holds a 10-byte key and a 90-byte value taken from a 128-bit linear
congruential sequence. A record depends on its number only: any task can start anywhere
in the sequence, so the table is the same for every partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixedwidth import fixed_binary

# fixed values: x' = STEP * x + SHIFT (mod 2^128), starting from zero
STEP = 0x2360ED051FC65DA44385DF649FCCF645
SHIFT = 0x4A696D47726179524950202020202001
# fixed values: marker bytes of the record layout
BREAK_AFTER_KEY = bytes.fromhex("0011")
BREAK_BEFORE_FILLER = bytes.fromhex("8899aabb")
END_MARK = bytes.fromhex("ccddeeff")

_ALL = (1 << 128) - 1
_HEX = np.frombuffer(b"0123456789ABCDEF", np.uint8)


def jump(n: int) -> tuple[int, int]:
    """(a, c) such that n steps of the sequence equal x -> a x + c."""
    a, c, step, shift = 1, 0, STEP, SHIFT
    while n:
        if n & 1:
            a, c = a * step & _ALL, (c * step + shift) & _ALL
        shift = shift * (step + 1) & _ALL
        step = step * step & _ALL
        n >>= 1
    return a, c


def _limbs(x: int) -> list[int]:
    return [(x >> (32 * i)) & 0xFFFFFFFF for i in range(4)]


def _affine(states: np.ndarray, a: int, c: int) -> np.ndarray:
    """a * x + c (mod 2^128) for rows of four little-endian 32-bit limbs."""
    al, cl = _limbs(a), _limbs(c)
    mask = np.uint64(0xFFFFFFFF)
    low = [np.full(len(states), cl[k], np.uint64) for k in range(4)]
    for i in range(4):
        for j in range(4 - i):
            product = states[:, i] * np.uint64(al[j])
            low[i + j] += product & mask
            if i + j < 3:
                low[i + j + 1] += product >> np.uint64(32)
    out = np.empty_like(states)
    carry = np.zeros(len(states), np.uint64)
    for k in range(4):
        total = low[k] + carry
        out[:, k] = total & mask
        carry = total >> np.uint64(32)
    return out


def states_from(first: int, count: int) -> np.ndarray:
    """The states of records ``first .. first + count - 1``, doubling the block each time."""
    _, start = jump(first + 1)
    block = np.array([_limbs(start)], np.uint64)
    while len(block) < count:
        block = np.vstack([block, _affine(block, *jump(len(block)))])
    return block[:count]


def states_at(numbers: np.ndarray) -> np.ndarray:
    """The states of arbitrary records: one masked step per bit of the record number."""
    steps = numbers.astype(np.uint64) + np.uint64(1)
    states = np.zeros((len(steps), 4), np.uint64)
    for bit in range(int(steps.max()).bit_length()):
        chosen = (steps >> np.uint64(bit)) & np.uint64(1) == 1
        if chosen.any():
            states[chosen] = _affine(states[chosen], *jump(1 << bit))
    return states


def record_block(numbers: np.ndarray) -> np.ndarray:
    """(n, 100) bytes for record numbers; runs of consecutive numbers are quickest."""
    n = len(numbers)
    consecutive = n < 2 or (np.diff(numbers) == 1).all()
    states = states_from(int(numbers[0]), n) if consecutive else states_at(numbers)
    raw = states[:, ::-1].astype(">u4").view(np.uint8).reshape(n, 16)  # big-endian bytes
    out = np.empty((n, 100), np.uint8)
    out[:, :10] = raw[:, :10]
    out[:, 10:12] = np.frombuffer(BREAK_AFTER_KEY, np.uint8)
    out[:, 12:28] = ord("0")
    shifts = np.arange(60, -4, -4, dtype=np.uint64)
    out[:, 28:44] = _HEX[(numbers.astype(np.uint64)[:, None] >> shifts) & np.uint64(15)]
    out[:, 44:48] = np.frombuffer(BREAK_BEFORE_FILLER, np.uint8)
    tail = raw[:, 10:16]
    digits = np.stack([tail >> 4, tail & 15], axis=2).reshape(n, 12)
    out[:, 48:96] = np.repeat(_HEX[digits], 4, axis=1)
    out[:, 96:] = np.frombuffer(END_MARK, np.uint8)
    return out


def _generate(batches):
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        if len(numbers):
            block = record_block(numbers)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), fixed_binary(block[:, :10]), fixed_binary(block[:, 10:])], ["number", "key", "value"]
            )


def records_for(numbers: DataFrame) -> DataFrame:
    """Records for a table with a bigint column of record numbers."""
    return numbers.select(F.col(numbers.columns[0]).cast("bigint")).mapInArrow(_generate, "number bigint, key binary, value binary")


def generate_records(spark: SparkSession, size_bytes: int, partitions: int) -> DataFrame:
    """``floor(size / 100 / partitions) * partitions`` records in number order."""
    count = size_bytes // 100 // partitions * partitions
    return records_for(spark.range(0, count, 1, partitions))
