"""Total-order sort and validation of keyed records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.binary import checksum_sum, prefix_number, wide_hex
from ..functions.units import whole
from ..session import with_input_position

PREFIX_SPACE = 2**56 - 1  # the first seven key bytes as a number


def prefix_partition(key: Column, partitions: int) -> Column:
    """Range partition id from the key prefix alone; the top prefixes are clamped."""
    share = PREFIX_SPACE // partitions
    return F.least(F.lit(partitions - 1), whole(prefix_number(key), share).cast("int"))


def sort_records(records: DataFrame, partitions: int, sampled: bool = True) -> DataFrame:
    """Order all records by key in one exchange.

    ``sampled`` picks range boundaries from the data, with the input position as tie
    break, so that a crowded prefix or one repeated key is split over tasks. Without it
    the partition follows from the key prefix alone: no sampling pass, right for evenly
    spread keys.
    """
    if sampled:
        tied = with_input_position(records, "_tie")
        return tied.repartitionByRange(partitions, "key", "_tie").sortWithinPartitions("key", "_tie").drop("_tie")
    placed = records.withColumn("_pid", prefix_partition(F.col("key"), partitions))
    return placed.repartitionById(partitions, "_pid").sortWithinPartitions("key").drop("_pid")


SEGMENT = (
    "path string, first_record bigint, last_record bigint, n bigint, "
    "first_key binary, last_key binary, disorders bigint, crc decimal(38,0)"
)


def _segments(batches):
    """Fold a task's rows into runs of consecutive records of one file.

    A run remembers its ends only, so the check needs no shuffle and no sorted group in
    memory. Rows that arrive out of sequence merely start a new run.
    """
    held: list | None = None

    def emit(run):
        columns = [[v] for v in run]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.decimal128(38, 0)]
        columns[-1] = [int(run[-1])]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, [f.strip().split(" ")[0] for f in SEGMENT.replace("(38,0)", "").split(",")])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        path, record, key, crc = (batch.column(i) for i in range(4))
        numbers = record.to_numpy()
        files = path.dictionary_encode().indices.to_numpy()
        names = path.dictionary_encode().dictionary
        breaks = np.flatnonzero((np.diff(numbers) != 1) | (np.diff(files) != 0)) + 1
        edges = [0, *breaks.tolist(), batch.num_rows]
        checks = crc.to_numpy()
        for a, z in zip(edges, edges[1:]):
            keys = key.slice(a, z - a)
            wrong = pc.sum(pc.greater(keys.slice(0, len(keys) - 1), keys.slice(1))).as_py() or 0
            name = names[files[a]].as_py()
            total = int(checks[a:z].sum(dtype=np.uint64))
            first, last = keys[0].as_py(), keys[len(keys) - 1].as_py()
            if held and held[0] == name and held[2] + 1 == numbers[a]:
                held[2], held[3] = int(numbers[z - 1]), held[3] + z - a
                held[6] += wrong + (held[5] > first)
                held[5], held[7] = last, held[7] + total
            else:
                if held:
                    yield emit(held)
                held = [name, int(numbers[a]), int(numbers[z - 1]), z - a, first, last, wrong, total]
    if held:
        yield emit(held)


def order_segments(records: DataFrame, whole_record: bool = False) -> DataFrame:
    """Per scan split: row count, first and last key, adjacent rows out of order, CRC sum."""
    body = F.concat("key", "value") if whole_record else F.col("key")
    return records.select("path", "record", "key", F.crc32(body).alias("crc")).mapInArrow(_segments, SEGMENT)


def segment_gaps(segments: DataFrame) -> DataFrame:
    """Segments with the last key before them and whether the border is in order.

    The window has one row per scan split, not per record; empty files have no row.
    """
    order = W.orderBy("path", "first_record")
    return segments.withColumn("previous_key", F.lag("last_key").over(order)).withColumn(
        "in_order", F.coalesce(F.col("previous_key") <= F.col("first_key"), F.lit(True))
    )


def validate_records(records: DataFrame, whole_record: bool = False) -> DataFrame:
    """One row: record count, checksum, disorder inside splits and across borders."""
    gaps = segment_gaps(order_segments(records, whole_record))
    return gaps.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        wide_hex(F.sum("crc").cast("decimal(38,0)")).alias("checksum"),
        F.coalesce(F.sum("disorders"), F.lit(0)).alias("inside_disorders"),
        F.count(F.when(~F.col("in_order"), F.lit(1))).alias("border_disorders"),
    )


def border_violations(records: DataFrame) -> DataFrame:
    return segment_gaps(order_segments(records)).filter(~F.col("in_order"))


RUN_LENGTH = 1_000_000


def adjacent_violations(records: DataFrame, group: str, position: str) -> DataFrame:
    """Rows whose key is below the key just before them, for tables without scan order.

    Groups are cut into runs of positions, so that one long group is checked by many
    tasks; the last key of the run before comes from a table with one row per run.
    """
    rows = records.withColumn("_run", F.floor(F.col(position) / RUN_LENGTH))
    ends = rows.groupBy(group, "_run").agg(F.max_by("key", position).alias("_end"))
    before = F.lag("_end").over(W.partitionBy(group).orderBy("_run"))
    borders = ends.withColumn("_border", before).drop("_end")
    inside = F.lag("key").over(W.partitionBy(group, "_run").orderBy(position))
    return (
        rows.withColumn("_inside", inside).join(borders, [group, "_run"])
        .withColumn("previous_key", F.coalesce("_inside", "_border"))
        .filter(F.col("previous_key") > F.col("key"))
        .drop("_run", "_inside", "_border")
    )


def checksum(records: DataFrame) -> DataFrame:
    return records.agg(wide_hex(checksum_sum(F.col("key"))).alias("checksum"))


def partition_ends(records: DataFrame, part: str, position: str) -> DataFrame:
    """First and last key of each partition by position, and its row count."""
    return records.groupBy(part).agg(
        F.min_by("key", position).alias("first_key"), F.max_by("key", position).alias("last_key"), F.count(F.lit(1)).alias("n")
    )
