"""Splits and samples whose outcome is a function of row identity and seed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.noise import uniform
from ..session import with_input_position

POSITION_BITS = 33  # of an input position: the row's place in its split


def random_split(df: DataFrame, weights: list[float], seed: int) -> list[DataFrame]:
    """Bernoulli split of a DataFrame without a row id."""
    return df.randomSplit(weights, seed)


def split_by_id(df: DataFrame, row_id: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """A split that gives each id the same side on every run and cluster."""
    draw = uniform(F.col(row_id), seed=seed)
    return df.filter(draw < share), df.filter(draw >= share)


def sample_with_replacement(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Exactly ``k`` draws (``draw`` = 0..k-1), each the row at a uniform input position.

    One pass counts the rows of every split, so a draw's position tells its split and its
    place in there, which is the number that a scan gives to the row without any sort.
    The rows are then read once more and meet the draws by that number. Few draws are sent
    to the rows, which stay where they are; many are joined like any other table. A table
    behind a shuffle is written first, since its rows have no places before.
    """
    numbered = with_input_position(df, "_at")
    sizes = numbered.groupBy(F.shiftright("_at", POSITION_BITS).alias("split")).agg(F.count(F.lit(1)).alias("n")).orderBy("split").collect()
    splits = np.array([r["split"] for r in sizes], np.int64)
    ends = np.cumsum([r["n"] for r in sizes]).astype(np.int64)
    drawn = df.sparkSession.range(k).select(F.col("id").alias("draw"), uniform(F.col("id"), seed=seed).alias("u"))

    def place(batches):
        for batch in batches:
            position = np.floor(batch.column(1).to_numpy() * ends[-1]).astype(np.int64)
            split = np.searchsorted(ends, position, "right")
            at = (splits[split] << POSITION_BITS) + position - np.r_[0, ends[:-1]][split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], ["draw", "_at"])

    if not len(ends):
        return df.select(F.lit(0).cast("bigint").alias("draw"), "*").limit(0)
    return drawn.mapInArrow(place, "draw bigint, _at bigint").join(numbered, "_at").drop("_at")
