"""Global positions, ranks and exact percentiles without a single-task window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.units import whole
from ..session import cut_lineage, with_input_position

# order statistics: a range of so many rows is sorted; a larger one is cut into cells
ROWS_AT_ONCE, CELLS = 100_000, 1024
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def rank_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", size: str | None = None
) -> DataFrame:
    """1-based rank of each row within ``keys`` (or in the whole table when empty), and the
    number of rows of its group as ``size`` if that is named.

    Rows are range-partitioned and sorted once; a rank is then the row's offset in its
    own partition plus the number of rows of that group in earlier partitions. The
    second part is a table of at most (partitions x groups) counts, so a group that
    holds most of the table is still ranked by many tasks. The input position breaks ties
    of ``order``, so that one value repeated over and over is split as well.
    """
    keys = list(keys)
    placed = with_input_position(df, "_tie").orderBy(*keys, *order, "_tie").drop("_tie")
    placed = cut_lineage(placed.withColumn("_mid", F.monotonically_increasing_id()))  # fixes the placement that both uses below refer to
    placed = placed.withColumn("_pid", F.shiftright("_mid", _ROW_BITS).cast("int"))
    earlier = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_pid", *keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    if size:
        offsets = offsets.withColumn(size, F.sum("_n").over(W.partitionBy(*keys)))
    offsets = offsets.drop("_n")
    if not keys:
        offsets = F.broadcast(offsets)  # one row per partition of the sort
    joined = placed.join(offsets, ["_pid", *keys])
    return joined.withColumn(name, F.col("_before") + F.col("_mid") - F.col("_first") + 1).drop(
        "_pid", "_mid", "_first", "_before"
    )


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Callable[[Column], Column]],
    limit: int = ROWS_AT_ONCE, cells: int = CELLS,
) -> DataFrame:
    """Exact values at sorted positions of each group: keys and one column per pick.

    A pick maps the group's row count to a 0-based position. First only counts per
    logarithmic value bucket are shuffled (at most a few thousand per group, map-side
    combined); they tell which bucket holds each position. A bucket of more than ``limit``
    rows is narrowed: its range is cut into ``cells`` equal ones, which are counted, and
    the one that holds the position takes its place, until it is small or holds one value
    only. So rounds follow the logarithm of the values' spread, every round shuffles counts,
    and only ``limit`` rows of a group and pick are ever brought together and sorted.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    bucket = F.floor(F.signum(number) * F.log2(F.abs(number) + 1.0) * 32).cast("int")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value, bucket.alias("_b"))
    group = W.partitionBy(*keys)
    counted = [F.count(F.lit(1)).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high")]
    before = lambda of: F.coalesce(F.sum("_n").over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = (
        rows.groupBy(*keys, "_b").agg(*counted)
        .withColumn("_base", before(group.orderBy("_b")))
        .withColumn("_total", F.sum("_n").over(group))
    )
    spots = F.array(*[F.struct(F.lit(n).alias("name"), pick(F.col("_total")).cast("bigint").alias("at")) for n, pick in picks.items()])
    inside = lambda at: (at >= F.col("_base")) & (at < F.col("_base") + F.col("_n"))
    wanted = (
        sizes.withColumn("_spot", F.explode(spots)).filter(inside(F.col("_spot.at")))
        .select(*keys, "_b", F.col("_spot.name").alias("_name"), (F.col("_spot.at") - F.col("_base")).alias("_at"), "_low", "_high", "_n")
    )
    wanted = cut_lineage(wanted)  # one row per group and pick
    where = [*keys, "_b", "_low", "_high"]
    large = (F.col("_n") > limit) & (F.col("_low") < F.col("_high"))

    def held(ranges: DataFrame) -> DataFrame:
        """The rows of some ranges, a range being part of a bucket."""
        return rows.join(ranges.select(*where).distinct(), [*keys, "_b"]).filter(F.col(value).between(F.col("_low"), F.col("_high")))

    while not wanted.filter(large).isEmpty():
        share = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))
        cell = F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")
        parts = held(wanted.filter(large)).groupBy(*where, cell.alias("_cell")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(value).alias("_first"), F.max(value).alias("_last"))
        parts = parts.withColumn("_base", before(W.partitionBy(*where).orderBy("_cell")))
        narrowed = wanted.filter(large).drop("_n").join(parts, where).filter(inside(F.col("_at"))).select(
            *keys, "_b", "_name", (F.col("_at") - F.col("_base")).alias("_at"), F.col("_first").alias("_low"), F.col("_last").alias("_high"), "_n")
        wanted = cut_lineage(wanted.filter(~large).unionByName(narrowed))

    single = F.col("_low") == F.col("_high")
    folded = held(wanted.filter(~single)).groupBy(*where, value).agg(F.count(F.lit(1)).alias("_n"))
    folded = folded.withColumn("_base", before(W.partitionBy(*where).orderBy(value)))
    found = folded.join(wanted.filter(~single).drop("_n"), where).filter(inside(F.col("_at"))).select(*keys, "_name", value)
    found = found.unionByName(wanted.filter(single).select(*keys, "_name", F.col("_low").alias(value)))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col(value))).alias(n) for n in picks])


def index_pick(p: float) -> Callable[[Column], Column]:
    """The position of ``sorted[floor(n * p)]``."""
    return lambda n: F.floor(n * F.lit(p))


def interpolated_percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Percentiles by the ``p (n + 1)`` rule: linear interpolation between neighbours,
    clamped to the smallest and largest value."""
    keys = list(keys)
    spot = lambda n, p: n.cast("double") * p + p
    low = lambda p: lambda n: F.least(F.greatest(F.floor(spot(n, p)), F.lit(1)), n) - 1
    high = lambda p: lambda n: F.least(F.greatest(F.floor(spot(n, p)), F.lit(1)), n - 1)
    picks = {f"{name}_low": low(p) for name, p in percents.items()} | {f"{name}_high": high(p) for name, p in percents.items()}
    found = order_statistics(df, keys, value, picks)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")

    def estimate(name: str, p: float) -> Column:
        at = spot(n, p)
        share = F.when((at < 1) | (at >= n), 0.0).otherwise(at - F.floor(at))
        return F.col(f"{name}_low") + share * (F.coalesce(F.col(f"{name}_high"), F.col(f"{name}_low")) - F.col(f"{name}_low"))

    return found.join(counts, keys).select(*keys, *[estimate(name, p).alias(name) for name, p in percents.items()])


def trim_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], percent: int) -> DataFrame:
    """Keep the 0-based ranks ``n*p/100 .. n*(100-p)/100``, both ends included."""
    ranked = rank_rows(df, keys, order, "_rank", "_size")
    low, high = whole(F.col("_size") * percent, 100), whole(F.col("_size") * (100 - percent), 100)
    return ranked.filter((F.col("_rank") - 1).between(low, high)).drop("_rank", "_size")
