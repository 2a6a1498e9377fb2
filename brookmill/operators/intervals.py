"""Joins of points in time with closed intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    start: str,
    end: str,
    width: int,
    on: Sequence[str] = (),
) -> DataFrame:
    """Every (point, interval) with ``start <= at <= end``, as an equi-join on time
    buckets of ``width`` plus a residual filter.

    A point sits in exactly one bucket, so a match appears once. Choose ``width`` near
    the usual interval length. Output is one row per match; where only an aggregate is
    wanted, :func:`interval_totals` avoids listing the matches.
    """
    left = points.withColumn("_bucket", F.floor(F.col(at) / width))
    right = intervals.filter(F.col(start) <= F.col(end)).withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    )
    return (
        left.join(right, ["_bucket", *on])
        .filter(F.col(at).between(F.col(start), F.col(end)))
        .drop("_bucket")
    )


def prefix_sums(df: DataFrame, by: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """``df`` with each of ``values`` replaced by its running sum within ``by``, in the
    order of ``at``, rows of the same ``at`` included. Nulls add nothing.

    Rows are range-partitioned once. Every partition sums its own stretch of each group,
    and a table of (partitions x groups) totals tells what lies before it, so a group that
    holds most of the table is summed by many tasks.
    """
    by = list(by)
    # written, so that both uses below refer to the same placement
    placed = cut_lineage(df.repartitionByRange(*by, at).withColumn("_pid", F.spark_partition_id()))
    group = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy("_pid", *by).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = before.select("_pid", *by, *[F.coalesce(F.sum(f"_{v}").over(group), F.lit(0)).alias(f"_{v}") for v in values])
    own = W.partitionBy("_pid", *by).orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    inside = placed.select(*[c for c in placed.columns if c not in values], *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(v) for v in values])
    joined = inside.join(before, ["_pid", *by])
    return joined.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in values else F.col(c) for c in df.columns])


def interval_totals(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    start: str,
    end: str,
    by: Sequence[str],
    values: Sequence[str],
    interval_id: Sequence[str],
    scale: int = 9,
) -> DataFrame:
    """Sum and count of ``values`` of the points in each interval, per ``by`` group.

    An interval is the difference of two running sums: up to its end and up to just before
    its start. Both ends of every interval are asked of every group; askers and points are
    sorted together, so the answer is the running sum at the asker's own place. The cost
    per (interval, group), which is the size of the answer, is two rows whatever the
    interval's length, and no block of time is shared by many. ``at`` and the ends are whole
    numbers. Fractions are summed exactly, to ``scale`` decimal places, so that long running
    sums lose nothing. Result columns: ``interval_id``, ``by``, ``<value>_sum`` and
    ``<value>_n`` (null and NaN left out), for groups with a point in the interval.
    """
    by, ids = list(by), list(interval_id)
    kinds = dict(points.select(*values).dtypes)
    whole = {v: kinds[v] in ("tinyint", "smallint", "int", "bigint") for v in values}

    def total(v: str):
        ok = F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
        exact = F.col(v).cast("bigint" if whole[v] else f"decimal(28,{scale})")
        return [F.sum(F.when(ok, exact)).cast("bigint" if whole[v] else f"decimal(38,{scale})").alias(f"{v}_sum"),
                F.count(F.when(ok, F.lit(1))).alias(f"{v}_n")]

    moments = points.groupBy(*by, F.col(at).cast("bigint").alias("_at")).agg(F.count(F.lit(1)).alias("_rows"), *[c for v in values for c in total(v)])
    moments = cut_lineage(moments)  # summed, and asked for its groups
    summed = [c for c in moments.columns if c not in (*by, "_at")]
    ends = intervals.filter(F.col(start) <= F.col(end)).select(
        *ids, F.explode(F.array(F.struct((F.col(start) - 1).cast("bigint").alias("at"), F.lit(-1).alias("sign")),
                                F.struct(F.col(end).cast("bigint").alias("at"), F.lit(1).alias("sign")))).alias("_e"))
    asked = ends.select(*ids, F.col("_e.at").alias("_at"), F.col("_e.sign").alias("_sign")).crossJoin(moments.select(*by).distinct())
    sums = prefix_sums(moments.unionByName(asked, allowMissingColumns=True), by, "_at", summed)
    answers = sums.filter(F.col("_sign").isNotNull()).groupBy(*ids, *by).agg(*[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in summed])
    back = lambda v: F.when(F.col(f"{v}_n") > 0, F.col(f"{v}_sum").cast("bigint" if whole[v] else "double"))
    return answers.filter(F.col("_rows") > 0).select(
        *ids, *by, *[c for v in values for c in (back(v).alias(f"{v}_sum"), F.col(f"{v}_n").cast("bigint").alias(f"{v}_n"))])
