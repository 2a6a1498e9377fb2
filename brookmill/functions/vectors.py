"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def doubles(col: Column) -> Column:
    return col.cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; raises when the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("double")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def divide(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x / by)


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(point: Column, centres: Sequence[Sequence[float]]) -> Column:
    """``struct<dist, idx>`` of the closest centre; the lowest index wins a tie.

    The centres are a literal (k x d numbers), so no join and no shuffle is needed.
    """
    options = [
        F.struct(squared_distance(point, literal_vector(c)).alias("dist"), F.lit(i).alias("idx"))
        for i, c in enumerate(centres)
    ]
    return F.array_min(F.array(*options))
