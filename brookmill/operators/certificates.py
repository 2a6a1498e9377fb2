"""Checks that a fitted model is where its problem has its optimum.

A library's optimiser may take any path, so its weights are not compared with another
run's. What each problem says of its optimum is measured instead, in one pass over the
data with map-side summed vectors: a gradient, a residual, or what a step would still win.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .learning import batch_sums, kmeans_totals


def logistic_gradient(rows: DataFrame, features: str, label: str, weights: Sequence[float]) -> np.ndarray:
    """Mean gradient of the logistic loss (no intercept, no penalty); 0 at the optimum."""
    w = np.asarray(weights, dtype=float)

    def fold(x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
        return {0: np.append(x.T @ (1.0 / (1.0 + np.exp(-(x @ w))) - y), len(y))}

    sums = np.array(batch_sums(rows.withColumn(label, F.col(label).cast("double")), [features, label], fold).first()["sums"])
    return sums[:-1] / sums[-1]


def hinge_gains(rows: DataFrame, features: str, label: str, weights: Sequence[float], reg: float, step: float) -> np.ndarray:
    """How much a step of ``step`` lowers ``mean hinge + reg / 2 |w|^2``, per dimension (the
    better of both directions) and, last, along the weights themselves (longer or shorter).

    The objective is convex, so at its optimum no step wins anything.
    """
    w = np.asarray(weights, dtype=float)
    steps = np.vstack([np.eye(len(w)) * step, w[None, :] * step])
    every = np.vstack([np.zeros_like(w), steps, -steps])

    def fold(x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
        sign = 2.0 * y - 1.0
        return {0: np.append(np.maximum(0.0, 1.0 - sign[:, None] * (x @ (w + every).T)).sum(axis=0), len(y))}

    sums = np.array(batch_sums(rows.withColumn(label, F.col(label).cast("double")), [features, label], fold).first()["sums"])
    value = sums[:-1] / sums[-1] + reg / 2 * ((w + every) ** 2).sum(axis=1)
    moved = value[1:].reshape(2, -1).min(axis=0)
    return value[0] - moved


def lloyd_costs(points: DataFrame, features: str, centres: Sequence[Sequence[float]]) -> tuple[float, float]:
    """Cost of the centres, and of the means of what is nearest to them: one step of
    assigning and averaging. Equal at a fixed point."""
    totals = kmeans_totals(points, features, np.asarray(centres, dtype=float))
    cost = sum(t[3] for t in totals)
    means = np.array([total / n for _, total, n, _ in totals])
    return cost, sum(t[3] for t in kmeans_totals(points, features, means))


def als_residuals(ratings: DataFrame, users: DataFrame, products: DataFrame, reg: float) -> DataFrame:
    """``(user, n, residual)``: how far each user's factors are from solving their normal
    equations, relative to the right-hand side.

    ``users`` and ``products`` are (id, factors) of the same length. With the products'
    factors q held, a user's p solves ``sum (r - q p) q = reg n p`` over the user's n
    ratings. The two sides are sums of vectors, added per dimension and map-side combined,
    so a user with very many ratings costs as many rows as there are tasks.
    """
    p = users.select(F.col("id").alias("user"), F.col("features").alias("_p"))
    q = products.select(F.col("id").alias("product"), F.col("features").alias("_q"))
    rows = ratings.join(q, "product").join(p, "user")
    said = F.aggregate(F.zip_with("_p", "_q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    rank = len(users.first()["features"])
    rows = rows.withColumn("_e", F.col("rating") - said)
    side = lambda d, value: F.sum(value * F.col("_q")[d].cast("double"))
    sums = rows.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("_p").alias("_p"),
        *[side(d, F.col("_e")).alias(f"_left{d}") for d in range(rank)], *[side(d, F.col("rating")).alias(f"_right{d}") for d in range(rank)])
    square = lambda terms: F.sqrt(sum((t * t for t in terms), F.lit(0.0)))
    gap = square([F.col(f"_left{d}") - reg * F.col("n") * F.col("_p")[d].cast("double") for d in range(rank)])
    return sums.select("user", "n", (gap / F.greatest(square([F.col(f"_right{d}") for d in range(rank)]), F.lit(1e-12))).alias("residual"))
