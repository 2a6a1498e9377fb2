"""Clustering, linear classification and matrix factorisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, functions as F

from .sampling import sample_with_replacement

SVM_PENALTY = 0.01
PAIR_ROWS = 1 << 18  # ratings in one partition of pairs


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as an (n, d) float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def batch_sums(df: DataFrame, columns: Sequence[str], fold: Callable[..., dict[int, np.ndarray]]) -> DataFrame:
    """Element-wise vector sums per group: ``(grp, sums array<double>)``.

    ``fold`` turns one Arrow batch (the matrices of ``columns``) into ``{group: vector}``.
    A task keeps one running vector per group, so it emits as many rows as there are
    groups however many rows it reads; the sums are then added dimension by dimension.
    """

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            arrays = [
                _matrix(batch.column(i)) if pa.types.is_list(batch.schema.field(i).type) else batch.column(i).to_numpy(zero_copy_only=False)
                for i in range(batch.num_columns)
            ]
            for group, vector in fold(*arrays).items():
                held[group] = held[group] + vector if group in held else vector
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))],
            ["grp", "sums"],
        )

    partial = df.select(*columns).mapInArrow(run, "grp int, sums array<double>")
    return (
        partial.select("grp", F.posexplode("sums").alias("dim", "x"))
        .groupBy("grp", "dim")
        .agg(F.sum("x").alias("x"))
        .groupBy("grp")  # d numbers per group from here on
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("sums"))
    )


def _assign(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dist = np.empty((len(points), len(centres)))
    for i, c in enumerate(centres):
        delta = points - c
        dist[:, i] = np.einsum("nd,nd->n", delta, delta)
    best = dist.argmin(axis=1)  # the lowest index wins a tie
    return best, dist[np.arange(len(points)), best]


def kmeans_totals(points: DataFrame, features: str, centres: np.ndarray) -> list[tuple[int, np.ndarray, float, float]]:
    """Per non-empty cluster: (index, vector sum, row count, squared distance sum).

    Only k rows of d + 2 numbers reach the driver.
    """

    def fold(matrix: np.ndarray) -> dict[int, np.ndarray]:
        best, dist = _assign(matrix, centres)
        out = {}
        for i in np.unique(best):
            mine = best == i
            out[int(i)] = np.concatenate([matrix[mine].sum(axis=0), [mine.sum(), dist[mine].sum()]])
        return out

    rows = batch_sums(points, [features], fold).orderBy("grp").collect()
    return [(r["grp"], np.array(r["sums"][:-2]), r["sums"][-2], r["sums"][-1]) for r in rows]


def wcss(points: DataFrame, features: str, centres: np.ndarray) -> float:
    """Within-cluster sum of squared distances."""
    return float(sum(t[3] for t in kmeans_totals(points, features, np.asarray(centres, dtype=float))))


def kmeans_naive(
    points: DataFrame,
    features: str,
    k: int,
    iters: int,
    init: Sequence[Sequence[float]] | None = None,
    seed: int = 11,
) -> tuple[np.ndarray, np.ndarray]:
    """Exactly ``iters`` rounds of assign and average; returns (start, final) centres.

    Without ``init``, k rows are drawn with replacement. A cluster that loses all its
    points disappears, so fewer than k centres may come back.
    """
    if init is None:
        drawn = sample_with_replacement(points, k, seed).orderBy("draw").select(features).collect()
        init = [row[0] for row in drawn]
    start = np.asarray(init, dtype=float)
    centres = start
    for _ in range(iters):
        centres = np.array([total / n for _, total, n, _ in kmeans_totals(points, features, centres)])
    return start, centres


def assign_clusters(points: DataFrame, features: str, centres: np.ndarray) -> DataFrame:
    """Add ``cluster`` and ``dist`` (squared) of the nearest centre to each point."""
    centres = np.asarray(centres, dtype=float)
    names = points.columns
    at = names.index(features)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches):
        for batch in batches:
            matrix = _matrix(batch.column(at))
            best, dist = _assign(matrix, centres) if len(matrix) else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best.astype(np.int32)), pa.array(dist)],
                [*names, "cluster", "dist"],
            )

    return points.mapInArrow(run, schema + ", cluster int, dist double")


def kmeans_library(points: DataFrame, features: str, k: int, iters: int, seed: int = 1):
    """Library k-means with random start; returns (model, cost)."""
    vectors = points.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=iters, initMode="random", seed=seed).fit(vectors)
    return model, model.summary.trainingCost


def gradient_descent(
    rows: DataFrame, features: str, label: str, dims: int, loss: str, rounds: int, step: float
) -> np.ndarray:
    """Full-batch descent from zero weights with a fixed step; labels are 0 or 1.

    ``loss`` is ``logistic`` or ``hinge``. Each round is one pass that emits ``dims``
    sums per task; only the weights travel to the driver.
    """
    if loss not in ("logistic", "hinge"):
        raise ValueError(f"unknown loss {loss!r}")
    weights = np.zeros(dims)

    for _ in range(rounds):
        def fold(x: np.ndarray, y: np.ndarray, w=weights) -> dict[int, np.ndarray]:
            margin = x @ w
            if loss == "logistic":
                slope = 1.0 / (1.0 + np.exp(-margin)) - y
            else:
                sign = 2.0 * y - 1.0
                slope = np.where(sign * margin < 1.0, -sign, 0.0)
            return {0: np.append(x.T @ slope, len(y))}

        got = batch_sums(rows.withColumn(label, F.col(label).cast("double")), [features, label], fold).first()["sums"]
        weights = weights - step * np.array(got[:-1]) / got[-1]
    return weights


def linear_scores(rows: DataFrame, features: str, weights: np.ndarray) -> DataFrame:
    """Add ``margin`` = features . weights."""
    w = np.asarray(weights, dtype=float)

    @F.pandas_udf("double")
    def margin(x):
        import pandas as pd

        return pd.Series(np.stack(x.to_numpy()).astype(float) @ w if len(x) else np.empty(0))

    return rows.withColumn("margin", margin(F.col(features)))


def accuracy(scored: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Overall precision and recall of a single-label classifier: both are accuracy."""
    hit = F.avg((F.col(prediction) == F.col(label)).cast("double"))
    return scored.agg(hit.alias("precision"), hit.alias("recall"))


def class_metrics(scored: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Precision and recall per class from the confusion counts."""
    cells = scored.groupBy(F.col(prediction).alias("p"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("p").alias("class"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("was"),
                 F.when(F.col("p") == F.col("l"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("l").alias("class"), F.lit(0).cast("bigint").alias("said"), F.col("n").alias("was"),
                 F.lit(0).cast("bigint").alias("hit")),
    )
    return (
        cells.select(F.inline(sides)).groupBy("class")
        .agg(F.try_divide(F.sum("hit"), F.sum("said")).alias("precision"), F.try_divide(F.sum("hit"), F.sum("was")).alias("recall"))
    )


def _labelled(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("features"))


def logistic_model(train: DataFrame, features: str, label: str, max_iter: int = 100):
    """Library logistic regression without intercept or penalty."""
    return LogisticRegression(regParam=0.0, fitIntercept=False, maxIter=max_iter).fit(_labelled(train, features, label))


def svm_model(train: DataFrame, features: str, label: str, max_iter: int = 100, reg: float = SVM_PENALTY):
    """Library linear SVM without intercept; features keep their scale."""
    return LinearSVC(regParam=reg, fitIntercept=False, standardization=False, maxIter=max_iter).fit(_labelled(train, features, label))


def predictions(model, test: DataFrame, features: str, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(label, prediction)`` of each row of ``test``, after the columns ``keep``."""
    vectors = array_to_vector(F.col(features).cast("array<double>"))
    rows = test.select(*keep, F.col(label).cast("double").alias("label"), vectors.alias("features"))
    return model.transform(rows).select(*keep, "label", "prediction")


def logistic_regression(train: DataFrame, test: DataFrame, features: str, label: str, max_iter: int = 100) -> DataFrame:
    """Fit without intercept or penalty on ``train``; ``(prediction, label)`` of ``test``."""
    return predictions(logistic_model(train, features, label, max_iter), test, features, label).select("prediction", "label")


def linear_svm(train: DataFrame, test: DataFrame, features: str, label: str, max_iter: int = 100) -> DataFrame:
    """Linear SVM without intercept; ``(label, prediction)`` of ``test``."""
    return predictions(svm_model(train, features, label, max_iter), test, features, label)


def als_model(ratings: DataFrame, rank: int, iters: int, reg: float = 0.01, seed: int = 3):
    return ALS(rank=rank, maxIter=iters, regParam=reg, seed=seed, userCol="user", itemCol="product", ratingCol="rating").fit(ratings)


def factorise(ratings: DataFrame, rank: int, iters: int, reg: float = 0.01, seed: int = 3) -> DataFrame:
    """ALS on ``(user, product, rating)``; the same rows with ``prediction`` added.

    The model scores each row in place, so a repeated (user, product) pair gets one
    prediction per row and does not multiply.
    """
    model = als_model(ratings, rank, iters, reg, seed)
    return model.transform(ratings).withColumn("prediction", F.col("prediction").cast("double"))


def by_pair(ratings: DataFrame) -> DataFrame:
    """``ratings`` placed by (user, product), about ``PAIR_ROWS`` in a partition.

    What groups or joins by pair behind it moves nothing again, and its tasks hold as many
    rows however large the table is; adaptive plans would fill a task up to a size on disk.
    """
    parts = max(ratings.sparkSession.sparkContext.defaultParallelism, -(-ratings.count() // PAIR_ROWS))
    return ratings.repartition(parts, "user", "product")


def join_predictions(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Join on the composite key; ``predicted`` is made unique per pair first. Place large
    inputs with :func:`by_pair`."""
    return actual.join(predicted.dropDuplicates(["user", "product"]), ["user", "product"])


def squared_error(scored: DataFrame, actual: str = "rating", predicted: str = "prediction") -> DataFrame:
    gap: Column = F.col(actual) - F.col(predicted)
    return scored.agg(F.avg(gap * gap).alias("mse"))
