import numpy as np
import pytest
from pyspark.sql import functions as F

from brookmill.functions import vectors
from brookmill.operators import certificates, learning, nearest
from brookmill.sources import generators as gen


@pytest.fixture(scope="module")
def points(spark):
    return gen.cluster_points(spark.range(300), k=3, d=4, scale=6.0, seed=3).cache()


def test_wcss_never_rises(points):
    costs, centres = [], None
    for rounds in range(1, 5):
        start, centres = learning.kmeans_naive(points, "features", 3, rounds, seed=5)
        costs.append(learning.wcss(points, "features", centres))
    assert all(a >= b - 1e-9 for a, b in zip([learning.wcss(points, "features", start), *costs], costs))


def test_rounds_match_numpy_with_ties_and_vanishing_clusters(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 1, 2, 10, 11, 12])]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    _, centres = learning.kmeans_naive(df, "features", 3, 2, init=[[0, 0], [0, 0], [11, 0]])
    assert centres.tolist() == [[1.0, 0.0], [11.0, 0.0]]


def test_expression_and_batch_assignment_agree(spark, points):
    centres = np.random.default_rng(1).normal(size=(4, 4)) * 4
    batch = {r["id"]: r["cluster"] for r in learning.assign_clusters(points, "features", centres).collect()}
    best = vectors.nearest(F.col("features"), centres.tolist())
    assert batch == {r["id"]: r["i"] for r in points.select("id", best["idx"].alias("i")).collect()}


def test_vector_functions(spark):
    row = spark.sql("SELECT array(1d, 2d) AS a, array(3d, 5d) AS b").select(
        vectors.squared_distance(F.col("a"), F.col("b")), vectors.dot(F.col("a"), F.col("b")),
        vectors.add(F.col("a"), F.col("b")), vectors.divide(F.col("b"), F.lit(2.0)),
    ).first()
    assert list(row) == [13.0, 13.0, [4.0, 7.0], [1.5, 2.5]]
    with pytest.raises(Exception, match="differ in length"):
        spark.sql("SELECT array(1d) AS a, array(1d, 2d) AS b").select(vectors.squared_distance(F.col("a"), F.col("b"))).collect()


@pytest.fixture(scope="module")
def separable(spark):
    return gen.separable_points(spark.range(600), 5, seed=4).cache()


@pytest.mark.parametrize("loss", ["logistic", "hinge"])
def test_descent_matches_numpy(separable, loss):
    rows = separable.collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    w = np.zeros(5)
    for _ in range(4):
        z = x @ w
        s = 1 / (1 + np.exp(-z)) - y if loss == "logistic" else np.where((2 * y - 1) * z < 1, -(2 * y - 1), 0.0)
        w = w - 0.5 * x.T @ s / len(y)
    assert learning.gradient_descent(separable, "features", "label", 5, loss, 4, 0.5) == pytest.approx(w)


def test_unknown_loss(separable):
    with pytest.raises(ValueError):
        learning.gradient_descent(separable, "features", "label", 5, "huber", 1, 0.1)


def test_library_classifiers_beat_the_majority(spark, separable):
    train, test = separable.filter("id % 5 < 3"), separable.filter("id % 5 >= 3")
    share = test.agg(F.avg("label")).first()[0]
    logistic = learning.logistic_regression(train, test, "features", "label")
    assert logistic.columns == ["prediction", "label"]
    svm = learning.linear_svm(train, test, "features", "label", 20)
    assert svm.columns == ["label", "prediction"]
    for scored in (logistic, svm):
        assert learning.accuracy(scored).first()["precision"] > max(share, 1 - share)


def test_library_kmeans(points):
    model, cost = learning.kmeans_library(points, "features", 3, 10)
    assert len(model.clusterCenters()) == 3 and cost > 0


def test_factorisation_error_is_below_variance(spark):
    train, _ = gen.low_rank_ratings(spark, 30, 25, rank=2, share=0.9, seed=3)
    train = train.select(F.col("user").cast("int"), F.col("product").cast("int"), "rating").cache()
    scored = learning.factorise(train, rank=4, iters=8)
    assert scored.count() == train.count()
    assert learning.squared_error(scored).first()["mse"] < train.agg(F.var_pop("rating")).first()[0]


def test_prediction_join_does_not_multiply(spark):
    actual = spark.createDataFrame([(1, 1, 4.0), (1, 1, 2.0)], "user int, product int, rating double")
    predicted = spark.createDataFrame([(1, 1, 3.0), (1, 1, 3.0)], "user int, product int, prediction double")
    assert learning.join_predictions(actual, predicted).count() == 2


def separated(spark, n=400, d=4, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ np.arange(1, d + 1) + rng.normal(scale=2, size=n) > 0).astype(float)
    return spark.createDataFrame([(i, list(map(float, r)), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, features array<double>, label double"), x, y


def test_gradient_certificate_tells_the_optimum_from_other_weights(spark):
    df, x, y = separated(spark)
    model = learning.logistic_model(df, "features", "label")
    w = model.coefficients.toArray()
    slope = certificates.logistic_gradient(df, "features", "label", w)
    assert np.abs(slope).max() < 1e-5
    other = certificates.logistic_gradient(df, "features", "label", w * 1.2)
    assert np.abs(other).max() > 1e-3
    assert np.allclose(other, x.T @ (1 / (1 + np.exp(-(x @ (w * 1.2)))) - y) / len(y))


def test_hinge_certificate(spark):
    df, x, y = separated(spark)
    w = learning.svm_model(df, "features", "label", 200).coefficients.toArray()
    step = 0.1 * np.abs(w).mean()
    assert certificates.hinge_gains(df, "features", "label", w, learning.SVM_PENALTY, step).max() < 1e-5
    moved = w + np.array([0.5, 0, 0, 0])
    gains = certificates.hinge_gains(df, "features", "label", moved, learning.SVM_PENALTY, step)
    cost = lambda v: np.maximum(0, 1 - (2 * y - 1) * (x @ v)).mean() + learning.SVM_PENALTY / 2 * v @ v
    assert gains.argmax() in (0, 4) and gains.max() > 1e-3
    assert gains[1] == pytest.approx(cost(moved) - min(cost(moved + [0, step, 0, 0]), cost(moved - [0, step, 0, 0])))


def test_lloyd_certificate(spark):
    df = spark.createDataFrame([([float(v)],) for v in (0, 1, 2, 10, 11, 12)], "features array<double>")
    assert certificates.lloyd_costs(df, "features", [[1.0], [11.0]]) == (4.0, 4.0)
    told, after = certificates.lloyd_costs(df, "features", [[0.0], [11.0]])
    assert after < told


def test_als_certificate(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 12)), int(rng.integers(0, 9)), float(rng.normal() + 3)) for _ in range(300)] + [(3, 3, 1.0)] * 5
    df = spark.createDataFrame(rows, "user int, product int, rating double")
    model = learning.als_model(df, rank=3, iters=3, reg=0.1)
    p = {r["id"]: np.array(r["features"]) for r in model.userFactors.collect()}
    q = {r["id"]: np.array(r["features"]) for r in model.itemFactors.collect()}
    got = {r["user"]: (r["n"], r["residual"]) for r in certificates.als_residuals(df, model.userFactors, model.itemFactors, 0.1).collect()}
    for u in p:
        mine = [(i, r) for v, i, r in rows if v == u]
        left = sum((r - q[i] @ p[u]) * q[i] for i, r in mine) - 0.1 * len(mine) * p[u]
        assert got[u][0] == len(mine) and got[u][1] == pytest.approx(np.linalg.norm(left) / np.linalg.norm(sum(r * q[i] for i, r in mine)), abs=1e-6)
    assert max(r for _, r in got.values()) < 1e-4
    moved = model.userFactors.withColumn("features", F.transform("features", lambda v: v * 1.1))
    assert certificates.als_residuals(df, moved, model.itemFactors, 0.1).agg(F.min("residual")).first()[0] > 1e-3


@pytest.mark.parametrize("k,per_block,spread", [(1, 128, 1.0), (700, 32, 1.0), (700, 32, 1e6), (300, 1, 1e-6)])
def test_nearest_of_many_centres_is_that_of_all(k, per_block, spread):
    rng = np.random.default_rng(k)
    middles = rng.normal(size=(9, 12)) * spread
    centres = middles[rng.integers(0, 9, k)] + rng.normal(size=(k, 12)) * 0.1
    centres[k // 2] = centres[0]  # a tie
    x = np.vstack([middles[rng.integers(0, 9, 800)] + rng.normal(size=(800, 12)) * 0.1, centres[:50]])
    best, dist = nearest.CentreBlocks(centres, per_block).nearest(x)
    every = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and np.array_equal(dist, every[np.arange(len(x)), best])


def test_assign_nearest_agrees_with_assign_clusters(spark, points):
    centres = np.random.default_rng(1).normal(size=(40, 4)) * 4
    a = {r["id"]: (r["cluster"], r["dist"]) for r in learning.assign_clusters(points, "features", centres).collect()}
    b = {r["id"]: (r["cluster"], r["dist"]) for r in nearest.assign_nearest(points, "features", centres, 8).collect()}
    assert a.keys() == b.keys() and all(a[i][0] == b[i][0] and abs(a[i][1] - b[i][1]) < 1e-9 for i in a)
