import re

from pyspark.sql import functions as F

from brookmill.operators import learning
from brookmill.plans.learning_queries import prediction_join_mse


def test_join_tasks_hold_a_bounded_number_of_pairs(spark, sf_dir, monkeypatch):
    """adaptive plans must not merge the partitions of pairs as the table grows."""
    monkeypatch.setattr(learning, "PAIR_ROWS", 500, raising=False)
    joined = prediction_join_mse(spark, sf_dir)
    assert joined.count() == 1
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    moved = re.findall(r"Exchange hashpartitioning\(user#\d+, product#\d+, (\d+)\), (\w+)", plan)
    assert moved and set(moved) == {(str(-(-lines // 500)), "REPARTITION_BY_NUM")}


def test_pairs_without_a_key_or_a_row(spark):
    rows = [(1, 1, 4.0), (1, 1, 2.0), (None, 1, 3.0), (2, None, 5.0), (None, None, None), (3, 3, None)]
    actual = learning.by_pair(spark.createDataFrame(rows, "user int, product int, rating double"))
    means = actual.groupBy("user", "product").agg(F.avg("rating").alias("prediction"))
    got = learning.join_predictions(actual, means)
    assert sorted(tuple(r)[:3] for r in got.collect() if r["rating"]) == [(1, 1, 2.0), (1, 1, 4.0)] and got.count() == 3
    assert learning.squared_error(got).first()["mse"] == 1.0
    assert learning.by_pair(actual.limit(0)).count() == 0
