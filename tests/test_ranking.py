import math
import random

from pyspark.sql import functions as F

from brookmill.operators.intervals import interval_join, interval_totals, prefix_sums
from brookmill.operators.ranking import index_pick, interpolated_percentiles, order_statistics, rank_rows, trim_ranks
from brookmill.operators.sampling import sample_with_replacement, split_by_id


def test_rank_rows_by_group_with_a_dominant_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(1000), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(6)
    got = {r["id"]: (r["position"], r["n"]) for r in rank_rows(df, ["k"], ["v", "id"], size="n").collect()}
    for key in {r[0] for r in rows}:
        group = sorted((v, i) for k, v, i in rows if k == key)
        for at, (_, i) in enumerate(group):
            assert got[i] == (at + 1, len(group))


def test_index_percentiles_of_one_to_ten(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 11)], "k string, d bigint")
    picks = {f"p{int(p * 100)}": index_pick(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    row = order_statistics(df, ["k"], "d", picks).first()
    assert (row["p5"], row["p25"], row["p50"], row["p75"], row["p95"]) == (1, 3, 6, 8, 10)


def test_order_statistics_with_ties_and_negative_values(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else "cold", rng.choice([-5, -1, 0, 7, rng.randrange(-(10**6), 10**6)])) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    picks = {f"q{i}": index_pick(i / 10) for i in range(10)}
    for r in order_statistics(df, ["k"], "v", picks).collect():
        values = sorted(v for k, v in rows if k == r["k"])
        assert [r[f"q{i}"] for i in range(10)] == [values[math.floor(len(values) * i / 10)] for i in range(10)]


def test_order_statistics_of_a_million_values_in_one_bucket(spark):
    """All values fall into one logarithmic bucket; no task may sort more than the limit."""
    n, base = 1_000_000, 2**40
    df = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 7919 % n + base).alias("v"), ((F.col("id") * 7919 % n) / 1000 + 1e9).alias("d"))
    picks = {f"q{i}": index_pick(i / 7) for i in range(7)}
    row = order_statistics(df, ["k"], "v", picks, limit=5_000).first()
    assert [row[f"q{i}"] for i in range(7)] == [base + math.floor(n * (i / 7)) for i in range(7)]
    row = order_statistics(df, ["k"], "d", picks, limit=50, cells=64).first()
    assert [row[f"q{i}"] for i in range(7)] == [math.floor(n * (i / 7)) / 1000 + 1e9 for i in range(7)]


def test_order_statistics_of_repeated_values_and_small_limits(spark):
    rng = random.Random(15)
    rows = [(k, rng.choice([7, 7, 7, 7, -3, 2**62, -(2**62), rng.randrange(100, 140)])) for k in "ab" for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    picks = {f"q{i}": index_pick(i / 10) for i in range(10)}
    for limit, cells in ((1, 2), (10, 3), (10**6, 1024)):
        for r in order_statistics(df, ["k"], "v", picks, limit, cells).collect():
            values = sorted(v for k, v in rows if k == r["k"])
            assert [r[f"q{i}"] for i in range(10)] == [values[math.floor(len(values) * i / 10)] for i in range(10)]


def test_interpolated_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in (10, 20, 30, 40)] + [("b", 5)], "k string, v bigint")
    got = {r["k"]: (r["m"], r["q"]) for r in interpolated_percentiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}).collect()}
    assert got == {"a": (25.0, 40.0), "b": (5.0, 5.0)}


def test_trim_keeps_ranks_one_to_nine_of_ten(spark):
    df = spark.createDataFrame([("a", i, 100 - i) for i in range(10)], "g string, id int, v int")
    assert sorted(r["v"] for r in trim_ranks(df, ["g"], ["v", "id"], 10).collect()) == list(range(92, 101))


def test_interval_join_and_totals_against_brute_force(spark):
    rng = random.Random(6)
    points = [(rng.choice("ab"), rng.randrange(0, 5000), rng.choice([float(rng.randrange(100)), float("nan")])) for _ in range(400)]
    spans = [(i, s, s + rng.choice([0, 3, 40, 900, 4000])) for i, s in enumerate(rng.randrange(0, 4000) for _ in range(60))]
    p = spark.createDataFrame(points, "host string, at bigint, v double")
    s = spark.createDataFrame(spans, "i int, start bigint, end bigint")
    joined = interval_join(p, s, "at", "start", "end", 100).select("i", "host", "at").collect()
    expected = sorted((i, h, at) for h, at, _ in points for i, a, z in spans if a <= at <= z)
    assert sorted(tuple(r) for r in joined) == expected
    for scale in (1, 9):
        got = {(r["i"], r["host"]): (r["v_sum"], r["v_n"]) for r in
               interval_totals(p, s, "at", "start", "end", ["host"], ["v"], ["i"], scale=scale).collect()}
        for i, a, z in spans:
            for h in "ab":
                inside = [v for host, at, v in points if host == h and a <= at <= z]
                good = [v for v in inside if v == v]
                if inside:
                    assert got[(i, h)] == (sum(good) if good else None, len(good))
                else:
                    assert (i, h) not in got


def test_prefix_sums_of_a_dominant_group_with_ties(spark):
    rng = random.Random(16)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(1, 4), rng.randrange(300), rng.choice([None, rng.randrange(-50, 50)]), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g int, at bigint, v bigint, id int").repartition(5)
    got = {r["id"]: r["v"] for r in prefix_sums(df, ["g"], "at", ["v"]).collect()}
    assert got == {i: sum(x or 0 for h, t, x, _ in rows if h == g and t <= at) for g, at, _, i in rows}


def test_interval_totals_are_exact_behind_a_long_history(spark):
    points = [("a", k, 1e15 if k < 50 else 0.1) for k in range(100)]
    p = spark.createDataFrame(points, "host string, at bigint, v double")
    s = spark.createDataFrame([(0, 60, 69), (1, 200, 300)], "i int, start bigint, end bigint")
    got = interval_totals(p, s, "at", "start", "end", ["host"], ["v"], ["i"]).collect()
    assert [tuple(r) for r in got] == [(0, "a", 1.0, 10)]


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(500)
    a = {r["id"] for r in split_by_id(df.repartition(7), "id", 0.6, 1)[0].collect()}
    b = {r["id"] for r in split_by_id(df.coalesce(1), "id", 0.6, 1)[0].collect()}
    assert a == b and 220 < len(a) < 380


def test_sample_has_exactly_k_draws(spark):
    got = sample_with_replacement(spark.range(5), 40, 9).collect()
    assert len(got) == 40 and len({r["id"] for r in got}) == 5
    assert sorted(r["draw"] for r in got) == list(range(40))


def test_sample_draws_uniform_positions_of_uneven_splits(spark):
    """Splits of very different sizes, empty ones too, and a table behind a shuffle."""
    df = spark.range(1_000).filter("id < 900 OR id % 10 = 0").repartition(3).unionByName(spark.range(10_000, 10_010, numPartitions=5))
    got = sample_with_replacement(df, 4_000, 3).collect()
    assert len(got) == 4_000 and {r["id"] for r in got} <= {r["id"] for r in df.collect()}
    late = sum(r["id"] >= 10_000 for r in got) / 4_000
    assert abs(late - 10 / 920) < 0.006 and len({r["id"] for r in got}) > 850
    assert sorted(sample_with_replacement(spark.range(50), 9, 1).collect()) == sorted(sample_with_replacement(spark.range(50), 9, 1).collect())
    assert sample_with_replacement(spark.range(0), 4, 1).isEmpty() and sample_with_replacement(spark.range(4), 0, 1).isEmpty()
