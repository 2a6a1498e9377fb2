import random

from brookmill.operators import mileage

SCHEMA = "passenger bigint, flights array<bigint>"


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "flight bigint, score bigint")


def as_dict(df):
    return {r["passenger"]: r["miles"] for r in df.collect()}


def test_repeated_flights_count_each_time(spark):
    p = spark.createDataFrame([(1, [4, 9, 4])], SCHEMA)
    s = scores(spark, [(4, 310), (9, 5)])
    for job in (mileage.mileage_flat, mileage.mileage_loop, mileage.mileage_fixed_rounds):
        assert as_dict(job(p, s)) == {1: 625}


def test_repeated_passenger_is_added_not_multiplied(spark):
    p = spark.createDataFrame([(1, [4]), (1, [9])], SCHEMA)
    s = scores(spark, [(4, 310), (9, 5)])
    for job in (mileage.mileage_flat, mileage.mileage_loop, mileage.mileage_fixed_rounds):
        assert as_dict(job(p, s)) == {1: 315}


def test_unknown_flight(spark):
    p = spark.createDataFrame([(2, [4, 77])], SCHEMA)
    s = scores(spark, [(4, 310)])
    assert as_dict(mileage.mileage_flat(p, s)) == {2: 310}
    assert as_dict(mileage.mileage_loop(p, s)) == {}
    assert as_dict(mileage.mileage_fixed_rounds(p, s)) == {}


def test_three_jobs_agree_when_all_flights_are_known(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), [rng.randrange(30) for _ in range(rng.randrange(1, 12))]) for _ in range(200)]
    p = spark.createDataFrame(rows, SCHEMA)
    worth = {f: rng.randrange(1, 1000) for f in range(30)}
    s = scores(spark, list(worth.items()))
    expected = {}
    for who, flights in rows:
        expected[who] = expected.get(who, 0) + sum(worth[f] for f in flights)
    assert as_dict(mileage.mileage_flat(p, s)) == expected
    assert as_dict(mileage.mileage_loop(p, s)) == expected
    assert as_dict(mileage.mileage_fixed_rounds(p, s, cut_every=3)) == expected
    assert mileage.mileage_total(mileage.mileage_flat(p, s)).first()[0] == sum(expected.values())


def test_state_update_join(spark):
    state = spark.createDataFrame([(1, 10), (2, 20)], "passenger bigint, miles bigint")
    update = spark.createDataFrame([(1, 5)], "passenger bigint, score bigint")
    assert as_dict(mileage.update_scores(state, update)) == {1: 15}
