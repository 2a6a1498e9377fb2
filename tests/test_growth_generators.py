from brookmill.sources import generators as gen


def test_the_vocabulary_is_not_broadcast(spark):
    vocabulary = gen.number_words(spark.createDataFrame([(w,) for w in ("a", "bc", "def")], "word string"))
    made = gen.text_lines(spark.range(5).withColumnRenamed("id", "part"), vocabulary, 200, 3)
    assert made.count() > 0
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    slots = [line for line in plan.splitlines() if "Join" in line and "slot" in line]
    assert slots and all("SortMergeJoin" in line for line in slots)
