from collections import Counter

from pyspark.sql import functions as F

from brookmill.functions.text import fields, permute_characters, sorted_characters, tokens
from brookmill.operators import text_ops


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_tokens_keep_leading_and_drop_trailing_empties(spark):
    cases = {" a b ": ["", "a", "b"], "": [""], "   ": [], "a\t\tb\r": ["a", "b"], "x": ["x"]}
    rows = lines(spark, cases).select("value", tokens(F.col("value")).alias("t")).collect()
    assert {r["value"]: r["t"] for r in rows} == cases


def test_fields_split_on_a_literal_mark(spark):
    row = spark.sql("SELECT 'a|b|c' AS p, 'x,y' AS c, 'u\tv' AS t").select(
        fields(F.col("p"), "|"), fields(F.col("c"), ","), fields(F.col("t"), "\t")
    ).first()
    assert list(row) == [["a", "b", "c"], ["x", "y"], ["u", "v"]]


def test_permutation_keeps_characters_and_is_repeatable(spark):
    text = ["the quick brown fox", "", "aé漢z", "zzz"]
    df = lines(spark, text)
    first = df.select("value", permute_characters(F.col("value"), 3).alias("p")).collect()
    again = df.repartition(3).select("value", permute_characters(F.col("value"), 3).alias("p")).collect()
    assert sorted(first) == sorted(again)
    assert all(Counter(r["p"]) == Counter(r["value"]) for r in first)
    assert any(r["p"] != r["value"] for r in first)


def test_shuffle_rounds_keep_lines(spark):
    df = lines(spark, ["abc", "abc", "", "hello world"])
    mixed = text_ops.shuffle_rounds(df, rounds=3, partitions=3)
    assert mixed.count() == 4
    key = sorted_characters(F.col("value"))
    assert sorted(r[0] for r in mixed.select(key).collect()) == sorted(r[0] for r in df.select(key).collect())


def test_word_jobs_on_a_skewed_vocabulary(spark):
    df = lines(spark, ["hot"] * 50 + ["a b", "b c", "c c"])
    counts = {r["word"]: r["n"] for r in text_ops.word_count(df).collect()}
    assert counts == {"hot": 50, "a": 1, "b": 2, "c": 3}
    assert {r["word"] for r in text_ops.frequent_words(df, 2).collect()} == {"hot", "c"}
    assert [r["word"] for r in text_ops.top_k(text_ops.word_count(df), "n", "word", 2).collect()] == ["hot", "c"]
    assert text_ops.frequent_words_per_bucket(df, 0, limit=1, hex_digits=0).count() == 1


def test_sort_positions_with_one_hot_line(spark):
    values = ["m"] * 300 + ["a", "z", "b"]
    got = text_ops.sort_positions(lines(spark, values).repartition(5)).orderBy("position").collect()
    assert [r["value"] for r in got] == sorted(values)
    assert [r["position"] for r in got] == list(range(1, 304))


def test_a_hot_line_is_split_over_partitions(spark):
    df = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).otherwise("m").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = text_ops.sort_lines(df).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["value"] for r in placed] == sorted(r["value"] for r in placed)
    assert len({r["p"] for r in placed if r["value"] == "m"}) > 1


def test_hash_sorted_partitions(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    out = text_ops.hash_sorted_partitions(df, "k", 4).withColumn("p", F.spark_partition_id()).collect()
    assert len({r["p"] for r in out}) > 1
    for p in {r["p"] for r in out}:
        ks = [r["k"] for r in out if r["p"] == p]
        assert ks == sorted(ks)
