from collections import Counter

from pyspark.sql import functions as F

from brookmill.functions import text


def test_characters_of_many_lines_are_sorted_at_once(spark, monkeypatch):
    values = [None, "", "é漢\U0001f600a", "b" * 5 + "a", *[f"line {i} of several" for i in range(50)]]
    df = spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)
    cols = df.select("value", text.permute_characters(F.col("value"), 3).alias("p"), text.sorted_characters(F.col("value")).alias("s"))
    assert "ArrowEvalPython" in cols._jdf.queryExecution().executedPlan().toString()
    rows = cols.collect()
    assert [r["s"] for r in rows] == [None if v is None else "".join(sorted(v)) for v in values]
    assert all((r["p"] is None) == (r["value"] is None) and Counter(r["p"] or "") == Counter(r["value"] or "") for r in rows)
    # a line's permutation does not hang on the lines beside it
    monkeypatch.setattr(text, "CHARACTERS_AT_ONCE", 7)
    alone = df.select(text.permute_characters(F.col("value"), 3).alias("p")).collect()
    assert [r["p"] for r in alone] == [r["p"] for r in rows]
