from brookmill.operators import graph


def test_no_round_passes_a_table_through_the_driver(spark, monkeypatch):
    plans = []

    def kept(df, cut=graph.cut_lineage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut_lineage", kept)
    found = graph.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40) if i % 7], "src bigint, dst bigint"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r["id"]: r["component"] for r in found.collect()} == {i: max(j for j in range(1, i + 1) if j % 7 == 1 or j == 1) for i in range(1, 41)}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
