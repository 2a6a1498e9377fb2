import os

from brookmill.operators import graph
from brookmill.plans import ORACLES, graph_queries


def test_graded_ratings_hold_only_what_gradients_read(spark, monkeypatch):
    written = []

    def kept(df, cut=graph.cut_lineage):
        written.append(set(df.columns))
        return cut(df)

    monkeypatch.setattr(graph, "cut_lineage", kept)
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5)) for u in range(6) for i in range(5)], "user bigint, item bigint, rating double")
    users, items, _ = graph.svdpp(ratings, rank=2, iters=1)
    assert users.count() == 6 and items.count() == 5
    graded = [c for c in written if "err" in c]
    assert graded == [{"user", "item", "norm", "q0", "q1", "u0", "u1", "err"}]


def test_the_query_runs_all_rounds(spark, tmp_path, monkeypatch):
    rows = [(s, p, float((s * p) % 50)) for s in range(3) for p in range(4)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    asked, fit = [], graph.svdpp

    def first_rounds(ratings, rank, iters, **more):
        asked.append((rank, iters))
        return fit(ratings, rank, 1, **more)

    monkeypatch.setattr(graph, "svdpp", first_rounds)
    assert graph_queries.svdpp(spark, str(tmp_path)).count() == 3
    assert asked == [(2, 50)]
    assert "du49 AS" in ORACLES["svdpp"]


def test_tables_of_finished_rounds_are_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("brookmill.session.shared_dir", lambda _: str(tmp_path))
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5)) for u in range(6) for i in range(5)], "user bigint, item bigint, rating double")
    held = []
    for rounds in (1, 3):
        users, items, _ = graph.svdpp(ratings, rank=2, iters=rounds)
        assert users.count() == 6 and items.count() == 5
        held.append(len(os.listdir(tmp_path)))
    # the second call leaves as many tables as the first
    assert held[1] == 2 * held[0]
