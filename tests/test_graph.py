import random

import pytest
from pyspark.sql import functions as F

from brookmill.operators import graph, skew


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


@pytest.fixture
def all_heavy(monkeypatch):
    """Treat small keys as heavy, so that the salted paths run."""
    monkeypatch.setattr(skew, "HEAVY_ROWS", 5)
    monkeypatch.setattr(graph, "HEAVY_ROWS", 5)


def test_simple_rank_drops_vertices_without_incoming_edges(spark):
    got = {r["id"]: r["rank"] for r in graph.pagerank_simple(edges(spark, [(1, 2), (1, 3), (2, 3), (2, 3)]), 1).collect()}
    assert got == pytest.approx({2: 0.575, 3: 1.425})


def static_rank(pairs, rounds):
    ids = {v for e in pairs for v in e}
    out = {v: sum(1 for s, _ in pairs if s == v) for v in ids}
    rank = dict.fromkeys(ids, 1.0)
    for _ in range(rounds):
        got = dict.fromkeys(ids, 0.0)
        for s, d in pairs:
            got[d] += rank[s] / out[s]
        rank = {v: 0.15 + 0.85 * got[v] for v in ids}
    return rank


def test_static_rank_counts_parallel_edges(spark):
    pairs = [(1, 2), (1, 2), (1, 3), (3, 1), (4, 1)]
    got = {r["id"]: r["rank"] for r in graph.pagerank(edges(spark, pairs), 4, cut_every=2).collect()}
    assert got == pytest.approx(static_rank(pairs, 4))


def test_both_ranks_agree_where_every_vertex_has_both_directions(spark):
    pairs = [(i, (i + k) % 7) for i in range(7) for k in (1, 3)]
    a = {r["id"]: r["rank"] for r in graph.pagerank(edges(spark, pairs), 6).collect()}
    b = {r["id"]: r["rank"] for r in graph.pagerank_simple(edges(spark, pairs), 6).collect()}
    assert a == pytest.approx(b)


def test_rank_with_a_salted_hub(spark, all_heavy):
    pairs = [(0, i) for i in range(1, 60)] + [(i, 0) for i in range(1, 60, 2)] + [(5, 6), (6, 7)]
    assert skew.heavy_keys(edges(spark, pairs).groupBy("src").agg(F.count("*").alias("n")), "src", "n") is not None
    got = {r["id"]: r["rank"] for r in graph.pagerank(edges(spark, pairs), 3).collect()}
    assert got == pytest.approx(static_rank(pairs, 3))


def test_loop_edges_are_not_moved_again(spark):
    ranks = graph.pagerank(edges(spark, [(i, i + 1) for i in range(50)]), 3)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" not in plan


def components(pairs):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("heavy", [False, True])
def test_components_of_random_and_long_graphs(spark, monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(skew, "HEAVY_ROWS", 5)
        monkeypatch.setattr(graph, "HEAVY_ROWS", 5)
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    pairs += [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2000 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in graph.connected_components(edges(spark, pairs)).collect()}
    assert got == components(pairs)


@pytest.mark.parametrize("n", [4, 6])
def test_triangles_of_complete_graphs(spark, n):
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b] + [(0, 0), (100, 101)]
    counts = graph.triangle_count(edges(spark, pairs))
    got = {r["id"]: r["triangles"] for r in counts.collect()}
    assert got == {**dict.fromkeys(range(n), (n - 1) * (n - 2) // 2), 100: 0, 101: 0}
    assert graph.triangle_total(counts).first()[0] == n * (n - 1) * (n - 2) // 2


def test_triangles_with_a_salted_hub(spark, all_heavy):
    rng = random.Random(8)
    pairs = [(0, i) for i in range(1, 80)] + [(rng.randrange(1, 80), rng.randrange(1, 80)) for _ in range(150)]
    simple = {(min(e), max(e)) for e in pairs if e[0] != e[1]}
    near = {}
    for a, b in simple:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = {v: sum(1 for a in near[v] for b in near[v] if a < b and b in near[a]) for v in near}
    got = {r["id"]: r["triangles"] for r in graph.triangle_count(edges(spark, pairs)).collect()}
    assert {v: got[v] for v in expected} == expected


def test_svdpp_of_split_users_and_items_is_the_same(spark):
    rng = random.Random(9)
    rows = sorted({(0 if rng.random() < 0.5 else rng.randrange(20), 1 if rng.random() < 0.4 else rng.randrange(15)) for _ in range(400)})
    ratings = spark.createDataFrame([(u, i, float((u * 7 + i) % 5)) for u, i in rows], "user bigint, item bigint, rating double")
    found = []
    for limit in (None, 4):
        users, items, mean = graph.svdpp(ratings, rank=2, iters=2, heavy_rows=limit)
        heavy = graph.heavy_raters(ratings, ratings.groupBy("user").agg(F.count(F.lit(1)).alias("n")), limit)
        assert all(h is None for h in heavy) == (limit is None)
        scored = graph.svdpp_predict(ratings, users, items, mean, 0.0, 5.0, heavy)
        found.append({(r["user"], r["item"]): round(r["prediction"], 9) for r in scored.collect()})
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_svdpp_error_falls(spark):
    rng = random.Random(2)
    rows = [(u, i, float(min(5, max(0, (u % 3) + (i % 2) + rng.random())))) for u in range(12) for i in range(8) if rng.random() < 0.7]
    ratings = spark.createDataFrame(rows, "user bigint, item bigint, rating double")

    def rmse(rounds):
        users, items, mean = graph.svdpp(ratings, rank=2, iters=rounds)
        scored = graph.svdpp_predict(ratings, users, items, mean, 0.0, 5.0)
        assert scored.count() == len(rows)
        return scored.agg(F.sqrt(F.avg((F.col("rating") - F.col("prediction")) ** 2))).first()[0]

    assert rmse(8) < rmse(1)
