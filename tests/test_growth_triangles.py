import random
from itertools import combinations

import pytest

from brookmill.operators import graph
from brookmill.plans import graph_queries


@pytest.mark.parametrize("heavy", [None, 3])
def test_triangles_by_lists_of_heads(spark, heavy):
    draw = random.Random(4)
    rows = [(draw.randrange(25), draw.randrange(25)) for _ in range(160)] + [(30, 30), (None, 31), (32, None)]
    simple = {frozenset(r) for r in rows if None not in r and r[0] != r[1]}
    want = {v: 0 for r in rows for v in r}
    for three in combinations(range(25), 3):
        if all(frozenset(p) in simple for p in combinations(three, 2)):
            for v in three:
                want[v] += 1
    counts = graph.triangle_count(spark.createDataFrame(rows, "src bigint, dst bigint"), heavy_rows=heavy)
    assert sum(want.values()) > 0
    assert {r["id"]: r["triangles"] for r in counts.collect()} == want
    # paths of two edges are no rows of their own
    assert "array_intersect" in counts._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_heads_are_carried_once(spark):
    counts = graph.triangle_count(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src bigint, dst bigint"))
    assert {r["id"]: r["triangles"] for r in counts.collect()} == {1: 1, 2: 1, 3: 1, 4: 0}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("posexplode(") == 1


def test_triangle_queries_count_parts_of_the_same_orders(spark, tmp_path):
    # order 1 has three parts, order 2 two of them and one more, order 3 one part twice
    lines = [(1, 7), (1, 8), (1, 9), (2, 8), (2, 9), (2, 10), (3, 11), (3, 11), (None, 7), (None, 10), (4, None), (4, 9)]
    rows = [(o, p, 8) for o, p in lines]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["id"]: r["triangles"] for r in graph_queries.triangle_count(spark, str(tmp_path)).collect()}
    assert got == {7: 1, 8: 2, 9: 2, 10: 1}
    assert graph_queries.triangle_total(spark, str(tmp_path)).first()["total"] == 6
    placed = graph_queries.bought_together(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [src" in placed
