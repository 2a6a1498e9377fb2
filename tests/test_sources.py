import pytest
from pyspark.sql import functions as F

from brookmill.functions.units import bytes_to_size, size_to_bytes
from brookmill.session import cut_lineage, cut_placed, shared_dir, with_input_position
from brookmill.sources import generators as gen
from brookmill.sources import text_formats as tf

CASES = [
    (tf.read_edges, ["# comment", "1 2", "3\t4"], "x y", [(1, 2), (3, 4)]),
    (tf.read_points, ["0.5 1", "2 3"], "0.5 abc", [([0.5, 1.0],), ([2.0, 3.0],)]),
    (tf.read_labeled_points, ["(1.0,[0.1,0.2])", "(0.0,[3,4])"], "(1.0,0.1)", [(1.0, [0.1, 0.2]), (0.0, [3.0, 4.0])]),
    (tf.read_ratings, ["3,7,0.25"], "3,7", [(3, 7, 0.25)]),
    (tf.read_passengers, ["1 4|9|4"], "1 4|x", [(1, [4, 9, 4])]),
    (tf.read_flights, ["4 310"], "4", [(4, 310)]),
]


@pytest.mark.parametrize("reader, good, bad, rows", CASES, ids=lambda c: getattr(c, "__name__", ""))
def test_readers_fail_or_drop(spark, tmp_path, reader, good, bad, rows):
    path = tmp_path / "f.txt"
    path.write_text("\n".join(good) + "\n")
    assert sorted(tuple(r) for r in reader(spark, str(path)).collect()) == sorted(rows)
    path.write_text("\n".join([*good, bad]) + "\n")
    assert sorted(tuple(r) for r in reader(spark, str(path), mode="drop").collect()) == sorted(rows)
    with pytest.raises(Exception, match="bad "):
        reader(spark, str(path)).collect()
    with pytest.raises(ValueError):
        reader(spark, str(path), mode="other")


def test_lines_can_be_rebalanced(spark, tmp_path):
    (tmp_path / "l.txt").write_text("\n".join(map(str, range(50))))
    df = tf.read_lines(spark, str(tmp_path / "l.txt"), partitions=5)
    assert df.count() == 50 and df.rdd.getNumPartitions() == 5


def test_size_text(spark):
    df = spark.createDataFrame([("5G",), ("10k",), ("7",), ("2t",)], "s string")
    assert [r[0] for r in df.select(size_to_bytes(F.col("s"))).collect()] == [5 * 10**9, 10**4, 7, 2 * 10**12]
    df = spark.createDataFrame([(1000,), (1001,), (5 * 10**9,)], "b bigint")
    assert [r[0] for r in df.select(bytes_to_size(F.col("b"))).collect()] == ["1000B", "1KB", "5GB"]


def test_generators_do_not_depend_on_partitioning(spark):
    def one(ids):
        return {
            "graph": gen.graph_edges(ids, 200, seed=1, mu=1.0, sigma=0.5),
            "points": gen.cluster_points(ids, 3, 2, 0.6, seed=2),
            "logistic": gen.logistic_points(ids, 2, 0.5, 0.4, seed=3),
            "svm": gen.separable_points(ids, 2, seed=4),
            "passengers": gen.passengers(ids, 1, 4, 50, seed=5),
            "flights": gen.flight_scores(ids, seed=6),
            "views": gen.page_views(ids, seed=7),
        }

    few, many = one(gen.int_range(spark, 200, 1)), one(gen.int_range(spark, 200, 7))
    for name in few:
        assert few[name].count() == many[name].count() > 0
        assert few[name].exceptAll(many[name]).isEmpty(), name


def test_distributions_are_plausible(spark):
    ids = spark.range(20000)
    views = gen.page_views(ids, seed=7)
    share = {r["url"]: r["count"] / 20000 for r in views.groupBy("url").count().collect()}
    assert share == pytest.approx(gen.PAGE_URLS, abs=0.015)
    assert views.filter("status = 404").count() / 20000 == pytest.approx(0.05, abs=0.006)
    assert views.select("user_id").distinct().count() == 100
    cells = gen.cluster_points(ids, 1, 2, 0.0, seed=2).select(F.posexplode("features").alias("d", "x"))
    for r in cells.groupBy("d").agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).collect():
        assert r["m"] == pytest.approx(0, abs=0.03) and r["s"] == pytest.approx(1, abs=0.03)
    pair = gen.cluster_points(ids, 1, 2, 0.0, seed=2).select(F.corr(F.col("features")[0], F.col("features")[1])).first()[0]
    assert abs(pair) < 0.03


def test_text_lines_pass_eighty_bytes_and_fill_the_part(spark):
    words = spark.createDataFrame([(w,) for w in ("a", "word", "another", "longest-of-them-all")], "word string")
    vocabulary = gen.number_words(words)
    made = gen.text_lines(spark.range(3), vocabulary, 400, seed=1)
    rows = made.collect()
    assert all(len(r["value"]) + 1 > 80 for r in rows)
    for part in range(3):
        sizes = [len(r["value"]) + 1 for r in sorted((r for r in rows if r["part"] == part), key=lambda r: r["line"])]
        assert sum(sizes) >= 400 > sum(sizes[:-1])
    assert len({r["value"] for r in rows}) == len(rows)
    same = gen.text_lines(spark.range(3), vocabulary, 400, seed=1, identical=True)
    assert same.select("line", "value").distinct().count() * 3 == same.count()


def test_rating_cells_are_distinct_and_low_rank(spark):
    import numpy as np

    train, test = gen.low_rank_ratings(spark, 20, 15, rank=2, share=3.0, seed=7, test_share=0.3)
    cells = train.unionByName(test)
    assert train.count() == min(round(3.0 * 2 * 33), round(0.99 * 300)) == 198
    assert test.count() == 59 and cells.select("user", "product").distinct().count() == 257
    full, _ = gen.low_rank_ratings(spark, 6, 6, rank=2, share=100.0, seed=7)
    matrix = np.full((6, 6), np.nan)
    for r in full.collect():
        matrix[r["user"], r["product"]] = r["rating"]
    rows = [i for i in range(6) if not np.isnan(matrix[i]).any()]
    assert np.linalg.matrix_rank(matrix[rows], tol=1e-8) == 2


def test_cut_lineage_uses_the_named_folder(spark, named_folder):
    assert shared_dir(spark) == str(named_folder)
    before = {p.name for p in named_folder.iterdir()}
    assert cut_lineage(spark.range(5)).count() == 5
    placed = cut_placed(spark.range(50), 3, ["id"])
    assert placed.count() == 50 and placed.rdd.getNumPartitions() == 3
    made = {p.name for p in named_folder.iterdir()} - before
    assert any(name.startswith("cut-") for name in made)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_rows_behind_a_shuffle_are_written_before_they_are_numbered(spark, named_folder):
    written = lambda: sum(1 for p in named_folder.iterdir() if p.name.startswith("cut-"))
    before = written()
    assert with_input_position(spark.range(9), "n").select("n").distinct().count() == 9
    assert written() == before
    again = with_input_position(spark.range(9).repartition(3), "n")
    assert written() == before + 1 and again.select("n").distinct().count() == 9
