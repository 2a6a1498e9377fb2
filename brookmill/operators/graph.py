"""Graph operators on an edge table ``(src bigint, dst bigint)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.noise import uniform
from ..session import cut_lineage, cut_placed, drop_cut
from .rounds import iterate
from .skew import HEAVY_ROWS, heavy_keys, row_total, salt_many, salt_one, skew_join

EDGES_PER_PARTITION = 4_000_000  # about 100 MB of placed edges


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected simple edges: smaller id first, no loops, no duplicates."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def spread_edges(edges: DataFrame, partitions: int) -> DataFrame:
    """Place edges by (src, dst), which also splits the edges of one hub."""
    return edges.repartition(partitions, "src", "dst")


class _Links:
    """Edges with the share of the source rank each one carries, placed once by source.

    The placement is written to shared storage and kept by all rounds, so a round
    moves ranks and contributions only. A hub's edges are salted over many tasks.
    """

    def __init__(self, weighted: DataFrame, heavy_rows: int | None):
        weighted = cut_lineage(weighted)
        out = cut_lineage(weighted.groupBy("src").agg(F.sum("w").alias("out"), F.count(F.lit(1)).alias("n")))
        self.heavy = heavy_keys(out, "src", "n", heavy_rows)
        # a hub's edges are spread before they meet its weight
        links = skew_join(weighted, out.drop("n"), "src", self.heavy, [F.col("dst")]).select("src", "dst", (F.col("w") / F.col("out")).alias("share"))
        place = ["src"]
        if self.heavy is not None:
            links = salt_many(links, self.heavy, "src", [F.col("dst")])
            place.append("_salt")
        n = max(int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions")), row_total(out, "n") // EDGES_PER_PARTITION + 1)
        self.keys = place
        self.table = cut_placed(cut_lineage(links), n, place)

    def contributions(self, ranks: DataFrame) -> DataFrame:
        ranks = ranks.withColumnRenamed("id", "src")
        if self.heavy is not None:
            ranks = salt_one(ranks, self.heavy, "src")
        return self.table.join(ranks, self.keys).select(
            F.col("dst").alias("id"), (F.col("rank") * F.col("share")).alias("c")
        )


def pagerank_simple(edges: DataFrame, iters: int = 10, cut_every: int = 5, heavy_rows: int | None = None) -> DataFrame:
    """Rank over de-duplicated edges where only vertices with a rank contribute.

    Sources start at 1.0. A vertex without incoming edges has no rank after the first
    round and stops contributing; targets without outgoing edges keep their rank.
    """
    links = _Links(edges.distinct().withColumn("w", F.lit(1)), heavy_rows)

    def step(ranks: DataFrame, _: int) -> DataFrame:
        return links.contributions(ranks).groupBy("id").agg((0.15 + 0.85 * F.sum("c")).alias("rank"))

    start = links.table.select(F.col("src").alias("id")).distinct().withColumn("rank", F.lit(1.0))
    return iterate(start, step, iters, cut_every)


def pagerank(
    edges: DataFrame, iters: int = 10, reset: float = 0.15, cut_every: int = 5, heavy_rows: int | None = None
) -> DataFrame:
    """Static rank of every vertex; parallel edges count, ranks are not normalised and
    the mass of vertices without outgoing edges is not redistributed."""
    links = _Links(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), heavy_rows)
    vertices = cut_lineage(vertices_of(edges))
    floor = vertices.withColumn("c", F.lit(0.0))

    def step(ranks: DataFrame, _: int) -> DataFrame:
        # the zero rows keep vertices without incoming edges, with no outer join
        received = links.contributions(ranks).unionByName(floor)
        return received.groupBy("id").agg((reset + (1.0 - reset) * F.sum("c")).alias("rank"))

    return iterate(vertices.withColumn("rank", F.lit(1.0)), step, iters, cut_every)


def rank_total(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.sum("rank").alias("total"))


def connected_components(edges: DataFrame, max_rounds: int = 100, heavy_rows: int | None = None) -> DataFrame:
    """``(id, component)``: every vertex with the lowest id it can reach.

    Edges are rewired towards smaller ids in alternating steps until each component is
    a star around its minimum, which takes logarithmically many rounds even for long
    chains. Minima are map-side combined; no neighbour list is ever collected. Joins are
    merge joins: a table just small enough to broadcast would pass through the driver in
    every round.
    """
    vertices = vertices_of(edges)
    limit = HEAVY_ROWS if heavy_rows is None else heavy_rows
    # hi > lo on every edge throughout
    e = cut_lineage(canonical(edges).select(F.col("dst").alias("hi"), F.col("src").alias("lo")))
    size = e.count()  # never grows beyond twice itself within a round
    for _ in range(max_rounds):
        # every larger neighbour of a vertex moves to the smallest id around it
        around = e.select("lo", F.col("lo").alias("to"), F.lit(1).alias("one")).unionByName(
            e.select(F.col("hi").alias("lo"), F.col("lo").alias("to"), F.lit(0).alias("one"))
        )
        low = around.groupBy("lo").agg(F.min("to").alias("m"), F.sum("one").alias("n"))
        crowded = None
        if size > limit:  # else no vertex can be heavy
            low = cut_lineage(low)
            crowded = heavy_keys(low, "lo", "n", limit)
        moved = skew_join(e, low.select("lo", "m"), "lo", crowded, [F.col("hi")], "merge")
        e = cut_lineage(moved.select("hi", F.col("m").alias("lo")).distinct())
        # the smaller neighbours of a vertex, and the vertex itself, move to their minimum
        low = cut_lineage(e.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n")))
        seen = low.agg(F.sum("n").alias("edges"), F.max("n").alias("top")).first()
        size = 2 * (seen["edges"] or 0)
        if (seen["top"] or 0) <= 1 and e.join(e.select(F.col("lo").alias("hi")).hint("merge"), "hi", "left_semi").isEmpty():
            return vertices.join(e.hint("merge"), F.col("id") == F.col("hi"), "left").select("id", F.coalesce("lo", "id").alias("component"))
        crowded = heavy_keys(low, "hi", "n", limit) if size > limit else None
        low = low.select("hi", "m")
        moved = skew_join(e, low, "hi", crowded, [F.col("lo")], "merge").filter(F.col("lo") != F.col("m"))
        e = cut_lineage(
            moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        )
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def component_count(components: DataFrame) -> DataFrame:
    return components.agg(F.countDistinct("component").alias("components"))


def triangle_count(edges: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """``(id, triangles)`` of the undirected simple graph; vertices without any stay.

    Edges point from the smaller to the larger (degree, id), so no vertex has more
    than sqrt(2 m) outgoing edges. A triangle is then u -> v, u -> w and v -> w: each edge
    carries the heads of u behind v, in one row, to the list of v's heads, and what both
    hold closes a triangle. Paths of two edges are never rows of their own.
    """
    simple = cut_lineage(canonical(edges))
    degree = simple.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    degree = cut_lineage(degree)
    busy = heavy_keys(degree, "id", "deg", heavy_rows)
    ends = skew_join(
        simple.withColumnRenamed("src", "id"), degree, "id", busy, [F.col("dst")]
    ).select(F.col("id").alias("a"), F.col("deg").alias("da"), F.col("dst").alias("id"))
    ends = skew_join(ends, degree, "id", busy, [F.col("a")]).withColumnsRenamed({"id": "b", "deg": "db"})
    forward = F.struct("da", "a") < F.struct("db", "b")
    place = lambda deg, id_: F.struct(F.col(deg).alias("deg"), F.col(id_).alias("id"))
    arcs = ends.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"),
                       F.when(forward, place("db", "b")).otherwise(place("da", "a")).alias("v"))
    heads = F.transform(F.sort_array(F.collect_list("v")), lambda s: s["id"])
    out = cut_lineage(arcs.groupBy("u").agg(heads.alias("out")))
    steps = out.select("u", F.posexplode("out").alias("at", "v"), "out")
    fan_in = heavy_keys(cut_lineage(steps.groupBy("v").agg(F.count(F.lit(1)).alias("n"))), "v", "n", heavy_rows)
    # the last head has none behind it
    steps = steps.filter(F.col("at") + 1 < F.size("out")).select("u", "v", F.slice("out", F.col("at") + 2, F.size("out")).alias("later"))
    closed = skew_join(steps, out.select(F.col("u").alias("v"), "out"), "v", fan_in, [F.col("u")], "merge").select(
        "u", "v", F.array_intersect("later", "out").alias("w"))
    closed = closed.filter(F.size("w") > 0)
    # all corners of a row at once, so that the lists are carried only once
    corner = lambda id_, t: F.struct(id_.alias("id"), t.alias("t"))
    both_ends = F.array(*[corner(F.col(c), F.size("w")) for c in ("u", "v")])
    corners = closed.select(F.inline(F.concat(both_ends, F.transform("w", lambda x: corner(x, F.lit(1))))))
    # vertices of edges that are left out above: loops, and edges with an unknown end
    odd = vertices_of(edges.filter(~F.coalesce(F.col("src") != F.col("dst"), F.lit(False))))
    none = degree.select("id").unionByName(odd).withColumn("t", F.lit(0))
    return corners.unionByName(none).groupBy("id").agg(F.sum("t").alias("triangles"))


def triangle_total(counts: DataFrame) -> DataFrame:
    """Sum over vertices: three times the number of triangles."""
    return counts.agg(F.sum("triangles").alias("total"))


def unit_ratings(edges: DataFrame) -> DataFrame:
    """An unweighted edge counts as rating 1.0."""
    return edges.select(F.col("src").alias("user"), F.col("dst").alias("item"), F.lit(1.0).alias("rating"))


def svdpp(
    ratings: DataFrame,
    rank: int = 10,
    iters: int = 2,
    low: float = 0.0,
    high: float = 5.0,
    g1: float = 0.007,
    g2: float = 0.007,
    g6: float = 0.005,
    g7: float = 0.015,
    seed: int = 5,
    cut_every: int = 1,
    heavy_rows: int | None = None,
) -> tuple[DataFrame, DataFrame, float]:
    """Factorise ``(user, item, rating)`` with implicit feedback, by full-batch steps.

    ``prediction = mean + bu + bi + q . (p + n^-1/2 * sum of y over the user's items)``,
    clamped to [low, high]. Factors are plain columns, so every gradient is an ordinary
    map-side combined sum. A round sends the items' factors to the ratings once; the
    implicit sums and the graded ratings are both taken from that. Users and items with very
    many ratings (counted once, they do not change) are split wherever factors meet
    ratings. Returns (users, items, mean).
    """
    ks = range(rank)
    ratings = cut_lineage(ratings.select("user", "item", F.col("rating").cast("double").alias("rating")))
    mean = ratings.agg(F.avg("rating").alias("m")).first()["m"]
    cols = lambda name: [f"{name}{k}" for k in ks]
    init = lambda key, name, tag: [uniform(F.col(key), tag * 1000 + k, seed=seed).alias(f"{name}{k}") for k in ks]
    per_user = cut_lineage(ratings.groupBy("user").agg(F.count(F.lit(1)).alias("n")))
    heavy = heavy_raters(ratings, per_user, heavy_rows)
    users = per_user.select("user", F.lit(0.0).alias("bu"), (1 / F.sqrt("n")).alias("norm"), *init("user", "p", 1))
    items = ratings.select("item").distinct().select("item", F.lit(0.0).alias("bi"), *init("item", "q", 2), *init("item", "y", 3))
    users, items = _cut_factors(users, items)

    done: list[DataFrame] = []
    for i in range(iters):
        # both gradients read it: written once, instead of joining three tables twice
        graded = cut_lineage(
            svdpp_predict(ratings, users, items, mean, low, high, heavy)
            .select("user", "item", "norm", *cols("q"), *cols("u"), (F.col("rating") - F.col("prediction")).alias("err"))
        )
        # a term that is the same for all ratings of a user or item comes once, times their number
        count, total = F.count("err").alias("n"), F.sum("err").alias("e")
        user_grad = graded.groupBy("user").agg(count, total, *[F.sum(F.col("err") * F.col(f"q{k}")).alias(f"eq{k}") for k in ks])
        item_grad = graded.groupBy("item").agg(
            count, total, F.sum(F.col("err") * F.col("norm")).alias("en"), *[F.sum(F.col("err") * F.col(f"u{k}")).alias(f"eu{k}") for k in ks])
        shrunk = lambda c, by: by * F.col("n") * F.col(c)
        bias = lambda c: (F.col(c) + g1 * (F.col("e") - shrunk(c, g6))).alias(c)
        factor = lambda c, gain: (F.col(c) + g2 * (gain - shrunk(c, g7))).alias(c)
        users = users.join(user_grad, "user").select("user", "norm", bias("bu"), *[factor(f"p{k}", F.col(f"eq{k}")) for k in ks])
        items = items.join(item_grad, "item").select(
            "item", bias("bi"), *[factor(f"q{k}", F.col(f"eu{k}")) for k in ks], *[factor(f"y{k}", F.col("en") * F.col(f"q{k}")) for k in ks])
        done.append(graded)
        if cut_every and (i + 1) % cut_every == 0:
            users, items = _cut_factors(users, items)
            # what the written factors were made from is read no more
            drop_cut(*done)
            done = [users]
    return users, items, mean


def _cut_factors(users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables of factors as one written table, read by its halves."""
    both = users.select(F.lit(True).alias("_user"), "*").unionByName(items.select(F.lit(False).alias("_user"), "*"), allowMissingColumns=True)
    both = cut_lineage(both)
    half = lambda is_user, names: both.filter(F.col("_user") == is_user).select(*names)
    return half(True, users.columns), half(False, items.columns)


def heavy_raters(ratings: DataFrame, per_user: DataFrame, rows: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Users and items with more ratings than one task should join; None where none has."""
    if row_total(per_user, "n") <= (HEAVY_ROWS if rows is None else rows):  # then nobody has
        return None, None
    per_item = cut_lineage(ratings.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    return heavy_keys(per_user, "user", "n", rows), heavy_keys(per_item, "item", "n", rows)


def svdpp_predict(
    ratings: DataFrame, users: DataFrame, items: DataFrame, mean: float, low: float, high: float,
    heavy: tuple[DataFrame | None, DataFrame | None] = (None, None),
) -> DataFrame:
    """Add ``prediction`` and the user vector ``u<k>`` (own plus implicit part)."""
    rank = sum(c.startswith("p") for c in users.columns)
    ks = range(rank)
    heavy_users, heavy_items = heavy
    routed = skew_join(ratings, items, "item", heavy_items, [F.col("user")])
    implicit = routed.groupBy("user").agg(*[F.sum(f"y{k}").alias(f"s{k}") for k in ks])
    people = users.join(implicit, "user").select(
        "user", "bu", "norm", *[f"p{k}" for k in ks],
        *[(F.col(f"p{k}") + F.col("norm") * F.col(f"s{k}")).alias(f"u{k}") for k in ks],
    )
    dot = sum((F.col(f"q{k}") * F.col(f"u{k}") for k in ks), F.lit(0.0))
    raw = F.lit(mean) + F.col("bu") + F.col("bi") + dot
    return skew_join(routed, people, "user", heavy_users, [F.col("item")]).withColumn(
        "prediction", F.least(F.greatest(raw, F.lit(low)), F.lit(high)))
