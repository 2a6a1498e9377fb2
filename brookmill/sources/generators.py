"""Seeded data generators. Each takes a table of ids (``spark.range(n)`` or the keys of
any table) and derives every row from id and seed, so the rows are the same for every
partitioning and work grows with the ids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.noise import below, gaussian, mix, uniform, weighted_pick
from ..functions.vectors import dot, literal_vector
from ..operators.ranking import rank_rows

LINE_BYTES = 80  # a text line ends once it has passed this length


def int_range(spark: SparkSession, n: int, partitions: int) -> DataFrame:
    return spark.range(0, n, 1, partitions)


def _spread(ids: DataFrame) -> DataFrame:
    """Ids placed evenly over the tasks before each one grows into many rows."""
    return ids.repartition(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _dims(d: int, value) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), value)


def number_words(words: DataFrame) -> DataFrame:
    """``(slot, word)``: the distinct words numbered from 0 in byte order."""
    return rank_rows(words.select("word").distinct(), [], ["word"], "slot").withColumn("slot", F.col("slot") - 1)


def text_lines(parts: DataFrame, vocabulary: DataFrame, bytes_per_part: int, seed: int, identical: bool = False) -> DataFrame:
    """``(part, line, value)``: random words until a line passes 80 bytes, and lines until
    a part passes ``bytes_per_part``.

    ``vocabulary`` is ``(slot, word)`` with slots 0..n-1. With ``identical`` all parts
    use the same draws. A line has at most 81 words and a part a fixed number of lines,
    so the running sums below stay within small groups.
    """
    words = vocabulary.agg(F.count(F.lit(1)).alias("n"), F.min(F.octet_length("word")).alias("shortest")).first()
    # as many draws as fill a line with the shortest word, which may be empty
    size, slots = words["n"], LINE_BYTES // ((words["shortest"] or 0) + 1) + 1
    lines = bytes_per_part // (LINE_BYTES + 1) + 1
    part = F.lit(0) if identical else F.col("part")
    draws = (
        _spread(parts.select(F.col(parts.columns[0]).alias("part")))
        .withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
        .withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        .withColumn("slot", below(size, part, F.col("line"), F.col("n"), seed=seed))
        # never by a copy of the vocabulary, which grows with the texts, in the driver
        .join(vocabulary.hint("merge"), "slot")
    )
    so_far = W.partitionBy("part", "line").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    used = draws.withColumn("before", F.coalesce(F.sum(F.octet_length("word") + 1).over(so_far), F.lit(0))).filter(
        F.col("before") <= LINE_BYTES
    )
    built = used.groupBy("part", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda s: s["word"]), " ").alias("value")
    )
    earlier = W.partitionBy("part").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return (
        built.withColumn("start", F.coalesce(F.sum(F.octet_length("value") + 1).over(earlier), F.lit(0)))
        .filter(F.col("start") < bytes_per_part).drop("start")
    )


def graph_edges(ids: DataFrame, n: int, seed: int, mu: float = 4.0, sigma: float = 1.3) -> DataFrame:
    """Edges whose out-degrees are log-normal, to uniform targets in [0, n)."""
    src = F.col(ids.columns[0])
    degree = F.least(F.lit(n), F.floor(F.exp(mu + sigma * gaussian(src, seed=seed))).cast("int"))
    return (
        _spread(ids).select(src.alias("src"), degree.alias("degree")).filter(F.col("degree") > 0)
        .withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("degree"))))
        .select("src", below(n, F.col("src"), F.col("slot"), seed=seed + 1).alias("dst"))
    )


def cluster_points(ids: DataFrame, k: int, d: int, scale: float, seed: int) -> DataFrame:
    """``(id, features)`` around k Gaussian centres stretched by ``scale``, unit noise."""
    row = F.col(ids.columns[0])
    value = lambda j: scale * gaussian(F.pmod(row, F.lit(k)), j, seed=seed) + gaussian(row, j, seed=seed + 1)
    return ids.select(row.alias("id"), _dims(d, value).alias("features"))


def logistic_points(ids: DataFrame, d: int, eps: float, p_one: float, seed: int) -> DataFrame:
    """``(id, label, features)``: label 1 with probability ``p_one``, features shifted by it."""
    row = F.col(ids.columns[0])
    labelled = ids.select(row.alias("id"), (uniform(row, seed=seed) < p_one).cast("double").alias("label"))
    value = lambda j: gaussian(F.col("id"), j, seed=seed + 1) + F.col("label") * eps
    return labelled.withColumn("features", _dims(d, value))


def separable_points(ids: DataFrame, d: int, seed: int, noise: float = 0.1, weights: Sequence[float] | None = None) -> DataFrame:
    """``(id, label, features)``: x uniform in [-1, 1), label from the sign of a noisy x . w."""
    row = F.col(ids.columns[0])
    w = literal_vector(weights) if weights is not None else _dims(d, lambda j: gaussian(j, seed=seed))
    points = ids.select(row.alias("id"), _dims(d, lambda j: 2 * uniform(row, j, seed=seed + 1) - 1).alias("features"))
    score = dot(F.col("features"), w) + noise * gaussian(F.col("id"), seed=seed + 2)
    return points.select("id", (score >= 0).cast("double").alias("label"), "features")


def low_rank_ratings(
    spark: SparkSession, rows: int, cols: int, rank: int, share: float, seed: int,
    noise: float = 0.0, test_share: float = 0.0, users: DataFrame | None = None, products: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and test cells ``(user, product, rating)`` of A.B / sqrt(rank).

    Users and products are numbers from 0, or the ids that ``users`` and ``products``,
    tables of (slot, id), give to these.

    ``min(round(share * rank * (rows + cols - rank)), round(.99 * rows * cols))`` distinct
    cells are visited by an affine permutation of the cell numbers, so no dense matrix
    and no sort is needed; the test cells follow the training cells in that order and
    never overlap them.
    """
    cells = rows * cols
    train = min(round(share * rank * (rows + cols - rank)), round(0.99 * cells))
    test = min(round(train * test_share), cells - train)
    stride = max(int(cells * (math.sqrt(5) - 1) / 2), 1) + seed % 7
    while math.gcd(stride, cells) != 1:
        stride += 1

    plain = lambda n: spark.range(n).select(F.col("id").alias("slot"), "id")
    sides = (plain(rows) if users is None else users, plain(cols) if products is None else products)

    def pick(first: int, count: int) -> DataFrame:
        i = F.col("id").cast("decimal(19,0)")
        cell = ((i * F.lit(stride).cast("decimal(18,0)") + F.lit(seed)) % F.lit(cells)).cast("bigint")
        at = spark.range(first, first + count).select(cell.alias("cell"))
        at = at.select("cell", (F.col("cell") % rows).alias("user"), F.call_function("div", F.col("cell"), F.lit(rows).cast("bigint")).alias("product"))
        left = sides[0].select(F.col("slot").alias("user"), F.col("id").alias("_u"), _dims(rank, lambda k: gaussian(F.col("slot"), k, seed=seed)).alias("a"))
        right = sides[1].select(F.col("slot").alias("product"), F.col("id").alias("_p"), _dims(rank, lambda k: gaussian(F.col("slot"), k, seed=seed + 1)).alias("b"))
        value = dot(F.col("a"), F.col("b")) / math.sqrt(rank)
        if noise:
            value = value + noise * gaussian(F.col("cell"), seed=seed + 2)
        return at.join(left, "user").join(right, "product").select(F.col("_u").alias("user"), F.col("_p").alias("product"), value.alias("rating"))

    return pick(0, train), pick(train, test)


def passengers(ids: DataFrame, low: int, high: int, flights: int, seed: int) -> DataFrame:
    """``(passenger, flights)`` with ``low..high`` flight ids in [0, flights)."""
    row = F.col(ids.columns[0])
    count = F.lit(low) + below(high - low + 1, row, seed=seed)
    legs = F.transform(F.sequence(F.lit(1).cast("bigint"), count), lambda i: below(flights, row, i, seed=seed + 1))
    return ids.select(row.alias("passenger"), legs.alias("flights"))


def flight_scores(ids: DataFrame, seed: int) -> DataFrame:
    """``(flight, score)`` with scores 1..1000."""
    row = F.col(ids.columns[0])
    return ids.select(row.alias("flight"), (below(1000, row, seed=seed) + 1).alias("score"))


# fixed values: the page-view distribution
PAGE_URLS = {"http://foo.com/": 0.7, "http://foo.com/news": 0.2, "http://foo.com/contact": 0.1}
PAGE_STATUS = {200: 0.95, 404: 0.05}
PAGE_ZIPS = {94709: 0.5, 94117: 0.5}
PAGE_USERS = 100


def page_views(ids: DataFrame, seed: int, per_second: float = 20_000.0, start_s: int = 0) -> DataFrame:
    """``(id, ts, url, status, zip_code, user_id)``; works on a streaming rate source too."""
    row = F.col(ids.columns[0])
    return ids.select(
        row.alias("id"),
        F.timestamp_millis(F.floor(F.lit(start_s) * 1000 + row * (1000.0 / per_second))).alias("ts"),
        weighted_pick(uniform(row, 1, seed=seed), PAGE_URLS).alias("url"),
        weighted_pick(uniform(row, 2, seed=seed), PAGE_STATUS).alias("status"),
        weighted_pick(uniform(row, 3, seed=seed), PAGE_ZIPS).alias("zip_code"),
        (mix(row, 4, seed=seed) % PAGE_USERS + 1).cast("int").alias("user_id"),
    )
