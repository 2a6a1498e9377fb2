"""Generators driven by the keys of the provided tables, so that output grows with them.

Every draw is integer arithmetic on (seed, key, draw number); the SQL repeats it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.noise import gaussian_sql, mix_sql, uniform_sql
from ..functions.units import bytes_to_size, size_to_bytes
from ..operators import text_ops
from ..operators.ranking import rank_rows
from ..operators.sampling import sample_with_replacement
from ..session import cut_lineage
from ..sources import generators as gen
from .registry import query, table
from .text_queries import COUNTS, document_lines

TEXT_SEED, TEXT_BYTES = 99, 400
_SLOTS, _LINES = gen.LINE_BYTES // 2 + 1, TEXT_BYTES // (gen.LINE_BYTES + 1) + 1


@query(
    "gen_text",
    f"""WITH {COUNTS}, vocabulary AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS slot FROM counts),
draws AS (SELECT doc_id AS part, line, n, {mix_sql('doc_id', 'line', 'n', seed=TEXT_SEED)} % (SELECT count(*) FROM vocabulary) AS slot
  FROM documents, range(0, {_LINES}) l(line), range(0, {_SLOTS}) s(n)),
sized AS (SELECT *, coalesce(sum(strlen(word) + 1) OVER (PARTITION BY part, line ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM draws JOIN vocabulary USING (slot)),
built AS (SELECT part, line, string_agg(word, ' ' ORDER BY n) AS value FROM sized WHERE before <= {gen.LINE_BYTES} GROUP BY part, line),
placed AS (SELECT *, coalesce(sum(strlen(value) + 1) OVER (PARTITION BY part ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_byte FROM built)
SELECT part, CAST(line AS INTEGER) AS line, value FROM placed WHERE at_byte < {TEXT_BYTES}""",
)
def gen_text(spark, sf_dir):
    vocabulary = gen.number_words(text_ops.words(document_lines(spark, sf_dir)))
    return gen.text_lines(table(spark, sf_dir, "documents").select("doc_id"), vocabulary, TEXT_BYTES, TEXT_SEED)


@query(
    "gen_graph",
    f"""WITH size AS (SELECT count(*) AS n FROM part),
d AS (SELECT p_partkey AS src, n, least(n, CAST(floor(exp(4.0 + 1.3 * {gaussian_sql('p_partkey', seed=11111)})) AS BIGINT)) AS degree FROM part, size),
e AS (SELECT src, n, unnest(range(1, degree + 1)) AS slot FROM d)
SELECT src, CAST(count(*) AS BIGINT) AS degree, CAST(sum({mix_sql('src', 'slot', seed=11112)} % n) AS BIGINT) AS targets FROM e GROUP BY src""",
)
def gen_graph(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    edges = gen.graph_edges(part, part.count(), seed=11111)
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("dst").alias("targets"))


_D, _K = 5, 10


def _cells(df, extra=()):
    return df.select("id", *extra, F.posexplode("features").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(
    "gen_cluster_points",
    f"""SELECT c_custkey AS id, CAST(j AS INTEGER) AS dim,
  round(0.6 * {gaussian_sql(f'c_custkey % {_K}', 'j', seed=1)} + {gaussian_sql('c_custkey', 'j', seed=2)}, 6) AS x FROM customer, range(0, {_D}) r(j)""",
)
def gen_cluster_points(spark, sf_dir):
    return _cells(gen.cluster_points(table(spark, sf_dir, "customer").select("c_custkey"), _K, _D, 0.6, seed=1))


@query(
    "gen_logistic_points",
    f"""WITH l AS (SELECT c_custkey AS id, CAST({uniform_sql('c_custkey', seed=21)} < 0.4 AS DOUBLE) AS label FROM customer)
SELECT id, label, CAST(j AS INTEGER) AS dim, round({gaussian_sql('id', 'j', seed=22)} + label * 0.5, 6) AS x FROM l, range(0, {_D}) r(j)""",
)
def gen_logistic_points(spark, sf_dir):
    return _cells(gen.logistic_points(table(spark, sf_dir, "customer").select("c_custkey"), _D, 0.5, 0.4, seed=21), ["label"])


@query(
    "gen_separable_points",
    f"""WITH x AS (SELECT c_custkey AS id, j, 2 * {uniform_sql('c_custkey', 'j', seed=32)} - 1 AS x, {gaussian_sql('j', seed=31)} AS w FROM customer, range(0, {_D}) r(j)),
y AS (SELECT id, CAST(sum(x * w) + 0.1 * {gaussian_sql('id', seed=33)} >= 0 AS DOUBLE) AS label FROM x GROUP BY id)
SELECT id, label, CAST(j AS INTEGER) AS dim, round(x, 6) AS x FROM x JOIN y USING (id)""",
)
def gen_separable_points(spark, sf_dir):
    return _cells(gen.separable_points(table(spark, sf_dir, "customer").select("c_custkey"), _D, seed=31), ["label"])


_GR = {"rank": 4, "share": 0.9, "seed": 7, "noise": 0.1, "test_share": 0.2}
_AB = " + ".join(f"{gaussian_sql('u', str(k), seed=7)} * {gaussian_sql('p', str(k), seed=8)}" for k in range(4))


@query(
    "gen_ratings",
    f"""WITH size AS (SELECT m, n, m * n AS cells, least(CAST(round(0.9 * 4 * (m + n - 4)) AS BIGINT), CAST(round(0.99 * m * n) AS BIGINT)) AS train
  FROM (SELECT count(*) AS m FROM supplier), (SELECT count(*) AS n FROM part)),
step AS (SELECT *, least(CAST(round(train * 0.2) AS BIGINT), cells - train) AS test, CAST(floor(cells * (sqrt(5) - 1) / 2) AS BIGINT) + 0 AS base FROM size),
stride AS (SELECT step.*, (SELECT min(base + k) FROM range(0, 2000) r(k) WHERE gcd(base + k, cells) = 1) AS stride FROM step),
c AS (SELECT i < train AS is_train, CAST((CAST(i AS HUGEINT) * stride + 7) % cells AS BIGINT) AS cell, m FROM stride, range(0, train + test) r(i)),
x AS (SELECT is_train, cell, cell % m AS u, cell // m AS p FROM c)
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS side, s_suppkey AS "user", p_partkey AS product,
  round(({_AB}) / sqrt(4) + 0.1 * {gaussian_sql('cell', seed=9)}, 6) AS rating
FROM x JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS us FROM supplier) ON u = us
  JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ps FROM part) ON p = ps""",
)
def gen_ratings(spark, sf_dir):
    """Ratings of the parts by the suppliers, both numbered in key order."""
    numbered = lambda name, key: cut_lineage(rank_rows(table(spark, sf_dir, name).select(F.col(key).alias("id")), [], ["id"], "slot").withColumn("slot", F.col("slot") - 1))
    users, products = numbered("supplier", "s_suppkey"), numbered("part", "p_partkey")
    train, test = gen.low_rank_ratings(spark, users.count(), products.count(), users=users, products=products, **_GR)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.select("side", "user", "product", F.round("rating", 6).alias("rating"))


@query(
    "gen_passengers",
    f"""WITH n AS (SELECT count(*) AS f FROM part), c AS (SELECT c_custkey AS passenger, 3 + {mix_sql('c_custkey', seed=41)} % 8 AS k FROM customer),
l AS (SELECT passenger, unnest(range(1, k + 1)) AS i FROM c)
SELECT passenger, CAST(i AS INTEGER) AS leg, {mix_sql('passenger', 'i', seed=42)} % f AS flight FROM l, n""",
)
def gen_passengers(spark, sf_dir):
    flights = table(spark, sf_dir, "part").count()
    made = gen.passengers(table(spark, sf_dir, "customer").select("c_custkey"), 3, 10, flights, seed=41)
    return made.select("passenger", F.posexplode("flights").alias("leg", "flight")).withColumn("leg", F.col("leg") + 1)


@query("gen_flights", f"SELECT p_partkey AS flight, {mix_sql('p_partkey', seed=43)} % 1000 + 1 AS score FROM part")
def gen_flights(spark, sf_dir):
    return gen.flight_scores(table(spark, sf_dir, "part").select("p_partkey"), seed=43)


def _pick_sql(draw: str, choices: dict) -> str:
    text, edge = "CASE", 0.0
    items = list(choices.items())
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    for value, p in items[:-1]:
        edge += p
        text += f" WHEN {draw} < {edge!r} THEN {show(value)}"
    return f"{text} ELSE {show(items[-1][0])} END"


@query(
    "gen_page_views",
    f"""SELECT o_orderkey AS id, {_pick_sql(uniform_sql('o_orderkey', '1', seed=51), gen.PAGE_URLS)} AS url,
  {_pick_sql(uniform_sql('o_orderkey', '2', seed=51), gen.PAGE_STATUS)} AS status, {_pick_sql(uniform_sql('o_orderkey', '3', seed=51), gen.PAGE_ZIPS)} AS zip_code,
  CAST({mix_sql('o_orderkey', '4', seed=51)} % 100 + 1 AS INTEGER) AS user_id, CAST(floor(o_orderkey * (1000.0::DOUBLE / 20000.0)) AS BIGINT) AS ms FROM orders""",
)
def gen_page_views(spark, sf_dir):
    made = gen.page_views(table(spark, sf_dir, "orders").select("o_orderkey"), seed=51)
    return made.withColumn("ms", F.unix_millis("ts")).drop("ts")


@query(
    "sample_with_replacement",
    f"""WITH n AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row FROM embeddings),
d AS (SELECT i AS draw, CAST(floor({uniform_sql('i', seed=61)} * n) AS BIGINT) + 1 AS row FROM n, range(0, 25) t(i))
SELECT draw, vec_id FROM d JOIN r USING (row)""",
)
def sample_rows(spark, sf_dir):
    """Twenty-five draws (the size of the sample is the operator's parameter) from all rows."""
    return sample_with_replacement(table(spark, sf_dir, "embeddings").select("vec_id"), 25, seed=61)


_UNIT = "CASE WHEN o_orderkey % 3 = 0 THEN 'k' WHEN o_orderkey % 3 = 1 THEN 'M' ELSE '' END"


@query(
    "size_text",
    f"""WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS q, {_UNIT} AS u FROM orders),
b AS (SELECT o_orderkey, concat(q, u) AS text, q * CASE u WHEN 'k' THEN 1000 WHEN 'M' THEN 1000000 ELSE 1 END AS bytes FROM s)
SELECT o_orderkey, text, bytes, CASE WHEN bytes > 1000000000000 THEN concat(bytes // 1000000000000, 'TB') WHEN bytes > 1000000000 THEN concat(bytes // 1000000000, 'GB')
  WHEN bytes > 1000000 THEN concat(bytes // 1000000, 'MB') WHEN bytes > 1000 THEN concat(bytes // 1000, 'KB') ELSE concat(bytes, 'B') END AS size FROM b""",
)
def size_text(spark, sf_dir):
    unit = F.when(F.col("o_orderkey") % 3 == 0, "k").when(F.col("o_orderkey") % 3 == 1, "M").otherwise("")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.floor("o_totalprice").cast("string"), unit).alias("text"))
    rows = rows.withColumn("bytes", size_to_bytes(F.col("text")))
    return rows.withColumn("size", bytes_to_size(F.col("bytes")))
