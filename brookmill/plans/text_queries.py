"""Text jobs over the lines of ``documents.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import sorted_characters
from ..operators import text_ops
from ..operators.sampling import split_by_id
from ..functions.noise import uniform_sql
from ..session import scratch_path, shuffle_partitions
from ..sources import text_formats
from ..sources.sinks import write_text
from .registry import query, table

LINES = "lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)"
WORDS = LINES + r""",
words AS (
  SELECT unnest(CASE WHEN regexp_full_match(value, '\s+') THEN CAST([] AS VARCHAR[])
                     ELSE string_split_regex(regexp_replace(value, '\s+$', ''), '\s+') END) AS word
  FROM lines)"""
COUNTS = WORDS + ", counts AS (SELECT word, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY word)"

FREQUENT = 300


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_ops.lines_of(table(spark, sf_dir, "documents", spread=True))


@query("word_count", f"WITH {COUNTS} SELECT word, n FROM counts")
def word_count(spark, sf_dir):
    return text_ops.word_count(document_lines(spark, sf_dir))


@query("frequent_words", f"WITH {COUNTS} SELECT word, n FROM counts WHERE n > {FREQUENT}")
def frequent_words(spark, sf_dir):
    return text_ops.frequent_words(document_lines(spark, sf_dir), FREQUENT)


@query(
    "frequent_words_per_bucket",
    f"""WITH {COUNTS}, ranked AS (
  SELECT word, n, substr(md5(word), 1, 1) AS bucket,
         row_number() OVER (PARTITION BY substr(md5(word), 1, 1) ORDER BY n DESC, word) AS rank
  FROM counts WHERE n > 20)
SELECT word, n, bucket, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 10""",
)
def frequent_words_per_bucket(spark, sf_dir):
    out = text_ops.frequent_words_per_bucket(document_lines(spark, sf_dir), 20, 10)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("top_k_words", f"WITH {COUNTS} SELECT word, n FROM counts ORDER BY n DESC, word LIMIT 10")
def top_k_words(spark, sf_dir):
    return text_ops.top_k(text_ops.word_count(document_lines(spark, sf_dir)), "n", "word", 10)


@query(
    "sort_lines",
    f"WITH {LINES} SELECT value, CAST(row_number() OVER (ORDER BY value) AS BIGINT) AS position FROM lines",
)
def sort_lines(spark, sf_dir):
    lines = text_ops.lines_of(table(spark, sf_dir, "documents"))
    return text_ops.sort_positions(lines).select("value", "position")


@query(
    "shuffle_invariant",
    f"""WITH {LINES}
SELECT array_to_string(list_sort(list_filter(string_split(value, ''), lambda c: c <> '')), '') AS characters,
       CAST(count(*) AS BIGINT) AS n
FROM lines GROUP BY 1""",
)
def shuffle_invariant(spark, sf_dir):
    """Five rounds of permute-and-rebalance change neither line count nor characters."""
    lines = text_ops.lines_of(table(spark, sf_dir, "documents"))  # the first step spreads them
    mixed = text_ops.shuffle_rounds(lines, rounds=5)
    return mixed.groupBy(sorted_characters(F.col("value")).alias("characters")).agg(F.count(F.lit(1)).alias("n"))


@query("line_total", f"WITH {LINES} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT value) AS BIGINT) AS distinct_lines FROM lines")
def line_total(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    # distinct by a keyed fold first: one hot line does not gather in one task
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct_lines"))


@query(
    "lines_round_trip",
    f"WITH {LINES} SELECT value, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY value",
)
def lines_round_trip(spark, sf_dir):
    """Text sink, then text scan with a rebalance."""
    path = scratch_path(spark, "lines")
    write_text(document_lines(spark, sf_dir), F.col("value"), path)
    back = text_formats.read_lines(spark, path, partitions=shuffle_partitions(spark), line_end="\n")
    return back.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hash_split",
    f"""SELECT CASE WHEN {uniform_sql('doc_id', seed=13290)} < 0.6 THEN 'train' ELSE 'test' END AS side,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""",
)
def hash_split(spark, sf_dir):
    train, test = split_by_id(table(spark, sf_dir, "documents"), "doc_id", 0.6, seed=13290)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
