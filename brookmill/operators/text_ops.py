"""Word counting, sorting and shuffling of text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import permute_characters, tokens
from ..session import with_input_position
from .ranking import rank_rows


def lines_of(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of a multi-line text column."""
    return df.select(F.explode(F.split(F.col(text), "\n")).alias("value"))


def words(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(tokens(F.col("value"))).alias("word"))


def word_count(lines: DataFrame) -> DataFrame:
    return combine_by_key(words(lines), ["word"], n=F.count(F.lit(1)))


def combine_by_key(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Fold rows per key with any aggregate columns (partial, then final aggregate)."""
    return df.groupBy(*keys).agg(*[col.alias(name) for name, col in aggregates.items()])


def frequent_words(lines: DataFrame, threshold: int) -> DataFrame:
    return word_count(lines).filter(F.col("n") > threshold)


def frequent_words_per_bucket(lines: DataFrame, threshold: int, limit: int = 10, hex_digits: int = 1) -> DataFrame:
    """At most ``limit`` qualifying words in each hash bucket of the vocabulary.

    The rank filter is also applied before the exchange, so a bucket's task receives
    ``limit`` rows from each upstream task at most.
    """
    bucketed = frequent_words(lines, threshold).withColumn("bucket", F.substring(F.md5(F.col("word").cast("binary")), 1, hex_digits))
    order = W.partitionBy("bucket").orderBy(F.desc("n"), "word")
    return bucketed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_k(df: DataFrame, by: str, tie: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def sort_lines(lines: DataFrame) -> DataFrame:
    """All lines in byte order. The input position breaks ties, so that a line that
    makes up much of the text is range-partitioned over several tasks."""
    return with_input_position(lines, "_tie").orderBy("value", "_tie").drop("_tie")


def sort_positions(lines: DataFrame) -> DataFrame:
    """The sorted lines with their 1-based position in the whole output."""
    return rank_rows(lines, [], ["value"])


def shuffle_rounds(lines: DataFrame, rounds: int = 5, partitions: int | None = None, seed: int = 17) -> DataFrame:
    """Spread the lines evenly, then permute the characters of each line and rebalance,
    ``rounds`` times over.

    A line carries a number, and number and round tell its place, so a retried task sends
    its lines where they went before; dealing them out in turn would need a sort before
    every exchange for that. Every round deals the lines of a partition to all others.
    """
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number's low part counts the lines of a split: dealt in turn, starting elsewhere for each split
    placed = lambda df, place: df.repartitionById(n, F.pmod(place, F.lit(n)).cast("int"))
    lines = with_input_position(lines, "_line")
    number = F.col("_line").bitwiseAND(F.lit((1 << 33) - 1)) + F.shiftright("_line", 33)
    lines = placed(lines, number)
    for i in range(rounds):
        moved = lines.select(permute_characters(F.col("value"), seed + i).alias("value"), "_line")
        lines = placed(moved, F.xxhash64("_line", F.lit(i)))
    return lines.drop("_line")


def hash_sorted_partitions(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``key`` and sort inside each partition."""
    spread = df.repartition(partitions, key) if partitions else df.repartition(key)
    return spread.sortWithinPartitions(key)
