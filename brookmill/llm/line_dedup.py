"""Line deduplication behind two Bloom filters.

A line's key is the line without white space at both ends, A-Z in lower case. Keys of at
least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all
their lines, except in the document with the largest id.

One pass fills two Bloom filters of key hashes per task (seen in one document, seen in
two), which a tree of shuffles merges. A second pass shuffles only keys that the second
filter holds, as digests; they are counted exactly, so a false alarm of the filter costs
a row of 24 bytes and never changes a result. When a corpus outgrows the filter, more
rows are shuffled, up to one digest for each long line.

Defined cases: a null or empty text is one empty line; a null id is the smallest id; rows
with the same id count as one document; an empty table gives an empty result; columns
of the table stay, but for ones named like the added ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import HASH, ID, TEXT, ascii_lower, held_rows, let, released, row_hash, strip
from .sketches import repeated, seen_twice

FILTER_BITS, FILTER_HASHES = 26, 2  # bits per hash: 16 MB a filter, 32 MB in a task


def line_key(line: Column) -> Column:
    return ascii_lower(strip(line))


def _hashes(min_chars: int) -> Column:
    """Hashes of a text's long keys, each once."""
    keys = F.filter(F.transform(F.split(TEXT, "\n"), line_key), lambda k: F.char_length(k) >= min_chars)
    return F.transform(F.array_distinct(keys), lambda k: F.xxhash64(k))


def dropped_lines(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``(id, hash of the text, line numbers to drop)`` for rows that lose lines."""
    spark = rows.sparkSession
    flat = lambda batch: batch.column(0).flatten().to_numpy(zero_copy_only=False)
    twice = spark.sparkContext.broadcast(
        seen_twice(rows.select(_hashes(min_chars).alias("h")), FILTER_BITS, FILTER_HASHES, flat)
    )

    @F.pandas_udf("array<boolean>")
    def suspected(lists):
        sizes = lists.map(len).to_numpy()
        every = np.concatenate(lists.to_list()) if sizes.sum() else np.zeros(0, np.int64)
        found = repeated(twice.value, FILTER_BITS, every)
        ends = np.cumsum(sizes)
        return pd.Series([found[e - n:e] for e, n in zip(ends, sizes)])

    lines = F.transform(F.split(TEXT, "\n"), lambda l, i: F.struct(line_key(l).alias("key"), i.alias("at")))
    long_lines = F.filter(lines, lambda l: F.char_length(l["key"]) >= min_chars)
    # only hashes travel to Python, never texts
    marked = (
        rows.select(ID, row_hash().alias(HASH), long_lines.alias("lines"))
        .filter(F.size("lines") > 0)
        .withColumn("hit", suspected(F.transform("lines", lambda l: F.xxhash64(l["key"]))))
        .select(ID, HASH, F.explode(F.filter(F.arrays_zip("lines", "hit"), lambda x: x["hit"])).alias("x"))
        .select(ID, HASH, F.unhex(F.md5("x.lines.key")).alias("key"), F.col("x.lines.at").alias("at"))
    )
    marked = cut_lineage(marked)  # counted and joined
    counted = (
        marked.select("key", ID).distinct().groupBy("key")
        .agg(F.count(F.lit(1)).alias("docs"), F.max(ID).alias("keeper"))
        .filter(F.col("docs") >= min_docs)
    )
    return (
        marked.join(counted, "key").filter(F.col(ID) != F.col("keeper"))
        .groupBy(ID, HASH).agg(F.collect_set("at").alias("gone"))
    )


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text",
               counts: bool = True) -> DataFrame:
    """All rows with the text that stays and, unless ``counts`` is off, ``n_lines`` before
    and ``n_dropped``."""
    rows = held_rows(docs, id_col, text_col)
    gone = dropped_lines(rows, min_chars, min_docs)
    joined = rows.withColumn(HASH, row_hash()).join(gone, [ID, HASH], "left")
    lines = F.split(TEXT, "\n")
    stay = let(lines, lambda ls: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col(TEXT)).otherwise(stay)
    numbers = {"n_lines": F.size(lines).cast("bigint"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")}
    return released(joined, docs.columns, text_col, **{text_col: text}, **(numbers if counts else {}))
