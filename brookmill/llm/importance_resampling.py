"""Resampling of documents towards a target distribution by importance weights.

Features are runs of one to ``longest`` words, hashed into ``buckets``. A bucket's gain is
a thousand times the logarithm of how much likelier it is in the target than in the
documents, with one added to every count; a document's weight is the floored mean of its
features' gains. Gumbel noise from a digest of the id turns the draw without replacement
into a top-k of the scores.

Two passes over the texts: one counts buckets (an array per task, merged by a tree of
shuffles), one looks every feature's gain up in an array of fixed size. Scores are then
written once. The cutoff is found by bisection with exact count jobs over that table, on
the score first and among the rows of the cutoff score on the id, so no sort, window or
group ever holds the candidates; only the drawn rows are range-partitioned to be ranked.

Defined cases: null texts have no words; a document without features has weight 0; a null
id is the smallest id, and its noise is that of an empty name; rows of one id are ranked
by a hash of their text and share what is equal in both; documents shorter than
``min_words`` are scored and never drawn; an empty table gives an empty result and an
empty target gives equal counts (0); columns of the table stay, but for ones named like
the added ones.
"""

from __future__ import annotations

import math
import zlib
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import rank_rows
from ..session import cut_lineage
from .common import HASH, ID, LOWER, NO_ID, ROW, TEXT, UPPER, held_rows, released, row_hash
from .sketches import PIECES, SCHEMA, as_table, merged, task_number

BUCKETS, LONGEST, SEED = 10_000, 2, 7
CUTS = 31  # cut points counted by one job: five halvings at once
# every byte of UTF-8 that is part of a word stays, A-Z in lower case; others part words
_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def text_features(text: bytes, longest: int = LONGEST) -> tuple[int, list[int]]:
    """Number of words and the checksums of all runs of up to ``longest`` words."""
    words = text.translate(_WORD_BYTES).split()
    run = list(map(crc32, words))
    found = list(run)
    more = [b" " + w for w in words]
    for k in range(1, min(longest, len(words))):
        run = list(map(crc32, more[k:], run))  # the checksum of a run goes on with the next word
        found += run
    return len(words), found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over all texts of the one binary column."""
    width = -(-buckets // PIECES)

    def build(batches):
        counts = np.zeros(width * PIECES, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = np.array(text_features(text.as_py() or b"", longest)[1], np.int64)
                counts += np.bincount(found % buckets, minlength=len(counts))
        for k, piece in enumerate(np.split(counts, PIECES)):
            if piece.any():
                yield as_table([(task_number(), k, zlib.compress(piece.tobytes(), 1))])

    out = np.zeros(width * PIECES, np.int64)
    for k, piece in merged(texts.mapInArrow(build, SCHEMA), np.int64, np.add).items():
        out[k * width:(k + 1) * width] = piece
    return out[:buckets]


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold logarithms of the smoothed ratio, one per bucket."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    gain = lambda s, t: math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
    return np.array([gain(s, t) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(id_text: Column, seed: int) -> Column:
    """A thousand times standard Gumbel noise, from a digest of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def kth_largest(df: DataFrame, value: Column, k: int) -> int | None:
    """The ``k``-th largest of the whole numbers ``value``, by counting; None if there are
    fewer. A job counts the rows above several cut points, which narrows the range by as
    many halvings as it has cut points for."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).first()
    if k < 1 or ends["n"] < k:
        return None
    low, high = ends["low"], ends["high"]
    while low < high:  # the answer lies in low..high
        span = high - low
        cuts = sorted({low - (low - high) * (i + 1) // (CUTS + 1) for i in range(CUTS)} - {low} | {high})
        above = df.agg(*[F.count(F.when(value >= F.lit(c), 1)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        reached = [c for i, c in enumerate(cuts) if above[i] >= k]
        missed = [c for i, c in enumerate(cuts) if above[i] < k]
        low, high = max([low, *reached]), min([high, *[c - 1 for c in missed]])
    return low


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
          id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Held rows with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    rows = held_rows(docs, id_col, text_col)
    source = bucket_counts(rows.select(F.encode(TEXT, "UTF-8")), buckets, longest)
    wanted = bucket_counts(target.select(F.encode(F.col(f"`{target_text_col}`"), "UTF-8")), buckets, longest)
    gains = rows.sparkSession.sparkContext.broadcast(bucket_gains(source, wanted))

    @F.pandas_udf("n_words bigint, n_features bigint, weight bigint")
    def measured(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            n, found = text_features(text, longest)
            total = int(gains.value[np.array(found, np.int64) % buckets].sum()) if found else 0
            out.append((n, len(found), total // max(len(found), 1)))
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    name = F.coalesce(F.when(F.col(ID) != NO_ID, F.col(ID)).cast("string"), F.lit(""))
    scored = rows.withColumn("_m", measured(F.encode(TEXT, "UTF-8")))
    return scored.select(ROW, ID, TEXT, "_m.*").withColumn("score", F.col("weight") + noise(name, seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = BUCKETS,
             longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", texts: bool = True) -> DataFrame:
    """All rows with ``n_features``, ``weight``, ``score`` and ``rank``: 1, 2, 3... for the
    ``percent`` of the long enough documents with the largest scores (ties to smaller ids),
    null for the others. Without ``texts`` the text column is left out."""
    columns = [c for c in docs.columns if texts or c != text_col]
    scored = weigh(docs, target, buckets, longest, seed, id_col, text_col, target_text_col).withColumn(HASH, row_hash())
    scored = cut_lineage(scored if texts else scored.drop(TEXT))
    able = F.col("n_words") >= min_words
    draw = scored.filter(able).count() * percent // 100
    cut = kth_largest(scored.filter(able), F.col("score"), draw)
    if cut is None:
        drawn = F.lit(False)
    else:
        # among ties of the cutoff the smallest ids are drawn: the largest complements
        above = scored.filter(able & (F.col("score") > cut)).count()
        last = kth_largest(scored.filter(able & (F.col("score") == cut)), F.bitwise_not(ID), draw - above)
        drawn = able & ((F.col("score") > cut) | ((F.col("score") == cut) & (F.bitwise_not(ID) >= F.lit(last))))
    # only rows of one id can be left beyond the number to draw
    picked = rank_rows(scored.filter(drawn).withColumn("_down", -F.col("score")), [], ["_down", ID, HASH], "rank").drop("_down")
    picked = picked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    both = picked.unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("bigint")))
    if not texts:
        both = both.withColumn(TEXT, F.lit(None).cast("string"))
    added = {c: F.col(c) for c in ("n_features", "weight", "score", "rank")}
    return released(both, columns, text_col, **added)
