"""Removal of passages that an earlier document holds too, behind a count-min prefilter.

A window is ``window`` consecutive words of one document. Words covered by a window whose
word sequence also starts in a document with a smaller id are removed; windows are judged
on the input.

A window is represented in the sketch by its smallest word-gram hash, which depends on the
window's words alone. Equal windows share it, so the number of documents in which that
gram is the smallest of some window is at least the number of documents with the window.
First pass: each task counts its documents' smallest grams in a count-min sketch whose
counters stop at two; the tasks' sketches are merged. Second pass: only windows whose
estimate is two are shuffled, as 95 bits of hashes of their words, and grouped exactly. The
estimate is never too low, so no repeat is lost; a sketch too small for a corpus lets
more windows through and changes nothing else.

Defined cases: null and blank texts have no words; texts with fewer words than a window
lose nothing; a null id is the smallest id; windows repeated only inside documents of the
same id stay; an empty table gives an empty result; columns of the table stay, but for
ones named like the added ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from .common import HASH, ID, TEXT, held_rows, let, released, row_hash, words
from .sketches import mix, repeated, seen_twice

WINDOW, GRAM = 50, 32
SKETCH_BITS, SKETCH_ROWS = 26, 2
_POWERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLOCK = 1 << 20  # positions worked on at once


def _rolled(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of every run of ``size`` words, by doubling: log2(size) vector steps."""
    with np.errstate(over="ignore"):
        base64, out, out_len = np.uint64(base), None, 0
        power, block, length = base64, h, 1
        while True:
            if size & length:
                if out is None:
                    out, out_len = block, length
                else:
                    keep = len(h) - (out_len + length) + 1
                    out = out[:keep] * power + block[out_len:out_len + keep]
                    out_len += length
            if length * 2 > size:
                return out
            block = block[:-length] * power + block[length:]
            power, length = power * power, length * 2


def smallest_grams(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of a text, the smallest hash of its grams."""
    grams = mix(_rolled(h, gram, _POWERS[0]), 1)
    span = window - gram + 1
    out = np.empty(len(grams) - span + 1, np.uint64)
    for at in range(0, len(out), BLOCK):
        piece = grams[at:at + BLOCK + span - 1]
        out[at:at + BLOCK] = sliding_window_view(piece, span).min(axis=1)
    return out


def _texts(batch: pa.RecordBatch, column: int):
    """(row, word hashes) of each text that has words."""
    lists = batch.column(column)
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = lists.offsets.to_numpy()
    for row in range(len(lists)):
        yield row, values[ends[row]:ends[row + 1]]


def repeated_windows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``(id, 32 bits of the text's hash, first word)`` of windows that an earlier document
    holds. Windows are told apart by 95 bits of two hashes."""
    hashed = rows.select(ID, row_hash().alias(HASH), F.transform(words(F.col(TEXT)), lambda w: F.xxhash64(w)).alias("h"))

    def read(batch):
        found = [np.unique(smallest_grams(h, window, gram)) for _, h in _texts(batch, 0) if len(h) >= window]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    twice = rows.sparkSession.sparkContext.broadcast(seen_twice(hashed.select("h"), SKETCH_BITS, SKETCH_ROWS, read))

    def windows(batches):
        names = ["a", "b", ID, "place"]
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, h in _texts(batch, 2):
                if len(h) < window:
                    continue
                least = smallest_grams(h, window, gram)
                change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                hit = np.repeat(repeated(twice.value, SKETCH_BITS, least[change]), np.diff(np.r_[change, len(least)]))
                at = np.flatnonzero(hit)
                if len(at):
                    a, b = (mix(_rolled(h, window, p), 2)[at] for p in _POWERS)
                    place = (at << 32) | (int(texts[row]) & 0xFFFFFFFF)
                    columns = [a.view(np.int64), (b >> np.uint64(33)).astype(np.int32), np.full(len(at), ids[row]), place]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    # made twice rather than written: the rows outweigh the work
    found = hashed.mapInArrow(windows, f"a bigint, b int, {ID} bigint, place bigint")
    first = found.groupBy("a", "b").agg(F.min(ID).alias("first"))
    later = found.join(first, ["a", "b"]).filter(F.col(ID) > F.col("first"))
    return later.select(ID, F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias(HASH), F.shiftright("place", 32).cast("int").alias("at"))


def _kept(starts: Column, size: Column, window: int) -> Column:
    """Stretches (from, length) left over when windows start at the sorted ``starts``."""
    bounds = F.concat(F.array((-F.lit(window)).cast("int")), starts, F.array(size))
    gaps = lambda bs: F.transform(F.sequence(F.lit(1), F.size(bs) - 1), lambda i: F.struct(
        (F.get(bs, i - 1) + window).alias("from"), (F.get(bs, i) - F.get(bs, i - 1) - window).alias("length")))
    return F.filter(let(bounds, gaps), lambda g: g["length"] > 0)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with the words that stay, joined by one blank, ``n_words`` before and
    ``n_removed``."""
    rows = held_rows(docs, id_col, text_col)
    starts = repeated_windows(rows, window, gram).groupBy(ID, HASH).agg(F.sort_array(F.collect_set("at")).alias("starts"))
    joined = rows.withColumn(HASH, row_hash().bitwiseAND(F.lit(0xFFFFFFFF))).join(starts, [ID, HASH], "left")
    none = F.array().cast("array<int>")
    # the first start has no stretch before it unless it is above 0: its left bound is -window
    cut = let(words(F.col(TEXT)), lambda ws: let(_kept(F.coalesce("starts", none), F.size(ws), window), lambda gs: F.struct(
        F.size(ws).cast("bigint").alias("n"),
        F.flatten(F.transform(gs, lambda g: F.slice(ws, g["from"] + 1, g["length"]))).alias("kept"))))
    joined = joined.withColumn("_cut", cut)
    return released(
        joined, docs.columns, text_col,
        **{text_col: F.array_join("_cut.kept", " ")},
        n_words=F.col("_cut.n"),
        n_removed=(F.col("_cut.n") - F.size("_cut.kept")).cast("bigint"),
    )
