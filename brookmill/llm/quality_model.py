"""Quality classifier: a generalised additive model with pairwise interactions.

Spark measures each text with built-in functions. The model is a lookup table per measure
and per chosen pair of measures; a score is the logistic of an intercept plus one entry
of each table, added up for a whole batch at once. Tables are learnt by cyclic boosting:
measures take turns, and each turn fits a tree with few leaves to the gradients of one
measure's bins and adds a small step of it to that table. Pairs are then picked by what a
two-level tree on both could still gain, and boosted in the same way.

The fit uses at most ``sample`` labelled rows, those with the smallest digests of their
ids, so its size does not depend on the corpus. Scores use the text alone.

Defined cases: a null text is empty, an empty text has a score as any other; ids without
a label, labels without a document and null labels are not learnt from; repeated labels
count once each distinct value; without any label every score is 0.5; an empty table gives
an empty result; columns of the table stay, but for ones named like the added ones.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ID, ROW, TEXT, held_rows, let, released, words

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 160, 80, 0.1, 4
SHRINK = 1.0  # added to the curvature of a leaf
THRESHOLD = 0.3


# ---------------------------------------------------------------- measures

def measures(text: Column) -> Column:
    """A struct of doubles that describe a text."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    share = lambda pattern: (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))) / chars

    def of_words(ws: Column) -> Column:
        n = F.greatest(F.size(ws), F.lit(1))
        twice = F.zip_with(F.slice(ws, 2, n), ws, lambda a, b: a == b)
        return F.struct(
            F.log1p(F.size(ws).cast("double")).alias("words"),
            (F.size(F.array_distinct(ws)) / n).alias("distinct_words"),
            (F.size(F.filter(twice, lambda t: t)) / n).alias("echoes"),
        )

    lines = let(F.split(text, "\n"), lambda ls: F.struct(
        (F.size(F.array_distinct(ls)) / F.size(ls)).alias("distinct_lines"), F.log1p(chars / F.size(ls)).alias("line_length")))
    return let(F.struct(let(words(text), of_words).alias("w"), lines.alias("l")), lambda m: F.struct(
        m["w"]["words"].alias("words"), m["w"]["distinct_words"].alias("distinct_words"), m["w"]["echoes"].alias("echoes"),
        m["l"]["distinct_lines"].alias("distinct_lines"), m["l"]["line_length"].alias("line_length"),
        (chars / (F.expm1(m["w"]["words"]) + 1)).alias("word_length"),
        share(r"[#*$%&<>]+").alias("symbols"), share(r"\|+").alias("bars"), share("!+").alias("calls"),
        share(r"[A-ZÀ-ÖØ-Þ]+").alias("capitals"), share("[0-9]+").alias("digits"), share("[.,;:?]+").alias("stops"),
    ))


NAMES = ("words distinct_words echoes distinct_lines line_length word_length "
         "symbols bars calls capitals digits stops").split()


# ---------------------------------------------------------------- model

@dataclass
class Model:
    """Bin edges per measure, a table per measure and per pair of measures."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
        for (f, g), table in self.pairs.items():
            total += table[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.zeros(0)


def _gain(g, h):
    return g * g / (h + SHRINK)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values per bin of a tree over ordered bins, grown by the best split first."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    sums_g, sums_h = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for lo, hi in parts:
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            left_g, left_h = sums_g[at] - sums_g[lo], sums_h[at] - sums_h[lo]
            all_g, all_h = sums_g[hi] - sums_g[lo], sums_h[hi] - sums_h[lo]
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (gains[k], (lo, hi), int(at[k]))
        if best[1] is None:
            break
        (lo, hi), at = best[1:]
        parts.remove((lo, hi))
        parts += [(lo, at), (at, hi)]
    for lo, hi in parts:
        out[lo:hi] = (sums_g[hi] - sums_g[lo]) / (sums_h[hi] - sums_h[lo] + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A split of the first axis with a split of the second on each side, and its gain."""
    down_g, down_h = g.cumsum(0), h.cumsum(0)
    best, out = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum())
    for at in range(len(g) - 1):
        sides, total = [], -whole
        for side_g, side_h in ((down_g[at], down_h[at]), (down_g[-1] - down_g[at], down_h[-1] - down_h[at])):
            cg, ch = side_g.cumsum(), side_h.cumsum()
            gains = _gain(cg, ch) + _gain(cg[-1] - cg, ch[-1] - ch)
            k = int(np.argmax(gains))
            total += gains[k]
            sides.append((k, cg[k] / (ch[k] + SHRINK), (cg[-1] - cg[k]) / (ch[-1] - ch[k] + SHRINK)))
        if total > best:
            best = total
            for rows, (k, low, high) in zip((slice(0, at + 1), slice(at + 1, None)), sides):
                out[rows, :k + 1], out[rows, k + 1:] = low, high
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single measures, then of the most promising pairs."""
    n, width = x.shape if len(x) else (0, len(NAMES))
    edges = [_edges(x[:, f], BINS) if n else np.zeros(0) for f in range(width)]
    coarse_edges = [_edges(x[:, f], PAIR_BINS) if n else np.zeros(0) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not n:
        return Model(0.0, edges, tables, coarse_edges, {})
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    intercept = float(np.log(mean / (1 - mean)))
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    total = np.full(n, intercept)

    def gradients():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = gradients()
            size = len(tables[f])
            step = RATE * _shallow_tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), LEAVES)
            tables[f] += step
            total += step[at[f]]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse_edges)]
    sizes = [len(e) + 1 for e in coarse_edges]

    def pair_sums(f, k, values):
        return np.bincount(coarse[f] * sizes[k] + coarse[k], values, sizes[f] * sizes[k]).reshape(sizes[f], sizes[k])

    g, h = gradients()
    gains = {(f, k): _pair_tree(pair_sums(f, k, g), pair_sums(f, k, h))[1] for f, k in itertools.combinations(range(width), 2)}
    chosen = sorted((p for p in gains if gains[p] > 0), key=lambda p: (-gains[p], p))[:PAIRS]
    pairs = {(f, k): np.zeros((sizes[f], sizes[k])) for f, k in chosen}
    for _ in range(PAIR_ROUNDS):
        for f, k in chosen:
            g, h = gradients()
            step = RATE * _pair_tree(pair_sums(f, k, g), pair_sums(f, k, h))[0]
            pairs[f, k] += step
            total += step[coarse[f], coarse[k]]
    return Model(intercept, edges, tables, coarse_edges, pairs)


# ---------------------------------------------------------------- tables

def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample`` labelled rows outside of the held-out fold."""
    wanted = (
        labels.select(F.col(id_col).cast("bigint").alias("_l"), F.col(label_col).cast("double").alias("_y"))
        .filter(F.col("_y").isNotNull() & F.col("_l").isNotNull() & ~is_held_out(F.col("_l"))).distinct()
        .orderBy(F.xxhash64("_l"), "_l", "_y").limit(sample)
    )
    # at most `sample` short rows: bounded whatever the size of the table
    known = held_rows(docs, id_col, text_col).join(F.broadcast(wanted), F.col(ID) == F.col("_l"))
    got = known.select(ID, "_y", measures(F.col(TEXT)).alias("m")).select(ID, "_y", "m.*")
    got = got.orderBy(F.xxhash64(ID), ID, "_y", *NAMES).limit(sample).toPandas()
    return fit(got[NAMES].to_numpy(float), got["_y"].to_numpy(float))


def _scored(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str, text_col: str) -> DataFrame:
    """Held rows with ``_score``."""
    model = train(docs, labels, label_col, sample, id_col, text_col)
    rows = held_rows(docs, id_col, text_col)
    # plain values: a broadcast names the classes in it, which workers may not have
    shared = rows.sparkSession.sparkContext.broadcast((model.intercept, model.edges, model.tables, model.pair_edges, model.pairs))

    @F.pandas_udf("double")
    def score(m: pd.DataFrame) -> pd.Series:
        return pd.Series(Model(*shared.value).score(m[NAMES].to_numpy(float)))

    return rows.withColumn("_score", score(measures(F.col(TEXT))))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with ``held_out``, ``score`` and ``predicted`` (1: good)."""
    return released(
        _scored(docs, labels, label_col, sample, id_col, text_col), docs.columns, text_col,
        held_out=is_held_out(F.col(f"{ROW}.`{id_col}`")), score=F.col("_score"),
        predicted=F.when(F.col("_score") >= threshold, 1).otherwise(0),
    )


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are predicted to be good, with their own columns."""
    return released(_scored(docs, labels, label_col, sample, id_col, text_col).filter(F.col("_score") >= threshold), docs.columns, text_col)
