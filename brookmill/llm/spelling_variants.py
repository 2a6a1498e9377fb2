"""Grouping of spelling variants: frequent words that differ by one code point.

Occurrences are counted per task and summed; the words that are long and frequent enough
are the vocabulary. Two words are near when one code point is inserted, deleted or
replaced. Such a step adds one to the count of one letter and takes one from that of
another, or does half of that.

The vocabulary is arranged as a frequency-vector trie: letters fall into ``GROUPS``
groups, and a word's path is the successive counts of its groups. A search walks the trie
depth first with a budget of one surplus and one deficit; words at the leaves it reaches
are verified letter by letter. The trie is shared out by its upper levels: a word is held
under the one upper path that is its own, and asks under the few that its budget reaches
(once for each surplus, each deficit and each of both). Upper levels are as many as it
takes for a path to hold few words; where one path still holds more than a task's share,
its words are dealt to slices that every asker visits. Askers are read in pieces, so no
task holds an unbounded group.

A word's form is its near word with the most occurrences (ties: the smallest by code
points), if that has at least ``factor`` times its own. Forms lead to ever more frequent
words, so doubling the steps finds every root in logarithmically many rounds.

Defined cases: null and empty texts have no words; a null id is written as nothing in the
checksum; rows of one id count like any others; an empty table gives an empty result;
other columns of the table play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import ID, NO_ID, TEXT, held_rows

MIN_CHARS, MIN_COUNT, FACTOR, NOISE = 6, 5, 5, 199
GROUPS = 16  # levels of the trie
HELD = 20_000  # words of a path that are searched as one trie
WIDTH = 24  # letters compared as rows of bytes; longer words are compared one by one
PAIRS = 1 << 15  # candidate pairs verified at once
FLUSH = 200_000  # distinct words counted in a task before they are sent on
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# fixed values: letters by how often they stand in European text, so that groups are even
COMMON = "eaniostrldchumgpbfvwkzyjxq"


def letter_group(c: int) -> int:
    """The group of a code point: common letters share theirs with rare ones only."""
    at = COMMON.find(chr(c))
    return (at if at >= 0 else c) % GROUPS


_GROUP_OF = np.array([letter_group(c) for c in range(0x100)], np.int64)


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, noise: int = NOISE,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: runs of letters after A-Z is lower-cased and one code point of every
    ``noise``-th (document, run) pair is deleted, with their numbers of occurrences."""
    rows = held_rows(docs, id_col, text_col)
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_chars},}}")

    def count(batches):
        seen: Counter[str] = Counter()

        def table():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = crc32(b":" if i == NO_ID else b"%d:" % i)
                for word, n in Counter(runs.findall(text.as_py().translate(_LOWER).decode())).items():
                    h = crc32(word.encode(), start)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= min_chars:
                        seen[word] += n
                if len(seen) > FLUSH:
                    yield table()
                    seen.clear()
        yield table()

    counted = rows.select(ID, F.encode(TEXT, "UTF-8")).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def frequency_vectors(words: list[str]) -> np.ndarray:
    """Letters per group, one row per word."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    flat = np.repeat(np.arange(len(words)) * GROUPS, sizes) + _GROUP_OF[letters]
    return np.bincount(flat, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def path_key(counts: np.ndarray) -> np.ndarray:
    """A number per row of counts: equal for equal rows."""
    key = np.full(len(counts), counts.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for level in range(counts.shape[1]):
            key = key * np.uint64(1_000_003) + counts[:, level].astype(np.uint64) + np.uint64(1)
    return key.view(np.int64)


def reached_paths(counts: np.ndarray) -> list[np.ndarray]:
    """Upper paths within the budget: the own one, one surplus, one deficit, one of each."""
    depth = counts.shape[1]
    steps = [np.zeros(depth, np.int64)]
    one = np.eye(depth, dtype=np.int64)
    steps += [*one, *-one] + [one[a] - one[b] for a in range(depth) for b in range(depth) if a != b]
    return [counts + s for s in steps]


def one_step(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class Spelled:
    """Words, their lengths, and up to ``WIDTH`` letters of each as rows of bytes, aligned
    at either end (the right end first)."""

    def __init__(self, words: list[str]):
        self.words, self.sizes = words, np.array([len(w) for w in words], np.int64)
        rows = lambda pad: np.frombuffer("".join(pad(w, WIDTH, "\0") for w in (w[-WIDTH:] if pad is str.rjust else w[:WIDTH] for w in words)).encode("latin-1"), np.uint8)
        self.heads = rows(str.ljust).reshape(-1, WIDTH)
        self.tails = rows(str.rjust).reshape(-1, WIDTH)[:, ::-1]


def verified(left: Spelled, q: np.ndarray, right: Spelled, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs that are one step apart: what two words share at both ends
    leaves at most one letter of the longer one."""
    a, b = left.sizes[q], right.sizes[w]
    ok = np.abs(a - b) <= 1
    q, w, a, b = q[ok], w[ok], a[ok], b[ok]
    shared, low, high = np.zeros(len(q), np.int64), np.minimum(a, b), np.maximum(a, b)
    for rows, others in ((left.heads, right.heads), (left.tails, right.tails)):
        for at in range(0, len(q), PAIRS):
            part = slice(at, at + PAIRS)
            differ = rows[q[part]] != others[w[part]]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
            shared[part] += np.minimum(same, low[part])
    near = (shared >= high - 1) & (shared < 2 * high)
    for k in np.flatnonzero(high > WIDTH):
        near[k] = one_step(left.words[q[k]], right.words[w[k]])
    return q[near], w[near]


class Trie:
    """Words by the successive counts of their letter groups, levels ``depth`` and below.

    Nodes are ranges of the sorted words, so a level is a list of bounds and the values
    that they hold; the search goes down for many words at once, a level at a time, and
    keeps the (word, node, surplus left, deficit left) that are within the budget.
    """

    def __init__(self, words: list[str], counts: list[int], depth: int):
        vectors = frequency_vectors(words)
        order = np.lexsort(vectors[:, ::-1].T)
        self.n = np.array(counts, np.int64)[order]
        self.words = [words[i] for i in order]
        self.spelled = Spelled(self.words)
        self.vectors, self.depth = vectors[order], depth
        # a node of a level starts where the counts up to that level differ from the word before
        new = np.zeros(len(words), bool)
        new[:1] = True
        self.levels = []
        for level in range(depth, GROUPS):
            new = new.copy()
            new[1:] |= self.vectors[1:, level] != self.vectors[:-1, level]
            starts = np.flatnonzero(new)
            self.levels.append((starts, self.vectors[starts, level]))
        self.ends = [np.r_[starts[1:], len(words)] for starts, _ in self.levels]

    def near(self, words: list[str], vectors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        """Pairs (asking word, word of the trie) that are one step apart, as two arrays."""
        asking = np.arange(len(words))
        low, high = np.zeros(len(words), np.int64), np.full(len(words), len(self.words))
        for k, (starts, values) in enumerate(self.levels):
            first, last = np.searchsorted(starts, low), np.searchsorted(starts, high)
            each = last - first
            node = np.repeat(first - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
            asking, surplus, deficit = (np.repeat(x, each) for x in (asking, surplus, deficit))
            step = values[node] - vectors[asking, self.depth + k]
            ok = (step <= surplus) & (-step <= deficit)
            asking, node, step = asking[ok], node[ok], step[ok]
            surplus, deficit = surplus[ok] - np.maximum(step, 0), deficit[ok] - np.maximum(-step, 0)
            low, high = starts[node], self.ends[k][node]
        each = high - low
        q = np.repeat(asking, each)
        w = np.repeat(low - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
        return verified(Spelled(words), q, self.spelled, w)


def near_pairs(vocab: DataFrame, depth: int, held: int = HELD) -> DataFrame:
    """``(word, n, other, other_n)`` for all ordered pairs of near words."""
    spark = vocab.sparkSession

    def place(batches):
        """Each word under its own upper path, and as an asker under all that it reaches."""
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            n = batch.column(1)
            counts = frequency_vectors(words)[:, :depth]
            for k, other in enumerate([counts, *reached_paths(counts)]):
                step = other - counts
                ok = np.flatnonzero((other >= 0).all(axis=1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(path_key(other[ok])), pa.array(np.full(len(ok), k > 0)),
                    batch.column(0).take(pa.array(ok)), n.take(pa.array(ok)),
                    pa.array((1 - np.maximum(step, 0).sum(axis=1))[ok].astype(np.int32)),
                    pa.array((1 - np.maximum(-step, 0).sum(axis=1))[ok].astype(np.int32))],
                    ["path", "asks", "word", "n", "surplus", "deficit"])

    placed = cut_lineage(vocab.mapInArrow(place, "path bigint, asks boolean, word string, n bigint, surplus int, deficit int"))
    # a path of more words than one trie holds is split: the words are dealt to slices, and
    # each asker visits every slice of its path
    sizes = placed.filter(~F.col("asks")).groupBy("path").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("slices"))
    sizes = cut_lineage(sizes)
    dealt = placed.join(sizes, "path")  # askers of paths without words go here
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    own = F.array(F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("slice", F.explode(F.when(F.col("asks"), every).otherwise(own)))

    def search(batches):
        """Tries come before their askers; both are read in pieces of bounded size."""
        trie, at, words, counts = None, None, [], []

        def pairs(asked):
            for start in range(0, len(asked[0]), 2_000):
                part = [x[start:start + 2_000] for x in asked]
                q, w = trie.near(part[0], frequency_vectors(part[0]), np.array(part[2]), np.array(part[3]))
                if len(q):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part[0][i] for i in q], pa.string()), pa.array([part[1][i] for i in q], pa.int64()),
                        pa.array([trie.words[i] for i in w], pa.string()), pa.array(trie.n[w])],
                        ["word", "n", "other", "other_n"])

        for batch in batches:
            path, slice_, asks, word, n, surplus, deficit = (c.to_pylist() for c in batch.columns)
            start = 0
            while start < len(path):
                key = (path[start], slice_[start])
                end = start
                while end < len(path) and (path[end], slice_[end]) == key:
                    end += 1
                if key != at:
                    at, trie, words, counts = key, None, [], []
                split = start
                while split < end and not asks[split]:
                    split += 1
                words += word[start:split]
                counts += n[start:split]
                if split < end and words:
                    if trie is None:
                        trie = Trie(words, counts, depth)
                    yield from pairs([x[split:end] for x in (word, n, surplus, deficit)])
                start = end

    dealt = dealt.select("path", "slice", "asks", "word", "n", "surplus", "deficit")
    ready = dealt.repartition("path", "slice").sortWithinPartitions("path", "slice", "asks")
    return ready.mapInArrow(search, "word string, n bigint, other string, other_n bigint")


def upper_depth(words: int, held: int = HELD) -> int:
    """Levels above the parts of the trie. Each level tells some three counts apart."""
    depth = 2
    while depth < GROUPS // 2 and words > held * 3**depth // 8:
        depth += 1
    return depth


def roots(formed: DataFrame) -> DataFrame:
    """``(word, root)`` of all words that have a form, by doubling the steps taken."""
    steps = cut_lineage(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut_lineage(steps.join(after, "root", "left"))
        steps = further.select("word", F.coalesce("next", "root").alias("root"))
        if further.filter(F.col("next").isNotNull()).isEmpty():
            return steps


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR,
                      noise: int = NOISE, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word of the vocabulary."""
    vocab = cut_lineage(vocabulary(docs, min_chars, min_count, noise, id_col, text_col))
    pairs = near_pairs(vocab, upper_depth(vocab.count(), held), held)
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), F.col("other")))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = vocab.join(near, "word", "left")
    enough: Column = F.col("best.other_n") >= factor * F.col("n")
    formed = cut_lineage(formed.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, F.col("best.other_n")).alias("form_n")))
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))
