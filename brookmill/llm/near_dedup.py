"""Near-duplicate classes by consistent weighted sampling.

A text is a weighted set of five-word shingles: term frequency times a saturating inverse
document frequency. Document frequencies are counted over the whole corpus in a hashed table of
fixed size, filled per task and merged. Improved consistent weighted sampling draws a
shingle and a weight level per hash; two texts draw the same with the probability of their
weighted Jaccard similarity. Draws are banded (10 bands of 3: a pair at 0.8 is missed once
in a thousand), and candidates are verified by exact weighted Jaccard.

Texts with the same words are one node. Shingles that only one
candidate holds bound its similarity to all others, so nodes and pairs that cannot reach
the threshold are left out before any comparison (a sketch tells which shingles; it may
call a lone one shared, which only weakens the bound).

In each bucket one node leads: the one whose buckets hold the most nodes, which stands in
the middle of its copies. The others are compared with it, unless their marks (``MARKS``
further draws) agree so seldom that a link is unlikely, and links bring groups together.
Then every bucket that still holds several groups is compared in full: all pairs of two
groups, whatever their marks say, but none within a group. Its members are dealt to parts
of at most about ``PART_ROWS`` texts and ``PART_WORDS`` words; a task takes two parts, gets
all their similarities as a product of matrices, and gives back only links that join groups,
so pairs are never rows. Parts within the leader's group do not meet: what is dealt grows
with the members in that group times the parts outside of it, and the square of the latter.
So no pair that shares a bucket and meets the threshold stays in two classes. Classes are
the connected components of all links found.

Defined cases: null texts are empty; texts with the same words (so also all empty ones)
are one class; texts shorter than a shingle are one shingle of all their words; a null id
is the smallest id; rows equal in id and text share a class; an empty table gives an empty
result; columns of the table stay, but for ones named like the added ones.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .common import HASH, ID, TEXT, held_rows, released, row_hash, words
from .sketches import PIECES, SCHEMA, as_table, merged, mix, repeated, seen_twice, slots, task_number
from .substring_dedup import _POWERS, _rolled, _texts

SIMILARITY, SHINGLE, BANDS, BAND_ROWS = 0.8, 5, 10, 3
FREQUENCY_BITS = 20
FULL_WEIGHT, PRIOR = 3, 100
SHARED_BITS, SHARED_ROWS = 26, 2
SLACK = 1e-6  # of rounding, between a bound and an exact similarity
MARKS, ODDS = 64, 3.7
PART_ROWS, PART_WORDS = 1 << 9, 1 << 19
COLUMNS = 1 << 12  # of a matrix of shingles
BLOCK = 1 << 10  # shingles drawn from at once
REMEMBERED = 32


def shingles(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, in order, and how often each occurs."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(mix(_rolled(h, min(size, len(h)), _POWERS[0]), len(h) if len(h) < size else 0), return_counts=True)


def inverse_frequencies(counts: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequencies from the hashed counts.

    They stop growing at that of a shingle in one of ``FULL_WEIGHT`` documents: what all
    texts carry counts less, but the words in which near copies differ never outweigh the
    many they share, however large a group of copies is. ``PRIOR`` documents without any
    of the shingles are added, for small tables.
    """
    idf = np.log1p((documents + PRIOR) / np.maximum(counts, 1)) / np.log1p(FULL_WEIGHT)
    return np.minimum(idf, 1.0).astype(np.float32)


def weigh(idf: np.ndarray, found: np.ndarray, times: np.ndarray) -> np.ndarray:
    return idf[slots(found, 0, FREQUENCY_BITS)] * times.astype(np.float32)


def document_frequencies(hashed: DataFrame, size: int) -> np.ndarray:
    """Documents per slot of a hashed table of shingles, over all documents."""

    def build(batches):
        counts = np.zeros(2**FREQUENCY_BITS, np.uint32)
        for batch in batches:
            for _, h in _texts(batch, 0):
                counts[np.unique(slots(shingles(h, size)[0], 0, FREQUENCY_BITS))] += 1
        for k, piece in enumerate(np.split(counts, PIECES)):
            if piece.any():
                yield as_table([(task_number(), k, zlib.compress(piece.tobytes(), 1))])

    pieces = merged(hashed.select("h").mapInArrow(build, SCHEMA), np.uint32, np.add)
    out = np.zeros(2**FREQUENCY_BITS, np.uint32)
    width = len(out) // PIECES
    for k, piece in pieces.items():
        out[k * width:(k + 1) * width] = piece
    return out


def _unit(hashes: np.ndarray) -> np.ndarray:
    """Uniform numbers of (0, 1) that grow with the hash."""
    return ((hashes >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Sampler:
    """Draws of improved consistent weighted sampling. Each (shingle, draw) has random
    numbers of its own, from 64-bit hashes of both, so that no two shingles share theirs.

    The value of weight 1 is standard exponential. It is drawn first, and the others as
    they are distributed beside it: with value ``a``, the upper level ``z`` is 1 plus an
    exponential of rate ``a``, ``c`` is ``a * z``, ``r`` is ``log z`` plus a standard
    exponential, and ``beta`` is ``1 - log z / r``. Among shingles of weight 1 the smallest
    hash is then the smallest value, and no other number of theirs is needed.
    """

    def __init__(self, draws: int, seed: int = 7):
        self.draws = draws
        self.salts = mix(np.arange(draws), 100 + seed)[:, None]

    def _values(self, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the values, and the levels, of shingles of any weight."""
        a = -np.log1p(-_unit(hashes))
        log_z = np.log1p(-np.log(_unit(mix(hashes, 4))) / a)
        r = log_z - np.log(_unit(mix(hashes, 5)))
        beta = 1 - log_z / r
        level = np.floor(np.log(weights) / r + beta)
        return np.log(a) + log_z - r * (level - beta + 1), level

    def __call__(self, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A hash of (shingle, level) per draw; ``found`` is sorted and not empty."""
        least = np.full(self.draws, np.inf)
        drawn, levels = np.zeros(self.draws, np.uint64), np.zeros(self.draws)
        every, weights = np.arange(self.draws), weights.astype(np.float64)

        def take(f, best, value, level):
            nonlocal least, drawn, levels
            better = value < least
            least, drawn, levels = np.where(better, value, least), np.where(better, f[best], drawn), np.where(better, level, levels)

        one = weights == 1
        for f, w in ((found[one], None), (found[~one], weights[~one])):
            for start in range(0, len(f), BLOCK):
                part = f[start:start + BLOCK]
                hashes = mix(part[None, :] ^ self.salts, 3)
                if w is None:
                    best = hashes.argmin(axis=1)
                    take(part, best, np.log(-np.log1p(-_unit(hashes[every, best]))), 0.0)
                else:
                    value, level = self._values(hashes, w[start:start + BLOCK])
                    best = value.argmin(axis=1)
                    take(part, best, value[every, best], level[every, best])
        return mix(drawn, 1) ^ mix(levels.astype(np.int64).view(np.uint64), 2)


def band_keys(drawn: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = drawn[: bands * rows].reshape(bands, rows)
    keys = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys ^ parts[:, r], r + 1)
    return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over sum of the larger ones; 1 for two empty sets."""
    (fa, wa), (fb, wb) = a, b
    if not len(fa) or not len(fb):
        return float(len(fa) == len(fb))
    at = np.minimum(np.searchsorted(fb, fa), len(fb) - 1)
    both = fb[at] == fa
    low = np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64)
    return low / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - low)


def _word_hashes(text):
    return F.transform(words(text), lambda w: F.xxhash64(w))


def sketch(hashed: DataFrame, weights, size: int, bands: int, rows: int) -> DataFrame:
    """``(id, hash, content, keys)``: a digest of the word sequence and its band keys."""

    def draw(batches):
        sampler = Sampler(bands * rows)
        for batch in batches:
            content, keys = [], []
            for _, h in _texts(batch, 2):
                content.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                found, times = shingles(h, size)
                keys.append(band_keys(sampler(found, weigh(weights.value, found, times)), bands, rows) if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(content, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], [ID, HASH, "content", "keys"])

    return hashed.mapInArrow(draw, f"{ID} bigint, {HASH} bigint, content binary, keys array<bigint>")


def masses(texts: DataFrame, weights, size: int) -> DataFrame:
    """``(node, mass, common, marks)``: the weight of all shingles of a candidate, an upper
    bound of the weight of those that other candidates hold too, and 16 bits of each of
    ``MARKS`` draws."""
    hashed = texts.select("node", _word_hashes(F.col(TEXT)).alias("h"))

    def read(batch):
        found = [shingles(h, size)[0] for _, h in _texts(batch, 0)]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    twice = texts.sparkSession.sparkContext.broadcast(seen_twice(hashed.select("h"), SHARED_BITS, SHARED_ROWS, read))

    def measure(batches):
        sampler = Sampler(MARKS, seed=71)
        for batch in batches:
            mass, common, marks = [], [], []
            for _, h in _texts(batch, 1):
                found, times = shingles(h, size)
                w = weigh(weights.value, found, times)
                mass.append(w.sum(dtype=np.float64))
                common.append(w[repeated(twice.value, SHARED_BITS, found)].sum(dtype=np.float64))
                marks.append((sampler(found, w) if len(found) else np.zeros(MARKS, np.uint64)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(mass, pa.float64()), pa.array(common, pa.float64()), pa.array(marks, pa.binary())], ["node", "mass", "common", "marks"])

    return hashed.mapInArrow(measure, "node bigint, mass double, common double, marks binary")


def promising(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose marks agree as often as those of a pair at the threshold may. It only
    chooses what is compared first; what it leaves out meets in :func:`links_apart`."""
    least = int(MARKS * threshold - ODDS * math.sqrt(MARKS * threshold * (1 - threshold)))

    def sift(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, MARKS) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least))

    return pairs.select("leader", "node", "lead_marks", "marks").mapInArrow(sift, "leader bigint, node bigint")


def most_alike(mass_a, common_a, mass_b, common_b):
    """An upper bound of the weighted Jaccard similarity of two candidates."""
    shared = F.least(common_a, common_b, mass_a, mass_b)
    return shared / (mass_a + mass_b - shared)


def worth_comparing(members: DataFrame, threshold: float) -> DataFrame:
    """Members of buckets that can reach the threshold with some other mass in there, in
    buckets of more than one such member."""
    limit = threshold - SLACK
    range_ = members.groupBy("key").agg(F.min("mass").alias("least"))
    kept = members.join(range_, "key").filter(most_alike(F.col("mass"), F.col("common"), F.greatest("least", "common"), F.col("common")) >= limit)
    several = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return kept.drop("least").join(several, "key", "left_semi")


def compare(pairs: DataFrame, texts: DataFrame, weights, size: int) -> DataFrame:
    """``(leader, node, similarity)`` of each pair."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col(TEXT).alias(f"{name}_text"))
    # the leader's text joins last: its rows then come in a row, and no further shuffle carries two texts
    joined = pairs.join(side("node"), "node").join(side("leader"), "leader")
    hashed = joined.select("leader", "node", _word_hashes(F.col("leader_text")).alias("lh"), _word_hashes(F.col("node_text")).alias("nh"))

    def measure(batches):
        known: OrderedDict[int, tuple] = OrderedDict()

        def of(key, h):
            if key not in known:
                found, times = shingles(h, size)
                known[key] = (found, weigh(weights.value, found, times))
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
            return known[key]

        for batch in batches:
            leaders, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = [
                weighted_jaccard(of(leaders[i], a), of(nodes[i], b))
                for (i, a), (_, b) in zip(_texts(batch, 2), _texts(batch, 3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["leader", "node", "similarity"])

    return hashed.mapInArrow(measure, "leader bigint, node bigint, similarity double")


def brought_together(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the groups that links join: each group takes the name of the highest
    one it is linked to, and that of the one this took. Leaders stand highest, so a leader
    and those linked to it become one group in one step."""
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("group").alias(f"{side}_of"))
    edges = links.join(of("leader"), "leader").join(of("node"), "node").filter(F.col("leader_of") != F.col("node_of"))
    ends = F.array(F.struct(F.col("leader_of").alias("group"), F.col("node_of").alias("to")), F.struct(F.col("node_of").alias("group"), F.col("leader_of").alias("to")))
    up = edges.select(F.inline(ends)).groupBy("group").agg(F.max("to").alias("to")).filter(F.col("to") > F.col("group"))
    up = cut_lineage(up)
    further = up.join(up.select(F.col("group").alias("to"), F.col("to").alias("top")), "to", "left").select("group", F.coalesce("top", "to").alias("to"))
    out = nodes.join(further, "group", "left").withColumn("group", F.coalesce("to", "group"))
    return cut_lineage(out.select(*nodes.columns))


def shared_weights(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The weight that each of ``left`` shares with each of ``right``; both number ``sets``,
    which hold shingles, how often each occurs, and the weight of one occurrence.

    Each further occurrence is an element of its own, so that the smaller of two weights is
    the weight of the elements in both. Elements held by the same texts are one column.
    """
    further = [np.repeat(np.arange(len(times)), times - 1) for _, times, _ in sets]
    nth = [np.arange(len(at)) - np.searchsorted(at, at) + 1 for at in further]
    ids = np.concatenate([part for (found, _, _), at, k in zip(sets, further, nth) for part in (found, mix(found[at] ^ mix(k, 11), 12))])
    weights = np.concatenate([part for (_, _, one), at in zip(sets, further) for part in (one, one[at])]).astype(np.float64)
    owners = np.repeat(np.arange(len(sets)), [len(found) + len(at) for (found, _, _), at in zip(sets, further)])
    order = np.argsort(ids, kind="stable")
    ids, weights, owners = ids[order], weights[order], owners[order]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    holders = np.diff(np.concatenate([start, [len(ids)]]))
    _, first, kind = np.unique(np.add.reduceat(mix(owners, 13), start), return_index=True, return_inverse=True)
    total = np.bincount(kind, weights[start])
    first, total = first[holders[first] > 1], total[holders[first] > 1]
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(first), COLUMNS):
        some = first[at:at + COLUMNS]
        held = np.zeros((len(sets), len(some)))
        column = np.repeat(np.arange(len(some)), holders[some])
        place = np.arange(len(column)) - np.repeat(np.cumsum(holders[some]) - holders[some], holders[some])
        held[owners[start[some][column] + place], column] = 1
        out += (held[left] * total[at:at + COLUMNS]) @ held[right].T
    return out


def joining_links(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], groups: np.ndarray, second: np.ndarray, within: bool, threshold: float) -> list[tuple[int, int]]:
    """Links that join all groups with a pair at the threshold: of one text of the first
    part and one of the ``second``, or also of two of the second if ``within``."""
    right = np.flatnonzero(second)
    left = np.arange(len(sets)) if within else np.flatnonzero(~second)
    apart = (groups[left][:, None] != groups[right]) & (~second[left][:, None] | (left[:, None] < right))
    if not apart.any():
        return []
    whole = [one * times.astype(np.float32) for _, times, one in sets]
    mass = np.array([w.sum(dtype=np.float64) for w in whole])
    low = shared_weights(sets, left, right)
    alike = low / (mass[left][:, None] + mass[right] - low)
    a, b = np.nonzero(apart & (alike >= threshold - SLACK))
    sure = alike[a, b] >= threshold + SLACK
    a, b = left[a], right[b]
    # one pair of each two groups will do where rounding cannot matter
    _, one = np.unique(np.stack([groups[a[sure]], groups[b[sure]]]), axis=1, return_index=True)
    pairs = [(x, y, True) for x, y in zip(a[sure][one], b[sure][one])] + [(x, y, False) for x, y in zip(a[~sure], b[~sure])]
    up: dict[int, int] = {}

    def top(g):
        while g in up:
            g = up[g]
        return g

    links = []
    for x, y, known in pairs:
        g, h = top(groups[x]), top(groups[y])
        if g != h and (known or weighted_jaccard((sets[x][0], whole[x]), (sets[y][0], whole[y])) >= threshold):
            up[g] = h
            links.append((x, y))
    return links


def dealt_parts(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(key, mixed, a, b, node, group, second, h)``: the members of buckets of several
    groups, dealt so that any two of different groups meet. ``mixed`` deals bring part ``a``
    of the leader's group and part ``b`` of the others; the rest parts ``a < b`` of the others."""
    rows = members.join(nodes.select("node", "group"), "node")
    several = rows.groupBy("key").agg(F.max("group").alias("of"), F.min("group").alias("low")).filter("of != low").select("key", "of")
    rows = rows.join(several, "key").select("key", "node", (-F.col("group.by")).alias("group"), (F.col("group") == F.col("of")).alias("inside"))
    rows = cut_lineage(rows)
    hashed = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", _word_hashes(F.col(TEXT)).alias("h"))
    rows = cut_lineage(rows.join(hashed.withColumn("n_words", F.size("h")), "node"))
    parts = lambda side: F.greatest(
        F.ceil(F.count_if(side) / PART_ROWS), F.ceil(F.sum(F.when(side, F.col("n_words")).otherwise(0)) / PART_WORDS)).cast("int")
    sizes = rows.groupBy("key").agg(parts(F.col("inside")).alias("n_in"), parts(~F.col("inside")).alias("n_out"))
    own = F.pmod(F.xxhash64("node", "key"), F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))).cast("int")
    rows = rows.join(sizes, "key").withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda mixed, a, b, second: F.struct(F.lit(mixed).alias("mixed"), a.alias("a"), b.alias("b"), second.alias("second"))
    inner = F.transform(upto("n_out"), lambda k: deal(True, F.col("own"), k, F.lit(False)))
    outer = F.transform(upto("n_in"), lambda k: deal(True, k, F.col("own"), F.lit(True)))
    others = F.filter(upto("n_out"), lambda k: k != F.col("own"))
    others = F.transform(others, lambda k: deal(False, F.least(k, "own"), F.greatest(k, "own"), F.col("own") > k))
    dealt = rows.select("key", "node", "group", "h", F.inline(F.when(F.col("inside"), inner).otherwise(F.concat(outer, others))))
    return dealt.select("key", "mixed", "a", "b", "node", "group", "second", "h")


def links_apart(members: DataFrame, nodes: DataFrame, texts: DataFrame, weights, size: int, threshold: float) -> DataFrame:
    """``(leader, node)`` links that join all groups with a pair at the threshold in a bucket."""

    def link(key, table):
        table = table.combine_chunks()
        sets = []
        for batch in table.select(["h"]).to_batches():
            for _, h in _texts(batch, 0):
                found, times = shingles(h, size)
                sets.append((found, times, weigh(weights.value, found, np.ones(len(found), np.int64))))
        nodes_, groups = table["node"].to_numpy(), table["group"].to_numpy()
        second = table["second"].to_numpy()
        links = joining_links(sets, groups, second, key[1].as_py() and key[2].as_py() == 0, threshold)
        a, b = (nodes_[np.array([pair[k] for pair in links], np.int64)] for k in (0, 1))
        return pa.table({"leader": pa.array(a, pa.int64()), "node": pa.array(b, pa.int64())})

    dealt = dealt_parts(members, nodes, texts)
    return dealt.groupBy("key", "mixed", "a", "b").applyInArrow(link, "leader bigint, node bigint")


def bucket_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, weights, size: int, threshold: float) -> DataFrame | None:
    """``(leader, node)`` links that join all that are alike; None if there are none.

    ``members`` are (key, node); ``nodes`` have mass, common and marks of each.
    """
    members = cut_lineage(members.select("key", "node"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    middle = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("crowd"))
    # groups are named by their highest node
    place = F.struct("crowd", (-F.col("node")).alias("by"))
    nodes = cut_lineage(nodes.join(middle, "node").withColumn("group", place).drop("crowd"))
    rows = members.join(nodes.select("node", "group"), "node")
    leaders = rows.groupBy("key").agg(F.max(F.struct("group", "node")).alias("l")).select("key", F.col("l.node").alias("leader"))
    pairs = rows.join(leaders, "key").filter(F.col("leader") != F.col("node"))
    # one pair under many keys is one pair, whichever of the two leads
    low, high = F.least("leader", "node"), F.greatest("leader", "node")
    pairs = pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.min("leader").alias("leader"))
    pairs = pairs.select("leader", (F.col("low") + F.col("high") - F.col("leader")).alias("node"))
    known = nodes.select("node", "mass", "common", "marks")
    lead = known.select(F.col("node").alias("leader"), F.col("mass").alias("lead_mass"), F.col("common").alias("lead_common"), F.col("marks").alias("lead_marks"))
    possible = most_alike(F.col("mass"), F.col("common"), F.col("lead_mass"), F.col("lead_common")) >= threshold - SLACK
    pairs = cut_lineage(promising(pairs.join(known, "node").join(lead, "leader").filter(possible), threshold))
    links = cut_lineage(compare(pairs, texts, weights, size).filter(F.col("similarity") >= threshold).select("leader", "node"))
    if not links.isEmpty():
        nodes = brought_together(nodes, links)
    links = links.unionByName(cut_lineage(links_apart(members, nodes, texts, weights, size, threshold)))
    return None if links.isEmpty() else links


def near_classes(rows: DataFrame, threshold: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``(id, hash of the text, class_id, class_hash)`` of held rows: the class is named
    by its row with the smallest id (and text hash)."""
    spark = rows.sparkSession
    hashed = rows.select(ID, row_hash().alias(HASH), _word_hashes(F.col(TEXT)).alias("h"))
    weights = spark.sparkContext.broadcast(inverse_frequencies(document_frequencies(hashed, size), rows.count()))
    sketches = cut_lineage(sketch(hashed, weights, size, bands, band_rows))
    nodes = cut_lineage(sketches.groupBy("content").agg(F.min(F.struct(ID, HASH)).alias("rep"), F.min("keys").alias("keys")))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    members = cut_lineage(keyed.join(shared.select("key"), "key"))
    wanted = members.select("node").distinct().join(nodes.select("node", "rep.*"), "node")
    texts = rows.withColumn(HASH, row_hash()).join(wanted, [ID, HASH]).dropDuplicates([ID, HASH])
    texts = cut_lineage(texts.select("node", TEXT))
    measured = cut_lineage(masses(texts, weights, size))
    worth = worth_comparing(members.join(measured.drop("marks"), "node"), threshold)
    links = bucket_links(worth, measured, texts, weights, size, threshold)
    if links is None:
        links = spark.createDataFrame([], "leader bigint, node bigint")
    joined = connected_components(links.select(F.col("leader").alias("src"), F.col("node").alias("dst")))
    named = nodes.join(joined.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("rep").alias("name"))
    of_content = cut_lineage(named.select("content", "component").join(names, "component").select(
        "content", F.col(f"name.{ID}").alias("class_id"), F.col(f"name.{HASH}").alias("class_hash")))
    return sketches.select(ID, HASH, "content").join(of_content, "content").drop("content")


def near_dedup(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that with the smallest id."""
    rows = held_rows(docs, id_col, text_col)
    classes = near_classes(rows, threshold)
    kept = classes.filter((F.col(ID) == F.col("class_id")) & (F.col(HASH) == F.col("class_hash"))).select(ID, HASH)
    joined = rows.withColumn(HASH, row_hash()).join(kept.distinct(), [ID, HASH]).dropDuplicates([ID, HASH])
    return released(joined, docs.columns, text_col)
