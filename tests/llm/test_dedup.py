"""Line, substring and near deduplication against brute force, on odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookmill.llm import line_dedup, near_dedup, sketches, substring_dedup
from brookmill.llm.common import held_rows, row_hash

from .conftest import near_copy, odd_rows, sentence

BLANK = " \t\n\x0b\f\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def no_id(i):
    return -(2**63) if i is None else i


def test_line_dedup(odd):
    got = line_dedup.line_dedup(odd).select("_id", "text", "n_lines", "n_dropped").collect()
    key = lambda l: l.strip(BLANK).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for r in odd_rows():
        for l in (r[1] or "").split("\n"):
            holders[key(l)].add(no_id(r[0]))
    want = {}
    for r in odd_rows():
        lines = (r[1] or "").split("\n")
        stay = [l for l in lines if not (len(key(l)) >= 20 and len(holders[key(l)]) >= 3 and max(holders[key(l)]) != no_id(r[0]))]
        want[r[5]] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    assert {r["_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got} == want
    assert any(n for _, _, n in want.values())


def test_line_dedup_needs_enough_documents(odd):
    assert line_dedup.line_dedup(odd, min_docs=1_000).agg(F.sum("n_dropped")).first()[0] == 0


@pytest.mark.parametrize("window,gram", [(50, 32), (7, 3), (5, 5)])
def test_substring_dedup(odd, window, gram):
    got = substring_dedup.substring_dedup(odd, window, gram).select("_id", "text", "n_words", "n_removed").collect()
    first = {}
    for r in odd_rows():
        ws = words_of(r[1])
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s:s + window])
            first[k] = min(first.get(k, no_id(r[0])), no_id(r[0]))
    want = {}
    for r in odd_rows():
        ws, gone = words_of(r[1]), set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s:s + window])] < no_id(r[0]):
                gone.update(range(s, s + window))
        want[r[5]] = (" ".join(w for i, w in enumerate(ws) if i not in gone), len(ws), len(gone))
    assert {r["_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in got} == want
    assert any(n for _, _, n in want.values())


def test_sketch_never_counts_too_low():
    rng = np.random.default_rng(1)
    for bits in (6, 16):
        sketch = sketches.SeenTwice(bits, 2)
        values = rng.integers(0, 500, 900).astype(np.int64)
        for part in np.array_split(values, 7):
            sketch.add(part)
        often = np.array([v for v, n in Counter(values.tolist()).items() if n > 1])
        assert sketches.repeated(sketch.twice, bits, often).all()
    once = np.arange(10_000, 10_100)
    assert sketches.repeated(sketch.twice, bits, once).mean() < 0.05


def test_sketch_parts_merge_to_the_whole():
    parts, whole = [sketches.SeenTwice(10, 2) for _ in range(3)], sketches.SeenTwice(10, 2)
    for k, part in enumerate(parts):
        values = np.arange(k * 40, k * 40 + 100)
        part.add(values)
        whole.add(values)
    flat = lambda s: np.stack([s.once.reshape(-1), s.twice.reshape(-1)]).reshape(-1)
    merged = flat(parts[0])
    for part in parts[1:]:
        merged = sketches.merge_twice(merged, flat(part))
    assert (merged == flat(whole)).all()


def shingle_weights(text):
    ws = words_of(text)
    return Counter(tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))) if ws else Counter()


def brute_classes(rows, threshold=0.8):
    sets = {k: shingle_weights(t) for k, (_, t) in enumerate(rows)}
    df, n = Counter(x for c in sets.values() for x in c), len(rows)
    weight = lambda x: min(1.0, math.log1p((n + near_dedup.PRIOR) / df[x]) / math.log1p(near_dedup.FULL_WEIGHT))
    of = list(range(len(rows)))

    def top(k):
        while of[k] != k:
            k = of[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        low = sum(min(x[s], y[s]) * weight(s) for s in x.keys() & y.keys())
        high = sum(max(x[s], y[s]) * weight(s) for s in x.keys() | y.keys())
        if words_of(rows[a][1]) == words_of(rows[b][1]) or high and low / high >= threshold:
            of[top(b)] = top(a)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[top(k)].append(no_id(rows[k][0]))
    return [min(groups[top(k)]) for k in range(len(rows))], len(groups)


def test_near_classes_odd_rows(odd):
    classes = near_dedup.near_classes(held_rows(odd)).distinct()
    rows = held_rows(odd).withColumn("_hash", row_hash()).join(classes, ["_id", "_hash"])
    got = {r["k"]: r["class_id"] for r in rows.select(F.col("_row._id").alias("k"), "class_id").collect()}
    data = odd_rows()
    assert got == {r[5]: c for r, c in zip(data, brute_classes([(r[0], r[1]) for r in data])[0])}


def test_near_classes_of_chains_and_large_groups(spark):
    """A group of near copies around a hidden middle, and a chain whose ends are unlike."""
    rng = random.Random(3)
    middle = sentence(rng, 300)
    rows = [(100 + k, near_copy(middle, 75 + k % 7, random.Random(k))) for k in range(60)] + [(999, middle)]
    chain = sentence(rng, 200)
    for k in range(6):
        rows.append((k, chain))
        ws = chain.split(" ")
        chain = " ".join([*ws[:k * 15], *(f"c{k}{j}" for j in range(5)), *ws[k * 15 + 5:]])
    rows += [(2_000 + k, sentence(rng, 120)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["_id"]: r["class_id"] for r in near_dedup.near_classes(held_rows(df)).collect()}
    assert got == {i: c for (i, _), c in zip(rows, brute_classes(rows)[0])}


def test_pairs_of_a_bucket_are_compared_whatever_their_marks_say(spark, monkeypatch):
    """a bucket around a middle, with links that neither the leader nor the marks show."""
    monkeypatch.setattr(near_dedup, "PART_ROWS", 5, raising=False)
    rng = random.Random(11)
    middle = sentence(rng, 200)
    texts = [middle] + [near_copy(middle, 60 + k, random.Random(k)) for k in range(9)]
    for k in range(8):  # pairs that are like each other, and unlike the middle
        far = near_copy(middle, 14, random.Random(100 + k))
        texts += [far, near_copy(far, 150, random.Random(200 + k))] + [far + " again and again and again and again"] * (k == 3)
    texts += [sentence(rng, 200) for _ in range(6)] + ["same same same same " * n for n in (20, 22, 90)]
    sets = [shingle_weights(t) for t in texts]
    mass = [float(sum(s.values())) for s in sets]
    like = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if (sets[a] & sets[b]).total() / (sets[a] | sets[b]).total() >= 0.8}
    marks = [np.random.default_rng(k).bytes(2 * near_dedup.MARKS) for k in range(len(texts))]
    nodes = spark.createDataFrame([(k, mass[k], mass[k], marks[k]) for k in range(len(texts))], "node bigint, mass double, common double, marks binary")
    members = spark.createDataFrame([(key, k) for k in range(len(texts)) for key in (1, 2 + k % 2)], "key bigint, node bigint")
    table = spark.createDataFrame(list(enumerate(texts)), "node bigint, _text string")
    weights = spark.sparkContext.broadcast(np.ones(2**near_dedup.FREQUENCY_BITS, np.float32))
    links = near_dedup.bucket_links(members, nodes, table, weights, near_dedup.SHINGLE, near_dedup.SIMILARITY).collect()
    assert {(min(x), max(x)) for x in links} <= like
    assert merged_sets(len(texts), links) == merged_sets(len(texts), like)
    assert near_dedup.bucket_links(members.limit(0), nodes, table, weights, near_dedup.SHINGLE, near_dedup.SIMILARITY) is None


def merged_sets(n, links):
    of = list(range(n))
    for a, b in links:
        of = [of[b] if x == of[a] else x for x in of]
    return {frozenset(k for k in range(n) if of[k] == g) for g in of}


def test_near_dedup_keeps_one_of_each(odd):
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns
    # null and repeated ids can name two classes alike, so classes are counted apart
    classes, groups = brute_classes([(r[0], r[1]) for r in odd_rows()])
    assert kept.count() == groups
    assert {no_id(r["doc_id"]) for r in kept.select("doc_id").collect()} == set(classes)


def test_draws_agree_as_often_as_weighted_sets():
    rng = np.random.default_rng(2)
    sampler, agree = near_dedup.Sampler(200), []
    found = np.sort(rng.integers(0, 2**63, 900).astype(np.uint64))
    w = rng.choice([1.0, 0.5, 2.0], 900).astype(np.float32)
    a, b = (found[:800], w[:800]), (found[100:], w[100:])
    agree = (sampler(*a) == sampler(*b)).mean()
    assert abs(agree - near_dedup.weighted_jaccard(a, b)) < 0.12


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_draws_of_long_texts_with_repeated_lines(n):
    """Texts that share their body and differ in lines repeated 20 times: draws agree as
    often as the texts are alike, so bands do not miss the pair."""
    rng = np.random.default_rng(n)
    hashes = lambda k: np.unique(rng.integers(0, 2**63, k).astype(np.uint64))
    body, sampler = hashes(n), near_dedup.Sampler(300)
    sides = []
    for own in (hashes(n // 200), hashes(n // 200)):
        found, w = np.concatenate([body, own]), np.concatenate([np.ones(len(body)), np.full(len(own), 20)]).astype(np.float32)
        sides.append((np.sort(found), w[np.argsort(found)]))
    alike = near_dedup.weighted_jaccard(*sides)
    agree = (sampler(*sides[0]) == sampler(*sides[1])).mean()
    assert 0.8 < alike < 0.85 and abs(agree - alike) < 0.08
    assert (1 - agree**near_dedup.BAND_ROWS) ** near_dedup.BANDS < 0.01


@pytest.mark.parametrize("run", [line_dedup.line_dedup, substring_dedup.substring_dedup, near_dedup.near_dedup])
def test_empty_table(empty, run):
    assert run(empty).count() == 0


def test_digest_of_kept_lines_is_utf8(odd):
    row = line_dedup.line_dedup(odd).filter("doc_id = 18").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(next(r[1] for r in odd_rows() if r[0] == 18).encode()).hexdigest()
