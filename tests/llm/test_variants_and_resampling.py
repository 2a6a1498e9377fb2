"""Spelling variants, importance resampling and the suffix sort against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brookmill.llm import importance_resampling as ir, spelling_variants as sv, suffix_dedup as sd

from .conftest import odd_rows, sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def no_id(i):
    return -(2**63) if i is None else i


# spelling variants


def variant_rows():
    rng = random.Random(11)
    base = ["lantern", "harbour", "Straße", "éclairer", "mountain", "mmmmmmm", "abcdefghijklmnopqrstuvwxyzabcdef"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(base)
            kind, at = rng.random(), rng.randrange(len(w))
            if kind < 0.15:
                w = w[:at] + rng.choice("aeß") + w[at:]
            elif kind < 0.3:
                w = w[:at] + rng.choice("aoé") + w[at + 1:]
            elif kind < 0.4:
                w = w[:at] + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((k if k % 50 else None, ("-" if k % 3 else " ").join(words)))
    rows += [(900 + k, " ".join(["zigzags", "zigzagsa"[:7 + (k < 15)], "zigzagsab"[:7 + 2 * (k < 6)]])) for k in range(40)]
    return rows + [(7, None), (7, ""), (7, "×÷×÷×÷ lantern1lantern"), rows[5], rows[5]]


def brute_variants(rows, min_chars, min_count, factor, noise):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}
    near = defaultdict(set)
    for a in words:
        for b in words:
            if a < b and brute_step(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, k in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * k else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (k, len(near[w]), form[w], form[w] and words[form[w]], root(w)) for w, k in words.items()}


def brute_step(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


@pytest.mark.parametrize("noise,held,factor,min_chars", [(199, 20_000, 5, 6), (7, 3, 2, 3)])
def test_spelling_variants(spark, noise, held, factor, min_chars):
    rows = variant_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, word string, n string").repartition(3)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in
           sv.spelling_variants(df, min_chars=min_chars, min_count=2, factor=factor, noise=noise, held=held).collect()}
    want = brute_variants(rows, min_chars, 2, factor, noise)
    assert got == want
    assert any(w[2] for w in want.values())
    assert factor > 2 or any(k[4] not in (w, k[2]) for w, k in want.items())


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_trie_finds_what_brute_force_finds(depth):
    rng = random.Random(depth)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(3, 8))) for _ in range(600)} | {"a" * 40, "a" * 41, "a" * 39 + "b"})
    vectors = sv.frequency_vectors(words)
    found, keys = set(), sv.path_key(vectors[:, :depth])
    for other in sv.reached_paths(vectors[:, :depth]):
        step = other - vectors[:, :depth]
        asks = sv.path_key(other)
        for key in set(keys.tolist()):
            q = np.flatnonzero((asks == key) & (other >= 0).all(axis=1))
            held = [words[i] for i in np.flatnonzero(keys == key)]
            trie = sv.Trie(held, [1] * len(held), depth)
            a, b = trie.near([words[i] for i in q], vectors[q], 1 - np.maximum(step[q], 0).sum(axis=1), 1 - np.maximum(-step[q], 0).sum(axis=1))
            found |= {(words[q[x]], trie.words[y]) for x, y in zip(a, b)}
    assert found == {(a, b) for a in words for b in words if brute_step(a, b) and a != b}


def test_spelling_variants_odd_rows(odd, empty):
    got = {r["word"]: r["n"] for r in sv.spelling_variants(odd, min_count=1).collect()}
    assert got == {w: v[0] for w, v in brute_variants([r[:2] for r in odd_rows()], 6, 1, 5, 199).items()}
    assert sv.spelling_variants(empty).count() == 0


# importance resampling


def brute_resample(rows, target, percent, min_words, buckets, longest):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        runs = [" ".join(ws[k:k + n]) for n in range(1, longest + 1) for k in range(len(ws) - n + 1)]
        return len(ws), [zlib.crc32(x.encode()) % buckets for x in runs]

    own, wanted = [features(t) for _, t in rows], [features(t)[1] for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for f in wanted for b in f)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (i, _), (n, f) in zip(rows, own):
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((no_id(i), n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted(((-r[4], r[0]) for r in out if r[1] >= min_words))
    return out, able[:percent * len(able) // 100]


@pytest.mark.parametrize("percent,min_words,longest", [(25, 20, 2), (60, 1, 3), (100, 0, 1), (0, 5, 2)])
def test_resample(spark, odd, percent, min_words, longest):
    rng = random.Random(8)
    target = [sentence(rng, 40), None, "", "éß中 Word 12 word", sentence(rng, 10)]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = ir.resample(odd, goal, percent, min_words, 50, longest)
    assert set(odd.columns) <= set(got.columns)
    got = got.select("_id", "doc_id", "text", "n_features", "weight", "score", "rank").collect()
    rows = odd_rows()
    want, drawn = brute_resample([r[:2] for r in rows], target, percent, min_words, 50, longest)
    assert {r["_id"]: (r["n_features"], r["weight"], r["score"]) for r in got} == {r[5]: w[2:] for r, w in zip(rows, want)}
    assert {r["_id"]: r["text"] for r in got} == {r[5]: r[1] for r in rows}
    ranked = sorted((r["rank"], -r["score"], no_id(r["doc_id"])) for r in got if r["rank"] is not None)
    assert ranked == [(k + 1, *x) for k, x in enumerate(drawn)]


def test_resample_of_ties_draws_smaller_ids(spark):
    same = spark.createDataFrame([(i, "one two three") for i in range(60)], "doc_id bigint, text string").repartition(4)
    with_noise = ir.weigh(same, same).collect()
    value = {r["_id"]: r["score"] for r in with_noise}
    got = ir.kth_largest(ir.weigh(same, same), ir.F.col("score"), 17)
    assert got == sorted(value.values(), reverse=True)[16]
    assert [ir.kth_largest(same, ir.F.col("doc_id"), k) for k in (0, 1, 60, 61)] == [None, 59, 0, None]
    twins = spark.createDataFrame([(5, "one two three")] * 9 + [(6, "one two three")], "doc_id bigint, text string")
    ranks = sorted(r["rank"] for r in ir.resample(twins, same, 50, 1).collect() if r["rank"])
    assert ranks == [1, 2, 3, 4, 5]


def test_resample_of_empty_tables(spark, odd, empty):
    assert ir.resample(empty, odd).count() == 0
    got = ir.resample(odd, empty, 25, 20, texts=False)
    assert "text" not in got.columns and got.count() == len(odd_rows())


# suffix sort


def brute_repeats(texts, window):
    places = defaultdict(list)
    for k, t in enumerate(texts):
        for s in range(len(t) - window + 1):
            places[t[s:s + window]].append((k, s))
    gone = defaultdict(set)
    for held in places.values():
        if len(held) > 1:
            for k, s in held:
                gone[k].update(range(s, s + window))
    return [gone[k] for k in range(len(texts))]


def suffix_rows():
    rng = random.Random(13)
    rows = [r[:2] for r in odd_rows()]
    passage = sentence(rng, 90)
    rows += [(100 + k, sentence(rng, 30) + "é" * (k % 3) + passage[:420 + k] + "中" + sentence(rng, 20)) for k in range(12)]
    rows += [(200, "ab" * 700), (201, "x" * 3_000), (202, sentence(rng, 60) + "ab" * 150), (203, "\U0001f600" * 60), (204, "\U0001f600" * 50)]
    return [(i, t, f"k{n}") for n, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("window,gram,heavy,block", [(200, 64, 1 << 25, None), (40, 16, 1 << 25, 700), (40, 40, 0, None), (200, 64, 2_000, 2_000)])
def test_suffix_dedup(spark, monkeypatch, window, gram, heavy, block):
    if block:
        monkeypatch.setattr(sd, "BLOCK", block)
        monkeypatch.setattr(sd, "CHUNK", block)
    rows = suffix_rows()
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id bigint, text string, k string, low string, kept string").repartition(4)
    got = {r["k"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in sd.suffix_dedup(df, window, gram, heavy).collect()}
    texts = [(t or "").encode() for _, t, _ in rows]
    for (_, _, k), t, gone in zip(rows, texts, brute_repeats(texts, window)):
        spans = sum(1 for p in gone if p - 1 not in gone)
        assert got[k] == (bytes(c for p, c in enumerate(t) if p not in gone), len(t), len(gone), spans), k
    assert len(got) == len(rows) and sum(v[2] for v in got.values())


def test_suffix_dedup_of_an_empty_table(empty):
    assert sd.suffix_dedup(empty).count() == 0


def test_suffix_sort_is_a_sort_and_survives_collisions(monkeypatch):
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    parts += parts[:40]
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
    data, group = np.frombuffer(b"".join(parts), np.uint8), np.sort(np.array([rng.randrange(6) for _ in parts]))

    def check(order, agree):
        assert sorted(order.tolist()) == list(range(len(parts)))
        for (x, y), k in zip(zip(order, order[1:]), agree):
            if group[x] == group[y]:
                a, b = parts[x], parts[y]
                assert a <= b and k == next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
            else:
                assert group[x] < group[y] and k == -1

    check(*sd._sorted(data, offsets[:-1], np.diff(offsets), group))
    base = sd._base
    monkeypatch.setattr(sd, "_base", lambda seed: 1 if seed < 2 else base(seed))  # sums only: anagrams collide
    monkeypatch.setattr(sd, "_powers", {})
    text = sd.Prefixes(data, 0)
    order = sd.suffix_sort(text, offsets[:-1], np.diff(offsets), group)
    assert sd.neighbours(text, offsets[:-1], np.diff(offsets), group, order) is None
    check(*sd._sorted(data, offsets[:-1], np.diff(offsets), group))


@pytest.mark.parametrize("text", ["ab" * 40 + "c", "x" * 50, "abcdefghij" * 6 + "k"])
def test_windows_of_a_large_group_are_sorted_in_parts(monkeypatch, text):
    window, most, seen = 20, 64, []
    sort = sd.suffix_sort
    monkeypatch.setattr(sd, "suffix_sort", lambda t, at, *rest: seen.append(len(at)) or sort(t, at, *rest))
    monkeypatch.setattr(sd, "PART", most)
    rng = random.Random(4)
    parts = [(text[k % 7:] + "".join(rng.choice("uvw") for _ in range(k % 30 + 1))).encode() for k in range(40)]
    parts.append("".join(rng.choice("0123456789") for _ in range(90)).encode())
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
    of, low, high = sd.repeats(np.frombuffer(b"".join(parts), np.uint8), offsets, np.zeros(len(parts), np.int64), window)
    got = [set() for _ in parts]
    for k, a, b in zip(of.tolist(), low.tolist(), high.tolist()):
        got[k].update(range(a, b))
    places = {}
    for k, p in enumerate(parts):
        for s in range(len(p) - window + 1):
            places.setdefault(p[s:s + window], []).append((k, s))
    want = [set() for _ in parts]
    for held in places.values():
        for k, s in held if len(held) > 1 else ():
            want[k].update(range(s, s + window))
    assert got == want and not got[-1]
    assert max(seen) <= 2 * most and sum(len(p) for p in parts) > 10 * most
