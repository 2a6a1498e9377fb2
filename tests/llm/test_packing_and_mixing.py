"""Packing round trips and mixing balances, on odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from brookmill.llm import mixing, packing
from brookmill.llm.common import held_rows
from brookmill.llm.queries import vocabulary

from .conftest import odd_rows, sentence


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def pieces_of(rows, tokenizer, capacity=4096):
    out = Counter()
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out[-(2**63) if i is None else i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    return out


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pieces_and_places(odd, tokenizer, capacity):
    rows = packing.pack_documents(odd, vocabulary(), capacity).collect()
    assert Counter(tuple(r)[:5] for r in map(lambda r: (r["_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), rows)) == pieces_of([(r[0], r[1]) for r in odd_rows()], tokenizer, capacity)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


def test_words_keep_their_ids_wherever_they_stand(tokenizer):
    texts = ["It's an uńusual  étude here", "<|endoftext|> a<|endoftext|>b", "ΟΔΟΣ ΣΑΣ.", "don't 'tis x'd", "\x1c\x85 odd gaps", "naïve ﬁ Ⅷ 漢字", "a\x0bb\x0cc\rd", ""]
    for _ in range(2):  # the second time from memory
        ids, sizes = packing.token_lists(pa.array(texts), vocabulary())
        assert [ids[e - n:e].tolist() for e, n in zip(np.cumsum(sizes), sizes)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=20))
def test_plans_place_all_and_leave_little(counts):
    runs = packing.plan_runs(counts, 30)
    placed, fill = Counter(), defaultdict(list)
    for size, rank, per, n, first, offset in runs.tolist():
        assert rank == placed[size]
        placed[size] += n
        for i in range(n):
            fill[first + i // per].append((offset + i % per * size, size))
    assert placed == Counter(counts)
    for parts in fill.values():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert end <= 30
        assert sum(3 * s > 30 for _, s in parts) <= 2
    rooms = []  # best-fit decreasing, piece by piece
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= size]
        rooms.append(min(fits, default=30) - size)
        if fits:
            rooms.remove(min(fits))
    assert len(fill) <= len(rooms) + 1


def test_large_pieces_pair_greedily():
    runs = packing.plan_runs({20: 1, 15: 3, 11: 1, 10: 1, 8: 1}, 30)
    together = defaultdict(set)
    for size, _, per, n, first, _ in runs.tolist():
        for i in range(n):
            together[first + i // per].add(size)
    assert {20, 10} in together.values() and {15} in together.values()


def test_empty_packing(empty):
    assert packing.pack_documents(empty, vocabulary()).count() == 0


def targets_of(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, budget, out = set(order), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in left}
        out |= {s: most * sizes[s] for s in full}
        budget -= sum(most * sizes[s] for s in full)
        left -= full
    return out


def test_targets(spark):
    rng = random.Random(2)
    sizes = {f"s{k}": rng.randrange(0, 900) for k in range(17)} | {None: 300, "": 5, "\U0001f600": 77, "￮": 41}
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint").repartition(5)
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets_of(sizes))


def test_mix_meets_targets(odd):
    size = n_words
    got = mixing.mix_sources(odd).select("_id", "source", "size", "source_size", "target", "rate", "taken")
    again = mixing.mix_sources(odd.repartition(7)).select(*got.columns)
    rows = got.collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again.collect()))
    sizes = Counter()
    for r in odd_rows():
        sizes[r[3]] += size(r[1])
    want, taken, longest = targets_of(dict(sizes)), Counter(), Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    # repeated rows share one decision, so sources that hold them may be off by theirs
    for source in set(sizes) - {r[3] for r in odd_rows()[20:]}:
        assert abs(taken[source] - want[source]) <= 1


def test_tilt_solves_the_dual(spark):
    """Rates are an exponential tilt of the odds, alike for equal sizes of a source."""
    rng = random.Random(6)
    rows = [(k, "w " * rng.randrange(1, 200), "ab"[k % 2] if k % 5 else "c") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    by = defaultdict(list)
    for r in mixing.mix_sources(df).collect():
        by[r["source"]].append(r)
    for source, rs in by.items():
        target, mean = rs[0]["target"], sum(r["size"] for r in rs) / len(rs)
        assert sum(r["size"] * r["rate"] for r in rs) == pytest.approx(target, rel=1e-5)
        if target < 2 * rs[0]["source_size"]:
            tilts = [(np.log(r["rate"] / (2 - r["rate"])) - np.log(3)) / (r["size"] / mean) for r in rs]
            assert max(tilts) - min(tilts) < 1e-5
        assert abs(sum(r["taken"] for r in rs) - target) <= 1


def test_copies_are_whole_texts_and_heads(odd):
    mix = {(r["_id"], r["text"]): (r["size"], r["taken"]) for r in mixing.mix_sources(odd.drop("size")).select("_id", "text", "size", "taken").collect()}
    got = mixing.copies(odd)
    assert got.columns == odd.columns
    texts = defaultdict(list)
    for r in got.select("_id", "text").collect():
        texts[r["_id"]].append(r["text"])
    for (key, text), (size, taken) in mix.items():
        assert sum(map(n_words, texts[key])) == taken
        assert sum(t == text for t in texts[key]) == (taken // size if size else 0)
        assert all(text.startswith(t) for t in texts[key])


def test_empty_mix(empty):
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.copies(empty).count() == 0
    assert held_rows(empty).count() == 0


def test_plain_words_share_encodings():
    path, rng = vocabulary(), random.Random(8)
    state = packing._worker_state(path)
    plain = [f"{rng.choice(['It', 'WE', 'x'])}{rng.choice(chr(39) + '-.3')}{k}ly!" for k in range(3_000)] + ["</w>", "ab</w>c", "<|endoftext|>", "a<|startoftext|>b"]
    other = ["\u0130", "e\u0301", "H\u0331", "\x1c", "a\x00b", "\uff11\uff12", "\U0001f600", "\u200b", "\u00f1and\u00fa."]
    words, texts = plain + other, []

    class Counted:
        def encode_batch_fast(self, some, **options):
            texts.extend(some)
            return state.tokenizer.encode_batch_fast(some, **options)

    class State:
        tokenizer, bytes = Counted(), state.bytes
        words, ids, ends = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    ids, sizes = packing._encode(State, pa.array(words))
    want = [state.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert len(texts) < len(plain) / 50 + len(other)
