"""Quality rules and Order MinHash against brute force, on odd rows; both run natively."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brookmill.llm import order_minhash, quality_rules
from brookmill.llm.queries import QUERIES

from .conftest import near_copy, odd_rows, sentence


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_of(text):
    text, ws, places, seen, dup = text or "", words_of(text), defaultdict(list), set(), 0
    for i in range(len(ws) - 2):
        places[tuple(ws[i:i + 3])].append(i)
    inside = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_base_counts(odd):
    got = quality_rules.quality_rules(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter((r[0], *base_of(r[1])) for r in odd_rows())
    assert Counter(tuple(r) for r in got.collect()) == want


def distance(p, q):
    half = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(sum(half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q)) / 2)


def test_divergence_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, sentence(rng, 130), "en") for k in range(30)]
    rows += [(100, "### " * 200, "en"), (101, " ".join(f"zq{k}" for k in range(150)), "en"), (102, sentence(rng, 60), "en"), (103, "short " * 3, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    classes = {}
    for i, text, _ in rows:
        if len(text) >= quality_rules.MIN_CHARS_JUDGED:
            n = [sum(map(len, re.findall(c, text))) for c in quality_rules.CLASSES]
            classes[i] = [x / len(text) for x in [*n, len(text) - sum(n)]]
    mean = [sum(h[b] for h in classes.values()) / len(classes) for b in range(7)]
    for i, _, _ in rows:
        if i in classes:
            assert got[i]["class_distance"] == pytest.approx(distance(classes[i], mean), abs=1e-9)
        else:
            assert got[i]["class_distance"] is None
    assert got[102]["word_distance"] is None and got[5]["word_distance"] is not None
    assert got[5]["kept"] and not got[101]["kept"] and not got[100]["kept"]


def test_no_reference_no_verdict(spark):
    df = spark.createDataFrame([(1, sentence(random.Random(1), 120), None)], "doc_id bigint, text string, lang string")
    row = quality_rules.quality_rules(df).first()
    assert row["kept"] and row["class_distance"] is None


def brute_edits(rows):
    """Per (id, text): the edited text, by descending id."""
    keys = {(-(2**63) if i is None else i, t or "") for i, t in rows}
    assert len({i for i, _ in keys}) == len(keys)
    order = sorted(keys, reverse=True)
    return {k: k[1][:len(k[1]) - len(k[1]) // 2] + order[(n + 1) % len(order)][1][:len(k[1]) // 2] for n, k in enumerate(order)}


def test_edited_texts(odd):
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] is not None and r[0] != 9]
    some = odd.filter("doc_id is not null and doc_id <> 9")
    got = order_minhash.edited_prints(some).select("_id", "n_chars", "edited_sha256", "fingerprint").collect()
    edits = brute_edits(rows)
    want = Counter((i, len(t or ""), hashlib.sha256(edits[i, t or ""].encode()).hexdigest()) for i, t in rows)
    assert Counter((r["_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = defaultdict(set)
    for r in got:
        prints[r["_id"]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and prints[5] == prints[6] != prints[7]
    assert prints[0] == prints[1] == prints[2] == {""}


def test_prints_of_all_odd_rows(odd):
    got = order_minhash.edited_prints(odd)
    assert got.count() == len(odd_rows())
    assert got.filter("near_edited not between 0 and 1 or near_next not between 0 and 1 or edited_sha256 is null").count() == 0


def test_likeness_falls_with_edits(spark):
    rng = random.Random(8)
    text = sentence(rng, 600)
    ws = text.split(" ")
    swapped = " ".join(ws[300:] + ws[:300])
    variants = [text, near_copy(text, 100, rng), near_copy(text, 20, rng), near_copy(text, 5, rng), swapped, sentence(rng, 600), f"  {text}\n"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(variants)], "k int, t string")
    rows = df.withColumn("p", order_minhash.fingerprint(F.col("t")))
    first = rows.filter("k = 0").select(F.col("p").alias("q"))
    like = {r["k"]: r["n"] for r in rows.join(F.broadcast(first)).select("k", order_minhash.likeness(F.col("p"), F.col("q")).alias("n")).collect()}
    assert like[0] == like[6] == 1 and 1 > like[1] > like[2] > like[3] >= like[5] and like[5] < 0.05
    assert like[4] < like[1]  # same k-mers, other order


def test_occurrences_are_told_apart(spark):
    df = spark.createDataFrame([(0, "a b c " * 10), (1, "a b c " * 11), (2, "")], "k int, t string")
    rows = {r["k"]: r["p"] for r in df.select("k", order_minhash.fingerprint(F.col("t")).alias("p")).collect()}
    assert rows[0] != rows[1] and len(rows[0]) == order_minhash.TUPLES and rows[2] == []


@pytest.mark.parametrize("run", [quality_rules.quality_rules, order_minhash.edited_prints])
def test_empty_table(empty, run):
    assert run(empty).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_order_minhash"])
def test_native_plans(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
