from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that working columns could clash with
    T.StructField("_id", T.StringType()), T.StructField("_text", T.LongType()), T.StructField("_row", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("a.b", T.StringType()),
])


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and to in is that it for was stone river lamp cloud green seven walks under about".split()) + rng.choice(["", "", "", "x", "ly", "ing"]) for _ in range(n))


def near_copy(text: str, every: int, rng: random.Random) -> str:
    words = text.split(" ")
    return " ".join(f"new{rng.random()}" if i % every == every // 2 else w for i, w in enumerate(words))


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    long_line = sentence(rng, 30)
    base, passage = sentence(rng, 400), sentence(rng, 80)
    texts = [
        None, "", "   \n\t ", "one", "one two", base, base, near_copy(base, 200, rng), near_copy(base, 4, rng),
        f"{sentence(rng, 60)}\n{long_line}\n{passage}", f"{long_line}  \n{sentence(rng, 70)}", f"\t{long_line.upper()}\n{long_line}\n\n",
        f"{passage} {sentence(rng, 20)}", "x" * 60_000, sentence(rng, 9_000), "same same same same " * 40, "### $$$ !!! *** " * 30,
        "a\nb\na\nb\n\n\n", "éß中\U0001f600 word joined wide", "ends with break\n",
    ]
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], [None, "s1", "s2", "\U0001f600", ""][i % 5], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[9], (None, base, "en", "s1", 3), (None, None, None, None, None), (9, sentence(rng, 55), "fr", "s1", 1)]
    return [(*r, f"i{k}", k, "r", "s", "n", "k", "ab") for k, r in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(20)] + [(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (9_999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
