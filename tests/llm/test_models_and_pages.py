"""Quality model, license scan, page extraction and the pipeline."""

import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brookmill.llm import html_extract, license_scan, quality_model
from brookmill.llm.queries import QUERIES, read

from .conftest import DOCS, odd_rows, sentence
from .test_dedup import brute_classes
from .test_packing_and_mixing import pieces_of


# ---------------------------------------------------------------- quality model

def test_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3_000, len(quality_model.NAMES)))
    y = ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.4)).astype(float)
    model = quality_model.fit(x[:2_000], y[:2_000])
    assert (1, 4) in model.pairs
    assert ((model.score(x[2_000:]) > 0.5) == y[2_000:]).mean() > 0.95


def test_score_is_a_sum_of_tables():
    rng = np.random.default_rng(4)
    x = rng.random((400, len(quality_model.NAMES)))
    model = quality_model.fit(x, (x[:, 0] > 0.3).astype(float))
    for row, score in zip(x[:20], model.score(x[:20])):
        total = model.intercept + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model.edges, model.tables, row))
        coarse = [np.searchsorted(e, v, "right") for e, v in zip(model.pair_edges, row)]
        total += sum(t[coarse[f], coarse[g]] for (f, g), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op8_quality_classifier"](spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.97


def test_scores_of_odd_rows(odd, labels, empty):
    got = quality_model.classify(odd, labels)
    assert got.count() == len(odd_rows())
    assert got.filter("score is null or score not between 0 and 1 or predicted <> int(score >= 0.3)").count() == 0
    assert {r["score"] for r in quality_model.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(empty, labels).count() == 0


def test_held_out_labels_and_other_columns_do_not_matter(odd, labels):
    scores = lambda d, l: Counter((r["text"], r["score"]) for r in quality_model.classify(d, l).select("text", "score").collect())
    base = scores(odd, labels)
    flipped = labels.withColumn("quality", F.when(quality_model.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert scores(odd, flipped) == base
    assert scores(odd.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), labels) == base


# ---------------------------------------------------------------- licenses

def test_license_spans(spark):
    rng, mit = random.Random(1), license_scan.TEMPLATES["MIT"]
    ws = mit.split()
    changed = " ".join(w if k % 20 else "changed" for k, w in enumerate(ws))
    shorter = " ".join(ws[:60] + ws[64:])
    lead = sentence(rng, 40)
    texts = [f"{lead} {mit} {lead}", f"{lead}\n* {changed}", shorter, " ".join(ws[:30]), f"{mit}\n{lead}\n{mit}", lead, "", None, "Licensed under CC BY-NC 4.0.", " ".join(reversed(ws)), "license " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = license_scan.scan_licenses(df, {k: license_scan.TEMPLATES[k] for k in ("MIT", "CC-BY-NC-4.0 line")}).collect()
    by = {k: [r for r in got if r["_id"] == k] for k in range(len(texts))}
    assert [len(by[k]) for k in range(len(texts))] == [1, 1, 1, 0, 2, 0, 0, 0, 1, 0, 0]
    whole = by[0][0]
    assert whole["coverage"] == 1 and texts[0][whole["start_char"]:whole["end_char"]] == mit
    n = len(ws)
    assert by[1][0]["n_matched"] == sum(1 for k in range(n) if k % 20) and by[2][0]["n_matched"] == n - 4
    assert {texts[4][r["start_char"]:r["end_char"]] for r in by[4]} == {mit} and by[4][0]["start_char"] != by[4][1]["start_char"]


@pytest.mark.parametrize("n", [10, 25, 50])
def test_words_inserted_in_or_missing_from_the_middle(spark, n):
    rng, ws = random.Random(n), license_scan.TEMPLATES["MIT"].split()
    foreign = " ".join(f"foreign{k}" for k in range(n))
    texts = [f"{sentence(rng, 40)} {' '.join(ws[:at])} {foreign} {' '.join(ws[at:])} {foreign}" for at in (50, 83, 110)]
    few = min(n, len(ws) // 5)
    texts += [" ".join([foreign, *ws[:60], *ws[60 + few:], foreign])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["_id"]: r for r in license_scan.scan_licenses(df, {"MIT": license_scan.TEMPLATES["MIT"]}).collect()}
    assert [got[k]["n_matched"] for k in range(4)] == [len(ws)] * 3 + [len(ws) - few]
    assert texts[0][got[0]["start_char"]:got[0]["end_char"]] == f"{' '.join(ws[:50])} {foreign} {' '.join(ws[50:])}"


def test_notices_are_whole():
    assert license_scan.TEMPLATES["ISC"].endswith("USE OR PERFORMANCE OF THIS SOFTWARE.")
    assert license_scan.TEMPLATES["GPL-3.0"].endswith("If not, see <https://www.gnu.org/licenses/>.")


def test_alignment_against_full_table():
    """Inside a wide band the alignment equals the longest common subsequence."""
    rng = random.Random(9)
    for _ in range(40):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        n, first, last = license_scan.align(np.array(a), np.array(b), 0, 20)
        assert n == table[-1][-1]
        assert n == 0 or 0 <= first <= last < len(b)


def test_license_scan_of_odd_rows(odd, empty):
    assert license_scan.scan_licenses(odd).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0


# ---------------------------------------------------------------- pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="x1"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div class="story-7"><h1>Big &amp; small</h1><p>First  <b>bold<br>line</b>
&eacute;&#33;<p>Second <a href="x">link</a> text, long enough to win over everything else on the page.<ul><li>one<li>two</ul>
<form><input><p>Search</form><script>var a="</p><p>no";</script><!-- <p>gone</p> --></div><aside><p>Side</aside>
<div id="comments"><p>A very long comment by a reader, which goes on and on and on, and on, longer than the story itself may be.</div>
<footer>&copy; Us</footer></body></html>"""
TEXT = "Big & small\nFirst bold line é!\nSecond link text, long enough to win over everything else on the page.\none\ntwo"


def test_blocks_of_a_page():
    found = html_extract.blocks(PAGE)
    path = html_extract.best_path(found)
    assert path.endswith("div.story-") and html_extract.text_at(found, path) == TEXT


STORY = "A story of some length, with enough words to be the main text of its page."


@pytest.mark.parametrize("open_", [
    "<body class='single has-sidebar'>", "<body class='no-sidebar'>", "<article class='post comments-open'>", "<article class='social'>",
    "<div class='content ad-free'>", "<div data-id='ad' data-class='menu'>", "<div class='widget'>", "<form id=aspnetForm>", "<div class='comments'>"])
def test_names_that_do_not_leave_out_the_page(open_):
    inner = f"<p>{STORY}<section id='related-work'><h2 id='navigation-api'>Related</h2><p id='notice-2'>Noted.</section><div class=ad>Buy</div>"
    found = html_extract.blocks(f"<nav>Home</nav>{open_}{inner}</{open_[1:].split()[0]}><footer>Us</footer>")
    assert [t for t, _, _ in found[0]] == [STORY, "Related", "Noted."]


@pytest.mark.parametrize("tag", "noscript template svg math object select button".split())
def test_unclosed_elements_keep_what_comes_after(tag):
    found = html_extract.blocks(f"<body><div><{tag}>x</div><div class=story><p>{STORY}</div>")
    assert [t for t, _, _ in found[0]][-1] == STORY


def test_nested_objects_and_fallbacks_stay():
    page = f"<div><p>{STORY}<p>a <object>b <object>c</object> d</object> <math>e</math> <noscript>f</noscript> <button>g</button> <svg/> h</div>"
    assert html_extract.blocks(page)[0][1][0] == "a b c d e f h"


def test_long_comments_do_not_replace_the_story():
    found = html_extract.blocks(f"<div class=story><p>{STORY}</div><div id=comments><p>{STORY * 9}</div><div class='cookie-notice'>Cookies</div>")
    assert [t for t, _, _ in found[0]] == [STORY]


def test_host_consensus(spark):
    thin = PAGE.replace("First", "F").replace("Second", "S").replace('<aside>', '<div class="other"><p>' + "loud " * 60 + '</div><aside>')
    rows = [(k, f"https://a.example/{k}?q", PAGE.replace("story-7", f"story-{k}")) for k in range(5)] + [
        (10, "https://A.example/odd", thin), (11, "https://b.example/", thin), (12, None, PAGE), (13, "https://a.example", None), (14, "not a url", ""),
        (15, "https://a.example/p", "plain words only"), (16, "https://a.example/<", "<p>cut off &am <b"), (17, "https://c.example/", "<div>" * 3_000 + "deep"), (None, None, PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).repartition(3)
    got = {r["page_id"]: r for r in html_extract.extract_pages(df).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["text"] == TEXT for k in range(5)) and got[12]["text"] == TEXT and got[None]["text"] == TEXT
    assert "loud" not in got[10]["text"] and "loud" in got[11]["text"]  # the host's votes decide
    assert got[13]["text"] == got[14]["text"] == "" and got[17]["text"] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_empty_pages(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract_pages(df).count() == 0


# ---------------------------------------------------------------- pipeline

@pytest.fixture(scope="module")
def stage_inputs(spark, tmp_path_factory, odd):
    """A folder of tables, and what each stage gives on the stage before it."""
    sf_dir = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    plain = [(1_000 + k, sentence(rng, 120), "en", f"s{k % 3}", 0, None, None, None, None, None, None, None) for k in range(12)]
    docs = odd.unionByName(spark.createDataFrame(plain, DOCS))
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    rows = [(i, 0 if i in (13, 15, 16) else 1, 0) for i in [*range(20), *range(1_000, 1_012)]]
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    states, current = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, sf_dir)
        out.write.parquet(f"{sf_dir}/stage{number}.parquet")
        current = spark.read.parquet(f"{sf_dir}/stage{number}.parquet")
        states.append(current)
    return sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet"), states


def test_stages_keep_columns_and_decide(spark, stage_inputs):
    sf_dir, docs, states = stage_inputs
    assert all(s.columns == docs.columns for s in states[:-1])
    key = lambda df: Counter((r["_id"], r["text"]) for r in df.select("_id", "text").collect())
    scored = quality_model.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1")
    assert key(states[0]) == key(scored)
    assert sum(key(states[1]).values()) == sum(key(states[0]).values())
    rows = [(r["doc_id"], r["text"]) for r in states[1].collect()]
    assert states[2].count() == brute_classes(rows)[1]
    assert states[3].filter("n_chars <> char_length(text)").count() == 0


def test_last_stage_packs_all_of_the_mix(stage_inputs):
    from tokenizers import Tokenizer

    from brookmill.llm.queries import vocabulary

    _, _, states = stage_inputs
    want = pieces_of([(r["doc_id"], r["text"]) for r in states[3].collect()], Tokenizer.from_file(vocabulary()))
    got = Counter((-(2**63) if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in states[4].collect())
    assert got == want


def test_run_is_the_stages_in_order(spark, stage_inputs):
    sf_dir, _, states = stage_inputs
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(tuple, states[4].collect()))


def test_stages_of_an_empty_table(spark, empty, stage_inputs):
    sf_dir, docs, _ = stage_inputs
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


@pytest.mark.parametrize("page,n", [
    ("<a " * 70_000, 1), ('<a "' * 50_000, 1), ("<a '\"" * 40_000, 1), ("<!x" * 70_000, 1), ("<!--" * 50_000, 0),
    ("<div class=content>" * 50_000, 0), ("<div class=content>t " * 50_000, 50_000), ("<div>" * 20_000 + "</b>" * 40_000, 0),
    ("<b>" * 30_000 + "<p>x" * 100, 100),
])
def test_malformed_and_deep_pages_cost_their_length(page, n):
    began, paths = time.time(), None
    tracemalloc.start()
    found, paths = html_extract.blocks(page)
    html_extract.text_at((found, paths), html_extract.best_path((found, paths)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n and time.time() - began < 60 and peak < 200 * len(page) + 1e6


def test_text_outside_of_any_container_is_kept(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "Bare <b>text</b>"), (2, None, "<p>One</p><p title='a > b' class=it's>Two</p>"), (3, "http://h/3", "")], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    assert got == {1: "Bare text", 2: "One\nTwo", 3: ""}
