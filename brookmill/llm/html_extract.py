"""Main text of web pages by consensus paths of each host.

Each page's containers are scored by the text of the blocks in them (all of it for the
block's container, half for the one around that; link text counts nothing, parts marked
as menus, adverts and the like are left out). A part is marked by its element, or by a
whole class name or id of a fixed list; html, body, main and article never are, ids of
headings, paragraphs and sections do not count, and a marked part that holds most of the
page's unlinked text stays (one marked as comments only where there is no other text).
Buttons, select lists, templates and drawings are such parts; one without its closing tag
ends with the element around it. A container is named by its generalised
path of tags and classes, without digits. Every page votes for the path of its best
container; Spark counts the votes per host; then each page is read again and gives the
blocks inside the elements at its host's winning path. A page that has none of these, or
no host, gives those at its own best path, or all its blocks if they stand in no container.

A page is read in one pass: a tag that does not end before the next ``<`` is text, and
containers are numbered nodes that know the one around them, so neither many unclosed
tags nor deep nesting costs more than its length.

Defined cases: a null or empty page, and one without blocks, gives an empty text; a page
without a url has no host; equal rows give equal results; an empty table gives an empty
result. Character references are decoded, also ones without a semicolon where the HTML
rules allow that; a line break inside a block is white space; white space of any kind
inside a block becomes one blank.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values: element names as HTML defines them
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe".split())
ASIDE = set("nav footer aside form dialog template svg select button".split())
ENDED = set("svg select".split())  # by any block that begins in them
BLOCKS = set("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = set("article body blockquote div main section td".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# fixed values: words in class and id names of parts around an article
AROUND = set("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation
menu breadcrumb breadcrumbs sidebar widget footer header masthead topbar cookie cookies consent notice notices gdpr comment
comments reply replies respond disqus share sharing social related recommended newsletter subscribe signup login popup modal
pagination pager toolbar cookie-notice cookie-banner cookie-consent ad-banner ad-container ad-slot ad-wrapper ad-unit main-nav
main-menu nav-menu nav-bar site-header site-footer site-nav page-footer sidebar-left sidebar-right comment-list comments-area
comment-form comments-section reply-form share-buttons social-links social-share related-posts related-articles related-links
newsletter-signup""".split())
COMMENTS = set("comment comments reply replies respond disqus comment-list comments-area comment-form comments-section reply-form".split())
NEVER = set("html body main article".split())
NO_IDS = set("h1 h2 h3 h4 h5 h6 section p li dt dd td th blockquote figure pre".split())
PREFERRED = ("article", "main")

# quotes stand around a value only behind its =; a tag with quotes that do not close ends
# at the first >, and none goes on over a < outside of quotes
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*+(?:"[^"]*"|'[^']*')|[^<>])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


def _names(attributes: str) -> tuple[list[str], list[str]]:
    """The class names and the id of an element, in lower case."""
    found: dict[str, list[str]] = {}
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            if (name := m[1].lower()) in ("class", "id"):
                found.setdefault(name, (m[2] or m[3] or m[4] or "").lower().split())
    return found.get("class", []), found.get("id", [])


def _is_around(tag: str, attributes: str, in_article: bool) -> str:
    """``hard`` for a part that is left out, ``soft`` for one that is unless it holds most
    of the page's text, ``comments`` for one that stays only in place of nothing."""
    if tag in ASIDE or tag == "header" and not in_article:
        return "soft" if tag == "form" else "hard"
    if not attributes or tag in NEVER:
        return ""
    classes, ids = _names(attributes)
    names = {re.sub(r"[-_]*\d+$", "", c) for c in classes}
    if tag not in NO_IDS and "section" not in classes:
        names.update(ids)
    names &= AROUND - {"header"} if in_article else AROUND
    return "comments" if names & COMMENTS else "soft" if names else ""


def _step(tag: str, attributes: str) -> str:
    classes = sorted(c for c in (re.sub(r"\d+", "", c) for c in _names(attributes)[0]) if c)
    return ".".join([tag, *classes]).replace(">", "")


class Paths:
    """Generalised paths as numbered nodes: a node is one step below another one (-1: none).
    Equal paths are one node, and a node's number is larger than that of the node above."""

    def __init__(self):
        self.above: list[int] = []
        self.steps: list[str] = []
        self._known: dict[tuple[int, str], int] = {}

    def below(self, node: int, step: str) -> int:
        found = self._known.setdefault((node, step), len(self.above))
        if found == len(self.above):
            self.above.append(node)
            self.steps.append(step)
        return found

    def up(self, node: int) -> list[int]:
        """The node and all above it, innermost first."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.above[node]
        return out

    def text(self, node: int) -> str:
        return ">".join(self.steps[n] for n in reversed(self.up(node)))

    def find(self, path: str) -> int:
        """The node of a path, or -1."""
        node = -1
        for step in path.split(">"):
            node = self._known.get((node, step), -1)
            if node < 0:
                break
        return node

    def inside(self, node: int) -> list[bool]:
        """Of each node, whether it is ``node`` or below it."""
        out: list[bool] = []
        for n, above in enumerate(self.above):
            out.append(n == node or above >= 0 and out[above])
        return out


Blocks = tuple[list[tuple[str, int, int]], Paths]


def blocks(page: str) -> Blocks:
    """(text, characters outside of links, node of the innermost container around it) of
    each block that is not part of a menu, an advert and the like, and the nodes."""
    paths = Paths()
    found, weights, total = _read(page, frozenset(), False, paths)
    kept = frozenset(k for k, n in weights.items() if 2 * n > total)
    found = _read(page, kept, False, paths)[0] if kept else found
    if not any(plain for _, plain, _ in found):
        _, weights, total = _read(page, frozenset(), True, paths)
        kept = frozenset(k for k, n in weights.items() if 2 * n > total)
        found = _read(page, kept, True, paths)[0] if kept else found
    return found, paths


def _read(page: str, kept: frozenset[int], comments: bool, paths: Paths) -> tuple[list, dict[int, int], int]:
    """The blocks outside of marked parts that are not ``kept``; the unlinked characters in
    each part that may stay (with ``comments``, those marked as such may), and in all of the
    page but for the parts that may not."""
    out: list = []
    stack: list[tuple[str, int]] = []  # tag, and the node of the container it was opened in
    open_tags: Counter[str] = Counter()
    here = -1
    text: list[str] = []
    parts: list[tuple[int, int, bool]] = []  # open marked parts: depth of the stack, number, whether it may stay
    weights: dict[int, int] = {}
    skip, hard, linked, in_article, at, number, total = 0, 0, 0, 0, 0, 0, 0  # skip, hard: how many open parts are left out, may not stay
    state = {"plain": 0}

    def flush():
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                out.append((joined, min(state["plain"], len(joined)), here))
        state["plain"] = 0

    def close(depth: int):
        nonlocal skip, hard, linked, in_article, here
        while len(stack) > depth:
            tag, outer = stack.pop()
            open_tags[tag] -= 1
            if tag in BLOCKS and not skip:
                flush()
            here = outer
            linked -= tag == "a"
            in_article -= tag == "article"
            if parts and len(stack) < parts[-1][0]:
                _, part, may_stay = parts.pop()
                skip -= part not in kept
                hard -= not may_stay
                if may_stay and parts and not hard:
                    weights[parts[-1][1]] += weights[part]

    def add(piece: str):
        nonlocal total
        if piece and not hard and not linked:
            n = len("".join(piece.split()))
            total += n
            if parts:
                weights[parts[-1][1]] += n
        if piece and not skip:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if not linked:
                state["plain"] += len(piece)

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("svg", "math") and m[3].endswith("/"):
            continue
        if tag in BLOCKS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ENDED:
                    close(depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or stack[depth][0] in CLOSES.get(tag, ()):
                    close(depth)
                elif stack[depth][0] in BLOCKS:
                    break
            if not skip:
                flush()
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        outer = here
        kind = _is_around(tag, m[3], in_article > 0)
        if kind:
            number += 1
            weights[number] = 0
            may_stay = kind == "soft" or comments and kind == "comments"
            parts.append((len(stack) + 1, number, may_stay))
            skip += number not in kept
            hard += not may_stay
        if tag in CONTAINERS:
            here = paths.below(here, _step(tag, m[3]))
        stack.append((tag, outer))
        open_tags[tag] += 1
        linked += tag == "a"
        in_article += tag == "article"
    if not skip:
        flush()
    close(0)
    return out, weights, total


def best_path(page: Blocks) -> str:
    """The path of the container that scores best (of equal ones the first), widened to the
    article it is in."""
    found, paths = page
    scores: Counter[int] = Counter()
    for _, plain, node in found:
        for share in (1.0, 0.5):
            if node >= 0:
                scores[node] += plain * share
                node = paths.above[node]
    if not scores:
        return ""
    best = min(scores, key=lambda node: (-scores[node], node))
    around = paths.up(best)[::-1]
    for name in PREFERRED:
        for node in around:
            if paths.steps[node].split(".")[0] == name:
                return paths.text(node)
    return paths.text(best)


def text_at(page: Blocks, path: str) -> str:
    """The blocks in the containers at a path, or all of a page that has its text in none."""
    found, paths = page
    if not path:
        return "\n".join(text for text, _, _ in found)
    node = paths.find(path)
    inside = paths.inside(node) if node >= 0 else None
    return "\n".join(text for text, _, n in found if n >= 0 and inside[n]) if inside else ""


def host_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``(host, path)``: the path most pages of a host vote for."""

    def vote(batches):
        for batch in batches:
            best = [best_path(blocks(page)) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string())], ["host", "path"])

    hosted = pages.select(host_of(url_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("html")).filter("host <> ''")
    votes = hosted.mapInArrow(vote, "host string, path string").filter("path <> ''")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


def host_of(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every page."""

    def read(batches):
        for batch in batches:
            texts = []
            for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist()):
                found = blocks(page)
                text = text_at(found, path) if path else ""
                texts.append(text or text_at(found, best_path(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    winners = host_paths(pages, html_col, url_col)
    rows = pages.select(id_col, url_col, F.coalesce(html_col, F.lit("")).alias("html"), host_of(url_col).alias("host"))
    joined = rows.join(winners, "host", "left").select(id_col, url_col, "html", "path")
    kinds = dict(joined.dtypes)
    found = joined.mapInArrow(read, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
