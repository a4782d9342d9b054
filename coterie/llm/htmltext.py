"""Main-text extraction with gradient-boosted trees over DOM nodes (operator 9).

Every block element has features: its tag, depth, the density of its subtree (text, links, tags,
sentences), the tokens of its class, id and role, those of its ancestors, and its standing among its
siblings. Boosted trees give the chance that its subtree holds main text. Decoding is over the whole
page at once: it takes the likeliest labelling in which a node is kept only if its parent is, so no kept
node stands inside a dropped one; the text that kept nodes hold directly is the result.

The trees are trained here, on TRAINING_PAGES generated pages whose main text is known (a documented,
fixed bound; no table is needed), once per process, and travel to the tasks as a few arrays.

The generated pages differ in words, markup habits and names: many have no article element, no class at
all or classes that tell nothing, so that density, place and siblings carry the decision there.

Cases: null and empty pages give empty text; broken markup is read as far as it goes, and a control or
drawing that is never closed costs no text after it; a very long or hostile page is read in one linear
pass; where two labellings are equally likely (a gain of exactly 0) the node is dropped; repeated rows are
read each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table
from .dom import Page
from .pagegen import KINDS, generated_page, varied_page

#: Training pages with telling names, and varied ones.
TRAINING_PAGES = 400, 700
TREES, DEPTH, RATE, BINS = 100, 4, 0.25, 32
#: Share of the features that one tree sees.
COLUMNS = 0.3

_TAGS = ("p", "div", "section", "article", "main", "body", "header", "footer", "nav", "aside", "form", "ul", "ol", "li", "table", "tr", "td", "blockquote", "pre", "figure", "h1", "h2", "h3", "dl")
_OWN = re.compile("\u00a9|(?i:copyright|all rights reserved|cookies?|subscribe|newsletter|advertisement|sponsored|log in|sign in|sign up|comments?|repl(?:y|ies))\\b")
_MEASURES = 46


def features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.tag)
    own, stops, signs, first, last = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, np.inf), np.zeros(n)
    total = 0
    for node, _, text in page.pieces:
        size = len(text.strip())
        if size:
            first[node] = min(first[node], total)
            total += size
            last[node] = total
            own[node] += size
            stops[node] += text.count(". ") + text.count(", ") + text.rstrip().endswith(".")
            if size < 400 and _OWN.search(text):
                signs[node] += 1
    parent = np.array(page.parent)
    heading = np.array([len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in page.tag], float)
    tops = np.array([t == "h1" for t in page.tag], float)
    paragraphs = np.array([t == "p" for t in page.tag], float)
    link, anchors, control = np.array(page.links, float), np.array(page.n_links, float), np.array(page.controls, float)
    size, tags, kids, kid_p, flow = own.copy(), np.ones(n), np.zeros(n), np.zeros(n), own - link
    stop, sign, heads, h1s, ps = stops.copy(), signs.copy(), heading.copy(), tops.copy(), paragraphs.copy()
    up = page.parent
    for k in range(n - 1, 0, -1):
        p = up[k]
        size[p] += size[k]
        link[p] += link[k]
        anchors[p] += anchors[k]
        control[p] += control[k]
        stop[p] += stop[k]
        sign[p] += sign[k]
        tags[p] += tags[k]
        ps[p] += ps[k]
        heads[p] += heads[k]
        h1s[p] += h1s[k]
        kids[p] += 1
        kid_p[p] += paragraphs[k]
        flow[p] += own[k] - page.links[k]  # unlinked text in the node itself and right below it
        first[p] = min(first[p], first[k])
        last[p] = max(last[p], last[k])
    densest = flow.copy()
    for k in range(n - 1, 0, -1):
        densest[up[k]] = max(densest[up[k]], densest[k])
    above = flow.copy()
    for k in range(1, n):
        above[k] = max(above[k], above[up[k]])
    top = max(flow.max(), 1.0)
    index, same, seen, before, after, largest = np.zeros(n), np.zeros(n), {}, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    latest: dict[int, int] = {}
    for k in range(1, n):
        p = up[k]
        key = p, page.tag[k]
        index[k] = seen[p] = seen.get(p, -1) + 1
        seen[key] = seen.get(key, 0) + 1
        if p in latest:
            before[k], after[latest[p]] = latest[p], k
        latest[p] = k
        largest[p] = max(largest[p], size[k])
    for k in range(1, n):
        same[k] = seen[up[k], page.tag[k]]
    place = np.maximum(parent, 0)
    grand = np.maximum(parent[place], 0)
    some, all_ = np.maximum(size, 1), max(size[0], 1.0)
    density = link / some
    first = np.where(np.isfinite(first), first, 0)
    marked = float("article" in page.tag) + 2.0 * ("main" in page.tag)
    title = np.flatnonzero(tops)
    title_at = first[title[0]] if len(title) else -1.0
    x = np.zeros((n, _MEASURES + len(_TAGS) + 2 * len(KINDS)), np.float32)
    x[:, :_MEASURES] = np.stack([
        page.depth, np.log1p(size), size / all_, density, tags / some, stop / some, own / some, kids, np.log1p(ps), kids[place], size / some[place], index / np.maximum(kids[place], 1), same,
        np.log1p(size / np.maximum(kids, 1)), density[place], np.log1p(size[place]), stop[place] / some[place], first / all_, last / all_, density[before] * (before > 0), np.log1p(size[before]) * (before > 0),
        density[after] * (after > 0), np.log1p(size[after]) * (after > 0), size / np.maximum(largest[place], 1), np.log1p(anchors), anchors / (kids + 1), sign / np.maximum(tags, 1), np.minimum(signs, 3), kid_p[place],
        size[grand] / all_, heads, h1s, h1s[place], first - title_at > 0, (first < title_at) * (title_at >= 0), flow[place] / top, flow / top, densest / top, above[place] / top, density[grand], np.log1p(stop), np.log1p(link), np.full(n, marked), np.full(n, np.log1p(all_)), np.log1p(control), np.log1p(control[place]),
    ], 1)
    number = {t: _MEASURES + k for k, t in enumerate(_TAGS)}
    at_own = _MEASURES + len(_TAGS)
    for k in range(n):
        at = number.get(page.tag[k])
        if at:
            x[k, at] = 1
        if page.names[k]:
            for j, kind in enumerate(KINDS):
                if page.names[k] & kind:
                    x[k, at_own + j] = 1
    # ancestors: token kinds, and standing tags of page furniture as if they were tokens
    a = at_own + len(KINDS)
    furniture = {"nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 8, "article": 0, "main": 0}
    for k in range(1, n):
        p = up[k]
        x[k, a:] = np.maximum(x[p, a:], x[p, at_own:a])
        if page.tag[p] in furniture:
            x[k, a + furniture[page.tag[p]]] = 1
    return x


class Boosted:
    """Logistic gradient boosting with histogram splits; complete trees of equal depth as arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        n, m = x.shape
        self.feature = np.zeros((TREES, 2**DEPTH - 1), np.int64)
        self.edge = np.full((TREES, 2**DEPTH - 1), np.inf, np.float32)
        self.leaf = np.zeros((TREES, 2**DEPTH))
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = np.log(rate / (1 - rate))
        score = np.full(n, self.start)
        rng = np.random.default_rng(3)
        for t in range(TREES):
            columns = np.sort(rng.choice(m, max(1, int(COLUMNS * m)), replace=False))
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for d in range(DEPTH):
                width = 2**d
                best = np.full(width, 1e-6)
                choice: list = [None] * width
                for f in columns.tolist():
                    if not len(edges[f]):
                        continue
                    key = node * (BINS + 1) + codes[:, f]
                    gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain = np.where((hl > 0.5) & (ht - hl > 0.5), gain, 0)[:, : len(edges[f])]
                    k = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(width), k] > best):
                        best[i], choice[i] = gain[i, k[i]], (f, k[i])
                right = np.zeros(n, np.int64)
                for i, c in enumerate(choice):
                    if c:
                        self.feature[t, width - 1 + i], self.edge[t, width - 1 + i] = c[0], edges[c[0]][c[1]]
                        own = node == i
                        right[own] = codes[own, c[0]] > c[1]
                node = node * 2 + right
            gs, hs = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
            self.leaf[t] = -RATE * gs / (hs + 1)
            score += self.leaf[t][node]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows, score = np.arange(len(x)), np.full(len(x), self.start)
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for d in range(DEPTH):
                at = 2**d - 1 + node
                node = node * 2 + (x[rows, self.feature[t, at]] > self.edge[t, at])
            score += self.leaf[t][node]
        return score


def decode(parent: list[int], log_odds: np.ndarray) -> list[bool]:
    """The likeliest labelling that keeps a node only if its parent is kept; the root always is."""
    gain = log_odds.copy()
    for k in range(len(parent) - 1, 0, -1):
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    keep = [True] * len(parent)
    for k in range(1, len(parent)):
        keep[k] = bool(keep[parent[k]] and gain[k] > 0)
    return keep


def _labelled(before: str, main: str, after: str) -> tuple[np.ndarray, np.ndarray]:
    head = "<!DOCTYPE html><html><head><title>t</title></head><body>"
    # marks tell which pieces of text are main; they are removed before the features are made
    page = Page(head + "\x01" + before + "\x00" + main.replace("\x00", "\x02").replace("\x01", "\x00").replace("\x02", "\x01") + "\x01" + after + "</body></html>")
    holds, on, pieces = np.zeros(len(page.tag)), False, []
    for node, block, text in page.pieces:
        for mark in text:
            if mark in "\x00\x01":
                on = mark == "\x00"
        clean = text.replace("\x00", "").replace("\x01", "")
        if clean.strip():
            pieces.append((node, block, clean))
            holds[node] = max(holds[node], on)
    page.pieces = pieces
    for k in range(len(holds) - 1, 0, -1):
        holds[page.parent[k]] = max(holds[page.parent[k]], holds[k])
    return features(page), holds


@cache
def model(pages: tuple[int, int] = TRAINING_PAGES, seed: int = 11) -> Boosted:
    rng = random.Random(seed)
    rows = [_labelled(*make(rng)) for make, n in zip((generated_page, varied_page), pages, strict=True) for _ in range(n)]
    return Boosted().fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


def main_texts(sources: list[str | None], trees: Boosted) -> list[str]:
    pages = [Page(s or "") for s in sources]
    rows = [features(p) for p in pages]
    odds = trees.log_odds(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for p, x in zip(pages, rows, strict=True):
        own = np.where(p.voided, -np.inf, odds[at : at + len(x)])
        out.append(p.text(decode(p.parent, own)))
        at += len(x)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources, texts = b.column(2).to_pylist(), []
            for at in range(0, len(sources), 64):
                texts += main_texts(sources[at : at + 64], trees)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
