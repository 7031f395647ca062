"""Operator 4: main-text extraction by gradient-boosted trees over DOM nodes, decoded along the tree.

Each block element with text gets features: text and link density of its subtree, depth, sibling statistics, its
tag and its ancestors', and the tokens of class, id and role of itself and its ancestors. Boosted trees give it the
probability that its subtree holds main text. Decoding then maximises the joint log likelihood over labellings in which
all descendants of a dropped element are dropped, so an ancestor and a descendant never contradict each other.

The model is trained here on pages that attestra.llm.html_samples makes, with known labels, in a fixed number
(``SAMPLES``); the model's size doesn't depend on the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import boosted
from attestra.llm.dom import Page
from attestra.llm.work import map_arrow, shared

#: Groups of attribute tokens, each a feature.
TOKENS = [
    "ad ads adv advert adverts advertisement adsense adslot banner sponsor sponsored promo promoted promotion dfp outbrain taboola commercial",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc tabs pagination pager navlinks sitemap topbar",
    "comment comments commentlist disqus discussion reply replies respond responses thread reader feedback",
    "share sharing social follow twitter facebook likes",
    "related recommended recommendations more similar trending popular latest also next previous read",
    "cookie cookies consent gdpr notice notices alert alerts warning message popup modal overlay dialog disclaimer privacy paywall toast announcement",
    "sidebar side aside widget widgets rail column left right secondary complementary",
    "footer foot bottom copyright legal colophon contentinfo",
    "header masthead head top site logo brand",
    "form search subscribe newsletter signup login register contact input",
    "article content post entry main story body text articlebody prose page",
    "meta byline author date tags tag category categories published info",
]
GROUP = {t: k for k, group in enumerate(TOKENS) for t in group.split()}
#: Groups of tags, each a feature of the element itself; the first six also of its ancestors.
TAGS = ["article main", "nav menu", "header", "footer", "aside", "form fieldset", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "div", "section", "table tr td th tbody thead", "blockquote pre", "figure figcaption", "#text"]
TAG_GROUP = {t: k for k, group in enumerate(TAGS) for t in group.split()}
ABOVE = 6
SAMPLES = 900
_MODEL: dict = {}


def node_features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the elements with text, their features), in page order."""
    n = len(page.tags)
    length, linked, own, nodes, paras, items, runs, marks = ([0] * n for _ in range(8))
    first = [None] * n
    children: list[list[int]] = [[] for _ in range(n)]
    before = 0
    for k, text, link in page.runs:
        length[k] += len(text)
        own[k] += len(text)
        linked[k] += link
        runs[k] += 1
        marks[k] += sum(map(text.count, ".,;:!?"))
        if first[k] is None:
            first[k] = before
        before += len(text)
    for k in range(n - 1, 0, -1):
        up, tag = page.parents[k], page.tags[k]
        for sums in (length, linked, runs, marks):
            sums[up] += sums[k]
        nodes[up] += nodes[k] + 1
        paras[up] += paras[k] + (tag == "p")
        items[up] += items[k] + (tag == "li")
        if first[k] is not None and (first[up] is None or first[k] < first[up]):
            first[up] = first[k]
    total = max(1, length[0])
    depth, tag_above, token_above = [0] * n, [0] * n, [0] * n
    tag_own, token_own = [0] * n, [0] * n
    for k in range(n):
        g = TAG_GROUP.get(page.tags[k], -1)
        tag_own[k] = 1 << g if g >= 0 else 0
        for t in page.tokens[k]:
            if t in GROUP:
                token_own[k] |= 1 << GROUP[t]
        if k:
            up = page.parents[k]
            depth[k] = depth[up] + 1
            tag_above[k] = tag_above[up] | tag_own[up]
            token_above[k] = token_above[up] | token_own[up]
            if length[k]:
                children[up].append(k)
    kept = [k for k in range(1, n) if length[k]]
    place = {}
    for kids in children:
        for i, k in enumerate(kids):
            place[k] = (i, len(kids), length[kids[i - 1]] if i else 0, length[kids[i + 1]] if i + 1 < len(kids) else 0)
    log = math.log1p
    out = []
    for k in kept:
        up, (i, siblings, left, right) = page.parents[k], place[k]
        size = length[k]
        out.append(
            [
                depth[k], log(size), log(own[k]), linked[k] / size, log(nodes[k]), size / (nodes[k] + 1), log(paras[k]), log(items[k]), size / max(1, runs[k]), marks[k] / size,
                first[k] / total, size / total, log(siblings), i / siblings, log(left), log(right), linked[up] / max(1, length[up]), length[up] / total, size / max(1, length[up]), len(page.tokens[k]),
                float(tag_own[k]), float(tag_above[k] & (1 << ABOVE) - 1), float(token_own[k]), float(token_above[k]),
            ]
        )
    x = np.array(out).reshape(len(out), -1 if out else 24)
    sets = [((x[:, c].astype(np.int64)[:, None] >> np.arange(w)) & 1) for c, w in ((20, len(TAGS)), (21, ABOVE), (22, len(TOKENS)), (23, len(TOKENS)))]
    return np.array(kept, dtype=np.int64), np.hstack([x[:, :20], *sets])


def decoded(page: Page, nodes: np.ndarray, odds: np.ndarray) -> list[bool]:
    """Whether each element is kept in the best labelling without a kept descendant of a dropped element."""
    n = len(page.tags)
    keep, drop = [0.0] * n, [0.0] * n
    for k, z in zip(nodes.tolist(), np.clip(odds, -12, 12).tolist(), strict=True):
        keep[k], drop[k] = -math.log1p(math.exp(-z)), -math.log1p(math.exp(z))
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        keep[up] += max(keep[k], drop[k])
        drop[up] += drop[k]
    kept = [True] * n
    for k in range(1, n):
        kept[k] = kept[page.parents[k]] and keep[k] >= drop[k]
    return kept


def texts_of(pages: list[Page], model: dict) -> list[str]:
    found = [node_features(p) for p in pages]
    x = np.vstack([f[1] for f in found]) if found else np.zeros((0, 0))
    odds, at, out = boosted.raw(model, x) if len(x) else np.zeros(0), 0, []
    for page, (nodes, _) in zip(pages, found, strict=True):
        kept = decoded(page, nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append(" ".join(text for k, text, _ in page.runs if kept[k]))
    return out


def model() -> dict:
    """The trees, trained once in a process on the made pages."""
    if not _MODEL:
        from attestra.llm.html_samples import labelled_pages

        rows, labels = [], []
        for source, main in labelled_pages(SAMPLES):
            page = Page(source)
            nodes, x = node_features(page)
            holds = [False] * len(page.tags)
            for k, text, _ in page.runs:
                if text in main:
                    while k >= 0 and not holds[k]:
                        holds[k] = True
                        k = page.parents[k]
            rows.append(x)
            labels += [holds[k] for k in nodes]
        _MODEL.update(boosted.fit(np.vstack(rows), np.array(labels, dtype=float)))
    return _MODEL


def extracted(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars for each row, from the whole html.

    Null or empty html, and pages without main text, give the empty string. A run of text straight in body, or without any
    tag, is judged like an element of its own. Cut-off pages are read as far as they go; an unfinished last tag is dropped.
    Repeated rows each get their row; extra columns are ignored; an empty table gives an empty result.
    """
    told = shared(pages.sparkSession, model())  # a fixed number of trees

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = texts_of([Page(h.as_py()) for h in part.column(2)], told.value)
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), run, "page_id long, url string, text string, n_chars long")
