"""A small DOM for text extraction: block elements with their texts, as parallel lists in page order."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

#: HTML's void elements, its inline elements, what closes an open paragraph's like, and what holds no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SILENT = frozenset("head select button object svg math audio video canvas datalist".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ()}
HOLDS = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav header footer form blockquote body html td th".split())
BARE = "#text"
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile(r">|=\s*([\"'])")
ATTRS = re.compile(r"\b(?:class|id|role|aria-label|itemprop|data-component)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def tokens(source: str):
    """(start, end, name, whether it closes, attributes) of each tag, and of what holds no text, with an empty name.

    Every character is passed once. A value in quotes may hold any character; one that is never closed ends with its tag
    at the next >. A tag that the page breaks off in ends with the page; < before anything but a tag is text.
    """
    last = {q: source.rfind(q) for q in "\"'"}
    raw_gone: set[str] = set()
    low, at, n = source.lower() if len(source.lower()) == len(source) else source, 0, len(source)
    while (i := source.find("<", at)) >= 0:
        if source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            at = n if end < 0 else end + 3
            yield i, at, "", False, ""
            continue
        m = NAME.match(source, i + 1)
        if not m:
            at = i + 1
            if source[i + 1 : i + 2] in ("!", "?", ""):
                end = source.find(">", i)
                at = n if end < 0 else end + 1
                yield i, at, "", False, ""
            continue
        j = m.end()
        while True:
            stop = STOP.search(source, j)
            if not stop:
                at = end = n
            elif not stop[1]:
                end, at = stop.start(), stop.end()
            elif last[stop[1]] >= stop.end():
                j = source.find(stop[1], stop.end()) + 1
                continue
            else:
                end = source.find(">", stop.end())
                at = n if end < 0 else end + 1
                end = n if end < 0 else end
            break
        name = m[0].lower()
        if not stop or end == n:
            yield i, n, "", False, ""
        elif name in RAW:
            close = -1 if name in raw_gone else low.find(f"</{name}", at)
            if close < 0:
                raw_gone.add(name)
                at = n
            else:
                close = source.find(">", close)
                at = n if close < 0 else close + 1
            yield i, at, "", False, ""
        elif name.startswith("/"):
            yield i, at, name[1:], True, ""
        else:
            yield i, at, name, False, source[m.end() : end]


class Page:
    """tags, parents, tokens (of class, id and role) of block elements; runs of text with their element and the length inside links.

    Each run of text straight in body stands in an element of its own, BARE, so that it has features like any other.
    """

    def __init__(self, source: str | None):
        self.tags, self.parents, self.tokens = ["html"], [-1], [()]
        self.runs: list[tuple[int, str, int]] = []
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack, silent, links, at = [0], 0, 0, 0
        texts: list[str] = []
        linked = 0
        open_silent: list[str] = []
        opened: Counter[str] = Counter()

        def cut(k: int) -> None:
            opened.subtract(self.tags[x] for x in stack[k:])
            del stack[k:]

        def flush() -> None:
            nonlocal texts, linked
            if texts:
                whole = " ".join("".join(texts).split())
                if whole:
                    if stack[-1] == 0:
                        self.tags.append(BARE)
                        self.parents.append(0)
                        self.tokens.append(())
                    self.runs.append((stack[-1] or len(self.tags) - 1, whole, min(linked, len(whole))))
                texts, linked = [], 0

        for start, end, name, closing, attributes in tokens(source):
            if start > at and not silent:
                piece = source[at:start]
                piece = entities.unescape(piece) if "&" in piece else piece
                texts.append(piece)
                if links:
                    linked += len(piece)
            at = end
            if not name:
                continue
            if name in SILENT:
                if not closing and not attributes.endswith("/"):
                    silent += 1
                    open_silent.append(name)
                elif closing and name in open_silent:
                    while open_silent and open_silent.pop() != name:
                        pass
                    silent = len(open_silent)
                continue
            if silent:
                if name == "body":  # ends a head that wasn't closed
                    silent, open_silent = 0, []
                else:
                    continue
            if name == "a":
                links = 0 if closing else 1
            if name in INLINE:
                continue
            if name in VOID:
                if name == "br":
                    texts.append(" ")
                elif name == "hr":
                    flush()
                continue
            flush()
            links = 0
            if closing:
                if opened[name] > 0:  # else there is nothing to look for
                    k = len(stack) - 1
                    while self.tags[stack[k]] != name:
                        k -= 1
                    cut(k)
                continue
            if name in ("html", "body"):
                continue
            if self.tags[stack[-1]] == "p":  # no block stands inside a paragraph
                cut(len(stack) - 1)
            ends = ENDS.get(name, ())
            if any(opened[tag] > 0 for tag in ends):
                for k in range(len(stack) - 1, 0, -1):
                    tag = self.tags[stack[k]]
                    if tag in ends:
                        cut(k)
                        break
                    if tag in HOLDS:
                        break
            self.tags.append(name)
            self.parents.append(stack[-1])
            found = ATTRS.findall(attributes) if attributes else ()
            self.tokens.append(tuple(t.lower() for f in found for t in SPLIT.findall(f[0] or f[1] or f[2])))
            stack.append(len(self.tags) - 1)
            opened[name] += 1
        if at < len(source) and not silent:
            piece = source[at:]
            texts.append(entities.unescape(piece) if "&" in piece else piece)
        flush()
