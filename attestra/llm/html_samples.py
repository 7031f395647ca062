"""Made web pages with known main text, to train the extractor on. The same seed gives the same pages."""

from __future__ import annotations

import random

_SYLLABLES = "an be cor da el fi gor ha in jo ka lem mi nor os pra qui re su ter un va wil xo ya zen für más été ção".split()
#: Names that sites give to the parts of a page.
_NAMES = {
    "nav": ["nav", "navbar", "main-menu", "menu", "breadcrumb", "site-navigation", "pagination", "toc"],
    "header": ["header", "site-header", "masthead", "top-bar", "page-head"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "copyright"],
    "aside": ["sidebar", "widget-area", "right-rail", "secondary", "side-column", "widget"],
    "ad": ["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo", "advertisement"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "alert", "notice", "gdpr", "message", "announcement", "privacy-notice"],
    "comments": ["comments", "comment-list", "discussion", "responses", "reader-comments", "disqus_thread"],
    "share": ["share", "social", "share-bar", "follow-us"],
    "related": ["related", "related-posts", "recommended", "more-stories", "trending", "popular"],
    "form": ["search", "newsletter", "subscribe", "login-form", "signup", "contact-form"],
    "content": ["content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text"],
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: set[str] = set()
        self.boilerplate = False

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, a: int, b: int) -> str:
        out = [self.word() for _ in range(self.r.randint(a, b))]
        if self.boilerplate:  # a word of its own, so that it never equals a main text
            out[0] = out[0] + "qx"
        style = self.style
        if style == "prose":
            out = [w + (self.r.choice(",.;") if self.r.random() < 0.12 else "") for w in out]
        elif style == "caps":
            out = [w.upper() + "!!" for w in out]
        elif style == "junk":
            out = [w + self.r.choice(("%%%", "***", "$$$", "###")) for w in out]
        return " ".join(out).capitalize() + ("." if style == "prose" else "")

    def text(self, a: int, b: int) -> str:
        """Main text, remembered as such."""
        s = self.words(a, b)
        self.main.add(s)
        return s

    def attrs(self, kind: str, chance: float = 0.85) -> str:
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(_NAMES[kind])}"' if self.r.random() < chance else ""

    def part(self, kind: str, tag: str, inner: str) -> str:
        """A part of the page: under its own tag, perhaps without a name, or as a named division."""
        if self.r.random() < 0.5 and tag != "div":
            return f"<{tag}{self.attrs(kind, 0.4)}>{inner}</{tag}>"
        return f"<div{self.attrs(kind, 1)}>{inner}</div>"

    def links(self, a: int, b: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(a, b))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.8 else " | ".join(items)

    def paragraph(self) -> str:
        self.style = self.page_style
        s = self.text(*self.r.choice(((1, 3), (3, 20), (15, 60), (40, 120), (40, 200))))
        roll = self.r.random()
        if roll < 0.10:
            return self.r.choice((f"<p><b>{s}<br>", f"<p><strong>{s}</strong></p>", f"<p><b>{s}</b><br>"))
        if roll < 0.75:
            return f"<p>{s}" + ("</p>" if self.r.random() < 0.9 else "")
        if roll < 0.83:
            head = s[:80].strip()
            self.main.add(head)
            return f"<h2>{head}</h2>"
        if roll < 0.88:
            own = [self.text(1, 15) for _ in range(self.r.randint(1, 5))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>"
        if roll < 0.92:
            return f"<blockquote><p>{s}</p></blockquote>"
        if roll < 0.95:
            return f"<table><tr><td>{s}</td><td>{self.text(1, 3)}</td></tr></table>"
        return f"<div>{s}</div>"

    def boiler(self, kind: str) -> str:
        self.style, self.boilerplate = "prose", True
        made = self._boiler(kind)
        self.boilerplate = False
        return made

    def _boiler(self, kind: str) -> str:
        if kind == "nav":
            return self.part("nav", "nav", self.links(1, 9))
        if kind == "header":
            return self.part("header", "header", f"<div>{self.words(1, 4)}</div>" + (self.links(2, 6) if self.r.random() < 0.5 else f"<p>{self.words(2, 8)}</p>"))
        if kind == "footer":
            return self.part("footer", "footer", f"&copy; {self.words(1, 10)}" + (self.links(1, 6) if self.r.random() < 0.4 else f"<p>{self.words(3, 40)}</p>" if self.r.random() < 0.4 else ""))
        if kind == "aside":
            return self.part("aside", "aside", f"<h3>{self.words(1, 4)}</h3>" + (self.links(2, 7) if self.r.random() < 0.5 else f"<p>{self.words(5, 60)}</p>"))
        if kind == "ad":
            body = self.words(2, 40)
            return self.part("ad", "div", f"<p>{body}</p>" if self.r.random() < 0.4 else f'<a href="/x">{body}</a>' if self.r.random() < 0.3 else body)
        if kind == "notice":
            return self.part("notice", "div", f"<p>{self.words(4, 40)}</p>" + ("<button>OK</button>" if self.r.random() < 0.5 else "") if self.r.random() < 0.7 else self.words(4, 40))
        if kind == "comments":
            own = "".join(f'<div class="{self.r.choice(("comment", "reply", "comment-body"))}"><b>{self.word()}</b><p>{self.words(2, 80)}</p></div>' for _ in range(self.r.randint(1, 5)))
            if self.r.random() < 0.3:
                own = "<ol>" + "".join(f"<li><p>{self.words(2, 60)}</p></li>" for _ in range(self.r.randint(1, 5))) + "</ol>"
            return f"<{(t := self.r.choice(('section', 'div')))}{self.attrs('comments', 1)}><h3>{self.words(1, 3)}</h3>{own}</{t}>"
        if kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input type=text><p>{self.words(2, 15)}</p><button>{self.word()}</button>"
            return f"<form{self.attrs('form', 0.5)}>{inner}</form>" if self.r.random() < 0.8 else f"<div{self.attrs('form', 1)}>{inner}</div>"
        return self.part(kind, "div", f"<h4>{self.words(1, 3)}</h4>" + self.links(2, 6))

    def bare(self) -> str:
        """Main text straight in body, or in no element at all, as old and converted pages have it, with little around it."""
        r = self.r
        made = []
        for _ in range(r.choice((1, 1, 2, 3))):
            lines = [self.text(*r.choice(((3, 12), (8, 30), (20, 80)))) for _ in range(r.choice((1, 1, 3, 8, 20)))]
            joint = r.choice(("<br>", "<br>\n", "<br/><br/>", "\n"))
            self.main.add(" ".join(lines))  # one run of text
            made.append(joint.join(lines))
            if r.random() < 0.5:
                made.append(r.choice(("<hr>", f"<p>{self.text(10, 60)}</p>", f"<h2>{self.text(1, 6)}</h2>")))
            else:
                made.append("<hr>")
        inner = "".join(made)
        if r.random() < 0.4:
            return inner
        head = self.text(2, 8)
        top = [self.boiler(k) for k, c in (("notice", 0.15), ("nav", 0.4), ("header", 0.2)) if r.random() < c]
        end = [self.boiler(k) for k, c in (("comments", 0.15), ("aside", 0.2), ("footer", 0.4)) if r.random() < c]
        if r.random() < 0.5:
            inner = f"<h1>{head}</h1>" + inner
        return "".join(["<html><head><title>x</title></head><body>", *top, inner, *end, "</body></html>"])

    def page(self) -> str:
        r = self.r
        if r.random() < 0.12:
            self.page_style = self.style = r.choice(("prose", "prose", "plain", "caps"))
            return self.bare()
        self.page_style = self.style = r.choice(("prose", "prose", "prose", "plain", "caps", "junk"))
        title = self.text(2, 12)
        head = title[: r.choice((60, 200))]
        self.main.add(head.strip())
        body = [f"<h1>{head}</h1>"] if r.random() < 0.9 else []
        if r.random() < 0.25 and body:
            body = [f"<header>{body[0]}</header>"]
        if r.random() < 0.5:
            lead = title if r.random() < 0.5 else self.text(4, 30)
            body.append(f"<p><b>{lead}<br>" if r.random() < 0.6 else f"<p><b>{lead}</b></p>")
        for _ in range(r.choice((0, 0, 1, 2, 4, 8, 15, 30))):
            body.append(self.paragraph())
            if r.random() < 0.06:
                body.append(self.boiler(r.choice(("ad", "ad", "related", "share", "form", "notice", "aside"))))
        for kind in ("share", "related", "comments"):
            if r.random() < 0.12:
                body.append(self.boiler(kind))
        if not self.main & set(body) and len(body) < 2:
            body.append(self.paragraph())
        inner = "".join(body)
        shape = r.random()
        if shape < 0.6:
            main = f"<article{self.attrs('content', 0.3)}>{inner}</article>"
        elif shape < 0.75:
            main = f"<main>{inner}</main>"
        else:
            main = f"<div{self.attrs('content', 0.9)}>{inner}</div>"
        if r.random() < 0.3:
            main = f"<{(t := r.choice(('main', 'div', 'section')))}{self.attrs('content', 0.5)}>{main}</{t}>"
        if r.random() < 0.15:  # bits of boilerplate straight in body, beside an article
            self.boilerplate = True
            bits = [f"&copy; {self.words(1, 8)}", f'<a href="/">{self.words(1, 3)}</a> | <a href="/x">{self.words(1, 3)}</a>', self.words(1, 5)]
            main = r.choice(bits) + main if r.random() < 0.5 else main + r.choice(bits)
            self.boilerplate = False
        top = [self.boiler(k) for k, c in (("notice", 0.25), ("header", 0.45), ("nav", 0.75), ("form", 0.15), ("ad", 0.5)) if r.random() < c]
        end = [self.boiler(k) for k, c in (("comments", 0.25), ("related", 0.25), ("share", 0.15), ("aside", 0.35), ("ad", 0.2), ("notice", 0.1), ("footer", 0.8)) if r.random() < c]
        if r.random() < 0.2 and end:
            top.append(end.pop(0))
        html = "".join(["<!DOCTYPE html><html><head><title>x</title></head><body>", *top, main, *end, "</body></html>"])
        return html if r.random() < 0.93 else html[: int(len(html) * r.uniform(0.7, 1))]


def labelled_pages(n: int, seed: int = 7):
    """n pages with the set of their main texts (as runs of text)."""
    for k in range(n):
        made = _Maker(seed * 1_000_003 + k)
        source = made.page()
        yield source, made.main
