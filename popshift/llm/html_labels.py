"""Labelled pages that the extractor learns from: layouts of the usual kinds, with made-up words.

An element's `data-y` says whether the text in it is the article's (1) or not (0); it holds for all that is inside, up to the
next mark. The attribute is for labels only and is never a feature.
"""

from __future__ import annotations

import random

PAGES, SEED = 160, 5

_SYLLABLES = "ka lo mi ren tas vor bel dun sti pra nek ol um ir as tor gan fel wi shu".split()

#: Class and id words by the role of a block. Fixed values.
WORDS = {
    "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "breadcrumb", "topnav", "site-nav", "toc"],
    "header": ["header", "masthead", "site-header", "topbar", "banner", "logo"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "legal", "bottom"],
    "side": ["sidebar", "aside", "widget", "related", "rail", "recommended", "popular", "tags", "share", "social"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "adsbygoogle"],
    "notice": ["cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"],
    "comments": ["comments", "comment", "comment-list", "responses", "disqus", "discussion", "replies"],
    "content": ["content", "article", "post", "entry", "entry-content", "post-body", "article-body", "story", "main", "text"],
    "wrap": ["wrapper", "container", "page", "row", "col", "layout", "site", "inner", "grid"],
}


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 3)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(a, b)))

    def attr(self, role: str) -> str:
        r = self.rng.random()
        w = self.rng.choice(WORDS[role])
        return f' class="{w}"' if r < 0.6 else f' id="{w}"' if r < 0.8 else f' class="{w} {self.word()}"'

    def links(self, a: int = 3, b: int = 9) -> str:
        item = lambda: f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>'
        return "<ul>" + "".join(item() for _ in range(self.rng.randint(a, b))) + "</ul>"

    def paragraph(self) -> str:
        size = self.rng.choice([(1, 4), (8, 30), (30, 120)])
        t = self.words(*size) + "."
        r = self.rng.random()
        if r < 0.15:
            t = f"<b>{t}</b>"
        elif r < 0.25:
            t = f"<b>{t}<br>"
        elif r < 0.4:
            t = f'{t} <a href="/{self.word()}">{self.words(1, 3)}</a> {self.words(2, 9)}'
        elif r < 0.5:
            t = f"{t} <em>{self.word()}</em> <span>{self.words(1, 5)}</span>"
        return f"<p>{t}" + ("</p>" if self.rng.random() < 0.8 else "")

    def block(self) -> str:
        r = self.rng.random()
        if r < 0.75:
            return self.paragraph()
        if r < 0.82:
            return f"<h{k}>{self.words(1, 7)}</h{k}>" if (k := self.rng.randint(2, 4)) else ""
        if r < 0.88:
            return "<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>"
        if r < 0.92:
            return f"<blockquote><p>{self.words(5, 40)}</p></blockquote>"
        if r < 0.95:
            return f"<pre><code>{self.words(3, 20)}</code></pre>"
        if r < 0.98:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><img src='/x.png'><figcaption>{self.words(3, 12)}</figcaption></figure>"

    def inside(self) -> str:
        """A block within the article that isn't of it."""
        r = self.rng.random()
        if r < 0.4:
            return f'<div{self.attr("ad")} data-y="0">{self.words(2, 12)}</div>'
        if r < 0.6:
            return f'<aside{self.attr("side") if self.rng.random() < 0.5 else ""} data-y="0"><h3>{self.words(1, 3)}</h3>{self.links(2, 4)}</aside>'
        if r < 0.8:
            return f'<form data-y="0"><label>{self.words(1, 3)}</label><input name="q"><button>{self.word()}</button></form>'
        return f'<div{self.attr("notice")} data-y="0"><p>{self.words(4, 20)}</p></div>'

    def article(self) -> str:
        blocks = [self.block() for _ in range(self.rng.choice([1, 2, 5, 12, 25]))]
        if self.rng.random() < 0.35:
            blocks.insert(self.rng.randint(0, len(blocks)), self.inside())
        title = f"<h1>{self.words(1, 9)}</h1>" if self.rng.random() < 0.85 else ""
        if title and self.rng.random() < 0.2:
            title = f"<header>{title}</header>"
        body = "".join(blocks)
        r = self.rng.random()
        if r < 0.15:
            body = f"<div>{body}</div>"
        elif r < 0.3:
            body = f"<section>{body}</section>"
        inner = title + body
        r = self.rng.random()
        if r < 0.5:
            return f'<article data-y="1">{inner}</article>'
        if r < 0.65:
            return f'<main data-y="1">{inner}</main>'
        if r < 0.75:
            return f'<main data-y="1"><article>{inner}</article></main>'
        if r < 0.9:
            return f'<div{self.attr("content")} data-y="1">{inner}</div>'
        return f'<div data-y="1">{inner}</div>'

    def around(self, role: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "comments": "section"}.get(role, "div")
        if self.rng.random() < 0.4 and role not in ("ad", "notice"):
            tag = "div"
        attr = self.attr(role) if tag in ("div", "section") or self.rng.random() < 0.3 else ""
        if role == "nav":
            inner = self.links()
        elif role == "header":
            inner = f'<a href="/">{self.words(1, 2)}</a>' + (self.links(2, 5) if self.rng.random() < 0.5 else f"<p>{self.words(2, 6)}</p>")
        elif role == "footer":
            inner = f"&copy; {self.word()}.com &middot; {self.words(2, 25)}" if self.rng.random() < 0.6 else f"<p>{self.words(2, 8)}</p>{self.links(2, 4)}"
        elif role == "side":
            inner = f"<h3>{self.words(1, 3)}</h3>" + (self.links() if self.rng.random() < 0.6 else f"<p>{self.words(3, 30)}</p>")
        elif role == "comments":
            one = lambda: f'<div{self.attr("comments")}><b>{self.word()}</b><p>{self.words(3, 60)}</p></div>' if self.rng.random() < 0.7 else f"<li><p>{self.words(3, 40)}</p></li>"
            inner = f"<h2>{self.words(1, 2)}</h2>" + "".join(one() for _ in range(self.rng.randint(1, 6)))
            inner += f"<form><textarea>{self.words(0, 3)}</textarea><button>{self.word()}</button></form>" if self.rng.random() < 0.5 else ""
        elif role == "ad":
            inner = self.words(2, 25) if self.rng.random() < 0.6 else f'<a href="/{self.word()}">{self.words(2, 8)}</a>'
        else:
            inner = f"<p>{self.words(4, 30)}</p>" + (f"<button>{self.word()}</button>" if self.rng.random() < 0.5 else "")
        return f'<{tag}{attr} data-y="0">{inner}</{tag}>'

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.06:
            return f'<html><body data-y="1">{"".join(self.block() for _ in range(r.randint(1, 6)))}</body></html>'
        above = [x for x in ("notice", "header", "nav", "ad", "side") if r.random() < 0.55]
        below = [x for x in ("comments", "side", "ad", "footer", "notice") if r.random() < 0.5]
        r.shuffle(above)
        inner = "".join(map(self.around, above)) + self.article() + "".join(map(self.around, below))
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = f"<div{self.attr('wrap')}>{inner}</div>" if r.random() < 0.8 else f"<div>{inner}</div>"
        head = f"<head><title>{self.words(2, 9)}</title><style>p{{}}</style><script>var t=1;</script></head>" if r.random() < 0.8 else ""
        return f'<!DOCTYPE html><html data-y="0">{head}<body>{inner}' + ("</body></html>" if r.random() < 0.8 else "")


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(n)]
