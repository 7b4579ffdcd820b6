"""Labelled pages for the block field: layouts of sites, each block marked as article text or not.

Pages are put together from the parts that sites are made of, with semantic tags
or plain ones, telling class names or none, broken or sound markup.  The number
of pages is a parameter; the seed fixes them."""

from __future__ import annotations

import random

#: Words to fill the blocks with; length and punctuation matter, the words do not.
_WORDS = "the river council report season market train winter library garden music letter engine harbour village school doctor island painter bridge".split()
_MENU = ["Home", "News", "About", "Contact", "Sports", "Archive", "Login", "Help", "Shop", "Blog"]


def _sentence(r: random.Random, lo: int = 5, hi: int = 22) -> str:
    n = r.randint(lo, hi)
    return (" ".join(r.choice(_WORDS) for _ in range(n)).capitalize()) + r.choice([".", ".", ".", ",", "?", "!"][: r.randint(1, 6)])


def _prose(r: random.Random) -> str:
    return " ".join(_sentence(r, 1) for _ in range(r.choice([1, 1, 2, 3, 5, 9])))


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.parts, self.labels = r, [], []

    def put(self, raw: str) -> None:
        self.parts.append(raw)

    def text(self, tag: str, text: str, good: bool, close: bool = True, attrs: str = "") -> None:
        self.parts.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if close else ""))
        self.labels.append(int(good))

    def open(self, tags: list[str], names: list[str]) -> str:
        """Opens an element that has a telling tag, a telling name, or both."""
        kind = self.r.random()
        tag = self.r.choice(tags) if tags and kind < 0.65 else self.r.choice(["div", "section", "div"])
        telling = tag in tags
        named = not telling or self.r.random() < 0.5
        name = self.r.choice(names)
        attr = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(["", "site-", "page ", "x-"])}{name}"' if named else ""
        self.parts.append(f"<{tag}{attr}>")
        return f"</{tag}>"

    def menu(self, n: int) -> None:
        r = self.r
        self.put("<ul>")
        for _ in range(n):
            label = r.choice(_MENU) if r.random() < 0.6 else r.choice(_WORDS)
            self.text("li", f'<a href="/{label}">{label}</a>', False)
        self.put("</ul>")

    def small(self, kinds: list[str]) -> None:
        """A part that is no article text."""
        r = self.r
        kind = r.choice(kinds)
        if kind == "nav":
            end = self.open(["nav"], ["menu", "navbar", "breadcrumb", "nav", "topbar", "pagination"])
            self.menu(r.randint(2, 8))
        elif kind == "header":
            end = self.open(["header"], ["header", "masthead", "branding", "logo"])
            self.text(r.choice(["div", "p", "h2"]), _sentence(r, 1, 6), False)
            if r.random() < 0.4:
                self.menu(3)
        elif kind == "footer":
            end = self.open(["footer"], ["footer", "colophon", "copyright", "legal"])
            self.text(r.choice(["p", "div", "span"]), "&copy; 2024 " + _prose(r), False)
            if r.random() < 0.4:
                self.menu(4)
        elif kind == "ad":
            end = self.open([], ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner"])
            self.text(r.choice(["p", "div", "span"]), _prose(r), False)
        elif kind == "notice":
            end = self.open([], ["cookie-banner", "notice", "consent", "alert", "popup", "modal", "gdpr"])
            self.text(r.choice(["p", "div"]), _prose(r), False)
            if r.random() < 0.5:
                self.text("button", "Accept", False)
        elif kind == "side":
            end = self.open(["aside"], ["sidebar", "widget", "related", "trending", "popular"])
            self.text(r.choice(["h3", "h2", "p"]), _sentence(r, 1, 4), False)
            for _ in range(r.randint(1, 4)):
                self.text(r.choice(["p", "li", "div"]), _prose(r) if r.random() < 0.5 else f'<a href="#">{_sentence(r, 3, 8)}</a>', False)
        elif kind == "form":
            end = self.open(["form"], ["newsletter", "search", "login", "subscribe", "signup-form"])
            self.text(r.choice(["label", "p"]), _sentence(r, 1, 12), False)
            self.put('<input type="text">')
            self.text("button", "Go", False)
        else:
            end = self.open([], ["comments", "comment-list", "discussion", "replies", "responses", "reader-comments"])
            if r.random() < 0.5:
                self.text("h3", "Comments", False)
            for _ in range(r.randint(1, 5)):
                inner = r.choice(["div", "li", "article", "div"])
                self.put(f'<{inner} class="{r.choice(["comment", "reply", "c", "item"])}">')
                self.text("p", _prose(r), False)
                self.put(f"</{inner}>")
        self.put(end)

    def article(self) -> None:
        r = self.r
        end = self.open(["article", "main"], ["content", "post", "entry-content", "story", "article-body", "main-text"])
        wrapped = r.random() < 0.3
        if wrapped:
            self.put("<div>")
        if r.random() < 0.9:
            head = r.random() < 0.15
            self.text(r.choice(["h1", "h1", "h2"]), _sentence(r, 1, 12), True, attrs=r.choice(["", "", ' class="title"', ' class="entry-title"']) if not head else "")
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            kind = r.random()
            if kind < 0.7:
                t = _prose(r)
                if r.random() < 0.15:
                    t = f"<b>{t}" + r.choice(["<br>", "</b>", ""])
                elif r.random() < 0.2:
                    t += f' <a href="#">{_sentence(r, 1, 5)}</a> {r.choice(_WORDS)}.'
                self.text("p", t, True, close=r.random() < 0.8)
            elif kind < 0.72:
                # A line that sounds like a footer is article text where the article has it.
                self.text("p", r.choice(["All rights reserved.", "Subscribe to our newsletter.", "&copy; 2024 " + _sentence(r, 1, 4)]), True)
            elif kind < 0.78:
                self.text(r.choice(["h2", "h3"]), _sentence(r, 1, 7), True)
            elif kind < 0.84:
                self.put("<ul>")
                for _ in range(r.randint(1, 4)):
                    self.text("li", _sentence(r, 1, 12), True)
                self.put("</ul>")
            elif kind < 0.88:
                self.text(r.choice(["blockquote", "pre", "figcaption", "td"]), _prose(r), True)
            else:
                self.small(["ad", "side", "form", "ad"])
        if wrapped:
            self.put("</div>")
        if r.random() < 0.15:
            self.small(["comment", "side", "form"])
        self.put(end)

    def links(self) -> None:
        """A menu that only its links tell."""
        r = self.r
        if r.random() < 0.5:
            self.menu(r.randint(2, 6))
        else:
            self.text(r.choice(["div", "p", "td"]), " ".join(f'<a href="/{k}">{r.choice(_MENU)}</a>' for k in range(r.randint(1, 6))), False)

    def plain(self) -> None:
        """An article that neither tag nor name tells: in a nameless element, a table cell or a cell for each paragraph."""
        r = self.r
        kind = r.choice(["div", "section", "none", "table", "nested", "cells"])
        attrs = r.choice(["", "", " id=page", ' class="col-2"', ' class="row x1"', ' style="a>b"'])
        begin, end = {
            "div": (f"<div{attrs}>", "</div>"), "section": (f"<section{attrs}><div>", "</div></section>"), "none": ("", ""),
            "table": (f"<table{attrs}><tr><td>", "</td></tr></table>"), "nested": ("<table><tr><td><table><tr><td>", "</td></tr></table></td></tr></table>"), "cells": (f"<table{attrs}>", "</table>"),
        }[kind]
        if r.random() < 0.7:
            self.put("<div>")
            self.links()
            self.put("</div>")
        if kind == "nested" and r.random() < 0.6:
            self.put("<table><tr><td>")
            self.links()
            begin, end = "</td><td><table><tr><td>", "</td></tr></table></td></tr></table>"
        self.put(begin)
        if kind != "cells" and r.random() < 0.6:
            self.text(r.choice(["h1", "h1", "h2", "h3"]), _sentence(r, 1, 10), True)
        tag = "td" if kind == "cells" else r.choice(["p", "p", "div"])
        for _ in range(r.choice([1, 2, 2, 4, 8])):
            if tag != "td" and r.random() < 0.1:
                self.put("<ul>")
                for _ in range(r.randint(1, 4)):
                    self.text("li", _sentence(r, 3, 14), True, close=r.random() < 0.7)
                self.put("</ul>")
            self.put("<tr>" if tag == "td" else "")
            self.text(tag, _prose(r), True, close=tag == "div" or r.random() < 0.8)
        self.put(end)
        for what in ("form", "foot", "links"):
            if r.random() < 0.4:
                if what == "form":
                    self.small(["form"])
                elif what == "links":
                    self.put("<div>")
                    self.links()
                    self.put("</div>")
                else:
                    self.text(r.choice(["div", "p"]), r.choice(["&copy; 2024 ", "Copyright &copy; "]) + r.choice(_WORDS) + r.choice(["", ". All rights reserved", ". All rights reserved."]), False)


#: One page in so many has an article without telling markup.
PLAIN = 3


def pages(n: int = 500, seed: int = 5) -> list[tuple[str, list[int]]]:
    """(html, label of each block in page order)"""
    out = []
    for k in range(n):
        r = random.Random(seed * 1_000_003 + k)
        p = _Page(r)
        p.put("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>")
        outer = r.random() < 0.4
        if outer:
            p.put('<div class="wrapper">')
        for kind in ("notice", "header", "nav", "ad"):
            if r.random() < 0.6:
                p.small([kind])
        if r.random() < 0.3:
            p.small(["side"])
        if k % PLAIN:
            p.article()
        else:
            p.plain()
        for kind in ("side", "comment", "form", "ad", "nav", "footer", "notice"):
            if r.random() < 0.45:
                p.small([kind])
        if outer:
            p.put("</div>")
        p.put("</body></html>")
        out.append(("".join(p.parts), p.labels))
    return out
