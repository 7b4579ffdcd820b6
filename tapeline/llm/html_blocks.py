"""Leaf text blocks of a page with what surrounds them, read leniently in one pass."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# What begins a token; the end of a tag is found apart, as it needs to know which quotes close.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)", re.S)
# A quote opens a value only right after "="; elsewhere it is a character like any other.
_ATTRS = re.compile(r"[^>=]*+(?:(?P<close>>)|=\s*+(?P<quote>[\"'])?)")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}

VOID = frozenset("br img input hr meta link area base col embed source track wbr param".split())
HIDDEN = frozenset("head title noscript template svg iframe object textarea select canvas audio video math".split())
BLOCKS = frozenset(
    "p div section article main aside header footer nav ul ol li table tr td th thead tbody h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption "
    "form fieldset dl dt dd hr address details summary button label option body html center caption legend".split()
)
#: Closed by the start of another of the same group.
_ALONE = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_CLOSES_P = BLOCKS - {"body", "html", "button", "label", "option", "legend", "caption"}

ROLES = ["none", "content", "ad", "nav", "header", "footer", "side", "notice", "form", "comment"]
_BY_TAG = {
    "article": "content", "main": "content", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "side",
    "form": "form", "fieldset": "form", "button": "form", "label": "form", "dialog": "notice", "ins": "ad",
}
#: Names that tell what an element is for.
_BY_NAME = {
    "ad": "ad ads adv advert advertisement adslot sponsor sponsored promo promotion banner dfp outbrain taboola",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topbar skip sitemap",
    "header": "header masthead logo branding tagline",
    "footer": "footer foot copyright colophon legal imprint contentinfo",
    "side": "sidebar side aside widget related recommended trending popular teaser complementary readmore",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog toast paywall",
    "form": "form subscribe newsletter signup login search share social follow",
    "comment": "comment comments commentlist discussion reply replies respond responses disqus feedback",
    "content": "content article post entry story main body text prose blog",
}
_ROLE_OF = {word: role for role, words in _BY_NAME.items() for word in words.split()}
_RANK = {r: k for k, r in enumerate(["ad", "notice", "comment", "nav", "form", "side", "footer", "header", "content"])}


def role_of(tag: str, attrs: str) -> str:
    """What an element is for, by its class, id and role, else by its tag; names of side matter win over those of content."""
    if tag in ("html", "body"):
        return "none"
    found = None
    for m in _NAMED.finditer(attrs) if "=" in attrs else ():
        for piece in _PIECES.findall(m.group(1) or m.group(2) or m.group(3) or ""):
            r = _ROLE_OF.get(piece.lower())
            if r and (found is None or _RANK[r] < _RANK[found]):
                found = r
    own = _BY_TAG.get(tag)
    if found == "header" and tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        found = None
    if found and (own is None or own == "content" or found != "content"):
        return found
    return own or "none"


@dataclass
class Leaf:
    text: str
    #: Characters that stand inside links.
    linked: int
    #: Innermost block tag, tags and roles from the outside in.
    tag: str
    tags: tuple[str, ...]
    roles: tuple[str, ...]


class _Tags:
    """Ends of tags; a quote that no other one follows is remembered, so a page of stray quotes is read once.

    Where values close but the bracket behind them is missing, the search was in vain; after a few pages' worth of
    such searches quotes are not trusted any more."""

    def __init__(self, page: str):
        self.page, self.none = page, {"'": len(page), '"': len(page), ">": len(page)}
        self.vain = 4 * len(page)

    def find(self, mark: str, at: int) -> int:
        if at >= self.none[mark]:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.none[mark] = at
        return found

    def end(self, at: int) -> int:
        """Where the bracket stands that closes a tag whose attributes begin at ``at``; -1 if none does."""
        first, begin = self.find(">", at), at
        if first < 0 or self.vain < 0:
            return first
        while (m := _ATTRS.match(self.page, at)) and not m["close"]:
            at = m.end()
            if m["quote"]:
                to = self.find(m["quote"], at)
                # A value whose quote never closes ends the tag at the first bracket.
                if to < 0:
                    break
                at = to + 1
        if m and m["close"]:
            return m.start("close")
        self.vain -= at - begin
        return first


def leaves(page: str) -> list[Leaf]:
    """Blocks with text in page order: references decoded, white space turned into one blank, trimmed."""
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = hidden = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tags = tuple(t for t, _ in stack)
                block = next((t for t in reversed(tags) if t in BLOCKS), "")
                out.append(Leaf(text, min(linked, len(text)), block, tags, tuple(r for _, r in stack if r != "none")))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal hidden, links
        while len(stack) > depth:
            tag = stack.pop()[0]
            hidden -= tag in HIDDEN
            links -= tag == "a"

    at, size, tags = 0, len(page), _Tags(page)
    while at < size:
        m = _TOKEN.search(page, at)
        close = tags.end(m.end()) if m and m["tag"] else 0
        if m is None or close < 0:
            # Nothing, or a tag that no bracket ends: the rest is text.
            if not hidden:
                parts.append(page[at:])
            break
        if m.start() > at and not hidden:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) if links else 0
        tag = (m["tag"] or "").lower()
        at = close + 1 if tag else m.end()
        if not tag:
            continue
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag in BLOCKS or tag in HIDDEN:
                        flush()
                    pop_to(depth)
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br" or tag == "hr":
            if tag == "hr":
                flush()
            elif not hidden:
                parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            flush()
            if tag == "body":
                pop_to(0)
            else:
                closes = _ALONE.get(tag, ()) + (("p",) if tag in _CLOSES_P else ())
                stop = ("ul", "ol", "table", "dl", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "body", "blockquote")
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in closes:
                        pop_to(depth)
                        break
                    if stack[depth][0] in stop:
                        break
        elif tag in HIDDEN:
            flush()
        attrs = page[m.end() : close]
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        stack.append((tag, role_of(tag, attrs)))
        hidden += tag in HIDDEN
        links += tag == "a"
    flush()
    return out
