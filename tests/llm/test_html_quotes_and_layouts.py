"""Stray quotes lose no text and take linear time; articles that no tag or name tells."""

from __future__ import annotations

import time

import pytest

from tapeline.llm import extract, html_blocks

ONE = "Rain fell over the valley for three days, and the mill stopped. The council met on Friday to decide what to do next."
TWO = "Nobody had expected the river to rise so fast, said the keeper, who has lived there since 1970."
MENU = "<a href='/'>Home</a> <a href='/n'>News</a>"


def _texts(page):
    return [b.text for b in html_blocks.leaves(page)]


def test_a_quote_opens_a_value_after_an_equals_sign_only():
    assert _texts("<p title=it's>hello world one</p><p>we don't stop here</p><p>end</p>") == ["hello world one", "we don't stop here", "end"]
    assert _texts("<p 'x'>one</p><p a=\"1>2\" b = '3>4' c=5\"6>two</p>") == ["one", "two"]
    assert _texts("one < two <b and three") == ["one < two <b and three"]


@pytest.mark.parametrize("piece", ["<b '", '<b x="', "<b '>", "<b x='>'", "<p a=b=c=", "<", "<!--", "<script>"])
def test_a_hundred_thousand_stray_pieces(piece):
    begin = time.perf_counter()
    html_blocks.leaves(piece * 100_000)
    assert time.perf_counter() - begin < 2


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='top'>{MENU}</div><div id=page><div>{ONE}</div><div>{TWO}</div></div><div class=footer>&copy; 2024 All rights reserved</div></body>",
        f"<table><tr><td><table><tr><td><ul><li><a href=#>Home</a><li><a href=#>About</a></ul></td></tr></table></td><td><table><tr><td><p>{ONE}</p><p>{TWO}</p></td></tr></table></td></tr></table><div class='ads'>Buy now!</div>",
        f"<ul class=menu><li><a href=/>Home<li><a href=/a>Archive</ul><div class=story><p>{ONE}<p>{TWO}</div>",
        "<div data-state='{\"html\":\"<p>not text</p>\"}'><script>var x={\"a\":\"<p>no</p>\"}</script><nav><a href=#>Home</a></nav><div><p>" + ONE + "</p><p>" + TWO + "</p></div></div><form><label>Subscribe to our newsletter</label><button>Go</button></form>",
    ],
)
def test_layouts_that_were_not_trained_on(page):
    assert extract.main_texts(extract.trained(), [page]) == [f"{ONE} {TWO}"]
