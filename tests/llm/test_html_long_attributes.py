"""Attributes and blocks of any length."""

from __future__ import annotations

import pytest

from tapeline.llm import extract, html_blocks
from tapeline.llm.html_blocks import Leaf


@pytest.mark.parametrize("quote", ["'", '"'])
@pytest.mark.parametrize("size", [100, 8000, 9000, 1_000_000])
def test_a_quoted_value_ends_at_its_quote(quote, size):
    page = f"<p>before</p><div data-x={quote}{'j' * size}<b>x</b> junk text{quote}><p>after</p></div>"
    assert [b.text for b in html_blocks.leaves(page)] == ["before", "after"]


def test_a_quote_that_never_closes_ends_at_the_next_bracket():
    assert [b.text for b in html_blocks.leaves('<p>a</p><p title="x>b</p><p>c</p>')] == ["a", "b", "c"]


@pytest.mark.parametrize("cue", ["all rights reserved", "subscribe"])
def test_cues_far_into_a_block(cue):
    far, none = (extract._features(Leaf("word " * 100 + end, 0, "p", ("p",), ())) for end in (cue, "other"))
    near = extract._features(Leaf(cue + " word" * 100, 0, "p", ("p",), ()))
    changed = [k for k, (a, b) in enumerate(zip(far, none, strict=True)) if a != b]
    assert changed and all(far[k] == near[k] for k in changed)
