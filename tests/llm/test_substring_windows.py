"""Removed words against every 50-word window that an earlier document holds, and repeats of short lines and sentences."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from tapeline.llm import substrings
from tapeline.session import as_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(r, n, stop=0):
    out = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(n)]
    return " ".join(w + "." if stop and (k + 1) % stop == 0 else w for k, w in enumerate(out))


def _removed(spark, texts):
    docs = as_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "windows_test")
    out = {}
    for r in substrings.repeated_units(docs).collect():
        out.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert " ".join(texts[r.doc_id][r.start : r.end].lower().split()) in " ".join(texts[r.first_doc_id][r.first_start :].lower().split())
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(docs).collect()}
    for k, text in enumerate(texts):
        assert kept[k] == "".join(c for i, c in enumerate(text) if i not in out.get(k, ()))
    return out


def _covered(text, gone):
    return [all(i in gone for i in range(*m.span())) for m in WORD.finditer(text)]


def test_pasted_passages(spark):
    r = random.Random(3)
    short_sentences, plain, two = _words(r, 60, 6), _words(r, 60), _words(r, 3, 3) + " " + _words(r, 6, 6)
    texts = [_words(r, 30, 10) + "\n" + short_sentences, _words(r, 25) + " " + plain + " " + _words(r, 25), _words(r, 9, 9) + " " + two + "\nAll rights reserved.\n" + _words(r, 20)]
    texts += [short_sentences + "\n" + _words(r, 30), _words(r, 40) + " " + plain.upper() + " " + _words(r, 9), _words(r, 15, 5) + " " + two + " " + _words(r, 15, 15) + "\nall rights  reserved."]
    gone = _removed(spark, texts)
    assert set(gone) == {3, 4, 5}
    assert _covered(texts[3], gone[3]) == [True] * 60 + [False] * 30
    assert _covered(texts[4], gone[4]) == [False] * 40 + [True] * 60 + [False] * 9
    assert _covered(texts[5], gone[5]) == [False] * 15 + [True] * 9 + [False] * 15 + [True] * 3


def test_a_periodic_text_keeps_its_first_window(spark):
    gone = _removed(spark, [" ".join(["to", "be"] * 100)])
    assert _covered(" ".join(["to", "be"] * 100), gone[0]) == [False] * 50 + [True] * 150


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_windows_of_earlier_documents(spark, size):
    docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    gone = {}
    for r in substrings.repeated_units(docs).collect():
        gone.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen, missed, found = set(), 0, 0
    for r in rows:
        spans = [m.span() for m in WORD.finditer(r.text or "")]
        words = [r.text[a:b].translate({c: c + 32 for c in range(65, 91)}) for a, b in spans]
        keys = [" ".join(words[k : k + 50]) for k in range(len(words) - 49)]
        inside = {i for k, w in enumerate(keys) if w in seen for i in range(k, k + 50)}
        hit = [all(c in gone.get(r.doc_id, ()) for c in range(*spans[i])) for i in inside]
        found += len(hit)
        missed += len(hit) - sum(hit)
        seen.update(keys)
    assert found and not missed


def test_smallest_digests_agree_with_enumeration():
    text = pa.array([_words(random.Random(k), n) for k, n in enumerate((49, 50, 51, 300))])
    data, offsets = substrings.flat(text)
    w = substrings.Words(data, offsets, substrings.NOT_SPACE)
    short, least, whole, _ = substrings._smallest(w)
    size = substrings.WIDTH - substrings.SHORT + 1
    assert [min(short[k : k + size]) for k in range(len(least))] == least.tolist()
    want = {k + int(short[k : k + size].argmin()) for k in range(len(least)) if whole[k]}
    assert sorted(short[sorted(want)].tolist()) == sorted(substrings._chosen(text).view("uint64").tolist())
