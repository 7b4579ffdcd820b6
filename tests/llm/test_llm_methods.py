"""Each operator against SQL, a brute-force version, an exact round trip or held-out rows."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash

from tapeline.llm import bpe, classify, components, crf, extract, html_blocks, html_labelled, lm, pii, quality, registry, secrets, simhash, substrings, words
from tapeline.session import as_table

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.mark.parametrize("name", [n for n, q in registry.QUERIES.items() if q.sql])
def test_sql(spark, name):
    from oracle import compare, connect

    ok, why = compare(registry.QUERIES[name].run(spark, SMALL), connect(SMALL), registry.QUERIES[name].sql)
    assert ok, why


def test_line_rules_one_by_one():
    menu, nav, shout = "Home", "a b c d e f g h i j k | l | m | n.", "THIS IS ALL CAPS AND LONG ENOUGH FOR IT TO BE JUDGED SO."
    clutter, notice, prose = "a%%% b%%% c.", "All rights reserved by the owners of it and of all other things here.", "The river ran on past the mill and the old bridge stood in the rain."
    m = quality.measure(pa.array(["\n".join([menu, prose, nav, prose + " More.", shout, clutter, notice, prose + " Again."])]))
    assert m["n_bad_lines"][0] == 5
    assert m["text"].to_pylist() == ["\n".join([prose, prose + " More.", prose + " Again."])]


def test_repeated_cover():
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.randrange(0, 12) for _ in range(4)]
        row, ids = np.repeat(np.arange(4), sizes), np.array([r.randrange(2) for _ in range(sum(sizes))], np.int32)
        want, at = [], 0
        for n in sizes:
            own = ids[at : at + n].tolist()
            seen = Counter(tuple(own[i : i + 3]) for i in range(n - 2))
            hot = {i + k for i in range(n - 2) if seen[tuple(own[i : i + 3])] > 1 for k in range(3)}
            want += [i in hot for i in range(n)]
            at += n
        assert words.repeated_cover(ids, row, 3).tolist() == want


def _fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    r = random.Random(2)
    texts = ["", None, "a", "A b", "One two\tthree", "x" * 700 + " y z w", "é è ñ  ü ö"] + [" ".join("q" * r.randrange(1, 30) for _ in range(n)) for n in range(1, 30)]
    assert [int(x) for x in simhash.fingerprint(pa.array(texts)).view(np.uint64)] == [_fingerprint(t) for t in texts]


def _classes(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[find(a)] = find(b)
    return {frozenset(i for i in range(n) if find(i) == r) for r in map(find, range(n))}


@pytest.mark.parametrize("small,blocks", [(32, 8192), (2, 8192), (2, 4)])
def test_lists_by_lags_blocks_and_lookup(monkeypatch, small, blocks):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "BLOCKS", blocks)
    r, values, places = random.Random(3), set(), (3, 4, 5, 6, 7)
    for _ in range(5):
        x = r.getrandbits(64)
        for _ in range(12):
            values.add(x)
            for _ in range(3):
                x ^= 1 << r.randrange(24)
    fp = np.array(sorted(values), np.uint64)
    key = np.array([(simhash.CHOICES.index(places) << 40) | sum(((int(f) >> (8 * b)) & 255) << (8 * (4 - i)) for i, b in enumerate(places)) for f in fp])
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    a, b = simhash._list_links(key, fp)
    at = {int(f): i for i, f in enumerate(fp)}
    near = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if key[i] == key[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 3]
    assert _classes(len(fp), [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]) == _classes(len(fp), near)
    assert len(a) < len(fp)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (-5, 159)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == -5 for k in range(100, 160)) and len(got) == 102
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicate_groups(spark, rows):
    got = registry.QUERIES["op8_simhash_dedup"].run(spark, SMALL).collect()
    prints = {r.doc_id: _fingerprint(r.text) for r in rows}
    ids = sorted(prints)
    near = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 3]
    low = {ids[i]: ids[min(c)] for c in _classes(len(ids), near) for i in c}
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], low[i]) for i in ids}


def test_pretokens():
    r = random.Random(4)
    parts = ["'", " ", "\n", "\t", "s", "t", "r", "e", "v", "l", "m", "d", "a", "1", "٣", "é", "漢", "　", "!", "🙂", "\r\n", "S", "\x1c", "'s", "'ll", "'re", " '"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(20_000)]
    tokens, counts = bpe.pretokens(*words.flat(pa.array(texts)))
    tokens, at = [t.decode() for t in tokens.to_pylist()], 0
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text, n in zip(texts, counts):
        assert tokens[at : at + n] == pattern.findall(text)
        at += n


def test_bpe_round_trip(spark, docs, rows):
    encode = bpe._encoding(bpe.default_path()).encode_ordinary
    ids = {r.doc_id: encode(r.text or "") for r in rows}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {r.doc_id: (len(ids[r.doc_id]), sha(" ".join(map(str, ids[r.doc_id]))), sha(r.text or "")) for r in rows}
    assert {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op5_byte_bpe"].run(spark, SMALL).collect()} == want
    back = bpe.decode(bpe.encode(docs)).collect()
    assert {r.doc_id: (r.ids, r.text) for r in back} == {r.doc_id: (ids[r.doc_id], r.text) for r in rows}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_personal_data(spark, rows):
    r = random.Random(5)
    for _ in range(40_000):
        chars = r.choice(["0123.@a+-", "1.@ +-( )b", "4 -0", "ab@.-c", "+1 ().-9"])
        text = "".join(r.choice(chars) for _ in range(r.randrange(26)))
        assert [s for s in pii.spans(text) if s[2] in BASE] == _base(text), text
    got = {x.doc_id: x for x in registry.QUERIES["op3_pii"].run(spark, SMALL).collect()}
    for x in rows:
        base = _base(x.text or "")
        assert got[x.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert [got[x.doc_id][f"n_{k}"] for k in BASE] == [sum(b[2] == k for b in base) for k in BASE]


def test_added_personal_data():
    found = {k: (s, e) for s, e, k in pii.spans("IBAN: DE89 3704 0044 0532 0130 00, ssn 078-05-1120, http://bob:pw@x.org, tel:+12125550100")}
    assert set(found) == {"iban", "ssn", "login", "email", "handle", "phone"}
    assert not [s for s in pii.spans("IBAN DE89 3704 0044 0532 0130 01 ssn 000-05-1120 http://x.org/a") if s[2] not in BASE]


def test_field_against_enumeration():
    rng = np.random.default_rng(0)
    model = crf.Crf(rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    slots, at = rng.integers(0, 6, (9, 2)), np.array([0, 3, 3, 4, 9])
    marginal, path, emit = crf.marginals(model, slots, at), crf.viterbi(model, slots, at), model.emissions(slots)
    for a, b in zip(at[:-1], at[1:]):
        if a == b:
            continue
        score = {y: model.start[y[0]] + sum(emit[a + i, y[i]] for i in range(b - a)) + sum(model.steps[y[i - 1], y[i]] for i in range(1, b - a)) for y in itertools.product(range(3), repeat=b - a)}
        z = sum(map(math.exp, score.values()))
        want = [[sum(math.exp(s) for y, s in score.items() if y[i] == k) / z for k in range(3)] for i in range(b - a)]
        assert np.allclose(marginal[a:b], want)
        assert tuple(path[a:b]) == max(score, key=score.get)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["op6_quality_classifier"].run(spark, d).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.score, label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([p == y for _, y, p in held]) > 0.95


def test_line_features_do_not_depend_on_the_batch():
    texts = ["One line here.\nTwo | lines | there | now\n\nTHREE!!", None, "", "a b c d e f g h a b c d e f g h.", "One line here."]
    slots, at, _ = classify.line_slots(pa.array(texts))
    for k, t in enumerate(texts):
        alone, _, _ = classify.line_slots(pa.array([t]))
        assert (slots[at[k] : at[k + 1]] == alone).all()


def test_unigram_scores(spark, rows):
    tokens = {r.doc_id: WORD.findall((r.text or "").translate(LOWER)) + ["</>"] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n = sum(c.values())
    got = registry.QUERIES["op10_lm_scoring"].run(spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_class_model_is_normalised(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 60)
    table = lm.train(np.arange(50), np.arange(1.0, 51.0))
    assert np.allclose((10.0 ** table.astype(np.float64)).sum(2), 1, atol=1e-4)


def test_rare_trigrams_are_trained_on():
    k, cells, n = lm.CLASSES, np.arange(50), np.append(np.full(50, 1e9), 1e3)
    of = lambda context: lm.train(np.append(cells, context * k + 9), n)
    with_, without = of(5 * k + 7), of(6 * k + 8)
    assert with_[5, 7, 9] > without[5, 7, 9] and with_[6, 8, 9] < without[6, 8, 9]


def test_article_of_every_page(spark):
    got = registry.QUERIES["op4_html_extraction"].run(spark, SMALL).collect()
    page = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(got) == len(page)
    for r in got:
        body = re.search("<article>(.*?)</article>", page[r.page_id] or "", re.S)
        text = re.sub("<[^>]*>", lambda m: " " if re.match("</?(p|h1|br|div)", m.group()) else "", body.group(1)) if body else ""
        assert r.text == " ".join(html.unescape(text).split()) and r.n_chars == len(r.text)


def test_labelled_pages_that_were_not_trained_on():
    pages = html_labelled.pages(300, seed=77)
    blocks = [html_blocks.leaves(p) for p, _ in pages]
    assert [len(b) for b in blocks] == [len(y) for _, y in pages]
    slots, _at = extract.block_slots(blocks)
    got = crf.viterbi(extract.trained(), slots, _at)
    assert (got == np.concatenate([y for _, y in pages])).mean() > 0.99


def test_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    model = secrets.fit(spark)
    rest = model.transform(secrets.features(secrets.labelled_findings(spark).where("id >= 0").withColumn("left", secrets.F.concat(secrets.F.lit("so "), "left"))))
    assert rest.where("_guess <> label").count() <= 0.01 * rest.count()
    planted = re.compile(r'(AKIA[A-Z0-9]{16})|token = "([0-9a-f]{40})"|password=([0-9a-f]{18})')
    want = {(r.doc_id, m.start(m.lastindex), m.end(m.lastindex)) for r in rows for m in planted.finditer(r.text or "")}
    got = {(r.doc_id, r.start, r.end) for r in secrets.scan(docs, model=model).collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(want) + 1
    plan = secrets.scan(docs, model=model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    cut = {r.doc_id: r.text for r in secrets.redact(docs, model=model).collect()}
    for r in rows:
        text = r.text or ""
        for _, s, e in sorted((x for x in got if x[0] == r.doc_id), reverse=True):
            text = text[:s] + secrets.MARK + text[e:]
        assert (cut[r.doc_id] or "") == text


def _units(text):
    """First and last word of every unit but the windows, by its definition."""
    found = list(WORD.finditer(text))
    breaks = [text.count("\n", x.end(), y.start()) for x, y in zip(found, found[1:])] + [2]
    whole = [k for k, m in enumerate(found) if m.group()[-1] in ".!?" or breaks[k]]

    def pieces(ends):
        return list(zip([0, *[e + 1 for e in ends[:-1]]], ends)) if ends else []

    sentences, lines, paragraphs = (pieces(e) for e in (whole, [k for k, n in enumerate(breaks) if n], [k for k, n in enumerate(breaks) if n > 1]))
    out = {p for p in paragraphs if p not in lines} | {(a, b) for a, b in lines if b - a + 1 < substrings.MIN_WORDS}
    for k, (a, b) in enumerate(sentences):
        if b - a + 1 >= substrings.MIN_WORDS:
            out.add((a, b))
            continue
        ahead = [y for _, y in sentences[k:] if y - a + 1 >= substrings.MIN_WORDS]
        behind = [x for x, _ in sentences[: k + 1] if b - x + 1 >= substrings.MIN_WORDS]
        out |= {(a, y) for y in ahead[:1]} | {(x, b) for x in behind[-1:]}
    return [(found[a].start(), found[b].end(), b - a + 1, " ".join(m.group() for m in found[a : b + 1]).translate(LOWER)) for a, b in out]


def test_repeated_units(spark, docs, rows):
    """Every repeated sentence, run, line and paragraph; all other rows are passages of a window's width or more."""
    places = {}
    for r in rows:
        for start, end, n, key in _units(r.text or ""):
            places.setdefault(key, []).append((r.doc_id, start, end, n))
    want = set()
    for found in places.values():
        first = min(found)
        want |= {(*p, *first[:2]) for p in found if p != first and (p[0] != first[0] or first[2] <= p[1])}
    got = {tuple(r) for r in registry.QUERIES["op9_substring_dedup"].run(spark, SMALL).collect()}
    assert want and want <= got
    text = {r.doc_id: r.text for r in rows}
    for doc, start, end, n, first_doc, first_start in got - want:
        same = " ".join(WORD.findall(text[doc][start:end])).translate(LOWER)
        assert n >= substrings.WIDTH and len(WORD.findall(same)) == n
        assert " ".join(WORD.findall(text[first_doc][first_start:])[:n]).translate(LOWER) == same
    for r in substrings.remove_repeats(docs).collect():
        assert r.text == "".join(text[r.doc_id][p.start : p.end] for p in r.kept_spans)


def test_pipeline_against_its_parts(spark, docs, rows):
    """The stages' decisions by brute force, one after another."""
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    kept = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert set(kept) == {i for i, k in verdict.items() if k}
    prints = {i: _fingerprint(t) for i, t in kept.items()}
    ids = sorted(prints)
    near = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 3]
    first = {ids[min(c)] for c in _classes(len(ids), near)}

    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    items = [tokens(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = {tuple(w[s : s + 13]) for w in items if w for s in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}
    clean = set()
    for i in first:
        w = tokens(kept[i])
        hit = {s + k for n in sizes for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for k in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert set(got) == clean
    cut = {r.doc_id: r.text for r in secrets.redact(as_table(quality.clean(docs), "kept")).collect()}
    encode = bpe._encoding(bpe.default_path()).encode_ordinary
    assert all(got[i].ids == encode(cut[i]) and got[i].n_tokens == len(got[i].ids) for i in clean)
