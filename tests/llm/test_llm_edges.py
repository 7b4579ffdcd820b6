"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tapeline.llm import bpe, classify, decontam, extract, lm, pii, quality, secrets, simhash, substrings
from tapeline.session import as_table

LINE = "the old river ran past nine quiet mills and turned north again."
CLASH = ["row", "_row", "fp", "h", "n_words", "kept", "spans", "start", "label", "block", "score", "_id", "_text", "no_id", "body", "gone", "list"]


@pytest.fixture(scope="module")
def messy(spark):
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [
        (1, LINE + "\n" + LINE),
        (1, LINE + "\n" + LINE),
        (2, None),
        (None, None),
        (None, "pass token = \"0123456789abcdef0123456789abcdef01234567\" to a@b.co. " + LINE),
        (3, ""),
        (4, " \n\t "),
        (5, long),
        (6, "x" * 50_000),
        (7, "Ünïcode 　 漢字 'tis we'll 🙂\r\n" + LINE),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    return as_table(df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}), "messy")


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, LINE), (1, LINE), (2, None), (None, "north again"), (3, ""), (4, "quiet mills")]
    return as_table(spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1)), "bench")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2) for k in range(1, 8)] + [(None, 1), (2, None), (3, 5), (1, 1)]
    return as_table(spark.createDataFrame(rows, "doc_id long, quality int"), "labels")


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.fit(spark)


def _empty(df):
    return as_table(df.where("false"), "none")


PER_ROW = {
    "rules": lambda d, b, q: quality.quality_rules(d),
    "overlap": lambda d, b, q: decontam.contamination(d, b),
    "pii": lambda d, b, q: pii.find(d),
    "bpe": lambda d, b, q: bpe.encode_digests(d),
    "tokens": lambda d, b, q: bpe.encode(d, keep=("doc_id", "lang")),
    "classify": lambda d, b, q: classify.quality(d, q),
    "simhash": lambda d, b, q: simhash.near_duplicates(d),
    "lm": lambda d, b, q: lm.score_texts(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(name, messy, bench, labels):
    ids = sorted([str(r[0]) for r in PER_ROW[name](messy, bench, labels).select("doc_id").collect()])
    assert ids == sorted(str(r[0]) for r in messy.select("doc_id").collect())
    assert PER_ROW[name](_empty(messy), _empty(bench), _empty(labels)).count() == 0


def test_without_side_tables(messy, bench, labels):
    assert decontam.contamination(messy, _empty(bench)).where("contaminated OR n_hit > 0").count() == 0
    assert decontam.decontaminate(messy, _empty(bench)).count() == messy.count()
    assert {r.score for r in classify.quality(messy, _empty(labels)).collect()} == {0.5}


def test_stages_keep_the_columns(messy, bench, forest):
    for out in (quality.clean(messy), simhash.keep_first(messy), decontam.decontaminate(messy, bench), secrets.redact(messy, model=forest)):
        assert out.columns == messy.columns
        out.count()
    for out in (simhash.keep_first(_empty(messy)), decontam.decontaminate(_empty(messy), bench), secrets.redact(_empty(messy), model=forest), quality.clean(_empty(messy))):
        assert out.columns == messy.columns and out.count() == 0


def test_defined_results(messy, bench, forest):
    rules = {r.doc_id: r for r in quality.quality_rules(messy.where("doc_id IS NOT NULL")).collect()}
    assert rules[2].n_words == 0 and rules[2].base_failed and not rules[2].kept
    assert rules[1].n_words == 24 and rules[1].n_dup_lines == 1 and rules[1].n_repeat_words == 24
    hit = {r.doc_id: r for r in decontam.contamination(messy.where("doc_id IS NOT NULL"), bench).collect()}
    assert (hit[1].n_hit, hit[1].n_items, hit[1].contaminated) == (24, 2, True)
    assert (hit[5].n_words, hit[5].n_hit) == (60_000, 0)
    groups = {str(r.doc_id): r.component_id for r in simhash.near_duplicates(messy).collect()}
    assert groups["2"] == groups["3"] == groups["4"] == 2
    kept = simhash.keep_first(messy).where("doc_id = 1").count()
    assert kept == 1
    gone = secrets.scan(messy, model=forest).collect()
    assert [(r.doc_id, r.end - r.start) for r in gone] == [(None, 40)]
    assert secrets.redact(messy, model=forest).where("text LIKE '%token = \"[SECRET]\" to%'").count() == 1
    units = substrings.repeated_units(messy).collect()
    # The line at five later places, and the two-line paragraph of the second of the equal rows.
    assert sorted(r.n_words for r in units) == [12] * 5 + [24] and {r.first_doc_id for r in units} == {1}
    assert substrings.repeated_units(_empty(messy)).count() == 0
    assert substrings.remove_repeats(messy).count() == messy.count()


def test_pages(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (2, None, "", 1), (None, "u", "no markup at all", 1), (3, "u", "<p>open <b>never closed &amp; &lt;x <div class='ad'>buy</div>", 1)]
    page = as_table(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), "pages")
    got = extract.extract(page).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert extract.extract(_empty(page)).count() == 0
