"""Line-first cleaning of documents.

Each line is judged on its own; failing lines go, and a document that loses more
than half of its word characters, or fails the base rules, is rejected.

Line rules (only lines with a word are judged):

* punctuation: up to ``SHORT`` words and no closing punctuation (menu entries, headings);
* navigation: three or more separators (pipes, bullets, arrows);
* boilerplate: a fixed phrase of notices and sign-up prompts;
* shouting: three or more words, capital letters and no small one;
* clutter: symbols ``#*$%&|<>`` make up a tenth of the word characters or more.

Base rules: fewer than 20 words, or more than 30 % of the words in repeated
8-word windows.  Null text counts as empty (no words: base_failed).  Rows are
independent: ties, repeated rows and other columns do not matter, an empty table
gives an empty result, and no text is cut.  One pass over the scan, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import LEADS, NOT_SPACE, Lines, Words, chunks, flat, offsets_of, range_sums, repeated_cover, strings

SHORT = 10
WINDOW = 8
CLOSED = r"""[.!?:;"')\]}…。！？»”][\s]*$"""
NAVIGATION = r"(?:[|»•›→].*){3}"
SHOUTING = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"
#: Phrases of boilerplate lines.
BOILERPLATE = (
    r"(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept cookies|"
    r"enable javascript|sign up for our|subscribe to our|click here|read more|share this|log ?in to|powered by|lorem ipsum"
)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """Per row: the counts of the contract, and the cleaned text."""
    data, offsets = flat(text)
    w, lines = Words(data, offsets, NOT_SPACE), Lines(data, offsets)
    ids, _ = w.ids()
    head, tail = np.searchsorted(w.starts, lines.starts), np.searchsorted(w.starts, lines.ends)
    n_words = tail - head
    chars = range_sums(w.inside & LEADS[data], lines.starts, lines.ends)
    symbols = range_sums(_SYMBOL[data], lines.starts, lines.ends)
    texts = lines.array()
    found = lambda pattern: np.asarray(pc.match_substring_regex(texts, pattern), bool)
    real = n_words > 0
    bad = real & (
        ((n_words <= SHORT) & ~found(CLOSED)) | found(NAVIGATION) | found(BOILERPLATE) | ((n_words >= 3) & found(SHOUTING)) | (10 * symbols >= chars)
    )

    codes = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[real]
    pairs = np.unique(lines.row_of[real] * (len(texts) + 1) + codes) // (len(texts) + 1)
    rows = len(offsets) - 1
    by_row = lambda x: np.bincount(lines.row_of, weights=x, minlength=rows).astype(np.int64)
    out = {"n_words": w.counts.astype(np.int64), "word_chars": by_row(chars), "n_symbols": by_row(symbols)}
    out["n_dup_lines"] = by_row(real) - np.bincount(pairs, minlength=rows)
    out["n_repeat_words"] = range_sums(repeated_cover(ids, w.row_of, WINDOW), w.rows[:-1], w.rows[1:])
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    out["n_bad_lines"], out["lost_chars"] = by_row(bad), by_row(np.where(bad, chars, 0))
    out["kept"] = ~out["base_failed"] & (2 * out["lost_chars"] <= out["word_chars"])

    good = ~bad
    spans = np.where(good, lines.ends - lines.starts, 0)
    first = np.zeros(len(good), bool)
    seen = range_sums(good, lines.rows[:-1][lines.row_of], np.arange(len(good)))
    first[good] = seen[good] == 0
    # A kept line takes the newline before it along, unless it is the first kept line of its row.
    lead = good & ~first
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, lines.starts[good] - lead[good], 1)
    np.add.at(edge, lines.ends[good], -1)
    cleaned = data[np.cumsum(edge)[: len(data)] > 0]
    lengths = np.bincount(lines.row_of, weights=spans + lead, minlength=rows).astype(np.int64)
    out["text"] = strings(cleaned, offsets_of(lengths), pa.large_string())
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_chars"]
FLAGS = ["base_failed", "kept"]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts, ``base_failed`` and ``kept``."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField(c, T.BooleanType()) for c in FLAGS]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            m = measure(part.column(text_col))
            yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(m[c]) for c in COUNTS + FLAGS)], [id_col, *COUNTS, *FLAGS])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The kept documents with their failing lines removed; the columns stay.

    ``chars_col``, where the table has it, is counted anew."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            m = measure(part.column(text_col))
            at = part.schema.get_field_index(text_col)
            part = part.set_column(at, part.schema.field(at), m["text"].cast(part.column(at).type))
            if chars_col in part.schema.names:
                k = part.schema.get_field_index(chars_col)
                part = part.set_column(k, part.schema.field(k), pc.utf8_length(part.column(at)).cast(part.column(k).type))
            yield part.filter(pa.array(m["kept"]))

    return docs.mapInArrow(run, schema)


_SQL_BAD = r"""
    nw > 0 AND ((nw <= 10 AND NOT regexp_matches(line, '[.!?:;"'')\]}…。！？»”][\s]*$')) OR regexp_matches(line, '(?:[|»•›→].*){3}')
     OR regexp_matches(line, '(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept cookies|enable javascript|sign up for our|subscribe to our|click here|read more|share this|log ?in to|powered by|lorem ipsum')
     OR (nw >= 3 AND regexp_matches(line, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$')) OR 10 * syms >= chars)
"""

#: Common table expressions over ``docs(r, t)``: ``judged`` has every count by r, ``lines`` every line with its verdict.
SQL_STEPS = rf"""
words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs),
grams AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM words)),
repeats AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cover AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM repeats) GROUP BY r),
cut AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM docs),
sized AS (SELECT r, k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
                 len(regexp_extract_all(line, '[#*$%&|<>]')) AS syms FROM cut),
lines AS (SELECT *, {_SQL_BAD} AS bad FROM sized),
counted AS (SELECT r, sum(nw)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, sum(syms)::BIGINT AS n_symbols,
                   count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS n_dup_lines,
                   count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(chars) FILTER (bad), 0)::BIGINT AS lost_chars FROM lines GROUP BY r),
based AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed FROM counted c LEFT JOIN cover USING (r)),
judged AS (SELECT *, NOT base_failed AND 2 * lost_chars <= word_chars AS kept FROM based)
"""

SQL = f"""
WITH ids AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), docs AS (SELECT r, t FROM ids), {SQL_STEPS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, lost_chars, base_failed, kept FROM judged JOIN ids USING (r)
"""
