"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

Features are the ancestors' tags and roles, the block's text and its neighbours;
the field is trained on labelled pages (``html_labelled``) and decoded by
Viterbi.  Blocks labelled as article text are joined in page order."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import crf
from .html_blocks import ROLES, Leaf, leaves
from .html_labelled import pages as labelled_pages
from .words import offsets_of

#: Labelled pages that the field is trained on.
PAGES = 750
#: Pages decoded at once.
BATCH = 128

_TAGS = ["p", "h1", "h2", "h3", "h4", "li", "td", "th", "div", "section", "blockquote", "pre", "figcaption", "button", "label", "dd", "dt", "body", "article", "main"]
_TAG_AT = {t: k + 1 for k, t in enumerate(_TAGS)}
_ANCESTORS = ["article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "section", "figure"]
_ROLE_AT = {r: k for k, r in enumerate(ROLES)}
BINS = 24
SLOTS = 1 + 2 + len(_ANCESTORS) + 8 + 4
N_FEATURES = SLOTS * BINS


def _features(block: Leaf) -> list[int]:
    inner = _ROLE_AT[block.roles[-1]] if block.roles else 0
    # The innermost role of side matter inside the innermost content element, if there is one.
    side = 0
    for r in reversed(block.roles):
        if r == "content":
            break
        side = side or _ROLE_AT[r]
    else:
        side += len(ROLES)
    text = block.text
    n = text.count(" ") + 1
    size = min(n.bit_length(), 9)
    link = 0 if not block.linked else 1 + min(4, 5 * block.linked // len(text))
    tags = block.tags
    low = text.lower()
    return [
        _TAG_AT.get(block.tag, 0), inner, side,
        *(int(t in tags) for t in _ANCESTORS),
        size, link, int(text[-1] in ".!?:;\"')") + 2 * int(text[-1] == ","), min(text.count(","), 5), 2 if "\xa9" in text else int("all rights reserved" in low),
        int(any(w in low for w in ("cookie", "subscribe", "log in", "sign up", "newsletter", "click here"))), int(text.isupper()), int("comment" in block.roles),
    ]


def block_slots(blocks: list[list[Leaf]]) -> tuple[np.ndarray, np.ndarray]:
    """(active feature per block and slot, blocks of each page)"""
    rows = offsets_of(np.array([len(b) for b in blocks], np.int64))
    own = np.array([_features(b) for page in blocks for b in page], np.int64).reshape(rows[-1], SLOTS - 4)
    out = np.full((rows[-1], SLOTS), BINS - 1, np.int64)
    out[:, : SLOTS - 4] = own
    page = np.repeat(np.arange(len(blocks)), np.diff(rows))
    if len(own):
        follows = np.flatnonzero(page[1:] == page[:-1]) + 1
        out[follows, SLOTS - 4], out[follows, SLOTS - 3] = own[follows - 1, 1], own[follows - 1, 3 + len(_ANCESTORS)]
        out[follows - 1, SLOTS - 2], out[follows - 1, SLOTS - 1] = own[follows, 1], own[follows, 3 + len(_ANCESTORS)]
    return out + np.arange(SLOTS) * BINS, rows


@functools.cache
def trained(pages: int = PAGES) -> crf.Crf:
    blocks, labels = [], []
    for page, marks in labelled_pages(pages):
        found = leaves(page)
        if len(found) != len(marks):
            raise ValueError("a labelled page was cut into other blocks than it has labels for")
        blocks.append(found)
        labels += marks
    slots, rows = block_slots(blocks)
    return crf.train(slots, np.array(labels, np.int64), rows, N_FEATURES, 2, rounds=120, l2=3e-4)


def main_texts(model: crf.Crf, pages: list[str]) -> list[str]:
    blocks = [leaves(p) for p in pages]
    slots, rows = block_slots(blocks)
    good = crf.viterbi(model, slots, rows) == 1
    return [" ".join(b.text for b, g in zip(page, good[rows[k] : rows[k + 1]], strict=True) if g) for k, page in enumerate(blocks)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """One row per page: id, url, the article's text and ``n_chars``, its code points.

    Null, empty and block-less pages have the empty text.  Repeated rows are
    extracted each; other columns are not read; pages are read whole.  One pass,
    no shuffle; the field has a few thousand weights and is broadcast."""
    model = pages.sparkSession.sparkContext.broadcast(trained())
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = main_texts(model.value, [x or "" for x in part.column(html_col).to_pylist()])
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column(url_col), pa.array(texts, pa.string()), sizes], schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
