"""Document quality from line labels.

A linear-chain conditional random field labels every line good or bad from
features of the line and of its neighbours; the forward-backward marginals of
"good", weighted by line length, average to the score of the document.  The
field is trained on a bounded sample of labelled documents (SAMPLE, lowest hash
of the id), each line taking its document's label.  Ids, labels, language and
source are no features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .tables import crc_mod
from .vocab import pack, unpack
from .words import LEADS, NOT_SPACE, Lines, Words, chunks, flat, range_sums, repeated_cover

#: Labelled documents to train on at most; one row in FOLDS is held out; score from which label 1 is predicted.
SAMPLE, FOLDS, THRESHOLD = 4000, 5, 0.3
WINDOW = 8

_B = np.arange(256)
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_LOWER = (_B >= 0x61) & (_B <= 0x7A)
_DIGIT = (_B >= 0x30) & (_B <= 0x39)
_MARK = np.isin(_B, np.frombuffer(b"#*$%&|<>@^~=+_\\{}[]", np.uint8))
_STOP = np.isin(_B, np.frombuffer(b".!?:;\"')", np.uint8))

_SHARES = np.array([0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.8])
_COUNTS = np.array([0, 1, 2, 4, 7, 11, 21, 41, 81])
_SIZES = np.array([1, 2.5, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9])
BINS = 12
OWN = ["words", "marks", "upper", "digits", "pipes", "bangs", "size", "stop", "twin", "distinct", "cover", "commas", "place", "beyond", "last"]
NEAR = ["words", "marks", "upper", "pipes", "twin", "cover"]
SLOTS = len(OWN) + 2 * len(NEAR)
N_FEATURES = SLOTS * BINS


def line_slots(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(active feature per line and slot, lines of each row, length of each line in code points).

    Lines without a word are passed over; a row without words has one empty line."""
    data, offsets = flat(text)
    w, lines = Words(data, offsets, NOT_SPACE), Lines(data, offsets)
    ids, _ = w.ids()
    head, tail = np.searchsorted(w.starts, lines.starts), np.searchsorted(w.starts, lines.ends)
    n = tail - head
    empty_row = w.counts == 0
    first = np.append(True, lines.row_of[1:] != lines.row_of[:-1]) if len(n) else np.zeros(0, bool)
    use = np.flatnonzero((n > 0) | (empty_row[lines.row_of] & first))
    n, head, tail, row = n[use], head[use], tail[use], lines.row_of[use]
    s, e = lines.starts[use], lines.ends[use]
    per = lambda table: range_sums(table[data] & w.inside, s, e)
    chars = range_sums(w.inside & LEADS[data], s, e)
    some = np.maximum(chars, 1)

    coded = lines.array().take(pa.array(use)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, at = np.unique(row * (len(use) + 1) + coded, return_index=True)
    twin = np.ones(len(use), np.int64)
    twin[at] = 0
    line_of = np.repeat(np.arange(len(use)), n)
    if len(ids):
        pairs = np.unique(line_of * (int(ids.max()) + 1) + ids) // (int(ids.max()) + 1)
        distinct = np.bincount(pairs, minlength=len(use)) / np.maximum(n, 1)
    else:
        distinct = np.zeros(len(use))
    cover = range_sums(repeated_cover(ids, w.row_of, WINDOW), head, tail) / np.maximum(n, 1)
    final = data[np.maximum(w.ends[np.maximum(tail, 1) - 1] - 1, 0)] if len(w.ends) else np.zeros(len(use), np.uint8)

    rows = np.searchsorted(row, np.arange(len(offsets)))
    size = np.diff(rows)
    place = np.arange(len(use)) - rows[:-1][row]
    share = lambda x: np.searchsorted(_SHARES, x, "left")
    bins = {
        "words": np.searchsorted(_COUNTS, n, "right"),
        "marks": share(per(_MARK) / some),
        "upper": share(per(_UPPER) / np.maximum(per(_UPPER | _LOWER), 1)),
        "digits": share(per(_DIGIT) / some),
        "pipes": np.searchsorted(_COUNTS, per(_B == 0x7C), "right"),
        "bangs": share(per(_B == 0x21) / some),
        "size": np.searchsorted(_SIZES, some / np.maximum(n, 1)),
        "stop": np.where(n > 0, 1 + _STOP[final], 0),
        "twin": twin,
        "distinct": np.minimum((distinct * 10).astype(np.int64), 10),
        "cover": share(cover),
        "commas": share(per(np.isin(_B, [0x2C, 0x2E])) / np.maximum(n, 1)),
        "place": np.minimum(place, 3) + 4 * (np.minimum(size[row], 3) - 1),
        "beyond": share(per(_B >= 0xC0) / some),
        "last": (place == size[row] - 1).astype(np.int64) + 2 * np.minimum(np.searchsorted([5, 15, 40], size[row]), 3),
    }
    out = np.empty((len(use), SLOTS), np.int64)
    for k, name in enumerate(OWN):
        out[:, k] = np.minimum(bins[name], BINS - 1)
    for j, step in enumerate((-1, 1)):
        other = np.clip(np.arange(len(use)) + step, 0, max(0, len(use) - 1))
        inside = row[other] == row if len(use) else np.zeros(0, bool)
        inside &= other != np.arange(len(use))
        for k, name in enumerate(NEAR):
            out[:, len(OWN) + j * len(NEAR) + k] = np.where(inside, np.minimum(bins[name][other], BINS - 2), BINS - 1)
    return out + np.arange(SLOTS) * BINS, rows, chars


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> crf.Crf:
    """The field from at most SAMPLE labelled training documents; only their line features reach the driver."""
    named = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_label")).where("_label IN (0, 1) AND _label_id IS NOT NULL")
    named = named.where(crc_mod("_label_id", FOLDS) != 0).groupBy("_label_id").agg(F.max("_label").alias("_label"))
    sample = named.orderBy(F.xxhash64("_label_id"), "_label_id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_id") == F.col("_label_id"))
    rows = rows.select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            slots, ends, _ = line_slots(part.column("_text"))
            packed = [pack(slots[a:b].ravel()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.string()), part.column("_label"), pa.array(packed, pa.binary())], ["id", "label", "slots"])

    got = rows.mapInArrow(run, "id string, label int, slots binary").distinct().orderBy("id", "slots").collect()
    parts = [unpack(bytes(r.slots))[0].reshape(-1, SLOTS) for r in got]
    sizes = np.array([len(p) for p in parts], np.int64)
    slots = np.concatenate(parts) if parts else np.zeros((0, SLOTS), np.int64)
    gold = np.repeat(np.array([r.label for r in got], np.int64), sizes)
    return crf.train(slots, gold, np.concatenate([[0], np.cumsum(sizes)]), N_FEATURES, 2)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (higher: label 1 likelier) and ``predicted``.

    Null text counts as empty; an empty text is one empty line, scored like any
    other.  Labels that are null or not 0 or 1 are not learned; of repeated ones
    the larger counts; a null id is held out.  Without labels every score is 0.5.
    Repeated rows are scored each, other columns are not read, texts are read
    whole.  One pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    own = docs.select(F.col(id_col).alias("_id"), (crc_mod(id_col, FOLDS) == 0).alias("_held"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_held", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            slots, rows, chars = line_slots(part.column("_text"))
            good = crf.marginals(model.value, slots, rows)[:, 1]
            of, weight = np.repeat(np.arange(len(rows) - 1), np.diff(rows)), np.maximum(chars, 1)
            total = np.bincount(of, weights=weight, minlength=part.num_rows)
            score = np.bincount(of, weights=weight * good, minlength=part.num_rows) / total
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_held"), pa.array(np.clip(score, 0.0, 1.0))], schema.names)

    out = own.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
