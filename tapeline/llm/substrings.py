"""Substring deduplication by hashing lines, paragraphs, sentences and windows of words.

Units are lines and paragraphs of any length, sentences (a line is cut once more
after words that end in ``.``, ``!`` or ``?``) of MIN_WORDS words and more, and,
for a shorter sentence, the shortest runs of sentences from it and up to it that
are long enough: a repeated run of whole sentences, and so a line of MIN_WORDS
words, is found by these wherever it is pasted.  A passage that keeps to no line or sentence end is met in a second pass, by its
windows of WIDTH words.  Equal windows have the same smallest digest of SHORT
words, so only windows whose smallest digest occurs twice can repeat; of these,
only those that two places hold with a word still there become units, as a window
that one place alone still holds is left once.

Before either pass stores a unit, its digests are counted over all documents and
the repeated ones fill a bitmap; what that lets through too much costs disk only.

Units are normalised (A-Z lower-cased, white space one blank) and hashed to 128
bits; digests are grouped over all documents and the earliest occurrence stays:
by document id (null last), then stored row, then place.  The others are removed
at their original offsets, save those that overlap the occurrence that stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import bitmap, bits_for, member
from .simhash import xxh64
from .tables import as_table, drop_table, fresh, with_row
from .words import LEADS, LOWER, NOT_SPACE, Words, chunks, flat, offsets_of

MIN_WORDS = 8
#: Words of a window, and of the digests inside it of which the smallest stands for it.
WIDTH, SHORT = 50, 26
SEEDS = (42, 4242)
#: Slots of a digest in a bitmap.
HASHES = 2

_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
#: An odd factor and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)

_FIELDS = ("start", "end", "n_words", "h1", "h2")


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """A digest of every ``width`` successive words from the words' digests."""
    n = len(h)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers(_BASE, n), out=sums[1:])
    out = (sums[width:] - sums[:-width]) * _powers(_BACK, n - width + 1)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of every ``width`` successive values."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = best(x[:-step], x[step:])
        size += step
    return x


def _smallest(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Digests of SHORT words; the smallest in each window; windows that lie in one row; digests of the words."""
    codes, distinct = w.ids()
    data, offsets = flat(distinct)
    h = [xxh64(data, offsets[:-1], np.diff(offsets), seed)[codes] for seed in SEEDS]
    short = _windows(h[0], SHORT)
    return short, _slide(short, WIDTH - SHORT + 1, np.minimum), w.row_of[: 1 - WIDTH] == w.row_of[WIDTH - 1 :], h


def _chosen(text: pa.Array) -> np.ndarray:
    """The digests of SHORT words that are the smallest of a window, once for each place."""
    data, offsets = flat(text)
    w = Words(LOWER[data], offsets, NOT_SPACE)
    if len(w.starts) < WIDTH:
        return np.zeros(0, np.int64)
    short, least, whole, _ = _smallest(w)
    edge = np.zeros(WIDTH - SHORT, np.uint64)
    most = _slide(np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), WIDTH - SHORT + 1, np.maximum)
    return short[most == short].view(np.int64)


def _spans(w: Words, data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every long enough sentence and run of sentences, shorter line and paragraph of several lines."""
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    gap = breaks[w.starts[1:]] - breaks[w.ends[:-1]]
    line, paragraph = last.copy(), last.copy()
    line[:-1] |= gap > 0
    paragraph[:-1] |= gap > 1
    begin = lambda b: np.append(0, b[:-1] + 1)
    b = np.flatnonzero(line | _STOP[data[w.ends - 1]])
    a = begin(b)
    short = np.flatnonzero(b - a + 1 < MIN_WORDS)
    to = np.searchsorted(b, a[short] + MIN_WORDS - 1)
    ahead = to < len(b)
    ahead[ahead] = w.row_of[b[to[ahead]]] == w.row_of[a[short[ahead]]]
    since = np.searchsorted(a, b[short] - MIN_WORDS + 1, "right") - 1
    behind = since >= 0
    behind[behind] = w.row_of[a[since[behind]]] == w.row_of[b[short[behind]]]
    long = b - a + 1 >= MIN_WORDS
    ends = [b[long], b[to[ahead]], b[short[behind]], np.flatnonzero(line), np.flatnonzero(paragraph)]
    firsts = [a[long], a[short[ahead]], a[since[behind]], begin(ends[3]), begin(ends[4])]
    # Of a longer line its sentences and runs leave nothing over; a paragraph of several lines may be wrapped anew.
    for k, use in ((3, ends[3] - firsts[3] + 1 < MIN_WORDS), (4, ~np.isin(firsts[4], firsts[3][np.isin(ends[3], ends[4])]))):
        ends[k], firsts[k] = ends[k][use], firsts[k][use]
    both = np.unique(np.concatenate(firsts) * len(w.starts) + np.concatenate(ends))
    return both // len(w.starts), both % len(w.starts)


def _placed(w: Words, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Row, start and end (code points) and number of words from first to last words."""
    points = offsets_of(LEADS[data])
    row = w.row_of[a]
    base = points[w.offsets[:-1]][row]
    return [row, points[w.starts[a]] - base, points[w.ends[b]] - base, b - a + 1]


def text_units(text: pa.Array, repeated: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Row, place (code points), number of words and digest of every unit but the windows; with ``repeated``, of those in that bitmap."""
    data, offsets = flat(text)
    w = Words(LOWER[data], offsets, NOT_SPACE)
    if not len(w.starts):
        return {k: np.zeros(0, np.int64) for k in ("row", *_FIELDS)}
    joined, at, last = w.joined()
    a, b = _spans(w, data, last)
    size = at[b] + (w.ends - w.starts)[b] - at[a]
    first = xxh64(joined, at[a], size, SEEDS[0]).view(np.int64)
    if repeated is not None:
        use = member(repeated, first, HASHES)
        a, b, size, first = a[use], b[use], size[use], first[use]
    digests = [first, xxh64(joined, at[a], size, SEEDS[1]).view(np.int64)]
    return dict(zip(("row", *_FIELDS), [*_placed(w, data, a, b), *digests], strict=True))


def text_windows(text: pa.Array, repeating: np.ndarray, gone: pa.Array | None = None, wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """As ``text_units`` the windows that can repeat, and ``at``, their first word's number.

    With ``gone``, the removed spans (start << 32 | end) of each row, only those with a word
    outside; with ``wanted`` only those whose digest is in that bitmap."""
    data, offsets = flat(text)
    w = Words(LOWER[data], offsets, NOT_SPACE)
    if len(w.starts) < WIDTH:
        return {k: np.zeros(0, np.int64) for k in ("row", *_FIELDS, "at")}
    _, least, whole, h = _smallest(w)
    h1 = _windows(h[0], WIDTH)
    use = whole & member(repeating, least, HASHES)
    if wanted is not None:
        use &= member(wanted, h1, HASHES)
    if gone is not None:
        points = offsets_of(LEADS[data])
        sizes = np.asarray(pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False), np.int64)
        spans = gone.flatten().to_numpy(zero_copy_only=False)
        base = np.repeat(points[offsets[:-1]], sizes)
        edge = np.zeros(len(w.starts) + 1, np.int64)
        begins, ends = points[w.starts], points[w.ends]
        for at, of, by, side in ((spans >> 32, begins, 1, "left"), (spans & 0xFFFFFFFF, ends, -1, "right")):
            np.add.at(edge, np.searchsorted(of, at + base, side), by)
        left = offsets_of(np.cumsum(edge)[:-1] <= 0)
        use &= left[WIDTH:] > left[:-WIDTH]
    a = np.flatnonzero(use)
    digests = h1[a].view(np.int64), _windows(h[1], WIDTH)[a].view(np.int64)
    return dict(zip(("row", *_FIELDS, "at"), [*_placed(w, data, a, a + WIDTH - 1), *digests, a - w.rows[w.row_of[a]]], strict=True))


#: Kinds of counted digests.
_UNIT, _SEED = 0, 1


def _repeated(docs: DataFrame, name: str, make) -> dict[int, Broadcast]:
    """Bitmaps, by kind, of the digests that occur twice or more among those that ``make`` yields as (kind, digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            for kind, digests in make(part):
                # The lowest bit of a digest, which no bitmap reads, tells the kind.
                h, n = np.unique((digests & ~1) | kind, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int32))], ["h", "n"])

    found = as_table(docs.mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), name)
    kind = F.col("h").bitwiseAND(F.lit(1))
    sizes = {r.kind: r.n for r in found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}
    maps = {k: bitmap(found.where(kind == k), "h", bits_for(sizes.get(k, 0)), HASHES) for k in (_UNIT, _SEED)}
    drop_table(found)
    return maps


def _table(docs: DataFrame, keep: list[str], text_col: str, names: tuple[str, ...], make) -> DataFrame:
    """keep and the named values of every unit that ``make`` finds in a part."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            u = make(part)
            at = pa.array(u["row"])
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in keep), *(pa.array(u[c]) for c in names)], schema.names)

    return docs.mapInArrow(run, schema)


def _later(found: DataFrame, name: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """The units that an earlier one repeats, with the place of that one; and the stored table of the earliest ones."""
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"), "start", "end", *more)
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").drop("n")
    # A table of its own leaves both sides of the join plain, so that a common unit's rows can be split.
    first = as_table(first, name)
    both = found.join(first, ["h1", "h2"]).where((F.col("first.row") != F.col("_row")) | (F.col("first.end") <= F.col("start")))
    return both.select("_row", "_id", "start", "end", "n_words", *more, *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("id", "row", "start", *more))), first


def _repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every unit that an earlier one repeats: _row, _id, start, end, n_words, first_id, first_start."""
    own = with_row(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_row")
    keep, names = ["_id", "_row"], ("_row", "_id", "start", "end", "n_words", "first_id", "first_start")
    maps = _repeated(own, "digests", lambda p: [(_UNIT, text_units(p.column("_text"))["h1"]), (_SEED, _chosen(p.column("_text")))])
    repeated, repeating = maps[_UNIT], maps[_SEED]
    found = as_table(_table(own, keep, "_text", _FIELDS, lambda p: text_units(p.column("_text"), repeated.value)), "text_units")
    both, first = _later(found, "first_units")
    later = as_table(both.select(*names), "repeated_units")
    drop_table(found), drop_table(first)

    # A span is one number, so that a list of them is as short as it can be.
    gone = later.groupBy("_row").agg(F.collect_list(F.shiftleft("start", 32) + F.col("end")).alias("_gone"))
    rest = own.where(F.length("_text") >= 2 * WIDTH - 1).join(gone, "_row", "left").select("_text", "_gone")
    wanted = _repeated(rest, "window_digests", lambda p: [(_UNIT, text_windows(p.column("_text"), repeating.value, p.column("_gone"))["h1"])])[_UNIT]
    windows = as_table(_table(own, keep, "_text", (*_FIELDS, "at"), lambda p: text_windows(p.column("_text"), repeating.value, wanted=wanted.value)), "text_windows")
    both, first = _later(windows, "first_windows", "at")
    # Windows that go on from one another in both documents are one passage.
    passage = ["_row", "_id", "first_id", "first_row", (F.col("first_at") - F.col("at")).alias("shift")]
    w = Window.partitionBy("_row", "first_row", F.col("first_at") - F.col("at")).orderBy("at")
    new = F.coalesce(F.col("at") > F.lag("at").over(w) + WIDTH, F.lit(True)).cast("int")
    merged = both.withColumn("new", new).withColumn("k", F.sum("new").over(w)).groupBy(*passage, "k").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("at") - F.min("at") + WIDTH).alias("n_words"), F.min("first_start").alias("first_start")
    )
    passages = as_table(merged.select(*names), "repeated_passages")
    drop_table(windows), drop_table(first)
    return later.unionByName(passages)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per removed unit: the document's id, ``start`` and ``end`` (code points, end exclusive), ``n_words``,
    and the kept occurrence: ``first_<id>`` and ``first_start``.

    Null and empty texts have no units; a text whose units are all new has no
    row.  Rows of one document may overlap, as a sentence and its line; windows of
    one passage are one row.  Of repeated rows the first stored one stays.  Other
    columns are not read; texts are read whole.  A common unit is one row per task before the
    digests meet.  ``docs`` is a stored table."""
    return _repeats(docs, id_col, text_col).select(F.col("_id").alias(id_col), "start", "end", "n_words", F.col("first_id").alias(f"first_{id_col}"), "first_start")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept_spans") -> DataFrame:
    """The documents without repeated units, with ``kept_col``: the original (start, end) of every piece that is left."""
    row, gone = fresh(docs, "row", "gone")
    spans = _repeats(docs, id_col, text_col).groupBy(F.col("_row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(gone))
    columns = docs.columns
    kept = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(kept_col, kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pieces = [], []
            for text, cut in zip(batch.column(text_col).to_pylist(), batch.column(gone).to_pylist(), strict=True):
                at, left = 0, []
                for c in cut or ():
                    left.append({"start": at, "end": c["start"]})
                    at = max(at, c["end"])
                left = [p for p in [*left, {"start": at, "end": len(text or "")}] if p["end"] > p["start"]]
                pieces.append(left)
                texts.append(None if text is None else "".join(text[p["start"] : p["end"]] for p in left))
            arrays = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in columns]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(pieces, kind)], schema.names)

    joined = with_row(docs, row).join(spans, row, "left").select(*docs.columns, gone)
    return joined.mapInArrow(run, schema)
