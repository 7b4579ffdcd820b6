"""Benchmark decontamination as a prefix-filtered containment join.

A benchmark window of 13 words holds nine shingles of five words.  A document
holds the window only if it holds all of them, so one shingle, the rarest in the
corpus, is prefix enough.  A first pass over the documents counts the benchmark's
shingles, a second one emits the prefix shingles it meets with the words around
them.  Length and position of the shingle in its window bound where the window
may lie; there it is compared word by word.  Both passes filter by a bitmap of
fixed size; the join itself is salted, as a shingle or a window may be common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import bitmap, member
from .simhash import xxh64
from .tables import as_table, fresh, with_row
from .words import ALNUM, LOWER, Words, chunks, flat, offsets_of

WINDOW = 13
SHINGLE = 5
SALTS = 16
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20


def _split(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of lower-cased texts and the hash of each word."""
    data, offsets = flat(column)
    w = Words(LOWER[data], offsets, ALNUM)
    ids, words = w.ids()
    chars, at = flat(words)
    return w, xxh64(chars, at[:-1], np.diff(at))[ids] if len(ids) else np.zeros(0, np.uint64)


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on, as signed longs (also across rows; callers check the row)."""
    n = max(0, len(hashes) - k + 1)
    h = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every window of every item with each of its shingles: item, win, len, k, at (offset in the window), h."""
    schema = T.StructType(
        [T.StructField("item", T.StringType()), T.StructField("win", T.StringType())]
        + [T.StructField(c, T.IntegerType()) for c in ("len", "k", "at")]
        + [T.StructField("h", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col, 1 << 18):
            w, hashes = _split(part.column(text_col))
            words = [x.decode("utf-8", "replace") for x in w.array().to_pylist()]
            out: dict[str, list] = {c: [] for c in schema.names}
            by_k = {k: _shingles(hashes, k) for k in range(1, SHINGLE + 1)}
            for r, item in enumerate(part.column(id_col).cast(pa.string()).to_pylist()):
                lo, n = int(w.rows[r]), int(w.counts[r])
                if not n:
                    continue
                size = min(n, WINDOW)
                k = min(size, SHINGLE)
                for s in range(lo, lo + n - size + 1):
                    win = " ".join(words[s : s + size])
                    for at in range(size - k + 1):
                        for c, v in zip(schema.names, (item, win, size, k, at, int(by_k[k][s + at])), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in schema], schema.names)

    return benchmark.select(id_col, text_col).mapInArrow(run, schema)


def _met(w: Words, hashes: np.ndarray, sizes: list[int], flags: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shingle size: the places whose shingle is in the bitmap, and its hash."""
    for k in sizes:
        h = _shingles(hashes, k)
        at = np.flatnonzero((w.row_of[: len(h)] == w.row_of[k - 1 :]) & member(flags, h)) if len(h) else np.zeros(0, np.int64)
        yield k, at, h[at]


def shingle_counts(docs: DataFrame, text_col: str, sizes: list[int], flags) -> DataFrame:
    """How often each shingle of the bitmap occurs in all documents: (h, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            w, hashes = _split(part.column(text_col))
            h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for _, _, x in _met(w, hashes, sizes, flags.value))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, keep: list[str], text_col: str, sizes: list[int], flags) -> DataFrame:
    """Per document: ``keep``, its number of words and the prefix shingles met, each with up to WINDOW words around it."""
    met = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("words", T.StringType())]))
    n_words, found = "_n_words", "_met"
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n_words, T.LongType()), T.StructField(found, met)])
    kind = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            w, hashes = _split(part.column(text_col))
            rows, cols = [], {"h": [], "pos": [], "before": [], "words": []}
            for k, places, hs in _met(w, hashes, sizes, flags.value):
                for at, h in zip(places.tolist(), hs.tolist(), strict=True):
                    r = int(w.row_of[at])
                    lo = max(int(w.rows[r]), at - (WINDOW - k))
                    hi = min(int(w.rows[r + 1]), at + WINDOW)
                    around = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[lo:hi].tolist(), w.ends[lo:hi].tolist(), strict=True))
                    rows.append(r)
                    for c, v in (("h", h), ("pos", at - int(w.rows[r])), ("before", at - lo), ("words", around.decode("utf-8", "replace"))):
                        cols[c].append(v)
            order = np.argsort(np.array(rows, np.int64), kind="stable")
            flat_met = pa.StructArray.from_arrays([pa.array(cols[f.name], f.type) for f in kind], fields=list(kind)).take(pa.array(order))
            counts = np.bincount(np.array(rows, np.int64), minlength=part.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(offsets_of(counts).astype(np.int32)), flat_met)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(w.counts.astype(np.int64)), lists], [*keep, n_words, found])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def _salted(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """Inner join whose keys may be hot on the left: each right row is repeated once per salt."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", salt).join(copies, [on, "salt"]).drop("salt")


def _overlaps(docs: DataFrame, benchmark: DataFrame, row: str, keep: list[str], text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(per document ``row, keep, _n_words``; per contaminated document ``row, n_hit, n_items, items_sha256``)."""
    wins = as_table(benchmark_windows(benchmark, item_col, item_text), "bench_windows")
    sizes = sorted(r.k for r in wins.select("k").distinct().collect())  # five values at most
    keys = wins.select("h").distinct()
    seen = shingle_counts(docs, text_col, sizes, bitmap(keys, "h"))
    known = as_table(keys.join(seen, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n")), "bench_rarity")
    rarest = F.min(F.struct("n", "h", "at")).alias("p")
    prefix = wins.select("win", "len", "at", "h").distinct().join(known, "h").groupBy("win", "len").agg(rarest).select("win", "len", "p.h", "p.at")
    prefix = as_table(prefix, "bench_prefix")

    found = as_table(_candidates(docs, [row, *keep], text_col, sizes, bitmap(prefix, "h")), "met_shingles")
    met = found.select(row, "_n_words", F.explode("_met").alias("m")).select(row, "_n_words", "m.*")
    first = F.col("pos") - F.col("at")
    inside = (first >= 0) & (first + F.col("len") <= F.col("_n_words"))
    same = F.array_join(F.slice(F.split("words", " "), F.col("before") - F.col("at") + 1, F.col("len")), " ") == F.col("win")
    hits = _salted(met, prefix, "h", row).where(inside).where(same).select(row, first.alias("s"), (first + F.col("len")).alias("e"), "win")
    hits = as_table(hits.distinct(), "window_hits")

    before = F.max("e").over(W.partitionBy(row).orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1))
    new = hits.select(row, "s", "e").distinct().withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(before, F.lit(0)))))
    n_hit = new.groupBy(row).agg(F.sum("new").alias("n_hit"))
    members = wins.where(F.col("item").isNotNull()).select("win", "item").distinct()
    items = _salted(hits.select(row, "win").distinct(), members, "win", row).select(row, "item").distinct()
    listed = items.groupBy(row).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("listed"))
    return found.drop("_met"), n_hit.join(listed, row, "left").withColumn("items_sha256", F.sha2(F.coalesce("listed", F.lit("")), 256)).drop("listed")


def _judge(n_hit: str, n_words: str):
    return (F.col(n_hit) > 0) & (SHARE * F.col(n_hit) >= F.col(n_words))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    Null text has no words.  Items without words never occur; an item with a null
    id marks words but is not counted or listed; repeated items count once.
    Repeated document rows are judged each; other columns are not read; an empty
    benchmark leaves every document clean.  ``docs`` is a stored table."""
    row = "_row"
    numbered = with_row(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), row)
    base, hits = _overlaps(numbered, benchmark, row, ["_id"], "_text", item_col, item_text)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = base.join(hits, row, "left").select(
        F.col("_id").alias(id_col), F.col("_n_words").alias("n_words"), zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256")
    )
    return out.withColumn("contaminated", _judge("n_hit", "n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns.  ``docs`` is a stored table."""
    row, text = fresh(docs, "row", "body")
    numbered = with_row(docs, row)
    base, hits = _overlaps(numbered.select(row, F.col(text_col).alias(text)), benchmark, row, [], text, item_col, item_text)
    bad = base.join(hits, row).where(_judge("n_hit", "_n_words")).select(row)
    return numbered.join(bad, row, "left_anti").drop(row)


SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Over ``dw(r, ws)``: ``soiled(r, n_words, n_hit, n_items, items_sha256, contaminated)``.
SQL_STEPS = f"""
iw AS (SELECT item_id, {SQL_WORDS} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[s:s + least(len(ws), 13) - 1], ' ') AS win
         FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS s FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
texts AS (SELECT DISTINCT n, win FROM wins),
places AS (SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM dw, sizes WHERE len(ws) >= n)),
hits AS (SELECT r, s, places.n, win FROM places JOIN texts USING (win) WHERE places.n = texts.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits JOIN wins USING (win) WHERE item_id IS NOT NULL) GROUP BY r),
soiled AS (SELECT r, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
                  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
           FROM dw LEFT JOIN hit USING (r) LEFT JOIN named USING (r))
"""

SQL = f"""
WITH ids AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), dw AS (SELECT r, {SQL_WORDS} AS ws FROM ids), {SQL_STEPS}
SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM soiled JOIN ids USING (r)
"""
