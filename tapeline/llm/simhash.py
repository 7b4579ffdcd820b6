"""SimHash fingerprints and their near-duplicate groups.

Two fingerprints that differ in at most three bits share at least five of their
eight bytes.  The inverted index therefore lists fingerprints by (byte
positions, byte values) for all 56 choices of five positions: a pair tallies
five shared positional bytes exactly if one list holds both.  Pairs of a list
are verified by bit distance.  A list has at most 2**24 members (three free
bytes), each distinct fingerprint once, and emits links of a spanning forest
only, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import as_table, fresh, with_row
from .words import LOWER, NOT_SPACE, Words, chunks, flat, offsets_of

SHINGLE = 3
SEED = 42
BITS = 3
MATCHES = 8 - BITS
#: Texts per chunk; a shingle takes 64 bytes while its bits are counted.
CHUNK = 2 << 20
#: Shingles longer than this are hashed one by one.
LONG = 512
#: Lists up to SMALL members are compared all lists at once, up to BLOCKS by blocks, longer ones by looking up every close value.
SMALL, BLOCKS = 32, 8192

_P = [np.uint64(int(x)) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges at once."""
    with np.errstate(over="ignore"):
        return _xxh64(data, starts, lengths, np.uint64(seed))


def _xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: np.uint64) -> np.ndarray:
    p1, p2, p3, p4, p5 = _P
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    lane = np.array(np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)))
    mixed = lambda k: _rot(k * p2, 31) * p1
    h = np.full(len(starts), seed + p5, np.uint64)
    p, end = starts.copy(), starts + lengths
    wide = np.flatnonzero((lengths >= 32) & (lengths <= LONG))
    if len(wide):
        acc = [np.full(len(wide), v, np.uint64) for v in (seed + p1 + p2, seed + p2, seed, seed - p1)]
        live = np.arange(len(wide))
        while len(live):
            at = p[wide[live]]
            for k in range(4):
                acc[k][live] = _rot(acc[k][live] + lane[at + 8 * k] * p2, 31) * p1
            p[wide[live]] += 32
            live = live[p[wide[live]] + 32 <= end[wide[live]]]
        v = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for a in acc:
            v = (v ^ mixed(a)) * p1 + p4
        h[wide] = v
    h += lengths.astype(np.uint64)
    short = lengths <= LONG
    while True:
        at = np.flatnonzero(short & (p + 8 <= end))
        if not len(at):
            break
        h[at] = _rot(h[at] ^ mixed(lane[p[at]]), 27) * p1 + p4
        p[at] += 8
    at = np.flatnonzero(short & (p + 4 <= end))
    h[at] = _rot(h[at] ^ ((lane[p[at]] & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
    p[at] += 4
    for _ in range(3):
        at = np.flatnonzero(short & (p < end))
        h[at] = _rot(h[at] ^ ((lane[p[at]] & np.uint64(0xFF)) * p5), 11) * p1
        p[at] += 1
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(~short):
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : end[k]].tobytes(), int(seed))
    return h


def fingerprint(text: pa.Array) -> np.ndarray:
    """The fingerprint of each text as a signed long; zero without words."""
    data, offsets = flat(text)
    w = Words(LOWER[data], offsets, NOT_SPACE)
    lengths = w.ends - w.starts
    joined, at, _ = w.joined()
    n = np.where(w.counts >= SHINGLE, w.counts - SHINGLE + 1, np.minimum(w.counts, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = w.rows[:-1][row] + np.arange(len(row)) - offsets_of(n)[:-1][row]
    final = first + np.minimum(w.counts[row], SHINGLE) - 1
    h = xxh64(joined, at[first], at[final] + lengths[final] - at[first])
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        tally = np.add.reduceat(bits, offsets_of(n)[:-1][full], axis=0, dtype=np.int32)
        over = 2 * tally > n[full][:, None]
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, fp_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, other ``keep`` columns and the fingerprint of each row."""
    kept = [id_col, *keep]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(fp_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col, CHUNK):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(fingerprint(part.column(text_col)))], [*kept, fp_col])

    return docs.select(*kept, text_col).mapInArrow(run, schema)


CHOICES = list(combinations(range(8), MATCHES))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = np.empty((len(CHOICES), len(fp)), np.uint64)
            for c, places in enumerate(CHOICES):
                keys[c] = c
                for b in places:
                    keys[c] = (keys[c] << np.uint64(8)) | ((fp >> np.uint64(8 * b)) & np.uint64(255))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fp.view(np.int64), len(CHOICES)))], ["list", "fp"])


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the classes of a[i] and b[i]; a label is the smallest index of its class."""
    while True:
        la, lb = labels[a], labels[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if (low == high).all():
            return
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _long_list(fp: np.ndarray, choice: int) -> np.ndarray:
    """Classes of one long list of distinct fingerprints: by blocks, or by every value at most BITS bits away."""
    labels = np.arange(len(fp))
    if len(fp) <= BLOCKS:
        step = max(1, (1 << 20) // len(fp))
        for at in range(0, len(fp), step):
            a, b = np.nonzero(np.bitwise_count(fp[at : at + step, None] ^ fp[None, :]) <= BITS)
            _join(labels, a + at, b)
        return labels
    free = [b for b in range(8) if b not in CHOICES[choice]]
    value = np.zeros(len(fp), np.int64)
    for b in free:
        value = (value << 8) | ((fp >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
    place = np.full(1 << 24, -1, np.int32)
    place[value] = np.arange(len(fp))
    for k in range(1, BITS + 1):
        for flips in combinations(range(24), k):
            other = place[value ^ sum(1 << f for f in flips)]
            a = np.flatnonzero(other > np.arange(len(fp)))
            if len(a):
                _join(labels, a, other[a].astype(np.int64))
    return labels


def _list_links(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole lists, sorted by key: each fingerprint to the first of its class in the list."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    labels = np.arange(len(keys))
    size_of = np.repeat(sizes, sizes)
    small = size_of <= SMALL
    for lag in range(1, min(SMALL, int(sizes.max(initial=1)))):
        a = np.flatnonzero(small[:-lag] & (keys[:-lag] == keys[lag:]))
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= BITS]
        if len(a):
            _join(labels, a, a + lag)
    for k in np.flatnonzero(sizes > SMALL):
        s = slice(starts[k], starts[k] + sizes[k])
        labels[s] = starts[k] + _long_list(fp[s], int(keys[starts[k]]) >> 40)
    moved = np.flatnonzero(labels != np.arange(len(keys)))
    return fp[moved], fp[labels[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the sorted lists of a partition; a list that a batch cuts waits for its rest."""
    rest: list[tuple[np.ndarray, np.ndarray]] = []

    def out(keys: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            a, b = _list_links(keys, fp)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (rest and rest[-1][0][-1] != keys[-1]):
            done = [*rest, (keys[:cut], fp[:cut])]
            yield from out(np.concatenate([k for k, _ in done]), np.concatenate([f for _, f in done]))
            rest = []
        rest.append((keys[cut:].copy(), fp[cut:].copy()))
    if rest:
        yield from out(np.concatenate([k for k, _ in rest]), np.concatenate([f for _, f in rest]))


def close_links(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)`` -> links ``(a, b)`` that span every class of fingerprints at most three bits apart."""
    lists = distinct.mapInArrow(_postings, "list long, fp long").repartition("list").sortWithinPartitions("list")
    return lists.mapInArrow(_links, "a long, b long").distinct()


def groups(prints: DataFrame, id_col: str, fp_col: str) -> DataFrame:
    """Stored ``prints(id, fp)`` -> ``(fp, component)`` with the smallest id reachable from each distinct fingerprint."""
    first = prints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("low"))
    first = as_table(first, "simhash_distinct")
    linked = components(close_links(first.select("fp")))
    named = first.join(linked, first.fp == linked.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = as_table(named, "simhash_classes")
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    return named.join(lows, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Null and word-less texts have fingerprint zero and link like any other; a
    component whose ids are all null has a null id.  Repeated rows give repeated
    results; other columns are not read; an empty table gives an empty result.
    Texts of any length are hashed whole."""
    fp = fresh(docs, "fp")[0]
    prints = as_table(fingerprints(docs, id_col, text_col, fp), "simhash")
    named = groups(prints, id_col, fp).withColumnRenamed("fp", "_key")
    return prints.join(named, prints[fp] == named["_key"], "left").select(
        prints[id_col], F.lpad(F.lower(F.hex(prints[fp])), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays (null ids last,
    the first stored row on ties).  ``docs`` is a stored table; its columns stay as they are."""
    row, fp, none = fresh(docs, "row", "fp", "no_id")
    numbered = with_row(docs, row)
    prints = as_table(fingerprints(numbered, id_col, text_col, fp, (row,)), "simhash")
    named = groups(prints, row, fp).withColumnRenamed("fp", "_key")
    placed = prints.join(named, prints[fp] == named["_key"]).select("component", F.struct(F.col(id_col).isNull().alias(none), id_col, row).alias("rank"))
    stay = placed.groupBy("component").agg(F.min("rank").alias("rank")).select(F.col(f"rank.{row}").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)
