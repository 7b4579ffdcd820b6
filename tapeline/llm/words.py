"""Text columns of Arrow batches as byte arrays.

Words and lines are index ranges into one byte buffer and equal words get equal
integer ids, so an operator touches no Python object per word.  Every helper
works on a chunk of whole texts of bounded size; only a single text that is
longer than the bound is a chunk of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 4 << 20

_ASCII = np.arange(256)
#: Words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_ASCII == 0x20) | ((_ASCII >= 9) & (_ASCII <= 13)))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, lower-case letters, all beyond ASCII.
ALNUM = (_ASCII >= 0x80) | ((_ASCII >= 0x30) & (_ASCII <= 0x39)) | ((_ASCII >= 0x61) & (_ASCII <= 0x7A))
#: A-Z to a-z, nothing else.
LOWER = np.where((_ASCII >= 0x41) & (_ASCII <= 0x5A), _ASCII + 32, _ASCII).astype(np.uint8)
#: Bytes that begin a code point.
LEADS = (_ASCII & 0xC0) != 0x80


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each part has at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        at, total = 0, np.cumsum(sizes)
        while at < len(sizes):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The opposite of ``flat``: rows of contiguous bytes, without a copy."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(kind or pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def range_sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``mask`` over ranges that may be empty."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[ends] - c[starts]


class Words:
    """Maximal runs of word bytes inside each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        self.inside = inside = table[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            filled = offsets[1:] > offsets[:-1]
            head, tail = offsets[:-1][filled], offsets[1:][filled] - 1
            first[head], last[tail] = inside[head], inside[tail]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Row r has the words rows[r] .. rows[r + 1].
        self.rows = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.rows)
        self.row_of = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def array(self) -> pa.Array:
        """All words in order, as one binary array."""
        return strings(self.data[self.inside], offsets_of(self.ends - self.starts))

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of each row with one blank between two; where each word begins there; which words end their row."""
        last = np.ones(len(self.starts), bool)
        last[:-1] = self.row_of[1:] != self.row_of[:-1]
        taken = self.inside.copy()
        taken[self.ends[~last]] = True
        text = np.where(self.inside, self.data, np.uint8(32))[taken]
        return text, offsets_of(self.ends - self.starts + ~last)[:-1], last

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """An id for each word, equal for equal words, and the words by id."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Lines:
    r"""The pieces of each row between ``\n``; every row has one at least."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
        start = np.concatenate([offsets[:-1], breaks + 1])
        order = np.lexsort((start, row))
        self.row_of, self.starts = row[order], start[order]
        self.ends = np.append(self.starts[1:] - 1, 0)
        last = np.append(self.row_of[1:] != self.row_of[:-1], True)
        self.ends[last] = offsets[1:][self.row_of[last]]
        self.rows = np.searchsorted(self.row_of, np.arange(len(offsets)))
        self._data = data

    def array(self) -> pa.Array:
        return strings(self._data[self._data != 10], offsets_of(self.ends - self.starts), pa.large_string())


def windows_equal(ids: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    same = np.ones(len(a), bool)
    for k in range(width):
        same &= ids[a + k] == ids[b + k]
    return same


def repeated_cover(ids: np.ndarray, row_of: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that its row holds twice or more.

    Windows meet by a hash and equal ones are compared word by word; should two
    different windows ever share a hash, the chunk is redone by whole rows."""
    n, m = len(ids), len(ids) - width + 1
    if m <= 0:
        return np.zeros(n, bool)
    at = np.flatnonzero(row_of[:m] == row_of[width - 1 :])
    h = row_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    s, at = h[order], at[order]
    twin = s[1:] == s[:-1]
    a, b = at[:-1][twin], at[1:][twin]
    if (windows_equal(ids, a, b, width) & (row_of[a] == row_of[b])).all():
        hit = np.unique(np.concatenate([a, b]))
    else:
        table = np.stack([row_of[at], *(ids[at + k] for k in range(width))], 1)
        _, back, count = np.unique(table, axis=0, return_inverse=True, return_counts=True)
        hit = at[count[back.ravel()] > 1]
    edge = np.bincount(hit, minlength=n + 1)[: n + 1] - np.bincount(hit + width, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0
