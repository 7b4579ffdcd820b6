"""Byte-level BPE over a global table of distinct words.

Documents are cut into pre-tokens; the distinct ones meet by hash bucket, each
is encoded once, and its ids go back to the places where it stands (``vocab``).
Decoding looks every id up in the table of token bytes, whose size the
vocabulary bounds.  The vocabulary is a rank file named by path."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vocab
from .words import flat, offsets_of, strings

#: Letters, numbers, white space and the rest.
REST, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    points = [range(0xD800), range(0xE000, 0x110000)]
    for part in points:
        text = "".join(map(chr, part))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                out[part.start + m.start() : part.start + m.end()] = kind
    return out


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the code point that each byte belongs to."""
    table = _classes()
    kinds = table[:256][np.where(data < 0x80, data, 0)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int64) & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
        kind = table[point]
        for k in range(4):
            more = size > k
            kinds[lead[more] + k] = kind[more]
    return kinds


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The matches of the splitting pattern in every row, in order, and how many each row has.

    A run of one class is a match.  Of white space before something else the
    last character stands alone, or joins what follows if it is a blank.  After
    an apostrophe that begins a match, the fixed endings s t re ve m ll d belong
    to it and what is left of the letters begins anew."""
    if not len(data):
        return strings(data, np.zeros(1, np.int64)), np.zeros(len(offsets) - 1, np.int64)
    kinds = _byte_classes(data)
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    head = offsets[:-1][offsets[1:] > offsets[:-1]]
    outer = np.zeros(len(data) + 1, bool)
    outer[head] = True
    outer[-1] = True
    edge[head] = True

    after = np.flatnonzero(edge & (kinds != SPACE) & ~outer[:-1])
    after = after[kinds[after - 1] == SPACE]
    last = after - 1
    while len(back := np.flatnonzero((data[last] & 0xC0) == 0x80)):
        last[back] -= 1
    edge[last] = True
    edge[after[data[last] == 0x20]] = False

    quote = np.flatnonzero(edge & (data == 0x27))
    padded = np.append(data, [0, 0, 0])
    free = ~np.append(outer, [True, True])[quote + 1]
    one, two = padded[quote + 1], padded[quote + 2]
    pair = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    pair &= ~np.append(outer, [True, True])[quote + 2]
    size = np.where(free & np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where(free & pair, 2, 0))
    edge[quote[size > 0] + 1] = False
    rest = (quote + 1 + size)[size > 0]
    edge[rest[rest < len(data)]] = True

    starts = np.flatnonzero(edge)
    return strings(data, np.append(starts, len(data))), np.diff(np.searchsorted(starts, offsets))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def _encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@functools.cache
def _tables(path: str) -> tuple[pa.Array, pa.Array]:
    """Bytes and decimal digits (with a blank after) of each id."""
    ranks = read_ranks(path)
    size = max(ranks.values()) + 1
    token: list[bytes] = [b""] * size
    for b, i in ranks.items():
        token[i] = b
    return pa.array(token, pa.large_binary()), pa.array([b"%d " % i for i in range(size)], pa.large_binary())


def _encode_rows(path: str):
    """Encodes the words of each bucket row; a word that the bucket had before is not encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bucket, known = _encoding(path)._core_bpe.encode_single_piece, None, {}
        for batch in batches:
            for key, k, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "payload")), strict=True):
                if k != bucket:
                    bucket, known = k, {}
                ids = []
                for word in vocab.words_of(payload).to_pylist():
                    if (got := known.get(word)) is None:
                        got = known[word] = np.array(encode(word), np.uint32)
                    ids.append(got)
                yield vocab.rows([key], [k], [vocab.pack(np.array([len(x) for x in ids]), np.concatenate(ids))])

    return run


def _take(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat(table.take(pa.array(ids)))


def _place(ranks: np.ndarray, counts: np.ndarray, order: np.ndarray, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all tokens of a block in order, and where each row begins."""
    parts = [vocab.unpack(a) for a in answers]
    lengths, ids = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(2))
    start, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    start[order], size[order] = offsets_of(lengths)[:-1], lengths
    token = offsets_of(size[ranks])
    at = np.repeat((start[ranks] - token[:-1]).astype(np.int32), size[ranks])
    at += np.arange(len(at), dtype=np.int32)
    return ids.astype(np.uint32)[at], token[offsets_of(counts)]


def _hashes(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(data))
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
IDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]


def _digests(path: str):
    def start():
        token_bytes, decimals = _tables(path)

        def make(ranks, counts, order, answers) -> list[pa.Array]:
            ids, rows = _place(ranks, counts, order, answers)
            digits, at = _take(decimals, ids)
            ends = at[rows]
            stop = np.where(ends[1:] > ends[:-1], ends[1:] - 1, ends[1:])  # without the last blank
            view = memoryview(np.ascontiguousarray(digits))
            listed = pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), stop.tolist(), strict=True)], pa.string())
            del digits, view, at
            text, at = _take(token_bytes, ids)
            return [pa.array(np.diff(rows)), listed, _hashes(text, at[rows])]

        return make

    return start


def _lists(path: str):
    def start():
        token_bytes, _ = _tables(path)

        def make(ranks, counts, order, answers) -> list[pa.Array]:
            ids, rows = _place(ranks, counts, order, answers)
            text, at = _take(token_bytes, ids)
            lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32)))
            return [pa.array(np.diff(rows)), lists, _hashes(text, at[rows])]

        return make

    return start


def _coded(docs: DataFrame, text_col: str, keep: tuple[str, ...], path: str, fields: list[T.StructField], assemble) -> DataFrame:
    n = vocab.bucket_count(docs.sparkSession)
    words = vocab.word_rows(docs, text_col, pretokens, n).repartition("bucket").sortWithinPartitions("bucket")
    answers = words.mapInArrow(_encode_rows(path), vocab.ROW)
    return vocab.reassemble(answers, vocab.code_rows(docs, text_col, pretokens, n, keep), docs, keep, fields, assemble)


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by a blank) and ``decoded_sha256``.

    Null text is empty and has no tokens.  Repeated rows give repeated results,
    other columns are not read, an empty table gives an empty result, texts are
    encoded whole.  ``docs`` is a stored table (see ``vocab``)."""
    path = path or default_path()
    return _coded(docs, text_col, (id_col,), path, DIGESTS, _digests(path))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, ``ids`` (array of int) and the digest of the decoded bytes of each document;
    null text has no ids.  ``docs`` is a stored table."""
    path = path or default_path()
    return _coded(docs, text_col, keep, path, IDS, _lists(path))


def decode(coded: DataFrame, ids_col: str = "ids", out_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds the decoded text of each row; a null list gives null.  Bytes that are no UTF-8 become U+FFFD, as in tiktoken."""
    path = path or default_path()
    schema = T.StructType([f for f in coded.schema if f.name != out_col] + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes, _ = _tables(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(ids_col)
                flat_ids = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
                data, cuts = _take(token_bytes, flat_ids)
                ends = cuts[offsets_of(np.asarray(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), np.int64))]
                texts = [None if null else data[a:b].tobytes().decode("utf-8", "replace") for a, b, null in zip(ends[:-1].tolist(), ends[1:].tolist(), pc.is_null(ids).to_pylist(), strict=True)]
                kept = [part.column(f.name) for f in schema if f.name != out_col]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], schema.names)

    return coded.mapInArrow(run, schema)
