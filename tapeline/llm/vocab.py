"""Global work on distinct words, without a row per occurrence.

A *block* is a run of whole texts of a few megabytes.  Its tokens are coded by
their rank in the block; only its distinct words travel, packed by hash bucket,
to the task that owns the bucket.  There each distinct word of the whole corpus
is worked on once, and what it got travels back to the blocks, where the codes
put it in place again.  A word sends one entry per block however often it
occurs, so a hot word is no hot key.

Blocks are named by a digest of their texts.  Words and codes come from two
scans; a table whose rows came in another order in the second scan would name
other blocks, and the join of the two would fail loudly.  Give stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .simhash import xxh64
from .words import chunks, flat, strings

BLOCK = 8 << 20
#: Bucket number of a block's codes: after all its words.
CODES = (1 << 31) - 1


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, compressed."""
    out = []
    for a in arrays:
        width = 1 if not len(a) else max(1, (int(a.max()).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        out += [np.array([width, len(a)], "<i8").tobytes(), np.ascontiguousarray(planes.T).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        width, n = np.frombuffer(raw, "<i8", 2, at)
        at += 16
        value = np.zeros(n, np.int64)
        for k in range(width):
            value |= np.frombuffer(raw, np.uint8, n, at).astype(np.int64) << (8 * k)
            at += n
        out.append(value)
    return out


@dataclass
class Block:
    part: pa.RecordBatch
    #: Digest of the texts.
    key: int
    #: Rank of each token's word, tokens in order; tokens per row.
    codes: np.ndarray
    counts: np.ndarray
    #: Words by rank, most frequent first.
    words: pa.Array


#: (bytes, offsets of rows) -> (tokens as one binary array in order, tokens per row)
Tokenise = Callable[[np.ndarray, np.ndarray], tuple[pa.Array, np.ndarray]]


def blocks(batches: Iterator[pa.RecordBatch], text_col: str, tokenise: Tokenise) -> Iterator[Block]:
    for part in chunks(batches, text_col, BLOCK):
        data, offsets = flat(part.column(text_col))
        digest = xxhash.xxh64(data.tobytes())
        digest.update(offsets.tobytes())
        tokens, counts = tokenise(data, offsets)
        coded = tokens.dictionary_encode()
        first = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(-np.bincount(first, minlength=len(coded.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield Block(part, digest.intdigest() - (1 << 63), rank[first], counts, coded.dictionary.take(pa.array(order)))


def buckets_of(words: pa.Array, buckets: int) -> np.ndarray:
    data, offsets = flat(words)
    return (xxh64(data, offsets[:-1], np.diff(offsets)) % np.uint64(buckets)).astype(np.int64)


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as shuffle partitions: the vocabulary of one is held by one task."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


ROW = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("extra", T.BinaryType())])


def rows(block: list[int], bucket: list[int], payload: list[bytes], extra: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary()), pa.array(extra or [b""] * len(block), pa.binary())], ROW.names
    )


def word_rows(docs: DataFrame, text_col: str, tokenise: Tokenise, buckets: int, counter: Callable[[Block], np.ndarray] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The distinct words of each block by bucket; ``extra`` has a number per word where ``counter`` gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col, tokenise):
            n = counter(b) if counter else None
            bucket = buckets_of(b.words, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out: list[list] = [[], [], [], []]
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[k] : cuts[k + 1]]
                data, offsets = flat(b.words.take(pa.array(own)))
                for x, v in zip(out, (b.key, k, pack(np.diff(offsets), data), pack(n[own]) if n is not None else b""), strict=True):
                    x.append(v)
            yield rows(*out)

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, ROW)


def words_of(payload: bytes) -> pa.Array:
    lengths, data = unpack(payload)
    return strings(data.astype(np.uint8), np.concatenate([[0], np.cumsum(lengths)]))


def code_rows(docs: DataFrame, text_col: str, tokenise: Tokenise, buckets: int, keep: tuple[str, ...], more: Callable[[Block], np.ndarray] | None = None) -> DataFrame:
    """One row per block: its codes, tokens per row, bucket of each word (and what ``more`` gives); ``extra`` has the ``keep`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col, tokenise):
            kept = b.part.select(list(keep))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as writer:
                writer.write_batch(kept)
            yield rows([b.key], [CODES], [pack(b.codes, b.counts, buckets_of(b.words, buckets), *([more(b)] if more else []))], [sink.getvalue().to_pybytes()])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, ROW)


#: (codes, tokens per row, order of the words by bucket, the answers for a block by bucket, what ``more`` gave) -> output columns.
Assemble = Callable[..., list[pa.Array]]


def reassemble(answers: DataFrame, codes: DataFrame, docs: DataFrame, keep: tuple[str, ...], fields: list[T.StructField], assemble: Callable[[], Assemble]) -> DataFrame:
    """Brings answers and codes of each block together: the ``keep`` columns and ``fields`` of every row.

    ``order`` lists the words' ranks by bucket, the order in which the answers of
    all buckets, one after another, are to be read."""
    schema = T.StructType([docs.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, block, answered = assemble(), None, {}
        for batch in batches:
            for key, bucket, payload, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != block:
                    block, answered = key, {}
                if bucket != CODES:
                    answered[bucket] = payload
                    continue
                ranks, counts, of, *more = unpack(payload)
                if sorted(answered) != np.unique(of).tolist():
                    raise ValueError("the words of a block are missing: the documents came in another order, store them first")
                kept = pa.ipc.open_stream(extra).read_next_batch()
                columns = make(ranks, counts, np.argsort(of, kind="stable"), [answered[k] for k in sorted(answered)], *more)
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], schema.names)

    both = answers.select(*ROW.names).union(codes.select(*ROW.names))
    return both.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)
