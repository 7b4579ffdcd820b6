"""A hashed bitmap of bounded size: a filter that may be broadcast whatever the number of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**BITS bits are 2 MB, 2**MOST_BITS bits 32 MB; more keys only let more false candidates through, which the join behind it drops.
BITS, MOST_BITS = 24, 28
#: Bits of one bucket of Spark's bitmap functions.
BUCKET = 32768


def bits_for(keys: int) -> int:
    """Sixteen slots a key, within the bounds."""
    return min(MOST_BITS, max(BITS, (16 * keys).bit_length()))


_FACTOR = 0x9E3779B97F4A7C15


def _hashes(keys: np.ndarray, hashes: int) -> list[np.ndarray]:
    """Of each key one or two numbers whose top bits are its slots; none reads the lowest bit."""
    return [keys] if hashes == 1 else [keys, (keys >> np.uint64(1)) * np.uint64(_FACTOR)]


def bitmap(keys: DataFrame, key: str, bits: int = BITS, hashes: int = 1) -> Broadcast:
    """The bitmap of a column of longs, combined on the executors; at most 2**bits / 2**15 buckets of 4 KB reach the driver."""
    spark = keys.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for x in _hashes(h, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], ["_at"])

    known = keys.where(F.col(key).isNotNull())
    placed = known.select(key).mapInArrow(place, "_at long") if hashes > 1 else known.select(F.col(key).alias("_at"))
    slot = F.shiftrightunsigned(F.col("_at"), 64 - bits)
    parts = (
        placed.select(F.floor(slot / BUCKET).cast("long").alias("bucket"), (slot % BUCKET).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    flags = np.zeros(1 << (bits - 3), np.uint8)
    for p in parts:
        flags[p.bucket * BUCKET // 8 : (p.bucket + 1) * BUCKET // 8] = np.frombuffer(p.bits, np.uint8)
    return spark.sparkContext.broadcast(flags)


def member(flags: np.ndarray, keys: np.ndarray, hashes: int = 1) -> np.ndarray:
    first, *more = _hashes(keys.view(np.uint64), hashes)
    found = _flag(flags, first)
    for x in more:
        found &= _flag(flags, x)
    return found


def _flag(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - (len(flags).bit_length() + 2))
    return ((flags[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
