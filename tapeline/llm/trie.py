"""The prefix trie of rebuilt conversations, by range-partitioned shards and a skeleton of splitter paths.

A turn is known by 128 bits of its role and text, a conversation by its path, the
string of its turns' digests.  Splitters, (path, conversation) pairs at even
ranks of a sample, cut the order of all paths into shards.  The conversations of
a node lie side by side in that order, so a node is inside one shard unless its
path is a prefix of a splitter's path.  These prefixes are the skeleton, a trie
of bounded size that is broadcast.  A shard reads its rows in order with one open
node per depth and finishes every other node, with its whole subtree, when the
path leaves it.  For a skeleton node it emits partial sums; these are reduced,
and only the skeleton is rolled up in the driver.  Equal paths are ordered by
conversation, so copies of one conversation spread over shards."""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .simhash import xxh64
from .tables import as_table
from .words import NOT_SPACE, Words, chunks, flat, offsets_of

#: Bytes of a turn's digest, and of its word count.
DIGEST, COUNT = 16, 8
SEEDS = (13, 1313)
GROUP, HEADS = 20, 4
#: Sampled conversations per shard, and skeleton prefixes at most: more would be broadcast, so fewer splitters are taken.
SAMPLED, SKELETON = 32, 1 << 17
#: Ids in one row of a long list of conversations that end at a skeleton node.
IDS = 1 << 15

NODE, PARTIAL, ENDS = 0, 1, 2


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversation, turn, digest and words of every turn; null role or text counts as empty."""
    for part in chunks(batches, "text"):
        roles, at_role = flat(part.column("role"))
        texts, at_text = flat(part.column("text"))
        n_role, n_text = np.diff(at_role), np.diff(at_text)
        words = Words(texts, at_text, NOT_SPACE).counts
        digest = np.zeros((part.num_rows, 2), ">u8")
        for k, seed in enumerate(SEEDS):
            # The text's digest follows the role's and both lengths in 32 bytes of their own.
            own = np.column_stack([xxh64(roles, at_role[:-1], n_role, seed), n_role.astype(np.uint64), xxh64(texts, at_text[:-1], n_text, seed), n_text.astype(np.uint64)])
            digest[:, k] = xxh64(np.ascontiguousarray(own).view(np.uint8).ravel(), np.arange(len(own)) * 32, np.full(len(own), 32), seed)
        raw = pa.Array.from_buffers(pa.binary(DIGEST), part.num_rows, [None, pa.py_buffer(digest.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), raw, pa.array(words, pa.int64())], ["conv_id", "turn", "digest", "words"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> a row per conversation; a conversation that a batch cuts waits for its rest."""
    held: list[tuple[bytes, bytes]] = []
    last = None

    def row() -> pa.RecordBatch:
        path, words = (b"".join(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([path], pa.binary()), pa.array([words], pa.binary())], ["conv_id", "path", "words"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        path = flat(batch.column("digest"))[0].tobytes()
        words = batch.column("words").to_numpy(zero_copy_only=False).astype("<i8").tobytes()
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])).tolist()
        if held and ids[0] != last:
            yield row()
            held = []
        done, pieces = [], list(zip(starts, [*starts[1:], len(ids)], strict=True))
        for k, (a, b) in enumerate(pieces):
            piece = path[a * DIGEST : b * DIGEST], words[a * COUNT : b * COUNT]
            last = int(ids[a])
            if held or k + 1 == len(pieces):
                held.append(piece)
                if k + 1 < len(pieces):
                    yield row()
                    held = []
            else:
                done.append((last, *piece))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "path", "words"])
    if held:
        yield row()


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` and ``words`` (packed, one entry per turn) of every original conversation, by turn (null first)."""
    found = turns.where("conv_id IS NOT NULL").mapInArrow(_digests, "conv_id long, turn long, digest binary, words long")
    # Repeated turn numbers are ordered by digest, so that the order never depends on how the table is stored.
    placed = found.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
    return placed.mapInArrow(_paths, "conv_id long, path binary, words binary")


def _cut(name: str, begin: Column, size: int, length: Column | None = None) -> Column:
    length = F.lit(2**31 - 1) if length is None else (length * size).cast("int")
    return F.substring(F.col(name), (begin * size + 1).cast("int"), length)


def rebuilt(found: DataFrame) -> DataFrame:
    """The same columns of the rebuilt conversations: the first h turns of conversation c - c % GROUP, then c's own after its first h."""
    zero = F.lit(0)
    heads = found.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("_base"), _cut("path", zero, DIGEST, F.lit(HEADS - 1)).alias("_path"), _cut("words", zero, COUNT, F.lit(HEADS - 1)).alias("_words")
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    joined = found.withColumn("_h", h).withColumn("_base", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "_base", "left")
    head = lambda name, size: F.coalesce(_cut(name, zero, size, F.col("_h")), F.unhex(F.lit("")))
    return joined.select(
        "conv_id",
        F.concat(head("_path", DIGEST), _cut("path", F.col("_h"), DIGEST)).alias("path"),
        F.concat(head("_words", COUNT), _cut("words", F.col("_h"), COUNT)).alias("words"),
    )


def splitters(found: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 (path, conversation) pairs at even ranks of a sample, and few enough for the skeleton."""
    total = found.count()
    share = min(1.0, shards * SAMPLED / max(total, 1))
    # A path only has to place a border, so a cut one does as well.
    sample = found.where(F.pmod(F.xxhash64("conv_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select(_cut("path", F.lit(0), DIGEST, F.lit(SKELETON // 64)).alias("path"), "conv_id")
    rows = sorted((bytes(r.path), r.conv_id) for r in sample.collect())
    while True:
        taken = [rows[len(rows) * k // shards] for k in range(1, shards)] if rows else []
        taken = sorted(set(taken))
        if sum(len(p) // DIGEST + 1 for p, _ in taken) <= SKELETON or shards <= 2:
            return taken
        shards = (shards + 1) // 2


def skeleton(cuts: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Every prefix of a splitter path and its number; a parent's number is below its children's."""
    names = {p[:k] for p, _ in cuts for k in range(0, len(p) + 1, DIGEST)} | {b""}
    return {p: k for k, p in enumerate(sorted(names, key=lambda p: (len(p), p)))}


@dataclass(slots=True)
class _Open:
    """A node whose subtree is being read."""

    words: int
    low: int = 1 << 63
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    sha: object = None
    #: Rows of finished children, which still lack the parent's conversation.
    waiting: list[list] = field(default_factory=list)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at the front."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST] else (low, mid)
    return low


_SCHEMA = (
    "kind int, skeleton long, shard long, seq long, conv_id long, depth long, parent_skeleton long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, words long, ends_sha256 string, ids binary"
)
_KINDS = [pa.int32(), *[pa.int64()] * 12, pa.string(), pa.binary()]
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


class _Shard:
    """Reads the sorted rows of one shard and puts out its nodes.

    Open are the nodes of the current path; finished children wait for their
    parent's smallest conversation, those of a skeleton node for the reduction."""

    def __init__(self, shard: int, names: dict[bytes, int]):
        self.shard, self.names, self.out, self.seq = shard, names, [], 0
        self.path, self.open = b"", [_Open(0)]
        #: Skeleton numbers of the path's prefixes; the skeleton holds every prefix of its paths.
        self.numbers = [names[b""]]
        self.any = False

    def name(self, depth: int) -> int | None:
        return self.numbers[depth] if depth < len(self.numbers) else None

    def ends(self, node: _Open, number: int) -> None:
        self.out.append([ENDS, number, self.shard, self.seq, *[None] * 10, np.array(node.ends, "<i8").tobytes()])
        self.seq += 1
        node.ends = []

    @staticmethod
    def digest(node: _Open) -> None:
        if node.ends:
            before = node.sha is not None
            node.sha = node.sha or hashlib.sha256()
            node.sha.update(("," * before + ",".join(map(str, node.ends))).encode())
            node.ends = []

    def close(self) -> None:
        """The deepest open node is done."""
        depth, node = len(self.open) - 1, self.open.pop()
        number = self.name(depth)
        parent = self.open[-1] if self.open else None
        if number is not None:
            if node.ends:
                self.ends(node, number)
            for r in node.waiting:
                self.out.append(r)
            self.out.append([PARTIAL, number, self.shard, 0, node.low, depth, None, None, node.convs, node.children, node.leaves, node.saved, node.words, None, None])
        else:
            leaves = node.leaves or 1
            saved = node.saved + (node.convs - 1) * node.words
            for r in node.waiting:
                r[7] = node.low
                self.out.append(r)
            self.digest(node)
            sha = node.sha or hashlib.sha256()
            parent.waiting.append([NODE, None, self.shard, 0, node.low, depth, self.name(depth - 1), None, node.convs, node.children, leaves, saved, node.words, sha.hexdigest(), None])
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
        if parent is not None:
            parent.convs += node.convs
            parent.low = min(parent.low, node.low)
        self.shed(parent)

    def shed(self, node: _Open | None) -> None:
        """Children that wait for a skeleton node need not wait: its conversation is known after the reduction only."""
        if node is not None and node.waiting and node.waiting[0][6] is not None:
            self.out += node.waiting
            node.waiting = []

    def add(self, conv: int, path: bytes, words: bytes) -> None:
        self.any = True
        same = _common(self.path, path)
        while len(self.open) - 1 > same:
            self.close()
        counts = np.frombuffer(words, "<i8")
        self.path = path
        self.open += [_Open(int(w)) for w in counts[same:]]
        del self.numbers[same + 1 :]
        while len(self.numbers) < len(self.open) and (number := self.names.get(path[: len(self.numbers) * DIGEST])) is not None:
            self.numbers.append(number)
        node = self.open[-1]
        node.convs += 1
        node.low = min(node.low, conv)
        node.ends.append(conv)
        if len(node.ends) >= IDS:
            if (number := self.name(len(self.open) - 1)) is not None:
                self.ends(node, number)
            else:
                self.digest(node)

    def finish(self) -> None:
        while self.any and self.open:
            self.close()

    def take(self) -> Iterator[pa.RecordBatch]:
        rows, self.out = self.out, []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def shard_nodes(found: DataFrame, cuts: list[tuple[bytes, int]]) -> DataFrame:
    """Finished nodes, partial sums of skeleton nodes and the conversations that end at those (kinds NODE, PARTIAL, ENDS)."""
    sent = found.sparkSession.sparkContext.broadcast((cuts, skeleton(cuts)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(sent.value[0], (p.as_py(), c.as_py())) for p, c in zip(batch.column("path"), batch.column("conv_id"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["shard", "conv_id", "path", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for shard, conv, path, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "words")), strict=True):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.finish()
                        yield from now.take()
                    now = _Shard(shard, sent.value[1])
                now.add(conv, path, words)
                if len(now.out) >= 10_000:
                    yield from now.take()
        if now is not None:
            now.finish()
            yield from now.take()

    placed = found.select("conv_id", "path", "words").mapInArrow(place, "shard int, conv_id long, path binary, words binary")
    return placed.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id").mapInArrow(run, _SCHEMA)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and place -> a digest per node; only the running hash is held."""
    node, sha, first = None, hashlib.sha256(), True

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["skeleton", "ends_sha256"])

    for batch in batches:
        for number, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ids"), strict=True):
            if number != node:
                if node is not None:
                    yield row()
                node, sha, first = number, hashlib.sha256(), True
            sha.update(("" if first else ",").encode() + ",".join(map(str, np.frombuffer(ids.as_py(), "<i8").tolist())).encode())
            first = False
    if node is not None:
        yield row()


_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _roll_up(partial: list, names: dict[bytes, int], ends: dict[int, str]) -> list[tuple]:
    """(number, result row) of every skeleton node that has conversations; bounded by SKELETON."""
    parent = {k: names[p[:-DIGEST]] for p, k in names.items() if p}
    nodes = {r.skeleton: r.asDict() for r in partial}
    for k in sorted(nodes, reverse=True):
        n = nodes[k]
        n["leaves"] = n["leaves"] or 1
        n["saved"] += (n["convs"] - 1) * n["words"]
        if k in parent:
            up = nodes[parent[k]]
            up["children"] += 1
            up["leaves"] += n["leaves"]
            up["saved"] += n["saved"]
    none = hashlib.sha256().hexdigest()
    return [(k, n["low"], n["depth"], nodes[parent[k]]["low"] if k in parent else None, n["convs"], n["children"], n["leaves"], n["saved"], ends.get(k, none)) for k, n in nodes.items()]


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has conv_id, turn, role, text; other columns are not read.  Null
    roles and texts are empty, null turns come first, rows of one turn number (also
    repeated rows, which all count) are ordered by their digest; rows without a
    conversation are left out.  Turns are equal if 128 bits of their digests are.  A
    conversation without turns after rebuilding is a member of the root only; an
    empty table has no node.  Texts of any length are hashed whole; a conversation
    takes 24 bytes a turn in a task.  ``shards``: spark.sql.shuffle.partitions."""
    spark = turns.sparkSession
    columns = [F.col(c).cast("long") for c in ("conv_id", "turn")] + [F.col(c) for c in ("role", "text")]
    original = as_table(paths(turns.select(*columns)), "conversation_paths")
    found = as_table(rebuilt(original), "rebuilt_paths")
    cuts = splitters(found, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    nodes = as_table(shard_nodes(found, cuts), "trie_nodes")
    partial = (
        nodes.where(F.col("kind") == PARTIAL)
        .groupBy("skeleton")
        .agg(F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("low"), *(F.sum(c).alias(a) for c, a in (("n_convs", "convs"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved"))))
        .collect()
    )
    listed = nodes.where(F.col("kind") == ENDS).select("skeleton", "shard", "seq", "ids").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "seq")
    ends = {r.skeleton: r.ends_sha256 for r in listed.mapInArrow(_end_digests, "skeleton long, ends_sha256 string").collect()}
    top = spark.createDataFrame(_roll_up(partial, skeleton(cuts), ends), "skeleton long, " + _RESULT)
    names = top.select(F.col("skeleton").alias("_of"), F.col("conv_id").alias("_up"))
    local = nodes.where(F.col("kind") == NODE).join(names, F.col("parent_skeleton") == F.col("_of"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    result = [c.split()[0] for c in _RESULT.split(", ")]
    return local.select(*result).union(top.select(*result))


#: DuckDB text of ``prefix_trie`` over ``conversations``.
SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc(c, rest, x) AS (
    SELECT c, c::VARCHAR, 4294967295::BIGINT FROM ids
    UNION ALL
    SELECT c, rest[2:], list_reduce(list_prepend(xor(x, ascii(rest[1:1])::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END) FROM crc WHERE rest <> ''),
heads AS (SELECT c, xor(x, 4294967295::BIGINT) % {HEADS} AS h FROM crc WHERE rest = ''),
turns AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
paths AS MATERIALIZED (SELECT h.c, coalesce(list_concat(
        (SELECT coalesce(list(t ORDER BY k), []) FROM turns b WHERE b.c = h.c - h.c % {GROUP} AND b.k <= h.h),
        (SELECT coalesce(list(t ORDER BY k), []) FROM turns o WHERE o.c = h.c AND o.k > h.h)), []) AS p FROM heads h),
steps AS (SELECT c, p, unnest(range(0, len(p) + 1)) AS depth FROM paths),
nodes AS MATERIALIZED (SELECT p[1:depth] AS node, depth, min(c) AS low, count(*) AS n,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(p) = depth), '')) AS ends FROM steps GROUP BY ALL),
own AS MATERIALIZED (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(node[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved,
    (SELECT count(*) FROM nodes k WHERE k.depth = o.depth + 1 AND k.node[1:o.depth] = o.node) AS children FROM nodes o)
SELECT v.low AS conv_id, v.depth, (SELECT low FROM nodes p WHERE p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]) AS parent_conv_id,
    v.n AS n_convs, v.children AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, v.ends AS ends_sha256
FROM own v JOIN (SELECT u.node[1:d] AS node, d AS depth, count(*) FILTER (WHERE u.children = 0) AS leaves, sum(u.saved)::BIGINT AS saved
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own) u GROUP BY ALL) s ON s.depth = v.depth AND s.node = v.node"""
