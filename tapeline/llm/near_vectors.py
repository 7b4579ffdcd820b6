"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of COSINE or more lie at most EPSILON apart, in
space and so in every projection.  Vectors of one label and length are sorted
over all partitions by their grid cells (width EPSILON) on the leading principal
axes, and cut into blocks.  Blocks and runs of FAN, FAN**2, ... neighbouring
blocks are the sequence intervals; each has a box on the axes and a ball in full
space.  The join starts with each label's whole sequence against itself and goes
down level by level: a pair of intervals whose boxes or balls are farther apart
than EPSILON is dropped with all that is below it, a pair whose balls lie within
EPSILON is linked as a whole by its counts, and only the others are split.  What
is left are pairs of blocks, sent in tiles of FAN by FAN blocks and halved on
inside a task until the pieces are small; the pieces' vectors are compared.

A dense group is linked as a whole by its balls, links between vectors leave a
task as one link per vector, and the order's last key is the row, so neither a
label nor a cell nor a group of copies has to fit a task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .simhash import _join as unite
from .tables import as_table, with_row
from .vectors import lengths

COSINE = 0.98
EPSILON = float(np.sqrt(2 - 2 * COSINE))
#: Allowance for rounded distances; pairs this close to a bound are compared.
SLACK = 1e-9
#: Leading principal axes, and vectors (of the smallest row hashes) that they are fitted on: they decide how much is skipped, never what is linked.
AXES, SAMPLE = 8, 2048
#: Vectors of a block, and bytes at most.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Blocks of a run, runs of a longer run and so on: 2**FAN_BITS.
FAN_BITS = 4
#: Vectors of a piece that is compared without a further cut.
PIECE = 128


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of valid vectors scaled to length one."""
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def _kind(vectors: DataFrame, vector_col: str) -> str:
    return "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"


def _numbered(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row, id, label, size and packed components of every vector; size 0 for those that link with nothing."""
    kind, (id_type, label_type) = _kind(vectors, vector_col), (vectors.schema[c].dataType for c in (id_col, label_col))
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("size", T.IntegerType()), T.StructField("v", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = lengths(batch.column("v"))
            sizes, packed = np.zeros(len(n), np.int32), [None] * len(n)
            fits = (n > 0) & ~np.asarray(batch.column("label").is_null().to_numpy(zero_copy_only=False), bool)
            for size in np.unique(n[fits]):
                at = np.flatnonzero(fits & (n == size))
                raw = batch.column("v").take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), size)
                some = raw.any(1)
                sizes[at[some]] = size
                for k, values in zip(at[some], raw[some].astype(kind), strict=True):
                    packed[k] = values.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label")), pa.array(sizes), pa.array(packed, pa.binary())], schema.names)

    return with_row(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), "row").mapInArrow(run, schema)


def principal_axes(numbered: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """For the sample's most frequent length, its leading principal axes as columns; other lengths use their first components."""
    rows = numbered.where("size > 0").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("size", "v").collect()
    if not rows:
        return {}
    size = Counter(r.size for r in rows).most_common(1)[0][0]
    u = units(np.frombuffer(b"".join(r.v for r in rows if r["size"] == size), kind).astype(np.float64).reshape(-1, size))
    u = u - u.mean(0)
    return {size: np.linalg.eigh(u.T @ u)[1][:, ::-1][:, :AXES].copy()}


def project(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates on at most AXES orthonormal directions (padded with zeros); distances never grow."""
    size = u.shape[1]
    found = u @ axes[size] if size in axes else u[:, :AXES]
    return np.pad(found, ((0, 0), (0, AXES - found.shape[1])))


def grid_key(p: np.ndarray) -> list[bytes]:
    """Sorts as the cells on the axes do, cells first, then finer places; big-endian 16-bit numbers."""
    cells = np.floor(p / EPSILON).astype(np.int64) + (1 << 15)
    finer = np.clip((p + 1.0) * 32767, 0, 65535).astype(np.int64)
    return [r.tobytes() for r in np.hstack([cells, finer]).astype(">u2")]


def _ordered(numbered: DataFrame, axes: dict[int, np.ndarray], kind: str) -> DataFrame:
    sent = numbered.sparkSession.sparkContext.broadcast(axes)
    schema = T.StructType([*numbered.drop("id").schema.fields, T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            keys = [b""] * len(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                raw = np.frombuffer(b"".join(batch.column("v").take(pa.array(at)).to_pylist()), kind).reshape(len(at), size)
                for k, key in zip(at, grid_key(project(units(raw.astype(np.float64)), sent.value)), strict=True):
                    keys[k] = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], schema.names)

    n = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "size", "key", "row"]
    return numbered.where("size > 0").drop("id").mapInArrow(run, schema).repartitionByRange(n, *order).sortWithinPartitions(*order)


def _ball(centers: np.ndarray, radii: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """A ball around all balls."""
    center = (centers * weights[:, None]).sum(0) / weights.sum()
    return center, float((np.sqrt(((centers - center) ** 2).sum(1)) + radii).max())


def _blocks(ordered: DataFrame, label: T.StructField, axes: dict[int, np.ndarray], kind: str) -> DataFrame:
    """Runs of at most BLOCK sorted vectors of one label and length, with box and ball; ``part`` and ``seq`` keep the order."""
    sent = ordered.sparkSession.sparkContext.broadcast(axes)
    many, whole = T.ArrayType(T.DoubleType()), T.LongType()
    kinds = {"part": whole, "seq": whole, "n": whole, "first": whole, "low": many, "high": many, "center": many, "radius": T.DoubleType(), "rows": T.BinaryType(), "v": T.BinaryType()}
    schema = T.StructType([label, T.StructField("size", T.IntegerType()), *(T.StructField(n, t) for n, t in kinds.items())])

    def block(held: list[pa.RecordBatch], part: int, seq: int) -> pa.RecordBatch:
        whole = pa.concat_batches(held)
        size = whole.column("size")[0].as_py()
        v = b"".join(whole.column("v").to_pylist())
        rows = whole.column("row").to_numpy(zero_copy_only=False)
        u = units(np.frombuffer(v, kind).astype(np.float64).reshape(len(rows), size))
        p = project(u, sent.value)
        center, radius = _ball(u, np.zeros(len(u)), np.ones(len(u)))
        values = [size, part, seq, len(rows), int(rows[0]), p.min(0).tolist(), p.max(0).tolist(), center.tolist(), radius, rows.astype("<i8").tobytes(), v]
        kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.float64())] * 3, pa.float64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([whole.column("label").slice(0, 1), *(pa.array([x], t) for x, t in zip(values, kinds, strict=True))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, n, now = TaskContext.get().partitionId(), 0, [], 0, None
        for batch in batches:
            label_of, sizes = batch.column("label"), batch.column("size").to_pylist()
            keys = list(zip(label_of.to_pylist(), sizes, strict=True))
            a = 0
            while a < len(keys):
                limit = max(1, min(BLOCK, BLOCK_BYTES // (8 * keys[a][1])))
                if held and (keys[a] != now or n >= limit):
                    yield block(held, part, seq)
                    seq, held, n = seq + 1, [], 0
                now, b = keys[a], a + 1
                while b < len(keys) and b - a < limit - n and keys[b] == now:
                    b += 1
                held.append(batch.slice(a, b - a))
                n, a = n + b - a, b
        if held:
            yield block(held, part, seq)

    return ordered.select("label", "size", "row", "v").mapInArrow(run, schema)


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in column]


def _parents(nodes: DataFrame) -> DataFrame:
    """The intervals of the next level."""
    fields = nodes.schema.fields

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("at")
        col = lambda c: np.array(table.column(c).to_pylist())
        n = col("n")
        center, radius = _ball(col("center"), col("radius"), n)
        values = [table.column("at")[0].as_py() >> FAN_BITS, int(n.sum()), table.column("first")[0].as_py(), col("low").min(0).tolist(), col("high").max(0).tolist(), center.tolist(), radius]
        kinds = [table.schema.field(c.name).type for c in fields[2:]]
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1) for c in ("label", "size")), *(pa.array([x], t) for x, t in zip(values, kinds, strict=True))], [c.name for c in fields])

    return nodes.groupBy("label", "size", F.shiftright("at", FAN_BITS).alias("up")).applyInArrow(run, nodes.schema)


def classify(low_a, high_a, center_a, radius_a, low_b, high_b, center_b, radius_b) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of intervals: surely farther apart than EPSILON; surely linked vector by vector."""
    gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    apart = np.sqrt(((center_a - center_b) ** 2).sum(1))
    most = EPSILON * (1 + SLACK) + SLACK
    far = (np.sqrt((gap**2).sum(1)) > most) | (apart - radius_a - radius_b > most)
    return far, apart + radius_a + radius_b < EPSILON * (1 - SLACK) - SLACK


def _split(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Open pairs of intervals -> the pairs of their children that are not far apart, and whether these are near."""
    keys = ["label", "size"]
    side = lambda s: nodes.select(*keys, F.shiftright("at", FAN_BITS).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("at", "n", "first", "low", "high", "center", "radius")))
    both = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"]).where("at_a <= at_b").drop("a", "b")
    kept = ["at_a", "at_b", "n_a", "n_b", "first_a", "first_b"]
    schema = T.StructType([*(nodes.schema[c] for c in keys), *(T.StructField(c, T.LongType()) for c in ("a", "b", *kept[2:])), T.StructField("near", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                grid = lambda c: np.asarray(part.column(c).flatten()).reshape(part.num_rows, -1)  # noqa: B023, E731
                geometry = [np.asarray(part.column(f"{c}_{s}")) if c == "radius" else grid(f"{c}_{s}") for s in "ab" for c in ("low", "high", "center", "radius")]
                far, near = classify(*geometry)
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keys, *kept)), pa.array(near)], schema.names)
                yield out.filter(pa.array(~far))

    return both.mapInArrow(run, schema)


class _Piece:
    """A block's vectors with their rows, places on the axes and ball."""

    def __init__(self, rows: bytes, v: bytes, size: int, kind: str, axes: dict[int, np.ndarray], base: int = 0):
        self.rows = np.frombuffer(rows, "<i8")
        self.u = units(np.frombuffer(v, kind).astype(np.float64).reshape(-1, size))
        self.p = project(self.u, axes)
        #: Where this block's vectors begin among those of the task.
        self.base = base


def join_intervals(x: _Piece, y: _Piece, a: tuple[int, int], b: tuple[int, int], found: list) -> None:
    """Links between the vectors a[0] .. a[1] of x and b of y, as index arrays; of an interval with itself, each pair once."""
    pa_, pb = x.p[a[0] : a[1]], y.p[b[0] : b[1]]
    gap = np.maximum(0, np.maximum(pb.min(0) - pa_.max(0), pa_.min(0) - pb.max(0)))
    if np.sqrt((gap**2).sum()) > EPSILON * (1 + SLACK) + SLACK:
        return
    if max(a[1] - a[0], b[1] - b[0]) <= PIECE:
        cosine = x.u[a[0] : a[1]] @ y.u[b[0] : b[1]].T
        i, j = np.nonzero(cosine >= COSINE)
        if x is y and a == b:
            i, j = i[i < j], j[i < j]
        found.append((i + a[0] + x.base, j + b[0] + y.base))
        return
    middle = lambda r: [(r[0], (r[0] + r[1]) // 2), ((r[0] + r[1]) // 2, r[1])]
    same = x is y and a == b
    if same or a[1] - a[0] >= b[1] - b[0]:
        for c in middle(a):
            for d in middle(b) if same else [b]:
                if not same or c <= d:
                    join_intervals(x, y, c, d, found)
    else:
        for d in middle(b):
            join_intervals(x, y, a, d, found)


def _linked(rows: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with links, how many they have here, and the first row of their class."""
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    count = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
    labels = np.arange(len(rows))
    if len(a):
        unite(labels, a, b)
    some = np.flatnonzero(count)
    return rows[some], count[some], rows[labels[some]]


_LINKS = "row long, n long, root long"


def _out(rows: np.ndarray, n: np.ndarray, root: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.asarray(x, np.int64)) for x in (rows, n, root)]


def _inside(blocks: DataFrame, axes: dict[int, np.ndarray], kind: str) -> DataFrame:
    """Links inside each block."""
    sent = blocks.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["n"] < 2:
                    continue
                if 2 * r["radius"] < EPSILON * (1 - SLACK) - SLACK:
                    rows = np.frombuffer(r["rows"], "<i8")
                    found = rows, np.full(len(rows), len(rows) - 1), np.full(len(rows), rows[0])
                else:
                    x, links = _Piece(r["rows"], r["v"], r["size"], kind, sent.value), []
                    join_intervals(x, x, (0, len(x.rows)), (0, len(x.rows)), links)
                    found = _linked(x.rows, links)
                yield pa.RecordBatch.from_arrays(_out(*found), ["row", "n", "root"])

    return blocks.select("size", "n", "radius", "rows", "v").mapInArrow(run, _LINKS)


def _between(open_: DataFrame, blocks: DataFrame, axes: dict[int, np.ndarray], kind: str) -> DataFrame:
    """Links between the open pairs of blocks, by tiles of two runs: a tile gets each of its blocks once."""
    sent = blocks.sparkSession.sparkContext.broadcast(axes)
    keys = ["label", "size"]
    tiled = open_.select(*keys, "a", "b", F.shiftright("a", FAN_BITS).alias("ta"), F.shiftright("b", FAN_BITS).alias("tb"))
    # Both lists are of 2**FAN_BITS blocks at most.
    left = tiled.groupBy(*keys, "ta", "tb", F.col("a").alias("at")).agg(F.collect_list("b").alias("partners"))
    right = tiled.select(*keys, "ta", "tb", F.col("b").alias("at")).distinct().withColumn("partners", F.lit(None).cast("array<long>"))
    # Stored, so that both sides of the join are plain and a block with many partners can be split.
    wanted = as_table(left.unionByName(right).groupBy(*keys, "ta", "tb", "at").agg(F.flatten(F.collect_list("partners")).alias("partners")), "tiles")
    sides = wanted.join(blocks.select(*keys, "at", "rows", "v"), [*keys, "at"])

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        pieces, base = {}, 0
        for at, rows, v in zip(*(table.column(c) for c in ("at", "rows", "v")), strict=True):
            pieces[at.as_py()] = x = _Piece(rows.as_py(), v.as_py(), size, kind, sent.value, base)
            base += len(x.rows)
        found = []
        for at, partners in zip(table.column("at").to_pylist(), table.column("partners").to_pylist(), strict=True):
            for other in partners:
                x, y = pieces[at], pieces[other]
                join_intervals(x, y, (0, len(x.rows)), (0, len(y.rows)), found)
        rows = np.concatenate([x.rows for x in pieces.values()])
        return pa.Table.from_arrays(_out(*_linked(rows, found)), ["row", "n", "root"])

    return sides.groupBy(*keys, "ta", "tb").applyInArrow(run, _LINKS)


def _whole(near: list[DataFrame], leaves: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Near pairs of intervals, by level -> links of every vector below them, and the links between the intervals' first vectors."""
    keys = ["label", "size"]
    pairs = near[0]
    for more in near[1:]:
        pairs = pairs.unionByName(more)
    side = lambda s, o: pairs.where("a <> b OR level > 0").select(
        *keys, "level", F.col(s).alias("node"), F.col(f"n_{o}").alias("n_all"), (F.col("a") == F.col("b")).cast("long").alias("self"), F.col(f"first_{o}").alias("root")
    )
    halves = side("a", "b").unionByName(side("b", "a").where("self = 0"))
    added = halves.groupBy(*keys, "level", "node").agg(F.sum("n_all").alias("n_all"), F.sum("self").alias("self"), F.min("root").alias("root"))
    up = leaves.select(*keys, "at", "n", "rows", F.explode(F.array(*(F.lit(k) for k in range(levels + 1)))).alias("level"))
    up = up.withColumn("node", F.expr(f"shiftright(at, level * {FAN_BITS})"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = np.frombuffer(r["rows"], "<i8")
                # Of an interval with itself the block's own vectors are counted inside the block.
                yield pa.RecordBatch.from_arrays(_out(rows, np.full(len(rows), r["n_all"] - r["self"] * r["n"]), np.full(len(rows), r["root"])), ["row", "n", "root"])

    counted = up.join(added, [*keys, "level", "node"]).select("rows", "n", "n_all", "self", "root").mapInArrow(run, _LINKS)
    return counted, pairs.where("a <> b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))


def links(numbered: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """``numbered`` (stored) -> (row, n): the links of each linked vector; (a, b): row pairs that span every component."""
    spark = numbered.sparkSession
    axes = principal_axes(numbered, kind)
    blocks = as_table(_blocks(_ordered(numbered, axes, kind), numbered.schema["label"], axes, kind), "vector_blocks")
    top = blocks.agg(F.max("part").alias("part"), F.max("seq").alias("seq")).first()
    if top.part is None:
        none = spark.createDataFrame([], _LINKS)
        return none.select("row", "n"), none.select(F.col("row").alias("a"), F.col("root").alias("b"))
    # Block numbers: the partition, then the place inside, on a whole number of levels.
    bits = -(-max(1, int(top.seq).bit_length()) // FAN_BITS) * FAN_BITS
    levels = -(-((int(top.part) << bits) + int(top.seq)).bit_length() // FAN_BITS)
    blocks = blocks.withColumn("at", F.shiftleft("part", bits) + F.col("seq"))
    keys = ["label", "size"]
    several = blocks.groupBy(*keys).agg(F.count("*").alias("_blocks")).where("_blocks > 1").drop("_blocks")
    leaves = as_table(blocks.join(several, keys, "left_semi").select(*keys, "at", "n", "first", "low", "high", "center", "radius", "rows"), "block_nodes")
    nodes = [leaves.drop("rows")]
    for _ in range(levels):
        nodes.append(as_table(_parents(nodes[-1]), "interval_nodes"))
    pairs, near = nodes[-1].select(*keys, F.col("at").alias("a"), F.col("at").alias("b")), []
    for level in range(levels - 1, -1, -1):
        found = as_table(_split(pairs, nodes[level]), "interval_pairs")
        near.append(found.where("near").withColumn("level", F.lit(level)).drop("near"))
        pairs = found.where("NOT near").select(*keys, "a", "b")
    parts = [_inside(blocks, axes, kind)]
    chain = None
    if near:
        counted, chain = _whole(near, leaves, levels)
        parts += [counted, _between(pairs.where("a < b"), blocks, axes, kind)]
    linked = parts[0]
    for more in parts[1:]:
        linked = linked.unionByName(more)
    linked = as_table(linked, "vector_links")
    spanning = linked.where("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b"))
    return linked.groupBy("row").agg(F.sum("n").alias("n")), spanning if chain is None else spanning.unionByName(chain)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their labels are equal and their cosine is COSINE or more.
    Null, empty and zero vectors, those that hold null or non-finite components,
    and those without a label link with nothing; vectors of unlike length do not
    link.  ``component_id`` is the smallest id of the component (nulls aside; null
    if it has no other), ``kept`` whether it is the row's own (null equals null).
    Rows of one id are vectors of their own, so repeated rows link.  Other columns
    are not read; an empty table gives an empty result."""
    kind = _kind(vectors, vector_col)
    numbered = as_table(_numbered(vectors, id_col, vector_col, label_col), "vectors")
    counted, spanning = links(numbered, kind)
    classes = as_table(components(spanning), "vector_classes")
    ids = numbered.select("row", "id")
    named = as_table(classes.join(ids, classes.node == ids.row).select("node", "root", "id"), "class_ids")
    # A table of its own leaves both sides of the join plain, so that a large component's rows can be split.
    lows = as_table(named.groupBy(F.col("root").alias("of")).agg(F.min("id").alias("low")), "class_lows")
    placed = named.join(lows, named.root == lows["of"]).select(F.col("node").alias("_node"), "low")
    result = ids.join(counted.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left").join(placed, F.col("row") == F.col("_node"), "left")
    component = F.when(F.col("_node").isNull(), F.col("id")).otherwise(F.col("low"))
    return result.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: DuckDB text of ``near_duplicates`` over ``embeddings`` (ids that are not null and differ).
SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {COSINE}),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(e.vec_id, r.low), e.vec_id) AS component_id, coalesce(least(e.vec_id, r.low), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT id, min(other) AS low FROM reach GROUP BY id) r ON r.id = e.vec_id"""
