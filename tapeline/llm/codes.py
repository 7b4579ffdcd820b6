"""Product codes of vectors, trained by Lloyd rounds over cover trees.

A vector's components become integers and are cut into equal parts.  Each block
of stored vectors builds one cover tree per part position: the children of a
node lie within half its radius of their own centre and those centres lie
farther apart than that; every node has its exact radius and the count and sum
of the points below it.  The trees are stored once and read in every round.

In a round a node keeps the codebook entries that can be nearest to any point
below it: an entry farther from the centre than the nearest one by more than
twice the radius cannot, by the triangle inequality.  With one entry left the
whole subtree is assigned and its stored count and sum are added; other nodes
hand their entries to their children, and what is left of an ambiguous leaf is
compared exactly, in integers.  Only sums per entry leave a task, so a round
moves as many rows as the codebooks have components, however many vectors there are."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import as_table, fresh, with_row
from .vectors import lengths, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Larger integers become this bound, so that squares and their sums fit a long.
LARGEST = 1 << 27
#: Vectors of a block, and points below which a node is not split.
BLOCK, LEAF = 8192, 16
#: Node and entry pairs compared at once.
AT_ONCE = 1 << 18
#: Relative allowance for rounded distances.
SLACK = 1e-9

_ARRAYS = ("part", "center", "radius", "sums", "first", "last", "child", "children", "order")


def integers(values: np.ndarray, width: int) -> np.ndarray:
    """floor(SCALE * x), padded with zeros to a multiple of ``width`` components."""
    whole = np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, -whole.shape[1] % width)))


def _distance(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(np.float64))


def cover_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes level by level, so that a node's children lie side by side; ``order`` places a node's points side by side.

    first, last: a node's points in ``order``; child, children: its first child and their number (none: a leaf)."""
    order = np.arange(len(points))
    away = _distance(points, points[0])
    nodes = [(points[0], away.max(), 0, len(points))]
    links, k = [], 0
    while k < len(nodes):
        center, radius, first, last = nodes[k]
        k += 1
        if last - first <= LEAF or radius == 0:
            links.append((0, 0))
            continue
        begin, at, rest, c = len(nodes), first, order[first:last].copy(), center
        while len(rest):
            away = _distance(points[rest], c)
            near = away <= radius / 2
            covered = rest[near]
            order[at : at + len(covered)] = covered
            nodes.append((c, away[near].max(), at, at + len(covered)))
            at += len(covered)
            rest = rest[~near]
            if len(rest):
                c = points[rest[0]]
        links.append((begin, len(nodes) - begin))
    center, radius, first, last = (np.array(x) for x in zip(*nodes, strict=True))
    total = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points[order], axis=0, out=total[1:])
    child, children = np.array(links).T
    return {"center": center, "radius": radius, "sums": total[last] - total[first], "first": first, "last": last, "child": child, "children": children, "order": order}


def forest(points: np.ndarray, parts: int = PARTS) -> dict[str, np.ndarray]:
    """One tree for each part position, in one set of arrays; roots are the nodes 0 .. parts - 1."""
    width = points.shape[1] // parts
    trees = [cover_tree(points[:, p * width : (p + 1) * width]) for p in range(parts)]
    sizes = np.array([len(t["first"]) for t in trees])
    # All roots first, then the rest of each tree.
    base = parts + np.concatenate([[0], np.cumsum(sizes - 1)[:-1]])
    out = {"part": np.concatenate([np.arange(parts), np.repeat(np.arange(parts), sizes - 1)])}
    for p, t in enumerate(trees):
        t["child"] = np.where(t["children"] > 0, t["child"] + base[p] - 1, 0)
        t["first"], t["last"], t["order"] = t["first"] + p * len(points), t["last"] + p * len(points), t["order"] + p * len(points)
    for name in _ARRAYS[1:-1]:
        out[name] = np.concatenate([*(t[name][:1] for t in trees), *(t[name][1:] for t in trees)])
    return out | {"order": np.concatenate([t["order"] for t in trees])}


def _nearest(points: np.ndarray, part: np.ndarray, allowed: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances (int) to each entry, and to the nearest of the allowed ones."""
    squared = np.zeros((len(points), books.shape[1]), np.int64)
    for j in range(points.shape[1]):
        gap = points[:, j, None] - books[part, :, j]
        squared += gap * gap
    squared[~allowed] = np.iinfo(np.int64).max
    return squared, squared.min(1)


def assign(tree: dict[str, np.ndarray], points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], int]:
    """The entry of every (part, point); what each whole subtree or single point adds, as (part, entry, count, sum); exact point comparisons.

    ``points``: one row per part and point, by part, then point."""
    codes = np.full(len(points), -1, np.int64)
    added, compared = [], 0
    levels = [(np.arange(len(books)), np.ones(books.shape[:2], bool))]
    while levels:
        nodes, allowed = levels.pop()
        step = max(1, AT_ONCE // books.shape[1])
        if len(nodes) > step:
            levels += [(nodes[a : a + step], allowed[a : a + step]) for a in range(0, len(nodes), step)]
            continue
        part, radius = tree["part"][nodes], tree["radius"][nodes]
        squared, least = _nearest(tree["center"][nodes], part, allowed, books)
        reach = (np.sqrt(least.astype(np.float64)) + 2 * radius) * (1 + SLACK)
        allowed = allowed & (np.sqrt(squared.astype(np.float64)) <= reach[:, None])
        whole = allowed.sum(1) == 1
        done, entry = nodes[whole], allowed[whole].argmax(1)
        sizes = tree["last"][done] - tree["first"][done]
        added.append((part[whole], entry, sizes, tree["sums"][done]))
        codes[tree["order"][_ranges(tree["first"][done], sizes)]] = np.repeat(entry, sizes)
        open_, allowed = nodes[~whole], allowed[~whole]
        leaf = tree["children"][open_] == 0
        for inner, begin, count in ((False, tree["child"], tree["children"]), (True, tree["first"], tree["last"] - tree["first"])):
            taken = open_[leaf] if inner else open_[~leaf]
            if not len(taken):
                continue
            places, kept = _ranges(begin[taken], count[taken]), np.repeat(allowed[leaf] if inner else allowed[~leaf], count[taken], axis=0)
            if not inner:
                levels.append((places, kept))
                continue
            places = tree["order"][places]
            part = np.repeat(tree["part"][taken], count[taken])
            compared += len(places)
            for a in range(0, len(places), step):
                s = slice(a, a + step)
                squared, least = _nearest(points[places[s]], part[s], kept[s], books)
                codes[places[s]] = (squared == least[:, None]).argmax(1)
            added.append((part, codes[places], np.ones(len(places), np.int64), points[places]))
    return codes, added, compared


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of begin[i] .. begin[i] + count[i] - 1."""
    ends = np.cumsum(count)
    return np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _small(x: np.ndarray) -> np.ndarray:
    """Integers in the narrowest type that holds them."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: x if x.dtype.kind == "f" else _small(x) for k, x in arrays.items()})
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: x if x.dtype.kind == "f" else x.astype(np.int64) for k, x in found.items()}


def _by_part(points: np.ndarray, parts: int) -> np.ndarray:
    return points.reshape(len(points), parts, -1).transpose(1, 0, 2).reshape(len(points) * parts, -1)


def _first_vectors(vectors: DataFrame, id_col: str, vector_col: str, n: int) -> list[list[float]]:
    """The valid vectors of the smallest ids (null last, then the first stored row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(lengths(batch.column("v")) > 0))

    row = with_row(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "row")
    return [r.v for r in row.mapInArrow(run, row.schema).orderBy(F.col("id").asc_nulls_last(), "row").limit(n).collect()]


def _trees(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, size: int, parts: int) -> DataFrame:
    """A row for each block of vectors: ids, labels, integer components and trees."""
    ids, labels = vectors.schema[id_col].dataType, vectors.schema[label_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(ids)), T.StructField("labels", T.ArrayType(labels)), T.StructField("points", T.BinaryType()), T.StructField("tree", T.BinaryType())])

    def block(parts_of: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.concat_batches(parts_of)
        points = integers(matrix(whole.column("v"), np.arange(whole.num_rows)), parts)
        ends = pa.array([0, whole.num_rows], pa.int32())
        packed = [pa.ListArray.from_arrays(ends, whole.column(c)) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*packed, pa.array([_pack({"points": points})], pa.binary()), pa.array([_pack(forest(points, parts))], pa.binary())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            batch = batch.filter(pa.array(lengths(batch.column("v")) == size))
            for a in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(a, BLOCK)
                if n + piece.num_rows > BLOCK:
                    yield block(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield block(held)

    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).mapInArrow(run, schema)


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after one assignment; sums are added up in each task before they meet."""
    parts, entries, width = books.shape
    sent = trees.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for points, tree in zip(batch.column("points"), batch.column("tree"), strict=True):
                points = _by_part(_unpack(points.as_py())["points"], parts)
                for part, entry, count, sums in assign(_unpack(tree.as_py()), points, sent.value)[1]:
                    np.add.at(total, (part, entry), np.column_stack([sums, count]))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total.ravel()[slot])], ["slot", "value"])

    found = trees.select("points", "tree").mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(parts * entries * (width + 1), np.int64)
    total[[r.slot for r in found]] = [r.value for r in found]
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)


def train(trees: DataFrame, first: np.ndarray, rounds: int = ROUNDS, parts: int = PARTS) -> np.ndarray:
    """Codebooks [part, entry, component] from the integer vectors that start them; every round reads all trees."""
    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _round(trees, books)
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(trees: DataFrame, books: np.ndarray, id_field: T.StructField, label_field: T.StructField) -> DataFrame:
    """Id, label, ``code`` and ``error`` of every vector in the trees."""
    sent = trees.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([id_field, label_field, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                points = _by_part(_unpack(batch.column("points")[k].as_py())["points"], parts)
                codes = assign(_unpack(batch.column("tree")[k].as_py()), points, sent.value)[0]
                part = np.repeat(np.arange(parts), len(points) // parts)
                gap = points - sent.value[part, codes]
                error = np.einsum("ij,ij->i", gap, gap).reshape(parts, -1).sum(0)
                text = ["".join(r) for r in digits[codes.reshape(parts, -1).T]]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(text, pa.string()), pa.array(error)], schema.names)

    return trees.mapInArrow(run, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: its id, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    Vectors that are null or empty, or hold null or non-finite components, are
    dropped.  All others are expected to be as long as the one of the smallest id;
    vectors of another length are dropped too, and a length that is no multiple of
    PARTS is padded with zeros.  Components beyond +-LARGEST / SCALE count as that
    bound.  Null ids come last among the first ENTRIES, repeated ids in stored
    order; repeated rows give repeated results; null labels are one group.  Fewer
    than ENTRIES vectors make smaller codebooks, an empty table an empty result.
    Other columns are not read.  ``vectors`` is a stored table."""
    spark = vectors.sparkSession
    label, code, error = "_label", *fresh(vectors, "code", "error")
    id_field = T.StructField(id_col, vectors.schema[id_col].dataType)
    label_field = T.StructField(label, vectors.schema[label_col].dataType)
    first = _first_vectors(vectors, id_col, vector_col, ENTRIES)
    first = [v for v in first if len(v) == len(first[0])]
    if not first:
        fields = [id_field, *(T.StructField(n, k) for n, k in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType())))]
        return spark.createDataFrame([], T.StructType(fields))
    trees = as_table(_trees(vectors, id_col, vector_col, label_col, len(first[0]), PARTS), "cover_trees")
    books = train(trees, integers(np.array(first, np.float64), PARTS))
    coded = as_table(encode(trees, books, id_field, label_field), "codes")
    # A table of its own leaves both sides of the join plain, so that a common label's rows can be split.
    sums = as_table(coded.groupBy(F.col(label).alias("_of")).agg(F.sum("error").alias("label_error")), "label_errors")
    joined = coded.join(sums, coded[label].eqNullSafe(sums["_of"]))
    return joined.select(id_col, "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    width = f"(SELECT max(len(v)) // {PARTS} FROM kept)"
    rounds, book = "", "b0"
    near = "SELECT id, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM (SELECT c.id, c.part, b.entry, sum((c.x - b.y) * (c.x - b.y))::BIGINT AS d FROM comps c JOIN {b} b USING (part, j) GROUP BY ALL) GROUP BY ALL"
    for k in range(1, ROUNDS + 1):
        rounds += f"""a{k} AS MATERIALIZED ({near.format(b=book)}),
        m{k} AS (SELECT part, entry, j, floor(sum(x)::HUGEINT / count(*))::BIGINT AS y FROM a{k} JOIN comps USING (id, part) GROUP BY ALL),
        b{k} AS MATERIALIZED (SELECT o.part, o.entry, o.j, coalesce(m.y, o.y) AS y FROM {book} o LEFT JOIN m{k} m USING (part, entry, j)), """
        book = f"b{k}"
    return f"""
    WITH kept AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    comps AS MATERIALIZED (SELECT id, (k - 1) // {width} AS part, (k - 1) % {width} AS j, v[k] AS x FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS k FROM kept)),
    b0 AS MATERIALIZED (SELECT part, entry, j, x AS y FROM comps JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM kept ORDER BY id LIMIT {ENTRIES}) USING (id)),
    {rounds}
    final AS MATERIALIZED ({near.format(b=book)}),
    coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY id)
    SELECT c.id AS vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, j)) FROM {book}) AS codebooks_sha256
    FROM coded c JOIN kept k USING (id)"""


#: DuckDB text of ``compress`` over ``embeddings``.
SQL = _sql()
