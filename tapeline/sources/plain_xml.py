"""Plain XML documents, a batch of them at a time.

Most documents are elements and text only.  These are read as one byte array:
the marks ``<`` and ``>`` cut it into tags and texts, equal tags get equal
integer ids, and each level of nesting is one pass over the tags.  A document
with anything else (entities, comments, sections, a stray ``>``, namespaces,
mixed content, repeated fields, ill-formed nesting) is returned as null, for
``from_xml`` to read."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import ArrayType, DataType, StructType

CHUNK = 1 << 20
LEVELS = 32

_HEAD = r'^<\?xml version="1\.0"( encoding="UTF-8")?\?>[ \t\n]*'
_TAG = re.compile(rb'<(/?)([A-Za-z_][A-Za-z0-9_.-]*)(?: [A-Za-z_][A-Za-z0-9_.-]*="[^"<>]*")?(/?)>')
_OPEN, _CLOSE, _EMPTY, _OTHER = 1, -1, 0, 2


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _tag(tag: bytes, names: dict[str, int], fields: set[str]) -> tuple[int, int]:
    """Kind and name of a tag; a field in other letter case is left to the session's rule."""
    m = _TAG.fullmatch(tag)
    if not m or (m[1] and (m[3] or b" " in tag)):
        return _OTHER, -1
    name = m[2].decode()
    if name not in fields and name.lower() in {f.lower() for f in fields}:
        return _OTHER, -1
    return _CLOSE if m[1] else _EMPTY if m[3] else _OPEN, names.setdefault(name, len(names))


def _is_text(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


class Tags:
    """Tags of the documents of a column that are plain."""

    def __init__(self, column: pa.Array, fields: set[str]):
        column = column.cast(pa.large_string())
        if any(pc.any(x).as_py() for x in (pc.starts_with(column, "<?"), *(pc.ends_with(column, c) for c in " \t\n"))):
            column = pc.replace_substring_regex(pc.ascii_rtrim(column, " \t\n"), _HEAD, "")
        data, offsets = _flat(column.cast(pa.large_binary()))
        marks = np.flatnonzero((data == 60) | (data == 62))
        rows = np.searchsorted(marks, offsets)
        sizes = np.diff(rows)
        good = (sizes > 1) & (sizes % 2 == 0)
        first, last = marks[rows[:-1][good]], marks[rows[1:][good] - 1]
        good[good] = (first == offsets[:-1][good]) & (data[first] == 60) & (last == offsets[1:][good] - 1)
        row_of = lambda at, of: np.searchsorted(of, at, "right") - 1
        kinds = data[marks]
        again = np.flatnonzero(kinds[1:] == kinds[:-1]) + 1
        row = row_of(again, rows)
        good[row[rows[row] < again]] = False
        # control characters, "&", and 0xEF, which begins the noncharacters
        odd = np.flatnonzero((data < 32) | (data == 38) | (data == 0xEF if _is_text(data) else data > 127))
        good[row_of(odd[(data[odd] != 9) & (data[odd] != 10)], offsets)] = False
        #: Documents that are plain as bytes; ``fine`` tells which of them are plain as tags.
        self.good = good
        self._read(data, marks[np.repeat(good, sizes)], sizes[good] // 2, fields)

    def _read(self, data: np.ndarray, marks: np.ndarray, counts: np.ndarray, fields: set[str]) -> None:
        cut = marks.copy()
        cut[1::2] += 1
        #: A tag at 2 i, the text behind it at 2 i + 1.
        self.pieces = pa.Array.from_buffers(pa.large_binary(), max(len(cut) - 1, 0), [None, pa.py_buffer(cut if len(cut) else np.zeros(1, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = self.pieces.take(pa.array(np.arange(0, len(cut), 2))).dictionary_encode()
        self.names: dict[str, int] = {}
        read = np.array([_tag(t, self.names, fields) for t in coded.dictionary.to_pylist()], np.int32).reshape(-1, 2)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.kind, self.name = read[codes, 0].astype(np.int8), read[codes, 1]
        #: Documents are numbered among the good ones; document d has the tags begin[d] .. begin[d + 1].
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.fine = np.ones(len(counts), bool)
        if not len(codes):
            self.level = np.zeros(0, np.int32)
            return
        depth = np.cumsum(np.where(self.kind == _OTHER, 0, self.kind), dtype=np.int32)
        depth -= np.repeat(np.concatenate([[0], depth])[self.begin[:-1]].astype(np.int32), counts)
        ends = np.zeros(len(codes), bool)
        ends[self.begin[1:] - 1] = True
        self.fine[self.doc[(self.kind == _OTHER) | ((depth <= 0) != ends) | (depth > LEVELS)]] = False
        self.fine[depth[ends] != 0] = False
        self.level = depth + (self.kind != _OPEN)
        #: A text that is neither blank nor all that an element holds is mixed content.
        pair = (self.kind[:-1] == _OPEN) & (self.kind[1:] == _CLOSE)
        mixed = np.flatnonzero((cut[2::2] > cut[1:-1:2]) & ~pair & ~ends[:-1])
        if len(mixed):
            told = pc.match_substring_regex(self.pieces.take(pa.array(2 * mixed + 1)), "[^ \\t\\n]").to_numpy(zero_copy_only=False)
            self.fine[self.doc[mixed[told]]] = False

    def nodes(self, tree: dict) -> dict[tuple[str, ...], np.ndarray]:
        """Opening tags of every path of a tree; a path to a text is a leaf, others hold elements."""
        paths: list[tuple[tuple[str, ...], dict | list | None]] = [((), tree)]
        for path, node in paths:
            paths += [((*path, k), v) for k, v in _inner(node).items()]
        number = {p: i for i, (p, _) in enumerate(paths)}
        step = np.full((len(paths) + 1, len(self.names) + 1), -1, np.int32)  # the last row is no path, the last column no name
        for path, _ in paths[1:]:
            if path[-1] in self.names:
                step[number[path[:-1]], self.names[path[-1]]] = number[path]
        is_leaf = np.array([v is None for _, v in paths])
        found = {p: np.zeros(0, np.int64) for p, _ in paths}
        usable = self.fine[self.doc]
        outer, outer_state = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for level in range(1, int(self.level[usable].max(initial=0)) + 1):
            at = np.flatnonzero((self.level == level) & usable)
            lone = self.kind[at] == _EMPTY
            held, at = at[lone], at[~lone]
            opens, closes = at[0::2], at[1::2]
            self.fine[self.doc[opens[self.name[opens] != self.name[closes]]]] = False
            under = lambda x: outer_state[np.searchsorted(outer, x) - 1]  # noqa: B023, E731
            state = np.zeros(len(opens), np.int32) if level == 1 else step[under(opens), self.name[opens]]
            known = state >= 0
            bare = (closes == opens + 1)[known]
            self.fine[self.doc[opens[known][bare != is_leaf[state[known]]]]] = False
            empty = np.ones(len(held), bool) if level == 1 else step[under(held), self.name[held]] >= 0
            self.fine[self.doc[held[empty]]] = False
            for k in np.unique(state[known]):
                found[paths[k][0]] = opens[state == k]
            outer, outer_state = opens, state
        return found

    def once(self, nodes: np.ndarray, holders: np.ndarray) -> np.ndarray:
        """The holder of each node; a document where one holds two is not plain."""
        holder = np.searchsorted(holders, nodes, "right") - 1
        self.fine[self.doc[nodes[1:][holder[1:] == holder[:-1]]]] = False
        return holder

    def texts(self, nodes: np.ndarray, holders: np.ndarray) -> pa.Array:
        """The text of the leaf in each holder, null if there is none; a text with blanks at its ends is not plain."""
        at = np.full(len(holders), -1, np.int64)
        at[self.once(nodes, holders)] = 2 * nodes + 1
        texts = self.pieces.take(pa.array(at, mask=at < 0))
        data, offsets = _flat(texts)
        some = np.flatnonzero(offsets[1:] > offsets[:-1])
        padded = some[(data[offsets[some]] <= 32) | (data[offsets[some + 1] - 1] <= 32)]
        self.fine[self.doc[at[padded] >> 1]] = False
        return texts.cast(pa.large_string()).cast(pa.string())


def tree_of(kind: DataType) -> dict | list | None:
    """Names of a schema of elements: None for a text, a list for a repeated element."""
    if isinstance(kind, ArrayType):
        return [tree_of(kind.elementType)]
    return {f.name: tree_of(f.dataType) for f in kind} if isinstance(kind, StructType) else None


def _inner(node: dict | list | None) -> dict:
    return (node[0] if isinstance(node, list) else node) or {}


def _fields(tree: dict) -> set[str]:
    return {*tree}.union(*(_fields(_inner(v)) for v in tree.values()))


def _built(tags: Tags, found: dict, tree: dict, path: tuple[str, ...], holders: np.ndarray) -> pa.Array:
    """A struct per holder: its texts and elements, of a repeated element a list."""
    out: dict[str, pa.Array] = {}
    for k, v in tree.items():
        nodes = found[p := (*path, k)]
        if v is None:
            out[k] = tags.texts(nodes, holders)
        elif isinstance(v, list):
            offsets = np.append(np.searchsorted(nodes, holders), len(nodes)).astype(np.int32)
            out[k] = pa.ListArray.from_arrays(pa.array(offsets), _built(tags, found, v[0], p, nodes))
        else:
            tags.once(nodes, holders)
            out[k] = _built(tags, found, v, p, holders)
    return pa.StructArray.from_arrays([*out.values()], [*out])


def read(column: pa.Array, tree: dict) -> pa.Array:
    """A struct per document after ``tree_of`` its schema; null if it is not plain."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    total, at, out, fields = np.cumsum(sizes), 0, [], _fields(tree)
    while at < len(column) or not out:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + CHUNK, "right")))
        tags = Tags(column.slice(at, to - at), fields)
        rows = _built(tags, tags.nodes(tree), tree, (), tags.begin[:-1])
        row = np.cumsum(tags.good) - 1
        tags.good[tags.good] = tags.fine
        out.append(rows if tags.good.all() else rows.take(pa.array(row, mask=~tags.good)))
        at = to
    return pa.concat_arrays(out)
