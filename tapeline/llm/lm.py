"""Log-bilinear language model over word classes, trained with noise-contrastive estimation.

A token's probability is that of its class after the two classes before it,
times that of the word within its class.  The most frequent words are classes of
their own, the others fall into classes by ending, script and length.

* Word counts cover all training texts: distinct words meet by hash bucket and
  the counts go back to the blocks that asked (``vocab``).
* Class trigram counts cover all training texts too; there are at most CLASSES**3
  of them whatever the corpus, so one numpy process trains on all of them,
  none drawn or left out.
* The log-bilinear part predicts a class vector from two context vectors; batched
  matrix products over all pairs of context classes give a table of normalised
  log-probabilities, which is broadcast (bounded by CLASSES**3)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab
from .tables import as_table, crc_mod
from .words import LOWER, NOT_SPACE, Words, flat, offsets_of

#: One row in FOLDS is held out of all counts.
FOLDS = 10
#: Words that are classes of their own; classes of the other words; the end of a text (also its start).
TOP, FEATURES = 112, 48
END = TOP + FEATURES
CLASSES = END + 1
#: Added to each count, for the base score and inside a class.
ALPHA = 0.1
#: STEPS is of an epoch.
WIDTH, EPOCHS, STEPS, NOISE, RATE, SCALE, SEED = 24, 24, 128, 64, 0.2, 45.0, 7


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    w = Words(LOWER[data], offsets, NOT_SPACE)
    return w.array(), w.counts


def features(words: pa.Array) -> np.ndarray:
    """A class below FEATURES for each word, by ending, first letter beyond ASCII and length."""
    data, offsets = flat(words)
    if not len(words):
        return np.zeros(0, np.int64)
    last = data[offsets[1:] - 1]
    letter = (last >= 0x80) | ((last >= 0x61) & (last <= 0x7A))
    ending = np.where(last == ord("."), 1, np.where(last == ord(","), 2, np.where(letter, 0, 3)))
    beyond = np.append(np.flatnonzero(data >= 0x80), len(data))
    first = beyond[np.searchsorted(beyond, offsets[:-1])]
    pair = np.append(data, [0, 0]).astype(np.int64)
    script = np.where(first < offsets[1:], 1 + (pair[first] * 31 + pair[np.minimum(first + 1, len(data))]) % 5, 0)
    return (ending * 6 + script) * 2 + (np.diff(offsets) > 6)


def classes(words: pa.Array, top: dict[bytes, int]) -> np.ndarray:
    out = TOP + features(words)
    values = words.to_pylist()
    for k, w in enumerate(values):
        if (c := top.get(w)) is not None:
            out[k] = c
    return out


_COUNTED = T.StructType(
    [*vocab.ROW.fields, T.StructField("n", T.LongType()), T.StructField("v", T.LongType())]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("class_n", "class_v", "top_n")]
    + [T.StructField("top", T.ArrayType(T.BinaryType()))]
)
_STATS = -1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and phase: phase 0 adds to the bucket's counts, phase 1 asks for them."""
    empty = [pa.array([None], t) for t in (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.binary()))]

    def stats(known: dict[bytes, int]) -> pa.RecordBatch:
        kind, n = features(pa.array(list(known), pa.large_binary())), np.fromiter(known.values(), np.int64, len(known))
        best = heapq.nlargest(TOP, known.items(), key=lambda x: (x[1], x[0]))
        of = lambda w: np.bincount(kind, weights=w, minlength=FEATURES).astype(np.int64).tolist()
        values = [0], [_STATS], [b""], [b""], [int(n.sum())], [len(known)], [of(n)], [of(None)], [[c for _, c in best]], [[w for w, _ in best]]
        kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], _COUNTED.names)

    bucket, known = None, {}
    for batch in batches:
        for key, k, phase, payload, extra in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "phase", "payload", "extra")), strict=True):
            if k != bucket:
                if bucket is not None:
                    yield stats(known)
                bucket, known = k, {}
            words = vocab.words_of(payload).to_pylist()
            if phase == 0:
                for w, n in zip(words, vocab.unpack(extra)[0].tolist(), strict=True):
                    if n:
                        known[w] = known.get(w, 0) + n
            else:
                got = vocab.rows([key], [k], [vocab.pack(np.array([known.get(w, 0) for w in words], np.int64))])
                yield pa.RecordBatch.from_arrays([*got.columns, *empty], _COUNTED.names)
    if bucket is not None:
        yield stats(known)


def train(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities [class before last, last class, class] from trigram counts.

    ``cells`` numbers the trigrams.  Every epoch goes through all of them, weighted
    by count, a run of contexts a step; noise is not drawn but has its expectation:
    NOISE times the class frequencies for each trigram of a context."""
    rng = np.random.default_rng(SEED)
    k = CLASSES
    unigram = np.bincount(cells % k, weights=n, minlength=k) + 1.0
    unigram /= unigram.sum()
    log_noise = np.log(NOISE * unigram)
    r, q = rng.normal(0, 0.1, (k, WIDTH)), rng.normal(0, 0.1, (k, WIDTH))
    c1, c2, b = np.eye(WIDTH) * 0.5, np.eye(WIDTH) * 0.8, np.log(unigram)
    params = [r, q, c1, c2, b]
    squares = [np.full(p.shape, 1e-3) for p in params]
    contexts, at = np.unique(cells // k, return_inverse=True)
    total = np.bincount(at, weights=n)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(len(contexts) + 1))
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(contexts))
        # steps of about equal counts: a step takes contexts until it has its share of all trigrams
        share = (np.cumsum(total[mixed]) - total[mixed]) * STEPS // max(1, n.sum())
        for own in np.split(mixed, np.flatnonzero(np.diff(share)) + 1) if len(mixed) else []:
            mine = order[np.concatenate([np.arange(cuts[c], cuts[c + 1]) for c in own])]
            size = np.diff(cuts)[own]
            real = np.zeros((len(own), k))
            real[np.repeat(np.arange(len(own)), size), cells[mine] % k] = n[mine]
            w1, w2 = contexts[own] // k, contexts[own] % k
            h = r[w1] @ c1 + r[w2] @ c2
            p_real = 1 / (1 + np.exp(-(h @ q.T + b - log_noise)))
            noise = total[own][:, None] * (NOISE * unigram)
            g = ((real + noise) * p_real - real) * (STEPS / n.sum())
            dh = g @ q
            grads = [np.zeros_like(r), g.T @ h, r[w1].T @ dh, r[w2].T @ dh, g.sum(0)]
            np.add.at(grads[0], w1, dh @ c1.T)
            np.add.at(grads[0], w2, dh @ c2.T)
            for p, s, d in zip(params, squares, grads, strict=True):
                d *= SCALE
                s += d * d
                p -= RATE * d / np.sqrt(s)
    out = np.empty((k, k, k), np.float32)
    second = r @ c2
    for c, first in enumerate(r @ c1):
        score = (second + first) @ q.T + b
        score -= score.max(1, keepdims=True)
        out[c] = (score - np.log(np.exp(score).sum(1, keepdims=True))) / np.log(10)
    return out


def _sequence(ranks: np.ndarray, counts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, class and the two classes before of every token, ends included; and where the words are."""
    rows = np.repeat(np.arange(len(counts)), counts + 1)
    starts = offsets_of(counts + 1)
    seq = np.full(len(rows), END, np.int64)
    word = np.ones(len(rows), bool)
    word[starts[1:] - 1] = False
    seq[word] = kind[ranks]
    one, two = np.full(len(seq), END, np.int64), np.full(len(seq), END, np.int64)
    one[1:], two[2:] = seq[:-1], seq[:-2]
    one[starts[:-1]] = END
    two[starts[:-1]] = END
    short = starts[:-1] + 1
    two[short[short < starts[1:]]] = END
    return rows, seq, one, two, word


@dataclass
class Model:
    """Everything a task needs to score a block; sizes do not depend on the corpus."""

    table: np.ndarray
    top: dict[bytes, int]
    total: int
    distinct: int
    ends: int
    class_n: np.ndarray
    class_v: np.ndarray


def _trigrams(docs: DataFrame, text_col: str, train_col: str, top: dict[bytes, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vocab.blocks(batches, text_col, tokens):
            rows, seq, one, two, _ = _sequence(b.codes, b.counts, classes(b.words, top))
            use = b.part.column(train_col).to_numpy(zero_copy_only=False).astype(bool)[rows]
            cell, n = np.unique(((two * CLASSES + one) * CLASSES + seq)[use], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    return docs.select(train_col, text_col).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType())] + [
    T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
]


def _scores(model) -> object:
    def start():
        m: Model = model.value
        room = m.total + ALPHA * (m.distinct + 1)

        def make(ranks, counts, order, answers, kind) -> list[pa.Array]:
            seen = np.zeros(len(order), np.int64)
            seen[order] = np.concatenate([np.zeros(0, np.int64), *(vocab.unpack(a)[0] for a in answers)])
            rows, seq, one, two, word = _sequence(ranks, counts, kind)
            base, known, within = (np.empty(len(seq)) for _ in range(3))
            base[word], base[~word] = np.log10((seen + ALPHA) / room)[ranks], np.log10((m.ends + ALPHA) / room)
            known[word], known[~word] = (seen > 0)[ranks], m.ends > 0
            group = np.maximum(kind - TOP, 0)
            inside = np.log10((seen + ALPHA) / (m.class_n[group] + ALPHA * (m.class_v[group] + 1)))
            within[word], within[~word] = np.where(kind < TOP, 0.0, inside)[ranks], 0.0
            per = lambda x: np.bincount(rows, weights=x, minlength=len(counts))
            score = per(within + m.table[two, one, seq])
            return [pa.array(counts + 1), pa.array(per(known).astype(np.int64)), pa.array(np.full(len(counts), m.total)), pa.array(per(base)), pa.array(score)]

        return make

    return start


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, token counts, unigram ``base_score`` and the model's ``score`` (log10).

    Null text is empty: one token, the end.  A null id hashes as empty text (held
    out).  Without training rows every count is zero and the class model is
    uniform over noise.  Repeated rows count and are scored each time, other
    columns are not read, texts are scored whole.  ``docs`` is a stored table."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (crc_mod(id_col, FOLDS) != 0).alias("_train"))
    n = vocab.bucket_count(spark)

    def trained(b: vocab.Block) -> np.ndarray:
        use = b.part.column("_train").to_numpy(zero_copy_only=False).astype(bool)
        return np.bincount(b.codes[np.repeat(use, b.counts)], minlength=len(b.words))

    asked = vocab.word_rows(own, "_text", tokens, n, trained, ("_train",))
    asked = asked.withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1)))).repartition("bucket").sortWithinPartitions("bucket", "phase")
    counted = as_table(asked.mapInArrow(_counts, _COUNTED), "word_counts")

    stats = counted.where(F.col("bucket") == _STATS)
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    pairs = stats.select(F.explode(F.arrays_zip("top", "top_n")).alias("t")).select("t.top", "t.top_n").orderBy(F.desc("top_n"), "top").limit(TOP).collect()
    sums = stats.select(F.posexplode(F.arrays_zip("class_n", "class_v"))).groupBy("pos").agg(F.sum("col.class_n").alias("n"), F.sum("col.class_v").alias("v")).collect()
    ends = own.where("_train").count()
    class_n, class_v = np.zeros(FEATURES), np.zeros(FEATURES)
    for s in sums:
        class_n[s.pos], class_v[s.pos] = s.n, s.v
    top = {bytes(p.top): k for k, p in enumerate(pairs)}
    if top:
        kinds = features(pa.array(list(top), pa.large_binary()))
        np.subtract.at(class_n, kinds, [p.top_n for p in pairs])
        np.subtract.at(class_v, kinds, 1)

    cells = _trigrams(own, "_text", "_train", top).toPandas()
    cells = cells.sort_values("cell")
    table = train(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64))
    model = spark.sparkContext.broadcast(Model(table, top, total.n + ends, total.v + (ends > 0), ends, class_n, class_v))

    answers = counted.where(F.col("bucket") != _STATS)
    codes = vocab.code_rows(own, "_text", tokens, n, ("_id", "_train"), lambda b: classes(b.words, top))
    out = vocab.reassemble(answers, codes, own, ("_id", "_train"), FIELDS, _scores(model))
    return out.select(F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), *(f.name for f in FIELDS))
