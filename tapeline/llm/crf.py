"""Linear-chain conditional random fields in numpy.

An item (a line, a block) has one active feature per slot; its score for a label
is the sum of the features' weights.  Sequences lie one after another; all
sequences of a batch advance together, one item per step."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    #: [feature, label], [label before, label], [label of the first item]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        out = np.zeros((len(slots), len(self.start)))
        for k in range(slots.shape[1]):
            out += self.weights[slots[:, k]]
        return out


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequences from long to short, how many last beyond each step, and the longest length."""
    lengths = np.diff(rows)
    order = np.argsort(-lengths, kind="stable")
    top = int(lengths.max(initial=0))
    return rows[:-1][order], len(lengths) - np.searchsorted(np.sort(lengths), np.arange(top), "right"), top


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def forward_backward(model: Crf, emit: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward scores, log backward scores, and the log partition of each item's sequence."""
    first, alive, top = _order(rows)
    fore, back, norm = emit.copy(), np.zeros_like(emit), np.zeros(len(emit))
    if top:
        fore[first[: alive[0]]] += model.start
    for t in range(1, top):
        at = first[: alive[t]] + t
        fore[at] += _sum(fore[at - 1][:, :, None] + model.steps, 1)
    for t in range(top - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        back[at] = _sum(model.steps + (emit[at + 1] + back[at + 1])[:, None, :], 2)
    lengths = np.diff(rows)
    full = lengths > 0
    norm = np.repeat(_sum(fore[rows[1:][full] - 1], 1), lengths[full]) if full.any() else norm
    return fore, back, norm


def marginals(model: Crf, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    fore, back, norm = forward_backward(model, model.emissions(slots), rows)
    return np.exp(fore + back - norm[:, None])


def viterbi(model: Crf, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The best label of each item; ties take the smaller label."""
    best = model.emissions(slots)
    first, alive, top = _order(rows)
    came = np.zeros(best.shape, np.int64)
    if top:
        best[first[: alive[0]]] += model.start
    for t in range(1, top):
        at = first[: alive[t]] + t
        path = best[at - 1][:, :, None] + model.steps
        came[at] = path.argmax(1)
        best[at] += path.max(1)
    out = np.zeros(len(best), np.int64)
    lengths = np.diff(rows)
    last = rows[1:][lengths > 0] - 1
    out[last] = best[last].argmax(1)
    for t in range(top - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        out[at] = came[at + 1, out[at + 1]]
    return out


def train(slots: np.ndarray, labels: np.ndarray, rows: np.ndarray, n_features: int, n_labels: int, rounds: int = 150, l2: float = 1e-3, rate: float = 0.08, weight: np.ndarray | None = None) -> Crf:
    """Maximum likelihood by full-batch Adam; ``weight`` is a weight per sequence."""
    model = Crf(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    if not len(slots):
        return model
    lengths = np.diff(rows)
    w = np.repeat(np.ones(len(lengths)) if weight is None else weight, lengths)
    inner = np.ones(len(slots), bool)
    inner[rows[:-1][lengths > 0]] = False
    inner = np.flatnonzero(inner)
    heads = rows[:-1][lengths > 0]
    gold = np.zeros((len(slots), n_labels))
    gold[np.arange(len(slots)), labels] = 1
    total = w[heads].sum()
    params = [model.weights, model.steps, model.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        emit = model.emissions(slots)
        fore, back, norm = forward_backward(model, emit, rows)
        diff = (np.exp(fore + back - norm[:, None]) - gold) * w[:, None]
        pair = np.exp(fore[inner - 1][:, :, None] + model.steps + (emit[inner] + back[inner])[:, None, :] - norm[inner][:, None, None])
        pair[np.arange(len(inner)), labels[inner - 1], labels[inner]] -= 1
        grads = [np.zeros_like(p) for p in params]
        for y in range(n_labels):
            for k in range(slots.shape[1]):
                grads[0][:, y] += np.bincount(slots[:, k], weights=diff[:, y], minlength=n_features)
        grads[1] = (pair * w[inner][:, None, None]).sum(0)
        grads[2] = diff[heads].sum(0)
        for k, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = g / total + l2 * p
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model
