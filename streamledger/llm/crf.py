"""Linear-chain conditional random fields over hashed sparse features, in numpy.

A position's features are slots of one weight table; its label scores are the sum
of those rows. Training maximises the regularised conditional likelihood by Adam
over mini-batches of padded sequences. Decoding works on many sequences at once,
given as the rows of one score matrix and the sequences' lengths: long sequences
are cut into segments whose transfer matrices are multiplied, so the cost of a
batch follows its rows and not its longest sequence, and results stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT = 128


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # slot, label
    transitions: np.ndarray  # label before, label
    start: np.ndarray


def scores_of(weights: np.ndarray, slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Label scores of positions whose slots stand at offsets[k]:offsets[k + 1]; every position has a slot."""
    return np.add.reduceat(weights[slots], offsets[:-1], axis=0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sequences: list[tuple[list[np.ndarray], list[int]]], labels: list[str], slots: int, epochs: int = 8, batch: int = 64, rate: float = 0.05, l2: float = 1e-5, seed: int = 7) -> Crf:
    """sequences: for each, the slots of every position and the positions' labels."""
    n = len(labels)
    w, t, s = np.zeros((slots, n)), np.zeros((n, n)), np.zeros(n)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, t, s)]
    rng, step = np.random.default_rng(seed), 0
    by_length = sorted((k for k in range(len(sequences)) if sequences[k][1]), key=lambda k: len(sequences[k][1]))
    batches = [by_length[k : k + batch] for k in range(0, len(by_length), batch)]
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            held = [sequences[k] for k in batches[b]]
            length = np.array([len(y) for _, y in held])
            size, most = len(held), int(length.max())
            here = np.arange(most)[None, :] < length[:, None]
            flat = [f for x, _ in held for f in x]
            slot = np.concatenate(flat)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in flat])])
            e, gold = np.zeros((size, most, n)), np.zeros((size, most), np.int64)
            e[here] = scores_of(w, slot, offsets)
            gold[here] = np.concatenate([y for _, y in held])
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = s + e[:, 0]
            for k in range(1, most):
                go = _logsum(alpha[:, k - 1, :, None] + t, 1) + e[:, k]
                alpha[:, k] = np.where(here[:, k, None], go, alpha[:, k - 1])
            for k in range(most - 2, -1, -1):
                go = _logsum(t[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
                beta[:, k] = np.where(here[:, k + 1, None], go, 0.0)
            total = _logsum(alpha[:, -1], 1)
            post = np.exp(alpha + beta - total[:, None, None])
            dt = np.zeros_like(t)
            for k in range(1, most):
                m = here[:, k]
                dt += np.exp(alpha[m, k - 1, :, None] + t + (e[m, k] + beta[m, k])[:, None, :] - total[m, None, None]).sum(0)
                np.add.at(dt, (gold[m, k - 1], gold[m, k]), -1.0)
            de = post - np.eye(n)[gold]
            ds = de[:, 0].sum(0)
            per_slot = np.repeat(de[here], np.diff(offsets), axis=0)
            dw = np.stack([np.bincount(slot, weights=per_slot[:, c], minlength=slots) for c in range(n)], axis=1)
            step += 1
            for x, g, (m1, m2) in zip((w, t, s), (dw / size, dt / size, ds / size), moments, strict=True):
                g += l2 * x
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                x -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Crf(labels, w, t, s)


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of all sequences, longest first: where they start, their length, sequence and place in it."""
    pieces = -(-lengths // SEGMENT)
    seq = np.repeat(np.arange(len(lengths)), pieces)
    place = np.arange(len(seq)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (np.cumsum(lengths) - lengths)[seq] + place * SEGMENT
    size = np.minimum(SEGMENT, lengths[seq] - place * SEGMENT)
    order = np.argsort(-size, kind="stable")
    return first[order], size[order], seq[order], place[order], pieces


def _norm(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def posteriors(model: Crf, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward-backward: the probability of each label at each row; lengths are those of the sequences, none of them 0."""
    n = len(model.labels)
    if not len(scores):
        return np.zeros((0, n))
    b = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(model.transitions - model.transitions.max())
    begin = np.exp(model.start - model.start.max())
    first, size, seq, place, pieces = _segments(lengths)
    active = np.searchsorted(-size, -np.arange(SEGMENT), side="left")  # segments longer than k
    long = pieces[seq] > 1
    ahead, behind = np.ones((len(first), n)), np.ones((len(first), n))
    if long.any():
        # Transfer of a whole segment, from the state before it to the state at its end.
        m = np.tile(np.eye(n), (len(first), 1, 1))
        for k in range(SEGMENT):
            on = np.flatnonzero(long[: active[k]])
            if len(on):
                m[on] = _norm((m[on] @ a) * b[first[on] + k][:, None, :], (1, 2))
        row = np.full((len(lengths), pieces.max()), -1)
        row[seq, place] = np.arange(len(first))
        for k in range(1, pieces.max()):
            now = row[pieces > k, k]
            was = row[pieces > k, k - 1]
            # Before the first segment stands the start vector in place of a transition.
            from_ = _start_through(begin, m[was], a, b, first[was], size[was]) if k == 1 else np.einsum("si,sij->sj", ahead[was], m[was])
            ahead[now] = _norm(from_, 1)
        for k in range(pieces.max() - 2, -1, -1):
            now, then = row[pieces > k + 1, k], row[pieces > k + 1, k + 1]
            behind[now] = _norm(np.einsum("sij,sj->si", m[then], behind[then]), 1)
    alpha, beta = np.empty_like(b), np.empty_like(b)
    state = ahead.copy()
    for k in range(SEGMENT):
        c = active[k]
        if not c:
            break
        at = first[:c] + k
        into = state[:c] @ a
        if k == 0:
            into[place[:c] == 0] = begin
        state[:c] = alpha[at] = _norm(into * b[at], 1)
    state = behind.copy()
    for k in range(SEGMENT - 1, -1, -1):
        c = active[k]
        if not c:
            continue
        at = first[:c] + k
        beta[at] = state[:c]
        state[:c] = _norm((state[:c] * b[at]) @ a.T, 1)
    return _norm(alpha * beta, 1)


def _start_through(begin, m, a, b, first, size) -> np.ndarray:
    """State at the end of first segments: step through them from the start vector (they are whole segments here)."""
    state = _norm(begin * b[first], 1)
    for k in range(1, int(size.max())):
        state = _norm((state @ a) * b[first + k], 1)
    return state


def viterbi(model: Crf, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label sequence of each sequence; ties go to the smaller label. Sequences are decoded side by side, longest first."""
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    back = np.zeros((len(scores), len(model.labels)), np.int8)
    best = np.zeros(len(scores), np.int8)
    state = np.empty((len(order), len(model.labels)))
    for k in range(int(size[0]) if len(size) else 0):
        c = int(np.searchsorted(-size, -k, side="left"))
        at = start[:c] + k
        if k == 0:
            state[:c] = model.start + scores[at]
        else:
            go = state[:c, :, None] + model.transitions
            back[at] = go.argmax(axis=1)
            state[:c] = go.max(axis=1) + scores[at]
    label = state.argmax(axis=1) if len(order) else np.empty(0, np.int64)
    for k in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        c = int(np.searchsorted(-size, -k, side="left"))
        at = start[:c] + k
        best[at] = label[:c]
        label[:c] = back[at, label[:c]]
    return best
