"""A discrete hidden Markov model in numpy: expected counts and exact likelihoods of batches of sequences.

Sequences are arrays of class numbers. Steps of many sequences are taken together.
Beyond STRETCH tokens a sequence is cut to stretches; each stretch's matrix from
state to state carries the forward state, and the backward one, over it exactly,
so stretches can be worked on side by side in memory that doesn't grow with the
sequence, and no transition is lost. The first stretch begins, and the last one
ends, with known states, so those two are carried as vectors. States are the rows
of all arrays and pieces the columns, so that each operation runs along many pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens of a stretch when scoring and when counting; results don't depend on either.
STRETCH, COUNTED = 1024, 1024
#: Tokens worked on together.
TOKENS = 1_048_576
#: Steps after which products of matrices are scaled.
SCALED = 8


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


def empty(classes: int, states: int) -> Model:
    return Model(np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)))


def initial(class_counts: np.ndarray, states: int, seed: int = 11) -> Model:
    """Emissions near the classes' shares, apart by chance; states that stay."""
    rng = np.random.default_rng(seed)
    emit = (class_counts[:, None] + 1) * rng.gamma(2.0, 1.0, (len(class_counts), states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def reestimated(counts: Model, class_counts: np.ndarray, weight: float = 1.0) -> Model:
    """The M step: each state's emissions are smoothed towards the classes' shares, all else by one."""
    share = (class_counts + 1) / (class_counts + 1).sum()
    smooth = weight * len(share)
    emit = (counts.emit + smooth * share[:, None]) / (counts.emit.sum(0) + smooth)
    norm = lambda x: (x + 1) / (x + 1).sum(-1, keepdims=True)
    return Model(norm(counts.start), norm(counts.move), emit)


def _batches(pieces: list[np.ndarray], tokens: int):
    """Pieces sorted by length, longest first, as (steps, pieces) arrays of about so many tokens, and how many pieces reach each step."""
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    at = 0
    while at < len(order):
        part = order[at : at + max(1, tokens // len(pieces[order[at]]))]
        at += len(part)
        lengths = np.array([len(pieces[i]) for i in part])
        ids = np.zeros((lengths[0], len(part)), np.int64)
        for c, i in enumerate(part):
            ids[: lengths[c], c] = pieces[i]
        yield np.array(part), ids, (lengths[:, None] > np.arange(lengths[0])).sum(0)


def _levelled(emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each class's emissions, the largest of them made 1, and the logarithms of what they were divided by."""
    top = emit.max(1)
    return emit / top[:, None], np.log10(top)


def _forward(pieces: list[np.ndarray], emit: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(states, pieces): the forward shares at the last token of each piece that begins a sequence; and log10 of its probability."""
    shares, logs = np.zeros((len(model.start), len(pieces))), np.zeros(len(pieces))
    back = np.ascontiguousarray(model.move.T)
    for part, ids, reach in _batches(pieces, TOKENS):
        a = np.tile(model.start[:, None], (1, len(part)))
        scale = np.ones(ids.shape)
        for t in range(len(ids)):
            k = reach[t]
            x = (back @ a[:, :k] if t else a[:, :k]) * emit.take(ids[t, :k], axis=0).T
            scale[t, :k] = c = x.sum(0)
            np.divide(x, c, out=a[:, :k])
        shares[:, part], logs[part] = a, np.log10(scale).sum(0)
    return shares, logs


def _backward(pieces: list[np.ndarray], emit: np.ndarray, model: Model) -> np.ndarray:
    """(states, pieces): the backward weights, scaled, at the token before each piece that ends a sequence."""
    weights = np.ones((len(model.start), len(pieces)))
    for part, ids, reach in _batches(pieces, TOKENS):
        b = np.ones((len(model.start), len(part)))
        for t in range(len(ids) - 1, -1, -1):
            k = reach[t]
            x = model.move @ (b[:, :k] * emit.take(ids[t, :k], axis=0).T)
            np.divide(x, x.max(0), out=b[:, :k])
        weights[:, part] = b
    return weights


def _carried(pieces: list[np.ndarray], emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the matrix from the state at its first token to that at its last one, with all its emissions, scaled; and log10 of the scale."""
    states = emit.shape[1]
    matrices, logs = np.zeros((len(pieces), states, states)), np.zeros(len(pieces))
    back = np.ascontiguousarray(move.T)
    for part, ids, reach in _batches(pieces, TOKENS // states):
        m = np.eye(states)[:, :, None] * emit.take(ids[0], axis=0).T[:, None, :]  # (state now, state at first, piece)
        for t in range(1, len(ids)):
            k = reach[t]
            x = (back @ m[:, :, :k].reshape(states, -1)).reshape(states, states, k)
            np.multiply(x, emit.take(ids[t, :k], axis=0).T[:, None, :], out=m[:, :, :k])
            if t % SCALED == 0 or t + 1 == len(ids):
                c = m.max((0, 1))
                m /= c
                logs[part] += np.log10(c)
        matrices[part] = m.transpose(2, 1, 0)
    return matrices, logs


def _edges(model: Model, emit: np.ndarray, pieces: list[np.ndarray], first: np.ndarray, last: np.ndarray):
    """begins, before, ends, (states, pieces): the state weights with which each piece begins, those at the token before it, and the backward weights at its last token."""
    states = len(model.start)
    begins, before, ends = np.tile(model.start[:, None], (1, len(pieces))), np.zeros((states, len(pieces))), np.ones((states, len(pieces)))
    heads, tails, middles = (np.flatnonzero(x) for x in (first & ~last, last & ~first, ~first & ~last))
    before[:, heads + 1] = _forward([pieces[i] for i in heads], emit, model)[0]
    ends[:, tails - 1] = _backward([pieces[i] for i in tails], emit, model)
    matrices, _ = _carried([pieces[i] for i in middles], emit, model.move)
    for i, m in zip(middles, matrices):
        a = before[:, i] @ model.move @ m
        before[:, i + 1] = a / a.sum()
    for i, m in zip(middles[::-1], matrices[::-1]):
        b = model.move @ (m @ ends[:, i])
        ends[:, i - 1] = b / b.max()
    begins[:, ~first] = model.move.T @ before[:, ~first]
    return begins, before, ends


def expected(model: Model, sequences: list[np.ndarray], total: Model) -> float:
    """Add the Baum-Welch counts of whole sequences to total; their natural log likelihood."""
    level, logs = _levelled(model.emit)
    pieces = [s[at : at + COUNTED] for s in sequences for at in range(0, len(s), COUNTED)]
    first = np.array([at == 0 for s in sequences for at in range(0, len(s), COUNTED)], bool)
    last = np.append(first[1:], True) if len(first) else first
    edges = [x.astype(np.float32) for x in _edges(model, level, pieces, first, last)]
    emit, move = level.astype(np.float32), model.move.astype(np.float32)
    back = np.ascontiguousarray(move.T)
    n, states = emit.shape
    likelihood = 0.0
    for part, ids, reach in _batches(pieces, TOKENS):
        begins, before, ends = (x[:, part] for x in edges)
        steps, width = ids.shape
        alpha = np.zeros((steps, states, width), np.float32)
        scale = np.ones((steps, width), np.float32)
        seen = np.empty((steps, states, width), np.float32)
        for t in range(steps):
            k = reach[t]
            seen[t, :, :k] = emit.take(ids[t, :k], axis=0).T
            a = (begins if t == 0 else back @ alpha[t - 1, :, :k]) * seen[t, :, :k]
            scale[t, :k] = c = a.sum(0)
            np.divide(a, c, out=alpha[t, :, :k])
        likelihood += float(np.log(scale, dtype=np.float64).sum() + np.log(10) * logs[ids][np.arange(width) < reach[:, None]].sum())
        # Backward weights are such that their products with alpha are the states' shares.
        beta = np.ones((states, width), np.float32)
        pairs = np.zeros((states, states))
        for t in range(steps - 1, -1, -1):
            on = reach[t + 1] if t + 1 < steps else 0
            if on:
                pairs += _step(alpha[t, :, :on], seen[t + 1, :, :on], beta[:, :on], move)
            if on < reach[t]:  # pieces that end here
                now, b = alpha[t, :, on : reach[t]], ends[:, on : reach[t]]
                beta[:, on : reach[t]] = b / (now * b).sum(0)
            alpha[t] *= beta  # zero where the piece has ended
        begun = first[part]
        total.start += alpha[0][:, begun].sum(1)
        if not begun.all():
            pairs += _step(before[:, ~begun], seen[0][:, ~begun], beta[:, ~begun], move)
        total.move += pairs * model.move
        flat = ids.ravel()
        for s in range(states):
            total.emit[:, s] += np.bincount(flat, alpha[:, s].ravel(), n)
    return likelihood


def _step(before: np.ndarray, seen: np.ndarray, beta: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Counts of moves over one step, but for the factor move; beta goes back by the step, in place."""
    ahead = seen * beta
    back = move @ ahead
    z = (before * back).sum(0)
    np.divide(back, z, out=beta)
    ahead /= z
    return before @ ahead.T


def log10_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each sequence by the scaled forward recursion; stretches beyond the first are carried by their matrices."""
    emit, per_class = _levelled(model.emit)
    alphas, logs = _forward([s[:STRETCH] for s in sequences], emit, model)
    owners = [i for i, s in enumerate(sequences) for _ in range(STRETCH, len(s), STRETCH)]
    rest = [s[at : at + STRETCH] for s in sequences for at in range(STRETCH, len(s), STRETCH)]
    for i, m, x in zip(owners, *_carried(rest, emit, model.move)):
        a = alphas[:, i] @ model.move @ m
        c = a.sum()
        alphas[:, i] = a / c
        logs[i] += np.log10(c) + x
    return logs + np.array([per_class[s].sum() for s in sequences])
