import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import hmm, lm, queries
from framewright.llm.common import in_training

from . import docs as D


def model(rng, states=3, classes=7):
    norm = lambda x: x / x.sum(-1, keepdims=True)
    emit = rng.random((classes, states)) + 0.05
    return hmm.Model(norm(rng.random(states)), norm(rng.random((states, states))), emit / emit.sum(0))


def forward(m, seq):
    """Plain recursion, without scaling tricks."""
    a = m.start * m.emit[seq[0]]
    log = 0.0
    for x in seq[1:]:
        c = a.sum()
        log, a = log + math.log10(c), (a / c) @ m.move * m.emit[x]
    return log + math.log10(a.sum())


def test_exact_likelihood_of_short_and_long(monkeypatch):
    monkeypatch.setattr(hmm, "STRETCH", 5)
    rng = np.random.default_rng(1)
    m = model(rng)
    seqs = [rng.integers(0, 7, n) for n in (1, 2, 5, 6, 10, 11, 57, 300)]
    assert hmm.log10_likelihood(m, seqs) == pytest.approx([forward(m, s) for s in seqs], rel=1e-10)


def test_all_sequences_sum_to_one():
    m = model(np.random.default_rng(4), 2, 3)
    seqs = [np.array([a, b, c, d]) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
    assert (10 ** hmm.log10_likelihood(m, seqs)).sum() == pytest.approx(1)


def test_expected_counts_are_those_of_enumeration():
    rng = np.random.default_rng(2)
    m = model(rng, 2, 4)
    seq = np.array([0, 3, 1, 1, 2])
    total = hmm.empty(4, 2)
    log = hmm.expected(m, [seq], total)
    weight, start, move, emit = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for code in range(32):
        path = [code >> i & 1 for i in range(5)]
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[x, b]
        weight += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for s, x in zip(path, seq):
            emit[x, s] += p
    assert log == pytest.approx(math.log(weight), rel=1e-5)
    for got, want in ((total.start, start), (total.move, move), (total.emit, emit)):
        assert got == pytest.approx(want / weight, rel=1e-4, abs=1e-6)


def plain_counts(m, seq):
    """Forward and backward weights of the whole sequence at once."""
    n, s = len(seq), len(m.start)
    a, b = np.zeros((n, s)), np.ones((n, s))
    a[0] = m.start * m.emit[seq[0]]
    a[0] /= a[0].sum()
    for t in range(1, n):
        a[t] = a[t - 1] @ m.move * m.emit[seq[t]]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[seq[t + 1]] * b[t + 1])
        b[t] /= b[t].sum()
    g = a * b
    g /= g.sum(1, keepdims=True)
    out = hmm.empty(*m.emit.shape)
    out.start += g[0]
    np.add.at(out.emit, seq, g)
    for t in range(1, n):
        x = a[t - 1][:, None] * m.move * (m.emit[seq[t]] * b[t])
        out.move += x / x.sum()
    return out


@pytest.mark.parametrize("counted", [1, 7, 64, 1024])
def test_counts_of_long_texts_are_whole(monkeypatch, counted):
    """No transition is lost where a text is cut, and no context: counts are those of the uncut recursion."""
    monkeypatch.setattr(hmm, "COUNTED", counted)
    monkeypatch.setattr(hmm, "TOKENS", 900)
    rng = np.random.default_rng(6)
    m = model(rng)
    seqs = [rng.integers(0, 7, k) for k in (1000, 1, 64, 65, 7, 129, 2500)]
    got = hmm.empty(7, 3)
    log = hmm.expected(m, seqs, got)
    want = [plain_counts(m, s) for s in seqs]
    assert log == pytest.approx(math.log(10) * sum(forward(m, s) for s in seqs), rel=1e-5)
    assert got.move.sum() == pytest.approx(sum(len(s) - 1 for s in seqs), rel=1e-4)
    for x in ("start", "move", "emit"):
        assert getattr(got, x) == pytest.approx(sum(getattr(w, x) for w in want), rel=2e-3, abs=1e-4)


def test_only_inner_stretches_cost_a_matrix(monkeypatch):
    """A text's first stretch and its last one are carried as vectors; a matrix, of as many times the work as there are states, is for those between."""
    carried, held = [], hmm._carried
    monkeypatch.setattr(hmm, "COUNTED", 64)
    monkeypatch.setattr(hmm, "_carried", lambda pieces, *more: carried.extend(map(len, pieces)) or held(pieces, *more))
    rng = np.random.default_rng(9)
    m = model(rng)
    for sizes, inner in (((1, 64, 65, 128), []), ((200, 3, 257), [64] * 5)):
        carried.clear()
        total = hmm.empty(7, 3)
        hmm.expected(m, [rng.integers(0, 7, k) for k in sizes], total)
        assert carried == inner and total.emit.sum() == pytest.approx(sum(sizes), rel=1e-5)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 3, 40) + 3 * (i % 2) for i in range(60)]
    counts = np.bincount(np.concatenate(seqs), minlength=6).astype(float)
    m, logs = hmm.initial(counts, 2), []
    for _ in range(6):
        total = hmm.empty(6, 2)
        logs.append(hmm.expected(m, seqs, total))
        m = hmm.reestimated(total, counts, 0.01)
    assert all(b > a - 1e-3 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0] + 100


@pytest.mark.parametrize("most", [0, 1, 7, 150, 999, 1000, 5000])
def test_frequent_words_fill_up_to_the_bound(spark, most):
    rng = np.random.default_rng(8)
    rows = [(f"w{i}".encode(), int(n)) for i, n in enumerate(rng.zipf(1.5, 1000) % 10**6 + 1)]
    got = lm.frequent_words(spark.createDataFrame(rows, "word binary, n long"), most)
    assert [r.n for r in got] == sorted((n for _, n in rows), reverse=True)[:most]
    assert len({bytes(r.word) for r in got}) == len(got) and {(bytes(r.word), r.n) for r in got} <= set(rows)


def base(rows, train):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w] + [None]
    counts = Counter(w for i, t in rows if train(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(w := split(t)), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows]


def check(got, rows, train):
    n, want = base(rows, train)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9) and g[4] < 0
    return n, got


@pytest.mark.parametrize("frequent", [3, 32_768])
def test_awkward(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    for extra in (False, True):
        docs = D.awkward(spark, extra)
        out = lm.score(docs, F.col("doc_id") != 3, states=2, rounds=2).collect()
        n, _ = check(out, D.TEXTS, lambda i: i is not None and i != 3)
        assert {r.train_tokens for r in out} == {n}
    assert lm.score(D.empty(spark), F.lit(True), 2, 1).collect() == []
    assert len(lm.score(D.awkward(spark), F.lit(False), 2, 1).collect()) == len(D.TEXTS)


def test_query_beats_the_unigram_on_held_out_texts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = queries.op5_lm_score(spark, sf_dir).collect()
    check(out, rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
