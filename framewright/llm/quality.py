"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes step over the whole text, each step overlapping the last;
a filter's response at a place is the sum of its weights for the bytes there. The
largest response of each filter over the text goes through a rectifier, and a
logistic layer makes one probability of all. Forward passes run in tasks; fitting
runs once, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import others
from .sample import label_sample
from .tokens import slices

WIDTH, STEP, FILTERS = 6, 1, 16
#: Rows drawn a label to fit on, and bytes of all their texts, at most: bounds of the sample fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 64_000_000
EPOCHS, BATCH, RATE = 8, 16, 0.02
#: Places evaluated at once.
PLACES = 32_768


def places_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes on end, each padded so that its steps are its own, and the first step of each."""
    sizes = [max(WIDTH, -(-len(t) // STEP) * STEP + WIDTH - STEP) for t in texts]
    data = np.frombuffer(b"".join(t.ljust(n, b"\0") + b"\0" * (-n % STEP) for t, n in zip(texts, sizes)), np.uint8)
    ends = np.cumsum([(n + n % STEP) // STEP for n in sizes])
    return data, ends - [(n + n % STEP) // STEP for n in sizes]


class Network:
    def __init__(self, tables: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.tables, self.bias, self.weights, self.offset = tables, bias, weights, offset  # (WIDTH, 256, FILTERS), ...

    def responses(self, data: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Responses of all filters at the steps from begin to end."""
        out = None
        for j in range(WIDTH):
            at = data[begin * STEP + j : (end - 1) * STEP + j + 1 : STEP]
            rows = self.tables[j].take(at, axis=0)
            out = rows if out is None else np.add(out, rows, out=out)
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The largest response of each filter in each text."""
        data, first = places_of(texts)
        best = np.full((len(texts), len(self.bias)), -np.inf, np.float32)
        last = np.append(first[1:], len(data) // STEP) - (WIDTH // STEP - 1)  # steps that fit
        jobs, begin = [], 0
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            for s in range(a, b, PLACES):
                jobs.append((i, s, min(s + PLACES, b)))
        while begin < len(jobs):
            stop, a = begin + 1, jobs[begin][1]
            while stop < len(jobs) and jobs[stop][2] - a <= PLACES:
                stop += 1
            found = self.responses(data, a, jobs[stop - 1][2])
            for i, s, e in jobs[begin:stop]:
                np.maximum(best[i], found[s - a : e - a].max(axis=0), out=best[i])
            begin = stop
        return best

    def strongest(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in one padded text, and its first step; PLACES at a time."""
        every = np.arange(len(self.bias))
        best, where = np.full(len(every), -np.inf, np.float32), np.zeros(len(every), np.int64)
        steps = len(data) // STEP - (WIDTH // STEP - 1)
        for s in range(0, steps, PLACES):
            found = self.responses(data, s, min(s + PLACES, steps))
            at = found.argmax(0)
            better = found[at, every] > best
            best[better], where[better] = found[at, every][better], s + at[better]
        return best, where

    def scores(self, texts: list[bytes]) -> np.ndarray:
        hidden = np.maximum(self.pooled(texts) + self.bias, 0).astype(np.float64)
        z = (hidden * self.weights).sum(axis=1) + self.offset  # row by row: equal texts score alike in any batch
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def gradients(net: Network, offset: float, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss by tables, bias, weights and offset; only the steps of largest response take part."""
    parts = [places_of([t])[0] for t in texts]
    found = [net.strongest(data) for data in parts]
    active = np.stack([best for best, _ in found]) + net.bias
    hidden = np.maximum(active, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.weights + offset, -30, 30)))
    up = (p - labels) / len(texts)
    back = np.outer(up, net.weights) * (active > 0)
    by_table, every = np.zeros_like(net.tables), np.arange(len(net.bias))
    for r, (data, (_, where)) in enumerate(zip(parts, found)):
        for j in range(WIDTH):
            np.add.at(by_table[j], (data[where * STEP + j], every), back[r])
    return [by_table, back.sum(0), hidden.T @ up, np.array([up.sum()], np.float32)]


def train(texts: list[bytes], labels: np.ndarray, prior: float, seed: int = 5) -> Network:
    """Adam on the mean log loss; then the offset moves from the sample's share of label 1 to prior."""
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    net = Network(tables, np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    offset = np.zeros(1, np.float32)
    params = [net.tables, net.bias, net.weights, offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    y, step = labels.astype(np.float32), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            grads = gradients(net, float(offset[0]), [texts[i] for i in pick], y[pick])
            grads[2] = grads[2] + 1e-4 * net.weights
            step += 1
            rate = RATE * (1 - epoch / EPOCHS * 0.8)
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    prior = float(np.clip(prior, 0.01, 0.99))
    net.offset = float(offset[0] + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def fit(rows: DataFrame, label: str = "quality", per_label: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Network:
    """A network for labelled rows (doc_id, text, 0/1 label). Labels' shares are those of all rows, not of the sample.

    Without drawn rows of both labels, scores are the share of label 1 (0.5 without
    any). Texts too long for max_bytes are not fitted on; all texts are scored.
    """
    shares = {r[label]: r["count"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    prior = shares.get(1, 0) / (sum(shares.values()) or 1) if shares else 0.5
    drawn = label_sample(rows, label, per_label, max_bytes)
    if len({r.label for r in drawn}) < 2:
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(np.log(prior / (1 - prior))))
    return train([r.text.encode("utf-8", "replace") for r in drawn], np.array([r.label for r in drawn]), prior)


def score(docs: DataFrame, net: Network, name: str = "quality_score") -> DataFrame:
    """docs with the probability of label 1 of each whole text. Null texts count as empty; a column of this name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((net.tables, net.bias, net.weights, net.offset))  # of fixed size

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        network = Network(*shared.value)
        for column in texts:
            found = [np.zeros(0)]
            for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), chars=2_000_000):
                found.append(network.scores([(t.as_py() or "").encode("utf-8", "replace") for t in part.column(0)]))
            yield pa.array(np.concatenate(found), pa.float64())

    of = F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)
    return docs.select(*others(docs, name), of(docs["text"]).alias(name))
