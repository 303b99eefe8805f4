"""LM scoring: a hidden Markov language model over a word vocabulary of any size.

A token's class is the token itself for the FREQUENT most frequent ones, else one
of BINS by the word's end; the states emit classes, a class emits its words by
add-one counts. So the states' tables are of fixed size, while words are counted
over the whole corpus and rare ones are looked up by a join in which, as they are
rare, no key is hot. Baum-Welch rounds run over all training documents, each as a
whole; their counts are summed across partitions.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import hmm
from .common import written
from .tokens import slices

#: The end of a text, as a token: no word holds a line break.
END = b"\n"
FREQUENT, BINS = 32_768, 1024
STATES, ROUNDS = 8, 4
#: Bins of equally frequent words, by hash, of which the last one may be taken in part.
TIES = 4096
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII blanks; null counts as empty."""
    return (text or "").encode("utf-8", "replace").lower().split()


def bin_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BINS


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n long): how often each token of docs' texts occurs, END once a document."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch):
                for t in part.column("text"):
                    counts.update(words_of(t.as_py()))
                counts[END] += part.num_rows
                if len(counts) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)
                    counts = Counter()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=schema)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Of fixed size, whatever the corpus: the frequent words and sums for each bin of rare ones."""

    total: int  # N
    distinct: int  # V
    frequent: dict[bytes, int]  # word -> its class, from 1; 0 is END
    counts: np.ndarray  # of each class
    bin_words: np.ndarray  # distinct words of each bin

    def unseen_log(self) -> np.ndarray:
        """log10 of what divides c + 1 in each class: 0 for a class of one word."""
        own = 1 + len(self.frequent)
        return np.concatenate([np.zeros(own), np.log10(self.counts[own:] + self.bin_words + 1)])


def frequent_words(words: DataFrame, most: int) -> list:
    """The `most` most frequent rows (word, n), all if fewer; equally frequent ones by their hash. Most frequent first.

    How far down they reach is told by three histograms, each over what the one
    before leaves open: grades of the logarithm, counts, bins of hashes. No more rows
    than asked for, and one bin, are gathered.
    """
    keys = [F.floor(F.log2("n") * 64), F.col("n"), F.pmod(F.xxhash64("word"), F.lit(TIES))]
    open_, sure, left = F.lit(True), F.lit(False), most
    for key, falling in zip(keys, (True, True, False)):
        bound = None
        for r in sorted(words.where(open_).groupBy(key.alias("k")).count().collect(), key=lambda r: -r.k if falling else r.k):
            if r["count"] > left:
                bound = r.k
                break
            left -= r["count"]
        if bound is None:
            sure = sure | open_
            break
        sure, open_ = sure | open_ & ((key > bound) if falling else (key <= bound)), open_ & (key == bound)
    found = words.where(sure).withColumn("h", F.xxhash64("word")).collect()
    return sorted(found, key=lambda r: (-r.n, r.h % TIES, r.h, bytes(r.word)))[:most]


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent_words(counts.where(F.col("word") != END), FREQUENT)
    frequent = {bytes(r.word): i + 1 for i, r in enumerate(top)}
    ends = counts.where(F.col("word") == END).collect()
    spark = counts.sparkSession
    own = F.broadcast(spark.createDataFrame([(w,) for w in [*frequent, END]], "word binary"))  # FREQUENT words
    tail = F.substring("word", -3, 3)
    tail = F.when(F.length("word") > 3, tail).otherwise(F.col("word"))
    rare = counts.join(own, "word", "left_anti").groupBy((F.crc32(tail) % BINS).alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(BINS), np.zeros(BINS)
    for r in rare:
        n[r.bin], v[r.bin] = r.n, r.v
    return Vocabulary(total, distinct, frequent, np.concatenate([[ends[0].n if ends else 0], [r.n for r in top], n]), v)


def encoded(docs: DataFrame, vocab: Vocabulary, train: Column) -> DataFrame:
    """One row a document: doc_id, train, uid, n_tokens, classes, the sums over its frequent tokens, and its rare words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    pair = pa.struct([("word", pa.binary()), ("tf", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("uid", pa.int64()), ("n_tokens", pa.int64()), ("classes", pa.binary()), ("frequent_log", pa.float64()), ("frequent_known", pa.int64()), ("rare", pa.list_(pair))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        get, own = v.frequent.get, 1 + len(v.frequent)
        logs, known = np.log10(v.counts + 1), v.counts > 0
        logs[own:], known[own:] = 0, False
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                sums, codes, names, times, ends = [], [], [], [], [0]
                for t in part.column("text"):
                    words = words_of(t.as_py())
                    classes = np.zeros(len(words) + 1, np.int64)
                    classes[:-1] = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    at = np.flatnonzero(classes < 0)
                    rare = [words[i] for i in at.tolist()]
                    classes[at] = [own + bin_of(w) for w in rare]
                    tf = Counter(rare)
                    names += tf
                    times += tf.values()
                    ends.append(len(names))
                    sums.append((len(classes), float(logs[classes].sum()), int(known[classes].sum())))
                    codes.append(classes.astype("<u2").tobytes())
                n = part.num_rows
                n_tokens, frequent_log, frequent_known = zip(*sums)
                pairs = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int32())], fields=list(pair))
                columns = [part.column("doc_id"), part.column("train"), np.arange(uid, uid + n), n_tokens, codes, frequent_log, frequent_known]
                uid += n
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], schema=schema)

    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, "doc_id long, train boolean, uid long, n_tokens long, classes binary, frequent_log double, frequent_known long, rare array<struct<word: binary, tf: int>>")


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in column]


def train(sequences: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> hmm.Model:
    """Baum-Welch over column `classes`: each round sums expected counts of all rows, one table of fixed size a task."""
    n = len(vocab.counts)
    model = hmm.initial(vocab.counts, states)
    names = [f"s{i}" for i in range(states)]
    schema = pa.schema([("key", pa.int32()), *((c, pa.float64()) for c in names)])
    context = sequences.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total = hmm.empty(n, states)
            for batch in batches:
                for part in slices(batch, "classes", 4_000_000):
                    hmm.expected(now, _sequences(part.column("classes")), total)
            rows = np.concatenate([total.emit, total.move, total.start[None]])
            key = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(pa.array(rows[key, s]) for s in range(states))], schema=schema)

        found = sequences.select("classes").mapInArrow(run, "key int, " + ", ".join(f"{c} double" for c in names)).groupBy("key").agg(*(F.sum(c).alias(c) for c in names)).orderBy("key").toPandas()
        rows = np.zeros((n + states + 1, states))
        rows[found["key"].to_numpy()] = found[names].to_numpy()
        model = hmm.reestimated(hmm.Model(rows[-1], rows[n:-1], rows[:n]), vocab.counts)
        shared.unpersist()
    return model


def score(docs: DataFrame, train_where: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every document, learning from those of train_where.

    `score` is the log10 probability of the text's tokens and its end under the
    hidden Markov model, `base_score` that of an add-one unigram. Null and empty
    texts are an end alone. Repeated rows are scored each on its own; a null in
    train_where counts as false. An empty table gives an empty table; without
    training rows every token is new.
    """
    train_where = F.coalesce(train_where, F.lit(False))
    counts = written(count_words(docs.where(train_where)), "word-counts")
    vocab = vocabulary(counts)
    rows = written(encoded(docs, vocab, train_where), "word-classes")
    model = train(rows.where("train"), vocab, states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((model, vocab.unseen_log()))
    schema = pa.schema([("uid", pa.int64()), ("hmm", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unseen = shared.value
        for batch in batches:
            for part in slices(batch, "classes", 4_000_000):
                found = _sequences(part.column("classes"))
                logs = hmm.log10_likelihood(now, found) - np.array([unseen[x].sum() for x in found])
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(logs)], schema=schema)

    states_log = rows.select("uid", "classes").mapInArrow(run, "uid long, hmm double")
    rare = rows.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.tf")
    rare = rare.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_log"),
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("rare_known"),
    )
    each = math.log10(vocab.total + vocab.distinct + 1)
    logs = F.coalesce("rare_log", F.lit(0.0))
    return (
        rows.select("uid", "doc_id", "train", "n_tokens", "frequent_log", "frequent_known").join(states_log, "uid").join(rare, "uid", "left")
        .select(
            "doc_id", "train", "n_tokens", (F.col("frequent_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(vocab.total).cast("long").alias("train_tokens"),
            (F.col("frequent_log") + logs - F.col("n_tokens") * each).alias("base_score"), (F.col("hmm") + logs).alias("score"),
        )
    )
