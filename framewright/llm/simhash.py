"""SimHash fingerprints and near-duplicate components within a Hamming distance.

Each distinct fingerprint is handled once. Fingerprints are dealt by each of
budget + 1 blocks of their bits: two that differ in at most `budget` bits agree on
one block at least. Buckets of more than BUCKET fingerprints are dealt again, by
blocks of the bits that they were not dealt by, until none is larger; the fewer
bits are left, the fewer fingerprints a bucket can have. The buckets are binary
tries: pairs of nodes are walked together from the root, differing bits add up,
and a pair ends where its sum passes the budget. A bucket gives no more links than
members: enough to connect what it connects. Components come from star
contraction on the links.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from .common import cut, join_hot, written

BITS = 64
#: Members of a trie; results don't depend on it.
BUCKET = 1024
#: Bytes of text whose words are held at once.
CHUNK = 1_000_000
BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Node pairs that are expanded at once.
FRONTIER = 500_000


def shingle_hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text's words, in order, CHUNK bytes of text at a time. A-Z are lower-cased, words split at ASCII blanks.

    Fewer words than width: one shingle of all. No words: none.
    """
    import xxhash

    digest, data = xxhash.xxh64_intdigest, (text or "").encode().lower()
    words: list[bytes] = []
    at, some = 0, False
    while at < len(data):
        blank = BLANK.search(data, at + CHUNK) if at + CHUNK < len(data) else None
        end = blank.start() if blank else len(data)
        words += data[at:end].split()
        at = end
        if len(words) >= width:
            joined, n = b" ".join(words), len(words) - width + 1
            ends = np.cumsum([len(w) + 1 for w in words])
            yield np.fromiter((digest(joined[a:b], seed) for a, b in zip([0, *ends[: n - 1].tolist()], (ends - 1)[width - 1 :].tolist())), np.uint64, n)
            words, some = words[n:], True
    if words and not some:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)


class BitCounts:
    """How many of the hashes added have each bit."""

    def __init__(self):
        self.n, self.counts = 0, np.zeros(BITS, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for at in range(0, len(hashes), 65_536):
            part = hashes[at : at + 65_536].astype("<u8")
            self.counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        self.n += len(hashes)

    def fingerprint(self) -> int:
        """A bit is 1 if over half the hashes have it."""
        return int.from_bytes(np.packbits(self.counts * 2 > self.n, bitorder="little").tobytes(), "little")


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A text's fingerprint over its shingles, repeats included; 0 without words."""
    bits = BitCounts()
    for hashes in shingle_hashes(text, width, seed):
        bits.add(hashes)
    return bits.fingerprint()


def fingerprint_of(text: Column, width: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text column as a signed long; null counts as empty."""

    @F.arrow_udf(LongType())
    def of(texts: pa.Array) -> pa.Array:
        found = (simhash(t.as_py(), width, seed) for t in texts)
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return of(text)


def trie_links(keys: np.ndarray, prints: np.ndarray, budget: int) -> np.ndarray:
    """For each row the first row, in (key, print) order, that it is connected to within its key.

    All keys' tries are walked together, level by level; a node is a range of the
    sorted rows. Both arrays must be sorted by (key, print).
    """
    n = len(keys)
    root = np.arange(n)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if n else np.zeros(1, int)
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, a, b, c, d, err = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(depth, *(x[:half] for x in (a, b, c, d, err))), (depth, *(x[half:] for x in (a, b, c, d, err)))]
            continue
        leaf = (b - a == 1) & (d - c == 1)
        if leaf.any():
            x, y = a[leaf], c[leaf]
            near = np.bitwise_count(prints[x] ^ prints[y]) <= budget
            _hook(root, x[near], y[near])
            keep = ~leaf
            a, b, c, d, err = a[keep], b[keep], c[keep], d[keep], err[keep]
        if not len(a) or depth == BITS:
            if len(a):  # equal prints under one key
                for s, e in set(zip(a.tolist(), b.tolist())) | set(zip(c.tolist(), d.tolist())):
                    _hook(root, np.arange(s, e), np.full(e - s, s))
                _hook(root, a, c)
            continue
        ones = np.concatenate([[0], np.cumsum(prints >> np.uint64(BITS - 1 - depth) & np.uint64(1), dtype=np.int64)])
        m, k = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = (a == c) & (b == d)
        more = [
            (a, m, c, k, err, None), (m, b, k, d, err, None), (a, m, k, d, err + 1, None), (m, b, c, k, err + 1, ~same),
        ]
        parts = []
        for s, e, t, f, x, only in more:
            ok = (e > s) & (f > t) & (x <= budget)
            if only is None:
                ok &= ~((s == t) & (e == f) & (e - s == 1))  # a row with itself
            else:
                ok &= only
            parts.append([y[ok] for y in (s, e, t, f, x)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))
    return root


def _hook(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of x and y, pairwise; each root is its component's first row."""
    while len(x):
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]


def _deeper(mask: int, budget: int) -> list[int]:
    """mask with each of budget + 1 blocks of the other bits added. Prints that agree on mask and differ in budget bits at most agree on one of these."""
    free = [b for b in reversed(range(BITS)) if not mask >> b & 1]
    ends = [len(free) * i // (budget + 1) for i in range(budget + 2)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(ends, ends[1:])]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << BITS) if x >> BITS - 1 else x).cast("long")


def _dealt(prints: DataFrame, budget: int) -> DataFrame:
    """(key, fp): the buckets, in which all prints within `budget` bits of each other meet."""
    open_, masks, found = prints.select("fp", F.lit(0).cast("long").alias("mask")), [0], []
    while True:
        parts = F.create_map(*(x for m in masks for x in (_signed(m), F.array(*map(_signed, _deeper(m, budget))))))
        dealt = open_.select("fp", F.explode(parts[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        deeper = [d for m in masks for d in _deeper(m, budget)]
        masks = sorted(set(deeper))
        if len(masks) < len(deeper):  # two masks may lead to the same one
            dealt = dealt.distinct()
        if BITS - min(m.bit_count() for m in masks) <= budget:  # a bucket has 2 ** budget prints at most
            found.append(dealt)
            break
        large = cut(dealt.groupBy("mask", "value").count().where(F.col("count") > BUCKET).select("mask", "value"))
        if large.isEmpty():
            found.append(dealt)
            break
        found.append(dealt.join(large, ["mask", "value"], "left_anti"))
        open_ = written(dealt.join(large, ["mask", "value"], "left_semi").select("fp", "mask"), "large-buckets")
    # Keys whose hashes are equal share a trie, where links are measured all the same.
    return functools.reduce(DataFrame.unionByName, (x.select(F.xxhash64("mask", "value").alias("key"), "fp") for x in found))


def links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column `fp` that connect all within `budget` bits, and no others."""
    if not 0 <= budget < BITS:
        raise ValueError("budget must be a number of bits")
    shards = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((fps, keys))
            fps = fps[order]
            root = trie_links(keys[order], fps, budget)
            far = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(fps[far].view(np.int64)), pa.array(fps[root[far]].view(np.int64))], schema=schema)

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            # The last key's rows may go on in the next batch.
            whole = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if len(keys) and (keys != keys[-1]).any() else 0
            if whole:
                yield linked(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield linked(keys, fps)

    return _dealt(prints, budget).repartition(shards, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (a, b) and the least node reachable, by alternate large and small stars."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a")
        now = cut(star.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == mark:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = found


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, budget: int = 2) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id among the documents reachable by links.

    One row for each row of docs, also for repeated ones. Null texts count as
    empty; texts without words have fingerprint 0 and link like any other. Rows
    without doc_id keep a null there and take part; a component of such rows
    alone has a null component_id. An empty table gives an empty table.
    """
    prints = written(docs.select("doc_id", fingerprint_of(docs["text"], width, seed).alias("fp")), "simhash")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), budget))
    member = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    found = cut(join_hot(member.select("fp", "n", "root"), least, "root", "size").select("fp", "n", "component_id"))
    return join_hot(prints, found, "fp", "n").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, width: int = 3, seed: int = 42, budget: int = 2) -> DataFrame:
    """docs with one document of each component: the one with the component's id. Of rows that repeat this id, one stays. Rows without doc_id stay."""
    kept = near_duplicates(docs, width, seed, budget).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    found = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    # Tasks keep one of repeats before rows move.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = found.groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text")).alias("__row")).select("__row.*")
    return first.unionByName(docs.where("doc_id IS NULL"))
