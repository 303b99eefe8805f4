"""Near-duplicate components by the resemblance of word-shingle sets, for the pipeline's stage.

Resemblance is the shared part of two texts' distinct shingles (intersection over
union). Texts with equal sets are one node. Two texts at 0.8 differ in about ten of
64 SimHash bits, so the tries of `simhash`, within BUDGET bits, give the closest
pairs only; more candidates agree in one of 20 bands of five minima (at
resemblance 0.8 two nodes do with probability 0.9996). Each candidate is verified
on the whole sets, so no link is wrong.

The tries' pairs and neighbours within a bucket are verified first, which joins
most of a group of copies; then all pairs of a bucket that these links leave apart.
In buckets above CAP such pairs are first weighed by their minima, in blocks: those
that share fewer than WEIGHED of 100 are passed over (at 0.8 they share 80; that
they share so few has a probability of about 10**-6). No bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from . import simhash
from .common import cut, written
from .simhash import components, shingle_hashes

WIDTH, LEAST, SEED = 5, 0.8, 42
#: Bits in which two texts' fingerprints may differ to be candidates.
BUDGET = 2
BANDS, ROWS = 20, 5
#: Members of a bucket that one task pairs by itself; minima, of all, that a pair of a larger one shares.
CAP, WEIGHED = 128, 60
#: Members, and members outside the bucket's largest component, of a block of a large bucket.
BLOCK, PROBES = 4096, 512
_MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of the distinct shingles, sorted. Fewer words than width: one shingle of all. No words: none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width, SEED)]))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, at : at + 1024] * _MULTIPLIERS[:, None]).min(1), out=least)
    return least ^ least >> np.uint64(29)


def bands(least: np.ndarray) -> np.ndarray:
    """One number a band: its minima, mixed."""
    mixed = (least * _MULTIPLIERS[::-1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return mixed ^ np.arange(BANDS, dtype=np.uint64) * _MULTIPLIERS[0]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


SKETCH = StructType([StructField("node", LongType()), StructField("n", LongType()), StructField("fp", LongType()), StructField("bands", ArrayType(LongType())), StructField("low", BinaryType())])


def _sketch(text: Column) -> Column:
    """struct(node, n, fp, bands, low): a hash of the shingle set, its size, its SimHash, its bands, a byte of each of its minima."""

    @F.arrow_udf(SKETCH)
    def of(texts: pa.Array) -> pa.Array:
        import xxhash

        nodes, sizes, prints, keys, low = [], [], [], [], []
        for t in texts:
            bits, found = simhash.BitCounts(), [np.zeros(0, np.uint64)]
            for hashes in shingle_hashes(t.as_py(), WIDTH, SEED):
                bits.add(hashes)
                found.append(hashes)
            h = np.unique(np.concatenate(found))
            least = minima(h)
            nodes.append(xxhash.xxh64_intdigest(h.tobytes()))
            sizes.append(len(h))
            prints.append(bits.fingerprint())
            keys.append(bands(least))
            low.append((least & np.uint64(255)).astype(np.uint8).tobytes())
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat.view(np.int64)))
        long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([long(nodes), pa.array(sizes, pa.int64()), long(prints), lists, pa.array(low, pa.binary())], SKETCH.names)

    return of(text)


def _set_of(text: Column) -> Column:
    @F.arrow_udf(ArrayType(LongType()))
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py()).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return of(text)


def _alike(a: Column, b: Column, least: float) -> Column:
    @F.arrow_udf(BooleanType())
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        sets = ((p.values.to_numpy(zero_copy_only=False), q.values.to_numpy(zero_copy_only=False)) for p, q in zip(x, y))
        return pa.array([resemblance(p, q) >= least for p, q in sets], pa.bool_())

    return of(a, b)


def _as_pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])


def _pairs(rows: DataFrame, reach: int, least: float) -> DataFrame:
    """(a, b) of rows (key, node, n, root), sorted by key within partitions, at most reach places apart under one key, whose roots differ and whose sizes allow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            key, node, n, root = held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "node", "n", "root"))]
            for d in range(1, min(reach + 1, len(key))):
                same = key[d:] == key[:-d]
                if not same.any():
                    break
                ok = same & (root[d:] != root[:-d]) & (np.minimum(n[d:], n[:-d]) >= least * np.maximum(n[d:], n[:-d]))
                if ok.any():
                    yield _as_pairs(node[d:][ok], node[:-d][ok])
            # The last key's rows may go on in the next batch.
            held = [h[-reach:] for h in held]

    return rows.select("key", "node", "n", "root").mapInArrow(run, "a long, b long").distinct()


def _weighed_pairs(rows: DataFrame, least: float, shards: int) -> DataFrame:
    """(a, b) of rows (key, node, n, root, low) under one key whose roots differ and whose sizes and minima allow it.

    Only members outside a key's largest root are compared with all of its members;
    both sides are dealt to blocks, so a task holds no more than a block of each.
    """
    roots = rows.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    apart = cut(roots.where("all > most").selectExpr("key", "main", f"cast(ceil(all / {BLOCK}) AS int) AS blocks", f"cast(ceil((all - most) / {PROBES}) AS int) AS probes"))
    some = rows.join(apart, "key").withColumns({"i": F.pmod(F.xxhash64("node"), "blocks"), "j": F.pmod(F.xxhash64(F.lit(1), "node"), "probes")})
    member = some.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("probes") - 1))).withColumn("tag", F.lit(0))
    probe = some.where("root <> main").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("tag", F.lit(1))
    # Blocks whose hashes are equal are compared with each other, too; all pairs are verified later.
    block = [F.xxhash64("key", F.col("i").cast("int"), F.col("j").cast("int")).alias("block"), F.col("tag").cast("byte").alias("tag"), "node", "n", "root", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, ready = None, [], None
        for batch in batches:
            at, tags, node, n, root = (batch.column(c).to_numpy() for c in ("block", "tag", "node", "n", "root"))
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(len(at), -1)
            edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (tags[1:] != tags[:-1])])).tolist() if len(at) else []
            for s, e in zip(edges, [*edges[1:], len(at)]):
                if at[s] != now:
                    now, members, ready = at[s], [], None
                if tags[s] == 0:
                    members.append((node[s:e], n[s:e], root[s:e], low[s:e]))
                    continue
                if not members:
                    continue
                ready = ready or tuple(np.concatenate(x) for x in zip(*members))
                others, sizes, theirs, lows = ready
                for k in range(s, e):
                    ok = (theirs != root[k]) & (np.minimum(sizes, n[k]) >= least * np.maximum(sizes, n[k]))
                    ok[ok] = (lows[ok] == low[k]).sum(1) >= WEIGHED
                    if ok.any():
                        yield _as_pairs(others[ok], np.full(int(ok.sum()), node[k]))

    dealt = member.select(*block).unionByName(probe.select(*block)).repartition(shards, "block").sortWithinPartitions("block", "tag")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _trie_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs that connect all nodes whose fingerprints are linked within BUDGET bits."""
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    linked = simhash.links(heads.select("fp"), BUDGET)
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    across = linked.join(head("a"), "a").join(head("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    within = nodes.join(heads.where("n > 1"), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return across.unionByName(within).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def links(signed: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): verified links between the nodes of rows (text, s) as _sketch gives them, enough to connect what candidates connect."""
    nodes = written(signed.groupBy("s.node").agg(*(F.any_value(f"s.{c}").alias(c) for c in ("n", "fp", "bands", "low"))), "nodes")
    dealt = nodes.select("node", "n", "bands", F.posexplode("bands").alias("i", "key")).select("node", "n", "key", F.get("bands", (F.col("i") + 1) % BANDS).alias("next"))
    sizes = cut(dealt.groupBy("key").count().where("count > 1"))
    dealt = written(dealt.join(sizes, "key"), "buckets")
    shards = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some_large = not sizes.where(F.col("count") > CAP).isEmpty()

    def by_key(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("count") <= CAP).repartition(shards, "key").sortWithinPartitions("key", "next", "node")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        members = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = signed.select("s.node", "text").join(members, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
        sets = written(texts.select("node", _set_of(F.col("text")).alias("set")), "sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        return cut(both.where(_alike(F.col("x"), F.col("y"), least)).select("a", "b"))

    alone = dealt.withColumn("root", F.col("node"))
    first = _trie_pairs(nodes).unionByName(_pairs(by_key(alone), 1, least))
    if some_large:
        first = first.unionByName(_pairs(alone.where(F.col("count") > CAP).repartitionByRange(shards, "key", "next", "node").sortWithinPartitions("key", "next", "node"), 1, least))
    near = verified(first.distinct())
    linked = dealt.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    then = _pairs(by_key(linked), CAP, least)
    if some_large:
        large = linked.where(F.col("count") > CAP).select("key", "node", "n", "root").join(nodes.select("node", "low"), "node")
        then = then.unionByName(_weighed_pairs(written(large, "large-buckets"), least, shards)).distinct()
    return near.unionByName(verified(then))


def keep_first(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with one document of each component: one row that has the least doc_id there. Rows without doc_id take part and stay."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    own = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    signed = written(docs.select("doc_id", "text", *(docs[f"`{c}`"].alias(n) for c, n in names.items()), _sketch(docs["text"]).alias("s")), "resemblance")
    roots = components(links(signed.select("text", "s"), least))
    first = signed.where("doc_id IS NOT NULL").groupBy("s.node").agg(F.min("doc_id").alias("doc_id"))
    member = first.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    kept = member.groupBy("root").agg(F.min_by(F.struct("node", "doc_id"), F.struct("doc_id", "node")).alias("k")).select(F.col("k.node").alias("__node"), F.col("k.doc_id").alias("__id"))
    found = signed.join(kept, (F.col("s.node") == F.col("__node")) & (F.col("doc_id") == F.col("__id")), "left_semi")
    one = found.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "s.node").orderBy(F.xxhash64("text")))).where("__nth = 1")
    return one.select(*own).unionByName(signed.where("doc_id IS NULL").select(*own))
