"""Approximate nearest neighbours by inner product: an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids; a pair of
centroids is a cell. A query walks the pairs by summed distance (here the negated
inner products with its halves) with a heap until the cells hold enough vectors,
and their entries are reranked by exact inner products in double precision.

Equal vectors are one entry with as many of the smallest ids as can ever be
returned, so a vector that a third of all rows share is scored once. Neighbouring
cells make blocks of like size, large cells are split over several; a task holds
one block and streams the queries past it. Only the centroids, cell counts and
block numbers, of bounded size, are gathered.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

#: Vectors that centroids and the number of candidates are fitted on, and centroids of each half, at most.
SAMPLE, CENTROIDS = 20_000, 512
#: Share of the true neighbours of sample queries that the candidates must hold.
RECALL = 0.95
SAMPLE_QUERIES = 200
#: Entries of a block, about.
BLOCK = 2000


def fit_half(x: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), count, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=count)
        c[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = x.shape[1] // 2
        return nearest(x[:, :h], self.first) * len(self.second) + nearest(x[:, h:], self.second)

    def walk(self, query: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
        """Cells by summed distance until they hold `wanted` entries; empty cells are passed over."""
        h, n = len(query) // 2, len(self.second)
        da, db = -(self.first @ query[:h]), -(self.second @ query[h:])
        oa, ob = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        da, db = da[oa].tolist(), db[ob].tolist()
        heap, out, held = [(da[0] + db[0], 0, 0)], [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * n + ob[j]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            if j + 1 < len(db):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(da):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return out


def fit(sample: np.ndarray, total: int, k: int) -> tuple[Index, float]:
    """An index, and the share of all entries that holds RECALL of the k nearest of the sample's own queries."""
    want = min(CENTROIDS, len(sample), max(1, int(2 ** round(np.log2(max(1.0, np.sqrt(total) / 2))))))
    h = sample.shape[1] // 2
    index = Index(fit_half(sample[:, :h], want), fit_half(sample[:, h:], want, seed=4))
    rng = np.random.default_rng(7)
    asked = sample[rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)]
    cells = index.cells(sample)
    order = -((asked[:, :h] @ index.first.T)[:, cells // want] + (asked[:, h:] @ index.second.T)[:, cells % want])
    rank = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1)
    top = np.argsort(-(asked @ sample.T), axis=1)[:, : k + 1]
    ranks = np.sort(np.take_along_axis(rank, top, axis=1).ravel())
    return index, float(ranks[min(len(ranks) - 1, int(RECALL * len(ranks)))] + 1) / len(sample)


def _entries(vectors: DataFrame, every: int, keep: int) -> DataFrame:
    """One row a distinct valid vector, ids cut to the smallest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("vec", pa.binary()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0 is 0
                if len(x) and np.isfinite(x).all() and x.any():
                    data = x.tobytes()
                    h = xxhash.xxh3_128_intdigest(data)
                    rows.append(((h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63), data, i))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "a long, b long, vec binary, id long")
    few = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, keep)
    # In levels by ranges of ids, so that no group is large: one vector may have a third of the rows.
    ones = rows.groupBy("a", "b", F.floor(F.col("id") / 1000).alias("part")).agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.collect_set("id")), 1, keep).alias("ids"), F.max(F.col("id") % every == 0).alias("asks"))
    salted = ones.groupBy("a", "b", F.floor(F.col("part") / 1000).alias("part")).agg(F.first("vec").alias("vec"), few("ids").alias("ids"), F.max("asks").alias("asks"))
    return salted.groupBy("a", "b").agg(F.first("vec").alias("vec"), few("ids").alias("ids"), F.max("asks").alias("asks"))


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row whose vec_id is divisible by `every`.

    vectors has vec_id and embedding (an array of numbers). A row is no candidate
    of its own; ties go to the smaller vec_id; with fewer candidates than k all are
    returned. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without vec_id, take no part; nor do those of another length
    than most distinct vectors have (of equally many the shorter). Repeated vec_ids
    count once a vector. Other columns are ignored.
    """
    spark = vectors.sparkSession
    keep = k + 1
    entries = written(_entries(vectors, every, keep), "entries")
    size = F.octet_length("vec")
    usual = entries.groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, entries = usual["count"], entries.where(size == usual["size"])
    # Keys are hashes: those below a bound are a sample of about the size wanted, and no task sends more than its share.
    bound = min((1 << 63) - 1, int(0.97 * SAMPLE / total * (1 << 64)) - (1 << 63))
    drawn = entries.where(F.col("a") <= F.lit(bound)) if total > SAMPLE else entries
    sample = np.stack([np.frombuffer(r.vec, "<f8") for r in drawn.limit(SAMPLE).select("vec").collect()])
    index, share = fit(sample, total, k)
    wanted = max(keep, int(np.ceil(share * total)))
    shared_index = spark.sparkContext.broadcast(index)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v.as_buffer(), "<f8") for v in batch.column("vec")])
                yield batch.append_column("cell", pa.array(shared_index.value.cells(x).astype(np.int32)))

    coded = written(entries.select("a", "b", "vec", "ids", "asks").mapInArrow(code, "a long, b long, vec binary, ids array<long>, asks boolean, cell int"), "coded")
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in coded.groupBy("cell").count().collect():  # CENTROIDS squared at most
        counts[r["cell"]] = r["count"]
    parts = np.maximum(1, -(-counts // (2 * BLOCK)))  # large cells are split
    begin = np.cumsum(counts) - counts
    block = begin // BLOCK + np.cumsum(parts - 1) - (parts - 1)
    shared = spark.sparkContext.broadcast((counts, block, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, block, parts = shared.value
        for batch in batches:
            cell, a = batch.column("cell").to_numpy(), batch.column("a").to_numpy()
            at = block[cell] + (a % parts[cell])
            n = len(cell)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(np.zeros(n, np.int8)), *(batch.column(c) for c in ("a", "b", "vec", "ids")), pa.array(cell[:, None].tolist(), pa.list_(pa.int32()))], schema=dealt)

    dealt = pa.schema([("block", pa.int64()), ("tag", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32()))])
    kinds = "block long, tag byte, a long, b long, vec binary, ids array<long>, cells array<int>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, block, parts = shared.value
        listed = counts.tolist()
        for batch in batches:
            for a, b, v in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "vec"))):
                at: dict[int, list[int]] = {}
                for cell in shared_index.value.walk(np.frombuffer(v, "<f8"), listed, wanted):
                    for p in range(parts[cell]):
                        at.setdefault(int(block[cell]) + p, []).append(cell)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((at.keys(), [1] * n, [a] * n, [b] * n, [v] * n, [[]] * n, at.values()), dealt)], schema=dealt)

    met = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vecs, cells, ids, ready = None, [], [], [], None
        for batch in batches:
            rows = []
            for blk, tag, a, b, v, own, at in zip(*(batch.column(c).to_pylist() for c in dealt.names)):
                if blk != now:
                    now, vecs, cells, ids, ready = blk, [], [], [], None
                if tag == 0:
                    vecs.append(v)
                    cells.append(at[0])
                    ids.append(own)
                    continue
                if ready is None:
                    ready = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1), np.array(cells), np.array([x[0] for x in ids])
                x, cell, least = ready
                some = np.flatnonzero(np.isin(cell, at))
                s = x[some] @ np.frombuffer(v, "<f8")
                if len(s) > keep:
                    bar = np.partition(s, len(s) - keep)[len(s) - keep]
                    some, s = some[s >= bar], s[s >= bar]
                best = np.lexsort((least[some], -s))[:keep]
                pairs = [(i, float(s[m])) for m in best for i in ids[some[m]]]
                rows.append((a, b, [p[0] for p in pairs], [p[1] for p in pairs]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), met)], schema=met)

    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probes = coded.where("asks").select("a", "b", "vec").mapInArrow(ask, kinds)
    both = coded.mapInArrow(deal, kinds).unionByName(probes).repartition(blocks, "block").sortWithinPartitions("block", "tag")
    found = both.mapInArrow(rerank, "a long, b long, ids array<long>, scores array<double>")
    pair = F.arrays_zip(F.transform("scores", lambda s: -s).alias("far"), F.col("ids").alias("vec_id"))
    best = found.select("a", "b", F.transform(pair, lambda p: F.struct(p["far"].alias("far"), p["vec_id"].alias("vec_id"))).alias("p")).groupBy("a", "b").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, keep).alias("best"))
    asking = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id") % every == 0)
    queries = _keys(asking)
    rows = queries.join(best, ["a", "b"]).select("query_id", F.slice(F.filter("best", lambda p: p["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return rows.select("query_id", F.posexplode("best").alias("p", "n")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.far")).alias("score"))


def _keys(vectors: DataFrame) -> DataFrame:
    """query_id and the key of its vector, of every valid row."""
    schema = pa.schema([("query_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if v.is_valid and not v.values.null_count:
                    h = xxhash.xxh3_128_intdigest((v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0).tobytes())
                    rows.append((i, (h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, a long, b long").distinct()
