"""Token-id files: Simple-8b blocks in ascending doc_id order.

A word of 64 bits holds a selector in its top 4 bits and up to 60 ids of equal
width below; ids wider than the widest selector follow an escape word raw. A
block has its own words and decodes by itself, one vectorised pass for each
selector. For each of its documents it also has the word in which the document
begins and the ids of that word that come before, so that one document can be
read without the block's other words. A file row is one block, so any store that
Spark writes to can hold the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import text_of
from .tokens import slices, word_ids

#: (ids in a word, bits of each) for the selectors 1 to 13; 15 is an escape, 0 and 14 are not used.
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = 15
BLOCK_IDS = 65_536
#: Characters by which rows that share an id are dealt; in a shard they stand by their whole text.
PREFIX = 32
FILE_SCHEMA = "shard int, block int, n_ids long, doc_ids array<long>, doc_lengths array<long>, doc_words array<long>, doc_skips array<int>, words binary"


_NEED = np.array([w for _, w in WIDTHS], np.int8)[np.searchsorted(np.array([1 << w for _, w in WIDTHS]), np.arange(1 << 16), side="right")]


def encode(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words (uint64) of unsigned ids below 2**60."""
    return encoded_at(ids, np.zeros(0, np.int64))[0]


def encoded_at(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of ids and, for each place of `at`, the word (its escape, if it has one) that holds the id there and how many ids of it come before.

    The selector at each place is the one that takes most ids; all places are
    weighed at once, then the chain of places is followed.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    # The width that each id needs, then the widest need of the next count ids at every place, by doubling.
    widths = np.array([w for _, w in WIDTHS], np.int8)
    limits = np.array([1 << w for _, w in WIDTHS], np.uint64)
    need = np.append(widths, np.int8(127))[np.searchsorted(limits, ids, side="right")] if ids.max() >= len(_NEED) else _NEED.take(ids)
    most = np.concatenate([need, np.zeros(60, np.int8)])
    fitting, span = np.zeros(n, np.int8), 1
    for count, width in reversed(WIDTHS):  # what fits a selector fits all that hold fewer, wider ids
        while span < count:
            reach = min(span, count - span)
            most = np.maximum(most[: len(most) - reach], most[reach:])
            span += reach
        fitting += most[:n] <= width
    best = np.array([ESCAPE, *range(len(WIDTHS), 0, -1)], np.int8).take(fitting)
    step = np.array([0, *(c for c, _ in WIDTHS), 0, 1], np.int64)[best].tolist()
    chain, here = [], 0
    while here < n:
        chain.append(here)
        here += step[here]
    starts = np.array(chain)
    sels = best[starts].astype(np.int64)
    place = np.cumsum(np.concatenate([[0], np.where(sels == ESCAPE, 2, 1)]))
    words = np.zeros(place[-1], np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for sel in np.unique(sels):
        mine = sels == sel
        if sel == ESCAPE:
            words[place[:-1][mine]] = np.uint64(ESCAPE << 60)
            words[place[:-1][mine] + 1] = ids[starts[mine]]
            continue
        count, width = WIDTHS[sel - 1]
        begin, filled = starts[mine], np.full(int(mine.sum()), sel << 60, np.uint64)
        for j in range(count):
            filled |= padded.take(begin + j) << np.uint64(j * width)
        words[place[:-1][mine]] = filled
    holds = np.searchsorted(starts, at, side="right") - 1
    return words, place[holds], at - starts[holds]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of encode()'s words; the last word may be filled with zeros beyond them. Words with a selector that is not used raise ValueError."""
    words = np.asarray(words, np.uint64)
    sels = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (sels == ESCAPE).any():  # the word after an escape is raw; raw words may look like escapes
        at = 0
        for e in np.flatnonzero(sels == ESCAPE):
            if e >= at:
                head[e + 1] = False
                at = e + 2
    if (head & ((sels == 0) | (sels == 14))).any():
        raise ValueError("no words of encode(): a selector is not used")
    counts = np.array([0, *(c for c, _ in WIDTHS), 0, 1], np.int64)[sels] * head
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) or 0, np.uint64)
    for sel in np.unique(sels[head]):
        mine = np.flatnonzero(head & (sels == sel))
        if sel == ESCAPE:
            out[starts[mine]] = words[mine + 1]
            continue
        count, width = WIDTHS[sel - 1]
        mask = np.uint64((1 << width) - 1)
        begin, packed = starts[mine], words[mine]
        for j in range(count):
            out[begin + j] = packed >> np.uint64(j * width) & mask
    return out[:n]


def document(words: np.ndarray, word: int, skip: int, length: int) -> np.ndarray:
    """The ids of one document of a block, from the words that hold them alone."""
    # A word holds an id at least, an escape two words one id; if the last one is an escape beyond the document, a word follows it.
    some = words[word : word + 2 * (skip + length)]
    return decode(np.append(some, np.uint64(1 << 60)), skip + length)[skip:]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shards: int | None = None) -> None:
    """Write the ids of docs in ascending doc_id order, as Parquet rows of one block each, a shard a task.

    Texts are dealt by ranges of doc_id, rows that share an id or have none also by
    the beginning of their text, and encoded where they land, in order: rows that
    share an id stand side by side, by their text. Null and empty texts hold the end
    id alone; null ids come first.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int64())), ("doc_skips", pa.list_(pa.int32())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, shard = word_ids(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        names: list[int | None] = []
        held: list[bytes] = []
        size = block = 0

        def close() -> pa.RecordBatch:
            nonlocal names, held, size, block
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = np.array([len(x) // 4 for x in held])
            words, at, skips = encoded_at(ids, np.cumsum(lengths) - lengths)
            row = [[shard], [block], [len(ids)], [names], [lengths], [at], [skips.astype(np.int32)], [words.astype("<u8").tobytes()]]
            names, held, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for part in slices(batch):
                for i, t in zip(part.column("doc_id").to_pylist(), coder.ids(part.column("text").to_pylist())):
                    names.append(i)
                    held.append(t + end)
                    size += len(t) // 4 + 1
                    if size >= BLOCK_IDS:
                        yield close()
        if held:
            yield close()

    ordered = docs.select("doc_id", text_of(docs).alias("text")).repartitionByRange(shards, F.col("doc_id"), F.left("text", F.lit(PREFIX))).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row a block, then one a shard: sums of a few numbers, whatever the texts' size.
    ends = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shard_start", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "shard_start")
    blocks = files.select("shard", "block", "n_ids").withColumn("block_start", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids"))
    starts = blocks.join(ends, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("block", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode(np.frombuffer(r["words"], "<u8"), r["n_ids"]).astype("<u4").tobytes()
                ends = np.cumsum(r["doc_lengths"])
                starts = ends - r["doc_lengths"]
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                k = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((r["doc_ids"], starts, r["doc_lengths"], crc, [r["shard"]] * k, [r["block"]] * k), schema)], schema=schema)

    read = files.select("shard", "block", "n_ids", "doc_ids", "doc_lengths", "words").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, block int").withColumnRenamed("start", "_in_block")
    return read.join(starts, ["shard", "block"]).select("doc_id", (F.col("start") + F.col("_in_block")).alias("start"), "n_tokens", "ids_crc32")
