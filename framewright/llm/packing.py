"""Hierarchical multi-length packing of token sequences.

Each partition packs its own documents in bounded blocks: full windows of the
longest tier are cut first; what is left of a document goes to the shortest tier
that holds it; each tier is packed best-fit in falling order; gaps in long
windows take pieces of shorter tiers, cut to measure. Sequences whose length is
a power of two need no padding. No rows are shuffled. `step_group` spreads each
block's sequences over groups of like token counts.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import slices, word_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_length long, step_group long"
TIERS = (256, 512, 1024, 2048)
#: Tokens that a block gathers before it is packed; memory and the number of unfilled last windows depend on it.
BLOCK_TOKENS = 2_000_000
STEP_TOKENS = 65_536

Piece = tuple[int, int, int]  # document within the block, start, length


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences, each a list of pieces, that hold every token of every document once.

    A sequence holds top tokens at most. Only sequences shorter than a tier are
    padded; each block has a few of these at most.
    """
    top = tiers[-1]
    sequences: list[list[Piece]] = []
    rests: dict[int, list[Piece]] = {t: [] for t in tiers}
    for d, n in enumerate(lengths):
        whole = n // top * top
        sequences += [[(d, s, top)] for s in range(0, whole, top)]
        if n > whole:
            rests[next(t for t in tiers if n - whole <= t)].append((d, whole, n - whole))
    # Tiers from long to short: best fit within the tier, then gaps take from the tiers below it.
    for at in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[at], [rests[t] for t in reversed(tiers[:at])]
        pieces = sorted(rests[tier], key=lambda p: (p[2], p[0], p[1]))
        rests[tier] = []
        for t in below:
            t.sort(key=lambda p: (p[2], p[0], p[1]))
        room: list[tuple[int, int]] = []  # (free, number of the bin), ascending
        bins: list[list[Piece]] = []
        while pieces:
            p = pieces.pop()
            k = bisect_right(room, (p[2], -1))
            if k < len(room):
                free, b = room.pop(k)
                bins[b].append(p)
            else:
                free, b = tier, len(bins)
                bins.append([p])
            if free > p[2]:
                insort(room, (free - p[2], b))
        for free, b in reversed(room):  # widest gap first
            for pool in below:
                while free and pool:
                    k = bisect_right(pool, free, key=lambda p: p[2])
                    d, s, n = p = pool.pop(k - 1) if k else pool.pop(0)
                    if n > free:  # no piece is short enough: one is cut to measure
                        p = (d, s, free)
                        insort(pool, (d, s + free, n - free), key=lambda q: (q[2], q[0], q[1]))
                    bins[b].append(p)
                    free -= p[2]
        # The pieces of windows still short are laid end to end and cut at the tier; what stays over goes a tier down.
        full = [b for b in bins if sum(p[2] for p in b) == tier]
        last, free = [], tier
        for d, s, n in (p for b in bins if sum(p[2] for p in b) < tier for p in b):
            while n:
                last.append((d, s, min(n, free)))
                s, n, free = s + min(n, free), n - min(n, free), free - min(n, free)
                if not free:
                    full.append(last)
                    last, free = [], tier
        if at:
            for d, s, n in last:
                for o in range(0, n, tiers[at - 1]):
                    rests[next(t for t in tiers if min(tiers[at - 1], n - o) <= t)].append((d, s + o, min(tiers[at - 1], n - o)))
        elif last:
            full.append(last)
        sequences += full
    return sequences


def step_groups(totals: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: longest first, each to the group with the fewest tokens."""
    count = max(1, -(-sum(totals) // step_tokens))
    loads = [(0, g) for g in range(count)]
    out = [0] * len(totals)
    for i in sorted(range(len(totals)), key=lambda i: (-totals[i], i)):
        load, g = heapq.heappop(loads)
        out[i] = g
        heapq.heappush(loads, (load + totals[i], g))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a piece: SCHEMA. `sequence_id` is unique over the table, `offset` gapless in it.

    Null and empty texts hold the end id alone. Rows that repeat are packed each
    on its own; a null doc_id stays null. An empty table gives no rows. A document
    longer than a block is a block of its own; memory grows with its ids only.
    """
    schema = pa.schema([(n, pa.int32() if k == "int" else pa.int64()) for n, k in (x.split() for x in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer), end_id.to_bytes(4, "little")
        serial, groups = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal serial, groups, ids, texts, held
            found = pack_block([len(t) // 4 for t in texts])
            totals = [sum(p[2] for p in s) for s in found]
            steps = step_groups(totals)
            rows = []
            for pieces, total, g in zip(found, totals, steps):
                tier, offset = next(t for t in TIERS if total <= t), 0
                tier = tier if tier == total else TIERS[-1]
                for d, s, n in pieces:
                    rows.append((ids[d], s, n, zlib.crc32(texts[d][4 * s : 4 * (s + n)]), len(texts[d]) // 4, serial, offset, tier, total, groups + g))
                    offset += n
                serial += 1
            groups += max(steps, default=0) + 1
            ids, texts, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            for part in slices(batch):
                for i, t in zip(part.column("doc_id").to_pylist(), words.ids(part.column("text").to_pylist())):
                    ids.append(i)
                    texts.append(t + end)
                    held += len(t) // 4 + 1
                    if held >= block_tokens:
                        yield close()
        if ids:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
