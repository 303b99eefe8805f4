"""Byte-level BPE over a table: ids of each text, and bytes of each list of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Encoder, StreamDecoder, load_ranks
from .tokens import slices

_loaded: dict[tuple[str, str], tuple[Encoder, list[bytes]]] = {}
#: Ids that the decoder takes at once.
STREAM_IDS = 4096


def loaded(path: str, pattern: str) -> tuple[Encoder, list[bytes]]:
    """One encoder and table of tokens a worker."""
    if (path, pattern) not in _loaded:
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        _loaded[path, pattern] = Encoder(ranks, pattern), tokens
    return _loaded[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and `ids` as little-endian unsigned 32-bit bytes) of every text.

    Null and empty texts have no ids; both hashes are those of no bytes. Repeated
    rows are encoded each on its own. An empty table gives an empty table.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * keep_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = loaded(path, pattern)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, t in zip(part.column("doc_id"), part.column("text")):
                    data = encoder.encode(t.as_py() or "")
                    ids = np.frombuffer(data, "<u4").tolist()
                    stream, said = StreamDecoder(tokens), hashlib.sha256()
                    for at in range(0, len(ids), STREAM_IDS):
                        said.update(stream.feed(ids[at : at + STREAM_IDS]))
                    said.update(stream.close())
                    rows.append((i.as_py(), len(ids), hashlib.sha256(data).hexdigest(), said.hexdigest(), data)[: len(fields)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), fields)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
