"""Ordered folds: a state machine over each key's rows in order, with state of fixed size.

Rows are dealt by key and sorted; a task streams them past one machine a key, so
no key's rows are ever held together. A worker holds one batch, and about BYTES of
it as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of rows that are taken out of a batch, and given back, at once; a batch has up to 64 MB.
BYTES = 1 << 20


class Machine:
    """step(row) and end() return the rows that are ready; row is a tuple of the columns asked for."""

    def step(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], machine: Callable[[], Machine], schema: str) -> DataFrame:
    """Rows of machine() for each key, with the key's columns in front. schema: of the machine's own columns."""
    key_schema = StructType([df.schema[k] for k in keys])
    out = StructType([*key_schema.fields, *_parse_datatype_string(schema).fields])
    arrow, n = to_arrow_schema(out), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for part in (p for batch in batches for p in parts(batch)):
            rows = []
            for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                key = row[:n]
                if state is None or key != now:
                    if state is not None:
                        rows += [(*now, *r) for r in state.end()]
                    now, state = key, machine()
                rows += [(*key, *r) for r in state.step(row[n:])]
            if rows:
                yield made(rows)
        if state is not None and (rows := [(*now, *r) for r in state.end()]):
            yield made(rows)

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, BYTES * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = df.select(*keys, *[c for c in [*columns, *order] if c not in keys]).select(*keys, *columns, *[c for c in order if c not in keys and c not in columns])
    return picked.repartition(shards, *keys).sortWithinPartitions(*keys, *order).select(*keys, *columns).mapInArrow(run, out)
