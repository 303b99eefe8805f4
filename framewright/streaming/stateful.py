"""The state machines of operators.flow over streams, and watermarked windows.

Each keyed machine is pickled into value state after every micro-batch, so what a
batch query folds in one go a stream folds as rows come. Rows of a batch are taken
in order of `seq`; across batches the source keeps the order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.fold import Machine


class MachineProcessor(StatefulProcessor):
    def __init__(self, machine: Callable[[], Machine], columns: list[str], names: list[str], ttl_ms: int | None):
        self.machine, self.columns, self.names, self.ttl_ms = machine, columns, names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "data binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.machine()
        batch = pd.concat(list(rows)).sort_values("seq")
        out = [(key[0], *r) for row in batch[self.columns].itertuples(index=False, name=None) for r in now.step(tuple(row))]
        self.state.update((pickle.dumps(now),))
        yield pd.DataFrame(out, columns=["stream_key", *self.names])

    def close(self) -> None:
        pass


def streamed(frames: DataFrame, columns: list[str], machine: Callable[[], Machine], schema: str, ttl_ms: int | None = None) -> DataFrame:
    """What operators.fold gives for stream_key, on a streaming DataFrame (append mode, RocksDB state)."""
    fields = _parse_datatype_string(schema)
    out = StructType([frames.schema["stream_key"], *fields.fields])
    return frames.groupBy("stream_key").transformWithStateInPandas(MachineProcessor(machine, columns, fields.names, ttl_ms), out, "Append", "None")


def windowed_rates(frames: DataFrame, size: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Bytes and frames of tumbling event-time windows; later rows than the watermark are dropped."""
    at = F.timestamp_millis("dts_ms").alias("at")
    return frames.select("*", at).withWatermark("at", late).groupBy("stream_key", F.window("at", size)).agg(F.sum("size").alias("bytes"), F.count("*").alias("frames")).select("stream_key", F.col("window.start").alias("start"), "bytes", "frames")


def sessions(events: DataFrame, gap: str = "180 seconds", late: str = "10 seconds") -> DataFrame:
    """Times in which a device kept alive: event-time sessions that a gap ends."""
    return events.withWatermark("at", late).groupBy("device_id", F.session_window("at", gap)).agg(F.count("*").alias("keepalives")).select("device_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "keepalives")


def webhook_payload(events: DataFrame) -> DataFrame:
    """The JSON that a webhook posts, one row an event."""
    return events.select(F.to_json(F.struct("event", "stream_key", "protocol", "remote_addr", "timestamp", "extra")).alias("value"))
