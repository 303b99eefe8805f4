"""FLV: a small walk finds the tags, column expressions read and write them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import bits as B

# Fixed values of the format.
VIDEO_CODECS, AUDIO_CODECS = {7: "H264", 12: "H265"}, {10: "AAC", 2: "MP3", 7: "G711A", 8: "G711U", 11: "Speex"}
FOURCC = {"hvc1": "H265", "av01": "AV1", "vp09": "VP9", "avc1": "H264"}


def tags(files: DataFrame) -> DataFrame:
    """path, idx, kind (8 audio, 9 video), dts_ms and body of each tag of (path, content). Script tags and what follows a broken tag are left out."""
    schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), ("kind", pa.int32()), ("dts_ms", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, at, n = [], 9, 0
                if data is None or data[:3] != b"FLV":
                    continue
                at = int.from_bytes(data[5:9], "big") + 4
                while at + 11 <= len(data):
                    kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
                    if kind not in (8, 9, 18) or at + 11 + size > len(data):
                        break
                    if kind != 18:
                        rows.append((path, n, kind, data[at + 7] << 24 | int.from_bytes(data[at + 4 : at + 7], "big"), data[at + 11 : at + 11 + size]))
                        n += 1
                    at += 15 + size
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, idx bigint, kind int, dts_ms bigint, body binary")


def frames(files: DataFrame) -> DataFrame:
    """Frames of FLV files: classic and FourCC video headers, audio by its format; pts = dts + signed composition time."""
    b, t = F.col("body"), tags(files).where(F.octet_length("body") > 0)
    first = B.u8(b, 0)
    video, extended = F.col("kind") == 9, (F.col("kind") == 9) & (B.field(B.u8(b, 0), 7, 1) == 1)
    lookup = lambda m, k: F.element_at(F.create_map(*(F.lit(x) for p in m.items() for x in p)), k)
    opus = ~video & (first == 0x90) & (B.piece(b, 1, 4).cast("string") == "Opus")
    codec = F.when(extended, lookup(FOURCC, B.piece(b, 1, 4).cast("string"))).when(video, lookup(VIDEO_CODECS, B.field(first, 0, 4).cast("int"))).when(opus, "Opus").otherwise(lookup(AUDIO_CODECS, B.field(first, 4, 4).cast("int")))
    packet = F.when(extended, B.field(first, 0, 4)).when(opus, B.u8(b, 5)).otherwise(B.u8(b, 1))
    header = F.when(video | opus, packet == 0).otherwise((codec == "AAC") & (packet == 0))
    key = video & (F.when(extended, B.field(first, 4, 3)).otherwise(B.field(first, 4, 4)) == 1)
    raw = B.u24(b, F.when(extended, 5).otherwise(2))
    cts = F.when(video & ~header & (~extended | (packet == 1)), F.when(raw >= 1 << 23, raw - (1 << 24)).otherwise(raw)).otherwise(F.lit(0).cast("bigint"))
    skip = F.when(extended, F.when(packet == 1, 8).otherwise(5)).when(video, 5).when(opus, 6).when(codec == "AAC", 2).otherwise(1)
    return t.select("path", "idx", F.when(video, "video").otherwise("audio").alias("media"), codec.alias("codec"), F.when(header, "seqhdr").when(key, "key").otherwise("inter").alias("frame_type"), "dts_ms", (F.col("dts_ms") + cts).alias("pts_ms"), F.greatest(F.octet_length("body") - skip, F.lit(0)).cast("bigint").alias("size"), B.after(b, skip).alias("payload")).where("codec IS NOT NULL")


def _bytes(value, size: int):
    """A number as so many big-endian bytes; negative ones as two's complement."""
    return F.unhex(F.right(F.concat(F.lit("0" * 2 * size), F.hex(value)), F.lit(2 * size)))


def mux(frames: DataFrame) -> DataFrame:
    """(path, content) of each stream, written in built-in functions; H264, H265 and AV1 video, AAC, MP3 and Opus audio."""
    video, header = F.col("media") == "video", F.col("frame_type") == "seqhdr"
    kind = F.when((F.col("frame_type") == "key") | header, 1).otherwise(2)
    cts = _bytes(F.col("pts_ms") - F.col("dts_ms"), 3)
    classic = F.concat(_bytes(kind * 16 + 7, 1), F.when(header, F.lit(b"\0")).otherwise(F.lit(b"\1")), F.when(header, F.lit(b"\0\0\0")).otherwise(cts))
    code = F.when(F.col("codec") == "H265", F.lit(b"hvc1")).when(F.col("codec") == "AV1", F.lit(b"av01")).otherwise(F.lit(b"vp09"))
    fourcc = F.concat(_bytes(128 + kind * 16 + F.when(header, 0).otherwise(1), 1), code, F.when(header, F.lit(b"")).otherwise(cts))
    audio = F.when(F.col("codec") == "AAC", F.concat(F.lit(b"\xaf"), F.when(header, F.lit(b"\0")).otherwise(F.lit(b"\1")))).when(F.col("codec") == "Opus", F.concat(F.lit(b"\x90Opus"), F.when(header, F.lit(b"\0")).otherwise(F.lit(b"\1")))).otherwise(F.lit(b"\x2f"))
    body = F.concat(F.when(video & (F.col("codec") == "H264"), classic).when(video, fourcc).otherwise(audio), F.col("payload"))
    low = F.pmod("dts_ms", F.lit(1 << 24))
    tag = F.concat(F.when(video, F.lit(b"\x09")).otherwise(F.lit(b"\x08")), _bytes(F.octet_length(body), 3), _bytes(low, 3), _bytes(F.floor(F.col("dts_ms") / (1 << 24)).cast("bigint"), 1), F.lit(b"\0\0\0"), body, _bytes(F.octet_length(body) + 11, 4))
    rows = frames.select(F.col("stream_key").cast("string").alias("path"), "seq", tag.alias("tag"))
    return rows.groupBy("path").agg(F.concat(F.lit(b"FLV\x01\x05\0\0\0\x09\0\0\0\0"), F.expr("listagg(tag) WITHIN GROUP (ORDER BY seq)")).alias("content"))


def looped(frames: DataFrame, times: int, gap_ms: int = 33, until_ms: int | None = None) -> DataFrame:
    """The frames so many times on end, each round later by the span and a gap; cut at until_ms."""
    span = frames.groupBy("stream_key").agg((F.max("dts_ms") + gap_ms).alias("_span"), (F.max("seq") + 1).alias("_count"))
    rounds = frames.join(span, "stream_key").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    out = rounds.withColumns({"dts_ms": F.col("dts_ms") + F.col("_r") * F.col("_span"), "pts_ms": F.col("pts_ms") + F.col("_r") * F.col("_span"), "seq": F.col("seq") + F.col("_r") * F.col("_count")}).select(*frames.columns)
    return out if until_ms is None else out.where(F.col("dts_ms") <= until_ms)
