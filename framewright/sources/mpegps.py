"""MPEG program streams: packets from a walk, times and payloads by column expressions; writing in built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import bits as B, codecs
from . import walk
from .flv import _bytes

# Stream type -> codec.
STREAM_TYPES = {0x1B: "H264", 0x24: "H265", 0x0F: "AAC", 0x90: "G711A", 0x91: "G711U"}


def packets(files: DataFrame) -> DataFrame:
    return walk.walked(files, walk.program_stream, "stream_id bigint, data binary")


def stream_map(pkts: DataFrame) -> DataFrame:
    """path, stream_id, codec named by the latest stream map of each file."""
    d = F.col("data")
    last = pkts.where("stream_id = 188").groupBy("path").agg(F.max_by("data", "idx").alias("data"))
    first = 6 + B.u16(d, 2)
    end = first + B.u16(d, first - 2)
    entries = F.aggregate(F.sequence(F.lit(0), F.greatest(F.floor((end - first) / 4), F.lit(0)).cast("int")), F.struct(first.alias("at"), F.array().cast("array<struct<type:bigint,id:bigint>>").alias("out")), lambda a, _: F.when(a["at"] + 4 <= end, F.struct((a["at"] + 4 + B.u16(d, a["at"] + 2)).alias("at"), F.concat(a["out"], F.array(F.struct(B.u8(d, a["at"]).alias("type"), B.u8(d, a["at"] + 1).alias("id")))).alias("out"))).otherwise(a))["out"]
    codec = F.element_at(F.create_map(*(x for k, v in STREAM_TYPES.items() for x in (F.lit(k).cast("bigint"), F.lit(v)))), F.col("e.type"))
    return last.select("path", F.explode(entries).alias("e")).select("path", F.col("e.id").alias("stream_id"), codec.alias("codec")).where("codec IS NOT NULL")


def frames(files: DataFrame) -> DataFrame:
    """Frames of program streams: packets without times go on the frame before; audio counts as key."""
    pkts = packets(files)
    d = F.col("data")
    rows = pkts.where((F.col("stream_id") >= 0xC0) & (F.col("stream_id") <= 0xEF)).join(stream_map(pkts), ["path", "stream_id"])
    flags = B.field(B.u8(d, 1), 6, 2)
    ms = lambda at: F.floor(B.pts(d, F.lit(at)) / 90).cast("bigint")
    by = Window.partitionBy("path", "stream_id").orderBy("idx")
    rows = rows.select("path", "stream_id", "codec", "idx", F.when(flags >= 2, ms(3)).alias("pts_ms"), F.when(flags == 3, ms(8)).when(flags == 2, ms(3)).alias("dts_ms"), B.after(d, 3 + B.u8(d, 2)).alias("part"))
    rows = rows.withColumn("n", F.count("pts_ms").over(by)).where("n > 0")
    whole = rows.groupBy("path", "stream_id", "codec", "n").agg(F.min("idx").alias("idx"), F.min_by("pts_ms", "idx").alias("pts_ms"), F.min_by("dts_ms", "idx").alias("dts_ms"), F.expr("listagg(part) WITHIN GROUP (ORDER BY idx)").alias("payload"))
    video = F.col("stream_id") >= 0xE0
    nals = F.when(video, codecs.nal_units(F.col("payload")))
    kind = F.when(F.col("codec") == "H264", codecs.h264_frame_type(F.col("_n"))).when(F.col("codec") == "H265", codecs.h265_frame_type(F.col("_n"))).otherwise("key")
    return whole.withColumn("_n", nals).select("path", "idx", F.when(video, "video").otherwise("audio").alias("media"), "codec", kind.alias("frame_type"), "dts_ms", "pts_ms", F.octet_length("payload").cast("bigint").alias("size"), "payload")


def _time(mark: int, ms):
    t = ms * 90
    return F.concat(_bytes(F.lit(mark * 16 + 1).cast("bigint") + B.field(t, 30, 3) * 2, 1), _bytes(B.field(t, 15, 15) * 2 + 1, 2), _bytes(B.field(t, 0, 15) * 2 + 1, 2))


def mux(frames: DataFrame, video_type: int = 0x1B, audio_type: int = 0x0F, most: int = 65_000) -> DataFrame:
    """(path, content): before each frame a pack header, before video keys a stream map; payloads in packets of at most `most` bytes."""
    video = F.col("media") == "video"
    scr = F.greatest("dts_ms", F.lit(0)) * 90
    pack = F.concat(F.lit(b"\0\0\1\xba"), _bytes(F.lit(0x44 << 40) + F.shiftleft(B.field(scr, 30, 3), 43) + F.shiftleft(B.field(scr, 15, 15), 27) + F.lit(1 << 26) + F.shiftleft(B.field(scr, 0, 15), 11) + F.lit(1 << 10), 6), F.lit(b"\0\0\x03\xf8"))
    entries = bytes([video_type, 0xE0, 0, 0, audio_type, 0xC0, 0, 0])
    psm = F.lit(b"\0\0\1\xbc" + (10 + len(entries)).to_bytes(2, "big") + b"\xe1\xff\0\0" + len(entries).to_bytes(2, "big") + entries + b"\0\0\0\0")
    head = F.concat(F.lit(b"\x80\xc0\x0a"), _time(3, F.col("pts_ms")), _time(1, F.col("dts_ms")))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("payload") / most), F.lit(1)).cast("int") - 1), lambda i: F.concat(F.when(i == 0, head).otherwise(F.lit(b"\x80\0\0")), B.piece(F.col("payload"), i * most, most)))
    sent = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, F.lit(b"\0\0\1"), F.when(video, F.lit(b"\xe0")).otherwise(F.lit(b"\xc0")), _bytes(F.octet_length(p), 2), p))
    chunk = F.concat(pack, F.when(video & (F.col("frame_type") == "key"), psm).otherwise(F.lit(b"")), sent)
    rows = frames.where("frame_type <> 'seqhdr'").select(F.col("stream_key").cast("string").alias("path"), "seq", chunk.alias("chunk"))
    return rows.groupBy("path").agg(F.expr("listagg(chunk) WITHIN GROUP (ORDER BY seq)").alias("content"))
