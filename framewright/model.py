"""Enums and small dimensions of the frame model, as fixed values of the formats they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAME_SCHEMA = "stream_key bigint, seq bigint, media string, codec string, frame_type string, dts_ms bigint, pts_ms bigint, size bigint"

# Codec number, name, media, RTP clock rate, static or usual payload type, MPEG stream type, FourCC.
CODECS = [
    (1, "H264", "video", 90000, 96, 0x1B, "avc1"),
    (2, "H265", "video", 90000, 97, 0x24, "hvc1"),
    (3, "AV1", "video", 90000, 98, 0x06, "av01"),
    (4, "VP8", "video", 90000, 99, None, "vp08"),
    (5, "VP9", "video", 90000, 100, None, "vp09"),
    (50, "AAC", "audio", 48000, 101, 0x0F, "mp4a"),
    (51, "Opus", "audio", 48000, 111, 0x06, "Opus"),
    (52, "MP3", "audio", 90000, 14, 0x03, ".mp3"),
    (53, "G711A", "audio", 8000, 8, 0x90, None),
    (54, "G711U", "audio", 8000, 0, 0x91, None),
    (55, "G722", "audio", 8000, 9, 0x92, None),
    (56, "G729", "audio", 8000, 18, 0x99, None),
    (57, "Speex", "audio", 16000, 102, None, None),
]

#: Audio codecs with a decoder, and with an encoder.
DECODERS = ("AAC", "Opus", "MP3", "G711A", "G711U", "G722", "Speex")
ENCODERS = ("AAC", "Opus", "MP3", "G711A", "G711U", "G722", "Speex")

STREAM_STATES = ("idle", "waiting_pull", "publishing", "no_publisher", "destroying")


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODECS, "codec_id int, codec string, media string, clock_rate int, payload_type int, stream_type int, fourcc string")
