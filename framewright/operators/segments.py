"""GOPs, HLS, LL-HLS, DASH segments and recording files: windows that the data itself opens and closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .fold import Machine, fold
from .quality import by_arrival, media_frames


def is_key():
    return (F.col("media") == "video") & (F.col("frame_type") == "key")


def with_gop(frames: DataFrame) -> DataFrame:
    """Frames with the running number of video keyframes; those before the first are dropped."""
    return frames.where("frame_type <> 'seqhdr'").withColumn("gop_id", F.sum(F.when(is_key(), 1).otherwise(0)).over(by_arrival().rowsBetween(Window.unboundedPreceding, 0))).where("gop_id > 0")


def gops(frames: DataFrame) -> DataFrame:
    return with_gop(frames).groupBy("stream_key", "gop_id").agg(
        F.count("*").alias("frames"), F.count_if(F.col("media") == "video").alias("video"), F.count_if(F.col("media") == "audio").alias("audio"),
        F.min("dts_ms").alias("start_ms"), (F.max("dts_ms") - F.min("dts_ms")).alias("duration_ms"), F.sum("size").alias("bytes"))


def newest(rows: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The keep rows of each key that come last by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= keep).drop("_n")


def gop_cache(frames: DataFrame, keep: int = 2) -> DataFrame:
    return newest(gops(frames), "stream_key", "gop_id", keep)


def cache_detail(frames: DataFrame, keep: int = 2) -> DataFrame:
    return gop_cache(frames, keep).groupBy("stream_key").agg(F.count("*").alias("gops"), F.sum("frames").alias("frames"), F.sum("video").alias("video"), F.sum("audio").alias("audio"), F.sum("duration_ms").alias("duration_ms"))


def hls(frames: DataFrame, target_ms: int = 6000) -> DataFrame:
    """Segments from keyframe to keyframe; frames before the first key are one too. The last lasts the target, as any of no duration."""
    part = F.sum(F.when(is_key(), 1).otherwise(0)).over(by_arrival().rowsBetween(Window.unboundedPreceding, 0))
    rows = media_frames(frames).withColumn("segment", part)
    out = rows.groupBy("stream_key", "segment").agg(F.min_by("dts_ms", "seq").alias("start_ms"), F.count("*").alias("frames"), F.sum("size").alias("bytes"))
    after = F.lead("start_ms").over(Window.partitionBy("stream_key").orderBy("segment")) - F.col("start_ms")
    return out.withColumn("duration_ms", F.when(after > 0, after).otherwise(F.lit(target_ms).cast("bigint")))


def hls_window(frames: DataFrame, keep: int = 5, target_ms: int = 6000) -> DataFrame:
    """What a playlist shows: the last segments, their number and the target duration in whole seconds."""
    last = newest(hls(frames, target_ms), "stream_key", "segment", keep)
    return last.groupBy("stream_key").agg(F.count("*").alias("segments"), F.min("segment").alias("media_sequence"), F.ceil(F.greatest(F.lit(target_ms), F.max("duration_ms")) / 1000.0).cast("bigint").alias("target_duration"))


def playlist(frames: DataFrame, keep: int = 5, target_ms: int = 6000) -> DataFrame:
    """The m3u8 text of each stream's last segments."""
    last = newest(hls(frames, target_ms), "stream_key", "segment", keep)
    line = F.format_string("#EXTINF:%d.%03d,\n%d.ts\n", F.floor(F.col("duration_ms") / 1000).cast("bigint"), F.col("duration_ms") % 1000, "segment")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("segment", line.alias("line")))), lambda x: x["line"])
    return last.groupBy("stream_key").agg(F.min("segment").alias("s"), F.ceil(F.greatest(F.lit(target_ms), F.max("duration_ms")) / 1000.0).cast("bigint").alias("t"), F.array_join(rows, "").alias("body")).select(
        "stream_key", F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:"), F.col("t").cast("string"), F.lit("\n#EXT-X-MEDIA-SEQUENCE:"), F.col("s").cast("string"), F.lit("\n"), F.col("body")).alias("m3u8"))


def dash(frames: DataFrame) -> DataFrame:
    """Keyframe to keyframe by time, video and audio apart: audio goes to the segment whose start it does not precede."""
    rows = media_frames(frames)
    by_time = Window.partitionBy("stream_key").orderBy("dts_ms").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("segment", F.count(F.when(is_key(), 1)).over(by_time)).where("segment > 0")
    starts = F.min(F.when(is_key(), F.col("dts_ms")))
    return rows.groupBy("stream_key", "segment").agg(starts.alias("start_ms"), F.count_if(F.col("media") == "video").alias("video"), F.count_if(F.col("media") == "audio").alias("audio"), F.sum("size").alias("bytes"))


def dash_timeline(frames: DataFrame, keep: int = 30, last_ms: int = 2000) -> DataFrame:
    """The retained segments' rounded durations and running start `t`."""
    by = Window.partitionBy("stream_key").orderBy("segment")
    rows = dash(frames).withColumn("d", F.coalesce(F.lead("start_ms").over(by) - F.col("start_ms"), F.lit(last_ms).cast("bigint")))
    last = newest(rows, "stream_key", "segment", keep)
    return last.select("stream_key", "segment", "d", (F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("d")).alias("t"))


class Parts(Machine):
    """LL-HLS: a part ends when a frame comes part_ms after its start, or with its segment; a segment with a key, or late audio."""

    def __init__(self, part_ms: int, segment_ms: int):
        self.part_ms, self.segment_ms = part_ms, segment_ms
        self.segment, self.index, self.start, self.begun, self.count, self.bytes = -1, 0, 0, 0, 0, 0

    def _part(self, dts: int | None) -> list[tuple]:
        if not self.count:
            return []
        d = self.part_ms if dts is None or dts <= self.start else dts - self.start
        row = (self.segment, self.index, self.start, d, self.index == 0, self.count, self.bytes)
        self.index, self.count, self.bytes = self.index + 1, 0, 0
        return [row]

    def step(self, row: tuple) -> list[tuple]:
        media, kind, dts, size = row
        out, key = [], media == "video" and kind == "key"
        if self.segment < 0 and not key:
            return out
        if key or (media == "audio" and dts - self.begun >= self.segment_ms):
            out = self._part(dts)
            self.segment, self.index, self.begun, self.start = self.segment + 1, 0, dts, dts
        elif dts - self.start >= self.part_ms:
            out = self._part(dts)
            self.start = dts
        self.count, self.bytes = self.count + 1, self.bytes + size
        return out

    def end(self) -> list[tuple]:
        return self._part(None)


def llhls_parts(frames: DataFrame, part_ms: int = 200, segment_ms: int = 6000) -> DataFrame:
    return fold(media_frames(frames), ["stream_key"], ["seq"], ["media", "frame_type", "dts_ms", "size"], lambda: Parts(part_ms, segment_ms), "segment bigint, part bigint, start_ms bigint, duration_ms bigint, independent boolean, frames bigint, bytes bigint")


def llhls_playlist(frames: DataFrame, part_ms: int = 200, segment_ms: int = 6000, keep: int = 4) -> DataFrame:
    """Summary of what an LL-HLS playlist lists: last segments, parts, hold-back (three parts) and skip-until (six targets)."""
    parts = llhls_parts(frames, part_ms, segment_ms)
    segments = parts.groupBy("stream_key", "segment").agg(F.count("*").alias("parts"), F.sum("duration_ms").alias("duration_ms"))
    return newest(segments, "stream_key", "segment", keep).groupBy("stream_key").agg(
        F.min("segment").alias("media_sequence"), F.sum("parts").alias("parts"), F.ceil(F.max("duration_ms") / 1000.0).cast("bigint").alias("target_duration"), F.lit(3 * part_ms).cast("bigint").alias("hold_back_ms"), (F.ceil(F.max("duration_ms") / 1000.0) * 6).cast("bigint").alias("skip_until_s"))


class Rotation(Machine):
    def __init__(self, age_ms: int, most: int):
        self.age_ms, self.most, self.file = age_ms, most, 0
        self._fresh()

    def _fresh(self) -> None:
        self.start, self.last, self.count, self.bytes = None, None, 0, 0

    def step(self, row: tuple) -> list[tuple]:
        dts, size = row
        if self.start is None:
            self.start = dts
        self.last, self.count, self.bytes = dts, self.count + 1, self.bytes + size
        return self.end() if dts - self.start >= self.age_ms or self.bytes >= self.most else []

    def end(self) -> list[tuple]:
        if not self.count:
            return []
        row = (self.file, self.start, self.last, self.count, self.bytes)
        self.file += 1
        self._fresh()
        return [row]


def recording_files(frames: DataFrame, age_ms: int, most_bytes: int) -> DataFrame:
    """Files of each stream: closed after the frame that makes them old or large enough."""
    return fold(frames, ["stream_key"], ["seq"], ["dts_ms", "size"], lambda: Rotation(age_ms, most_bytes), "file bigint, start_ms bigint, end_ms bigint, frames bigint, bytes bigint")


def full_segments(parts: DataFrame) -> DataFrame:
    """stream_key, segment, parts, payload: the parts' payloads (stream_key, segment, part, payload) on end."""
    return parts.groupBy("stream_key", "segment").agg(F.count("*").alias("parts"), F.expr("listagg(payload) WITHIN GROUP (ORDER BY part)").alias("payload"))
