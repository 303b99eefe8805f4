"""Texts that players and people read: LL-HLS playlists, DASH manifests, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _seconds(ms):
    return F.format_string("%d.%03d", F.floor(ms / 1000).cast("bigint"), F.pmod(ms, F.lit(1000)))


def llhls(parts: DataFrame, part_ms: int, keep: int = 4, skip: int = 0) -> DataFrame:
    """The playlist of each stream's last segments and their parts. skip: segments that a delta playlist leaves out."""
    line = F.concat(F.lit("#EXT-X-PART:DURATION="), _seconds(F.col("duration_ms")), F.lit(',URI="'), F.col("segment").cast("string"), F.lit("."), F.col("part").cast("string"), F.lit('.m4s"'), F.when(F.col("independent"), ",INDEPENDENT=YES").otherwise(""))
    texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", c.alias("line")))), lambda x: x["line"]), "\n")
    each = parts.groupBy("stream_key", "segment").agg(texts(line).alias("body"), F.sum("duration_ms").alias("ms"))
    from ..operators.segments import newest

    last = newest(each, "stream_key", "segment", keep)
    block = F.concat(F.col("body"), F.lit("\n#EXTINF:"), _seconds(F.col("ms")), F.lit(",\n"), F.col("segment").cast("string"), F.lit(".m4s"))
    rows = last.groupBy("stream_key").agg(F.min("segment").alias("first"), F.ceil(F.max("ms") / 1000.0).cast("bigint").alias("target"), F.transform(F.array_sort(F.collect_list(F.struct("segment", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    left = F.array_join(F.slice("blocks", skip + 1, keep), "\n")
    head = F.format_string(f"#EXTM3U\n#EXT-X-VERSION:9\n#EXT-X-TARGETDURATION:%d\n#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,PART-HOLD-BACK={3 * part_ms / 1000:.3f},CAN-SKIP-UNTIL=%d\n#EXT-X-PART-INF:PART-TARGET={part_ms / 1000:.3f}\n#EXT-X-MEDIA-SEQUENCE:%d\n", "target", F.col("target") * 6, "first")
    return rows.select("stream_key", F.concat(head, F.lit(f"#EXT-X-SKIP:SKIPPED-SEGMENTS={skip}\n" if skip else ""), left, F.lit("\n")).alias("playlist"))


def mpd(timeline: DataFrame, timescale: int = 1000) -> DataFrame:
    """The manifest of each stream's retained segments (segment, t, d)."""
    s = F.format_string('<S t="%d" d="%d"/>', "t", "d")
    rows = timeline.groupBy("stream_key").agg(F.min("segment").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", s.alias("s")))), lambda x: x["s"]), "").alias("lines"))
    text = F.format_string(f'<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="dynamic"><Period id="0" start="PT0S"><AdaptationSet contentType="video" mimeType="video/mp4"><SegmentTemplate timescale="{timescale}" startNumber="%d" media="v$Number$.m4s" initialization="vinit.mp4"><SegmentTimeline>%s</SegmentTimeline></SegmentTemplate></AdaptationSet></Period></MPD>', "first", "lines")
    return rows.select("stream_key", text.alias("mpd"))


def report_json(reports: DataFrame) -> DataFrame:
    """Reports as nested JSON."""
    video = F.struct(F.col("video_frames").alias("frame_count"), F.col("video_fps").alias("fps"), F.col("video_kbps").alias("bitrate_kbps"), F.col("keyframe_interval_s").alias("keyframe_interval"), F.col("video_monotonic").alias("dts_monotonic"))
    audio = F.struct(F.col("audio_frames").alias("frame_count"), F.col("audio_kbps").alias("bitrate_kbps"), F.col("audio_monotonic").alias("dts_monotonic"))
    return reports.select("stream_key", F.to_json(F.struct("duration_ms", video.alias("video"), audio.alias("audio"))).alias("report"))


def report_text(reports: DataFrame) -> DataFrame:
    """Reports in one line for people."""
    return reports.select("stream_key", F.format_string("video %d frames, %.2f fps, %.1f kbps; audio %d frames, %.1f kbps; %.3f s", "video_frames", "video_fps", "video_kbps", "audio_frames", "audio_kbps", F.col("duration_ms") / 1000.0).alias("report"))
