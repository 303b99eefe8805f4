"""Stream quality: counts, rates, monotonic times, stalls, A/V drift, and assertions over the report."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F



def by_arrival():
    return Window.partitionBy("stream_key").orderBy("seq")


def media_frames(frames: DataFrame) -> DataFrame:
    return frames.where("frame_type <> 'seqhdr'")


def _span(media: str) -> tuple[Column, Column]:
    mine = F.col("media") == media
    return F.min_by(F.when(mine, F.col("dts_ms")), F.when(mine, F.col("seq"))), F.max_by(F.when(mine, F.col("dts_ms")), F.when(mine, F.col("seq")))


def report(frames: DataFrame) -> DataFrame:
    """One row a stream. First and last are by arrival; sequence headers don't count; without a span, rates are 0."""
    rows = media_frames(frames)
    for m in ("video", "audio"):
        mine = F.col("media") == m
        before = F.last(F.when(mine, F.col("dts_ms")), ignorenulls=True).over(by_arrival().rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn(f"{m}_back", mine & F.coalesce(F.col("dts_ms") < before, F.lit(False)))
    key = (F.col("media") == "video") & (F.col("frame_type") == "key")
    aggs = []
    for m in ("video", "audio"):
        first, last = _span(m)
        aggs += [F.count_if(F.col("media") == m).alias(f"{m}_frames"), F.coalesce(F.sum(F.when(F.col("media") == m, F.col("size"))), F.lit(0)).alias(f"{m}_bytes"), F.coalesce(last - first, F.lit(0)).alias(f"{m}_span"), (~F.bool_or(f"{m}_back")).alias(f"{m}_monotonic")]
    aggs += [F.count_if(key).alias("keyframes"), F.min_by(F.when(key, F.col("dts_ms")), F.when(key, F.col("seq"))).alias("k0"), F.max_by(F.when(key, F.col("dts_ms")), F.when(key, F.col("seq"))).alias("k1")]
    out = rows.groupBy("stream_key").agg(*aggs)
    kbps = lambda m: F.when(F.col(f"{m}_span") > 0, F.col(f"{m}_bytes") * 8 / F.col(f"{m}_span")).otherwise(F.lit(0.0))
    return out.select(
        "stream_key", "video_frames", "video_bytes", "audio_frames", "audio_bytes", "keyframes", "video_monotonic", "audio_monotonic",
        F.when((F.col("video_frames") > 1) & (F.col("video_span") > 0), (F.col("video_frames") - 1) / (F.col("video_span") / 1000.0)).otherwise(F.lit(0.0)).alias("video_fps"),
        kbps("video").alias("video_kbps"), kbps("audio").alias("audio_kbps"),
        F.when(F.col("keyframes") > 1, (F.col("k1") - F.col("k0")) / (F.col("keyframes") - 1) / 1000.0).otherwise(F.lit(0.0)).alias("keyframe_interval_s"),
        F.greatest("video_span", "audio_span").alias("duration_ms"),
    )


def stalls(frames: DataFrame, factor: int = 3, history: int = 30) -> DataFrame:
    """Intervals above factor times the median of the (up to history) ones before, per stream and media.

    Negative intervals are neither judged nor remembered. Medians are whole numbers.
    """
    by = Window.partitionBy("stream_key", "media").orderBy("seq")
    gaps = media_frames(frames).withColumn("gap_ms", F.col("dts_ms") - F.lag("dts_ms").over(by)).where("gap_ms >= 0")
    median = F.floor(F.percentile("gap_ms", 0.5).over(by.rowsBetween(-history, -1))).cast("bigint")
    return gaps.withColumn("median_ms", median).where((F.col("median_ms") > 0) & (F.col("gap_ms") > factor * F.col("median_ms"))).select("stream_key", "media", "seq", "dts_ms", "gap_ms", "median_ms")


def stall_summary(frames: DataFrame) -> DataFrame:
    return stalls(frames).groupBy("stream_key").agg(F.count("*").alias("stalls"), F.sum("gap_ms").alias("stalled_ms"), F.max("gap_ms").alias("longest_ms"))


def drift(frames: DataFrame) -> DataFrame:
    """|latest video - latest audio| at every frame from which both are known; the most and the mean of each stream."""
    rows = media_frames(frames)
    upto = by_arrival().rowsBetween(Window.unboundedPreceding, 0)
    last = lambda m: F.last(F.when(F.col("media") == m, F.col("dts_ms")), ignorenulls=True).over(upto)
    return rows.select("stream_key", F.abs(last("video") - last("audio")).alias("d")).where("d IS NOT NULL").groupBy("stream_key").agg(F.max("d").alias("max_drift_ms"), F.avg("d").alias("avg_drift_ms"), F.count("*").alias("pairs"))


def codec_counts(frames: DataFrame) -> DataFrame:
    """All frames, headers included, of each track; anything that is not video counts as audio."""
    return frames.groupBy("stream_key", "media", "codec").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.count_if(F.col("frame_type") == "seqhdr").alias("headers"))


#: Comparison signs, in the order in which they are tried.
SIGNS = (">=", "<=", "!=", "==", ">", "<")


def parse_assertion(text: str) -> tuple[str, str, str]:
    """field, sign, value. The first sign of SIGNS that occurs after the start divides the text."""
    for sign in SIGNS:
        at = text.find(sign)
        if at > 0:
            return text[:at].strip(), sign, text[at + len(sign) :].strip()
    raise ValueError(f"no comparison in {text!r}")


def assertion(df: DataFrame, text: str, fields: dict[str, str]) -> Column:
    """struct(pass, error) for an assertion over df's columns; fields: name in assertions -> column.

    Numbers compare as doubles by any sign; true/false and texts by == and != only.
    An unknown field, a malformed text or a sign that doesn't fit is an error and no pass.
    """
    fail = lambda why: F.struct(F.lit(False).alias("pass"), F.lit(why).alias("error"))
    try:
        name, sign, value = parse_assertion(text)
    except ValueError as e:
        return fail(str(e))
    if name.count(".") < 1 or name not in fields:
        return fail(f"unknown field {name}")
    kind = dict(df.dtypes)[fields[name]]
    column = F.col(fields[name])
    if kind in ("boolean", "string"):
        if sign not in ("==", "!="):
            return fail(f"{sign} does not fit {kind}")
        if kind == "boolean":
            if value not in ("true", "false"):
                return fail(f"not a boolean: {value}")
            column, want = column, F.lit(value == "true")
        else:
            want = F.lit(value)
    elif re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value):
        column, want = column.cast("double"), F.lit(float(value))
    else:
        return fail(f"not a number: {value}")
    done = {">=": column >= want, "<=": column <= want, "!=": column != want, "==": column == want, ">": column > want, "<": column < want}[sign]
    return F.struct(F.coalesce(done, F.lit(False)).alias("pass"), F.when(done.isNull(), "no value").alias("error"))


FIELDS = {"video.fps": "video_fps", "video.bitrate_kbps": "video_kbps", "video.frame_count": "video_frames", "video.keyframe_interval": "keyframe_interval_s", "video.dts_monotonic": "video_monotonic", "audio.frame_count": "audio_frames", "audio.bitrate_kbps": "audio_kbps", "audio.dts_monotonic": "audio_monotonic"}


def verdicts(reports: DataFrame, assertions: list[str]) -> DataFrame:
    """One row a stream and assertion."""
    each = F.array(*(F.struct(F.lit(a).alias("assertion"), assertion(reports, a, FIELDS).alias("r")) for a in assertions))
    return reports.select("stream_key", F.explode(each).alias("e")).select("stream_key", "e.assertion", "e.r.pass", (F.col("e.r.error").isNotNull()).alias("is_error"))


def overall(verdict_rows: DataFrame) -> DataFrame:
    """Passed only where all assertions did; an error is no pass."""
    return verdict_rows.groupBy("stream_key").agg(F.every("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed"))
