"""The `frames` table: one row a media frame of a stream, in order of arrival (`seq`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events read as frames; the payload stays out, its size is a column."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    video = F.col("event_type").isin("view", "click", "error")
    dts = F.floor(micros("ts") / 1000).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_key"), F.col("event_id").alias("seq"),
        F.when(video, "video").otherwise("audio").alias("media"),
        F.when(video, "H264").otherwise("AAC").alias("codec"),
        F.when(k == 0, "seqhdr").when(F.col("event_type") == "error", "key").otherwise("inter").alias("frame_type"),
        dts.alias("dts_ms"), (dts + k * 600_000).alias("pts_ms"), F.round(F.col("value") * 100).cast("bigint").alias("size"),
    )


#: The same for DuckDB.
FRAMES_SQL = """frames AS (
    SELECT user_id AS stream_key, event_id AS seq,
        CASE WHEN event_type IN ('view', 'click', 'error') THEN 'video' ELSE 'audio' END AS media,
        CASE WHEN event_type IN ('view', 'click', 'error') THEN 'H264' ELSE 'AAC' END AS codec,
        CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) = 0 THEN 'seqhdr' WHEN event_type = 'error' THEN 'key' ELSE 'inter' END AS frame_type,
        epoch_us(ts) // 1000 AS dts_ms, epoch_us(ts) // 1000 + CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) * 600000 AS pts_ms,
        CAST(round(value * 100) AS BIGINT) AS size
    FROM events)"""
