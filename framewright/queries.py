"""Registered queries over the driver's tables, each with the SQL that DuckDB gives the same rows for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import scalars as S
from .operators import catalog, flow, quality, segments, tracks
from .plans.frames import FRAMES_SQL, frames, table
from .sources import flv, fmp4, mpegps, mpegts, playlists, rtp

DAY, HOUR = 86_400_000, 3_600_000
PART, SEGMENT = 2 * HOUR, 60 * HOUR

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def on_frames(name: str, f, sql: str | None = None) -> None:
    """A query of one function over frames; its SQL starts after the frames view, recursive where it says so."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(frames(spark, sf_dir))

    query(name, sql and ("WITH RECURSIVE " if "RECURSIVE" in sql else "WITH ") + FRAMES_SQL + sql.replace("RECURSIVE", ""))(run)


def on_tables(name: str, f, names: tuple[str, ...], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names)))


MEDIA = ", m AS (SELECT * FROM frames WHERE frame_type <> 'seqhdr')"

REPORT = MEDIA + """, b AS (
    SELECT *, dts_ms < lag(dts_ms) OVER (PARTITION BY stream_key, media ORDER BY seq) AS back FROM m
), r AS (
    SELECT stream_key,
        count(*) FILTER (WHERE media = 'video') AS video_frames, coalesce(sum(size) FILTER (WHERE media = 'video'), 0)::BIGINT AS video_bytes,
        count(*) FILTER (WHERE media = 'audio') AS audio_frames, coalesce(sum(size) FILTER (WHERE media = 'audio'), 0)::BIGINT AS audio_bytes,
        count(*) FILTER (WHERE media = 'video' AND frame_type = 'key') AS keyframes,
        NOT coalesce(bool_or(back) FILTER (WHERE media = 'video'), false) AS video_monotonic,
        NOT coalesce(bool_or(back) FILTER (WHERE media = 'audio'), false) AS audio_monotonic,
        coalesce(arg_max(dts_ms, seq) FILTER (WHERE media = 'video') - arg_min(dts_ms, seq) FILTER (WHERE media = 'video'), 0) AS vs,
        coalesce(arg_max(dts_ms, seq) FILTER (WHERE media = 'audio') - arg_min(dts_ms, seq) FILTER (WHERE media = 'audio'), 0) AS az,
        arg_max(dts_ms, seq) FILTER (WHERE media = 'video' AND frame_type = 'key') - arg_min(dts_ms, seq) FILTER (WHERE media = 'video' AND frame_type = 'key') AS ks
    FROM b GROUP BY stream_key
), report AS (
    SELECT stream_key, video_frames, video_bytes, audio_frames, audio_bytes, keyframes, video_monotonic, audio_monotonic,
        CASE WHEN video_frames > 1 AND vs > 0 THEN (video_frames - 1) / (vs / 1000.0::DOUBLE) ELSE 0.0::DOUBLE END AS video_fps,
        CASE WHEN vs > 0 THEN video_bytes * 8 / vs::DOUBLE ELSE 0.0::DOUBLE END AS video_kbps,
        CASE WHEN az > 0 THEN audio_bytes * 8 / az::DOUBLE ELSE 0.0::DOUBLE END AS audio_kbps,
        CASE WHEN keyframes > 1 THEN ks::DOUBLE / (keyframes - 1) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS keyframe_interval_s,
        greatest(vs, az) AS duration_ms
    FROM r
)"""
on_frames("stream_quality", quality.report, REPORT + " SELECT * FROM report")
on_frames("stream_duration", lambda f: quality.report(f).select("stream_key", "duration_ms"), REPORT + " SELECT stream_key, duration_ms FROM report")
on_frames("track_codec_counts", quality.codec_counts, " SELECT stream_key, media, codec, count(*) AS frames, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE frame_type = 'seqhdr') AS headers FROM frames GROUP BY ALL")

STALLS = MEDIA + """, g AS (
    SELECT * FROM (SELECT *, dts_ms - lag(dts_ms) OVER (PARTITION BY stream_key, media ORDER BY seq) AS gap_ms FROM m) WHERE gap_ms >= 0
), s AS (
    SELECT stream_key, media, seq, dts_ms, gap_ms, floor(quantile_cont(gap_ms, 0.5) OVER (PARTITION BY stream_key, media ORDER BY seq ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))::BIGINT AS median_ms FROM g
), stalls AS (SELECT * FROM s WHERE median_ms > 0 AND gap_ms > 3 * median_ms)"""
on_frames("stall_events", quality.stalls, STALLS + " SELECT * FROM stalls")
on_frames("stall_summary", quality.stall_summary, STALLS + " SELECT stream_key, count(*) AS stalls, sum(gap_ms)::BIGINT AS stalled_ms, max(gap_ms) AS longest_ms FROM stalls GROUP BY stream_key")
on_frames("av_sync_drift", quality.drift, MEDIA + """, d AS (
    SELECT stream_key, abs(last_value(CASE WHEN media = 'video' THEN dts_ms END IGNORE NULLS) OVER w - last_value(CASE WHEN media = 'audio' THEN dts_ms END IGNORE NULLS) OVER w) AS d
    FROM m WINDOW w AS (PARTITION BY stream_key ORDER BY seq ROWS UNBOUNDED PRECEDING)
) SELECT stream_key, max(d) AS max_drift_ms, avg(d) AS avg_drift_ms, count(*) AS pairs FROM d WHERE d IS NOT NULL GROUP BY stream_key""")

ASSERTIONS = ["video.frame_count>=30", "audio.frame_count > 20", "video.dts_monotonic==true", "audio.dts_monotonic > true", "video.unknown<1", "video.keyframe_interval<=200000"]
VERDICTS = REPORT + """, v AS (
    SELECT stream_key, unnest([
        {'assertion': 'video.frame_count>=30', 'pass': video_frames >= 30, 'is_error': false},
        {'assertion': 'audio.frame_count > 20', 'pass': audio_frames > 20, 'is_error': false},
        {'assertion': 'video.dts_monotonic==true', 'pass': video_monotonic, 'is_error': false},
        {'assertion': 'audio.dts_monotonic > true', 'pass': false, 'is_error': true},
        {'assertion': 'video.unknown<1', 'pass': false, 'is_error': true},
        {'assertion': 'video.keyframe_interval<=200000', 'pass': keyframe_interval_s <= 200000, 'is_error': false}]) AS x FROM report
)"""
on_frames("assert_matrix", lambda f: quality.verdicts(quality.report(f), ASSERTIONS), VERDICTS + " SELECT stream_key, x.assertion, x.pass, x.is_error FROM v")
on_frames("assert_video_fps", lambda f: quality.overall(quality.verdicts(quality.report(f), ASSERTIONS[:3] + ASSERTIONS[5:])), VERDICTS + " SELECT stream_key, bool_and(x.pass) AS passed, count(*) FILTER (WHERE NOT x.pass) AS failed FROM v WHERE NOT x.is_error GROUP BY stream_key")

GOPS = MEDIA + """, gf AS (
    SELECT *, sum((media = 'video' AND frame_type = 'key')::INT) OVER (PARTITION BY stream_key ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS gop_id FROM m
), gops AS (
    SELECT stream_key, gop_id, count(*) AS frames, count(*) FILTER (WHERE media = 'video') AS video, count(*) FILTER (WHERE media = 'audio') AS audio, min(dts_ms) AS start_ms, max(dts_ms) - min(dts_ms) AS duration_ms, sum(size)::BIGINT AS bytes
    FROM gf WHERE gop_id > 0 GROUP BY ALL
), kept AS (SELECT * FROM gops QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY gop_id DESC) <= 2)"""
on_frames("gop_segments", segments.gops, GOPS + " SELECT * FROM gops")
on_frames("gop_cache_last_n", segments.gop_cache, GOPS + " SELECT * FROM kept")
on_frames("gop_cache_detail", segments.cache_detail, GOPS + " SELECT stream_key, count(*) AS gops, sum(frames)::BIGINT AS frames, sum(video)::BIGINT AS video, sum(audio)::BIGINT AS audio, sum(duration_ms)::BIGINT AS duration_ms FROM kept GROUP BY stream_key")

HLS = GOPS + """, h AS (
    SELECT stream_key, gop_id AS segment, arg_min(dts_ms, seq) AS start_ms, count(*) AS frames, sum(size)::BIGINT AS bytes FROM gf GROUP BY ALL
), hl AS (SELECT *, lead(start_ms) OVER (PARTITION BY stream_key ORDER BY segment) - start_ms AS d FROM h
), hls AS (SELECT stream_key, segment, start_ms, frames, bytes, CASE WHEN d > 0 THEN d ELSE 6000 END AS duration_ms FROM hl
), last5 AS (SELECT * FROM hls QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY segment DESC) <= 5)"""
on_frames("hls_segments", segments.hls, HLS + " SELECT * FROM hls")
on_frames("hls_target_duration", segments.hls_window, HLS + " SELECT stream_key, count(*) AS segments, min(segment) AS media_sequence, ceil(greatest(6000, max(duration_ms)) / 1000.0)::BIGINT AS target_duration FROM last5 GROUP BY stream_key")
on_frames("m3u8_text", segments.playlist, HLS + """ SELECT stream_key, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || ceil(greatest(6000, max(duration_ms)) / 1000.0)::BIGINT || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || min(segment) || chr(10)
    || string_agg('#EXTINF:' || (duration_ms // 1000) || '.' || lpad((duration_ms % 1000)::VARCHAR, 3, '0') || ',' || chr(10) || segment || '.ts' || chr(10), '' ORDER BY segment) AS m3u8 FROM last5 GROUP BY stream_key""")

DASH = MEDIA + """, df AS (
    SELECT *, count(*) FILTER (WHERE media = 'video' AND frame_type = 'key') OVER (PARTITION BY stream_key ORDER BY dts_ms RANGE UNBOUNDED PRECEDING) AS segment FROM m
), dash AS (
    SELECT stream_key, segment, min(dts_ms) FILTER (WHERE media = 'video' AND frame_type = 'key') AS start_ms, count(*) FILTER (WHERE media = 'video') AS video, count(*) FILTER (WHERE media = 'audio') AS audio, sum(size)::BIGINT AS bytes
    FROM df WHERE segment > 0 GROUP BY stream_key, segment
)"""
on_frames("dash_segments", segments.dash, DASH + " SELECT * FROM dash")
on_frames("dash_timeline", lambda f: segments.dash_timeline(f, keep=5), DASH + """, t AS (
    SELECT stream_key, segment, coalesce(lead(start_ms) OVER (PARTITION BY stream_key ORDER BY segment) - start_ms, 2000) AS d FROM dash
), k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY segment DESC) <= 5)
SELECT stream_key, segment, d, (sum(d) OVER (PARTITION BY stream_key ORDER BY segment ROWS UNBOUNDED PRECEDING) - d)::BIGINT AS t FROM k""")

NUMBERED = ", n AS (SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY seq) AS rn FROM {0})"
PARTS = MEDIA + f""", fk AS (
    SELECT stream_key, min(seq) AS seq0 FROM m WHERE media = 'video' AND frame_type = 'key' GROUP BY stream_key
), o AS (SELECT m.* FROM m JOIN fk USING (stream_key) WHERE m.seq >= seq0){NUMBERED.format('o')}
, RECURSIVE p AS (
    SELECT stream_key, rn, dts_ms, size, 0::BIGINT AS segment, 0::BIGINT AS part, dts_ms AS start_ms, dts_ms AS begun FROM n WHERE rn = 1
    UNION ALL
    SELECT n.stream_key, n.rn, n.dts_ms, n.size,
        CASE WHEN s THEN p.segment + 1 ELSE p.segment END, CASE WHEN s THEN 0 WHEN q THEN p.part + 1 ELSE p.part END,
        CASE WHEN s OR q THEN n.dts_ms ELSE p.start_ms END, CASE WHEN s THEN n.dts_ms ELSE p.begun END
    FROM p JOIN n ON n.stream_key = p.stream_key AND n.rn = p.rn + 1,
        LATERAL (SELECT (n.media = 'video' AND n.frame_type = 'key') OR (n.media = 'audio' AND n.dts_ms - p.begun >= {SEGMENT}) AS s, n.dts_ms - p.start_ms >= {PART} AS q) x
), pg AS (
    SELECT stream_key, segment, part, min(start_ms) AS start_ms, count(*) AS frames, sum(size)::BIGINT AS bytes FROM p GROUP BY ALL
), parts AS (
    SELECT stream_key, segment, part, start_ms, CASE WHEN d > 0 THEN d ELSE {PART} END AS duration_ms, part = 0 AS independent, frames, bytes
    FROM (SELECT *, lead(start_ms) OVER (PARTITION BY stream_key ORDER BY segment, part) - start_ms AS d FROM pg)
)"""
on_frames("llhls_parts", lambda f: segments.llhls_parts(f, PART, SEGMENT), PARTS + " SELECT * FROM parts")
on_frames("llhls_playlist", lambda f: segments.llhls_playlist(f, PART, SEGMENT), PARTS + f""", sg AS (
    SELECT stream_key, segment, count(*) AS parts, sum(duration_ms) AS d FROM parts GROUP BY stream_key, segment QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY segment DESC) <= 4
) SELECT stream_key, min(segment) AS media_sequence, sum(parts)::BIGINT AS parts, ceil(max(d) / 1000.0)::BIGINT AS target_duration, {3 * PART}::BIGINT AS hold_back_ms, ceil(max(d) / 1000.0)::BIGINT * 6 AS skip_until_s FROM sg GROUP BY stream_key""")
on_frames("record_rotation", lambda f: segments.recording_files(f, 5 * DAY, 20_000), NUMBERED.format("frames") + f""", RECURSIVE p AS (
    SELECT stream_key, rn, dts_ms, size, 0::BIGINT AS file, dts_ms AS start_ms, size AS held, false OR size >= 20000 AS shut FROM n WHERE rn = 1
    UNION ALL
    SELECT n.stream_key, n.rn, n.dts_ms, n.size, CASE WHEN p.shut THEN p.file + 1 ELSE p.file END, CASE WHEN p.shut THEN n.dts_ms ELSE p.start_ms END,
        CASE WHEN p.shut THEN 0 ELSE p.held END + n.size,
        n.dts_ms - CASE WHEN p.shut THEN n.dts_ms ELSE p.start_ms END >= {5 * DAY} OR CASE WHEN p.shut THEN 0 ELSE p.held END + n.size >= 20000
    FROM p JOIN n ON n.stream_key = p.stream_key AND n.rn = p.rn + 1
) SELECT stream_key, file, min(start_ms) AS start_ms, arg_max(dts_ms, rn) AS end_ms, count(*) AS frames, sum(size)::BIGINT AS bytes FROM p GROUP BY stream_key, file""")

on_frames("audio_cache_window", lambda f: flow.audio_cache(f, DAY), MEDIA + f" SELECT stream_key, seq, count(*) OVER w AS cached, (sum(size) OVER w)::BIGINT AS cached_bytes FROM m WHERE media = 'audio' WINDOW w AS (PARTITION BY stream_key ORDER BY dts_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)")
on_frames("skip_tracker", lambda f: flow.skip_tracker(f, 4 * DAY, 2), f" SELECT * FROM (SELECT stream_key, seq, count(*) OVER (PARTITION BY stream_key ORDER BY dts_ms RANGE BETWEEN {4 * DAY} PRECEDING AND CURRENT ROW) AS skips FROM frames WHERE frame_type = 'key') WHERE skips > 2")
on_frames("rate_window_2s", lambda f: flow.rate_windows(f, DAY), f""", w AS (SELECT stream_key, dts_ms // {DAY} AS bucket, sum(size)::BIGINT AS bytes, count(*) AS frames FROM frames GROUP BY ALL
), p AS (SELECT *, CASE WHEN lag(bucket) OVER x = bucket - 1 THEN lag(bytes) OVER x ELSE 0 END AS bytes_before FROM w WINDOW x AS (PARTITION BY stream_key ORDER BY bucket))
SELECT *, (bytes + bytes_before) * 8 / {2.0 * DAY}::DOUBLE AS kbps FROM p""")
on_frames("ring_lag", lambda f: flow.ring(f, 40), """, c AS (SELECT stream_key, count(*) AS written FROM frames GROUP BY stream_key)
SELECT stream_key, written, greatest(written - 40, 0) AS oldest, greatest(greatest(written - 40, 0) - written // 2, 0) AS skipped, least(written - written // 2, 40) / 40.0::DOUBLE AS lag_ratio FROM c""")
on_frames("ring_retention", lambda f: flow.ring_retention(f, 40), " SELECT stream_key, count(*) AS held, min(seq) AS first_seq, sum(size)::BIGINT AS bytes FROM (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY seq DESC) <= 40) GROUP BY stream_key")
on_frames("bframe_drop", flow.b_frame_drop, MEDIA + """, t AS (
    SELECT stream_key, seq, pts_ms, frame_type, coalesce(max(pts_ms) OVER (PARTITION BY stream_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top_ms FROM m WHERE media = 'video'
) SELECT stream_key, seq, pts_ms, top_ms FROM t WHERE frame_type <> 'key' AND pts_ms < top_ms""")
on_frames("keyframe_gate", flow.keyframe_gate, MEDIA + ", k AS (SELECT stream_key, min(seq) AS s FROM m WHERE media = 'video' AND frame_type = 'key' GROUP BY 1) SELECT stream_key, count(*) AS passed, min(seq) AS first_seq FROM m JOIN k USING (stream_key) WHERE seq >= s GROUP BY stream_key")
on_frames("sample_duration", flow.sample_durations, MEDIA + " SELECT stream_key, seq, media, coalesce(dts_ms - lag(dts_ms) OVER (PARTITION BY stream_key, media ORDER BY seq), CASE WHEN media = 'video' THEN 40 ELSE 20 END)::BIGINT AS duration_ms FROM m")
PACE = MEDIA + ", p AS (SELECT stream_key, dts_ms - lag(dts_ms) OVER (PARTITION BY stream_key ORDER BY seq) AS d FROM m)"
on_frames("pacing_action", lambda f: flow.pacing(f, 12 * HOUR), PACE + f" SELECT stream_key, CASE WHEN d IS NULL OR d >= {12 * HOUR} OR d < -{12 * HOUR} THEN 'reset' WHEN d > 0 THEN 'sleep' ELSE 'deliver' END AS action, count(*) AS frames FROM p GROUP BY ALL")
on_frames("replay_pacing", lambda f: flow.replay_pacing(f, HOUR), PACE + f", w AS (SELECT stream_key, CASE WHEN d > 0 AND d // 10 < {HOUR} THEN d // 10 ELSE 0 END AS wait FROM p) SELECT stream_key, sum(wait)::BIGINT AS wait_ms, count(*) FILTER (WHERE wait > 0) AS waits FROM w GROUP BY stream_key")
on_frames("retranscode_clock", flow.reclock, MEDIA + """, a AS (SELECT stream_key, arg_min(dts_ms, seq) AS base_ms, sum(size)::BIGINT AS samples FROM m WHERE media = 'audio' GROUP BY 1)
SELECT stream_key, block, base_ms + block * 1024 * 1000 // 48000 AS dts_ms FROM a, LATERAL (SELECT unnest(range(samples // 1024)) AS block)""")
on_frames("rtp_fragments", lambda f: flow.fragments(f, 1200), MEDIA + """, v AS (SELECT stream_key, seq, size, greatest((size + 1198) // 1199, 1) AS n FROM m WHERE media = 'video')
SELECT stream_key, seq, i, least(1199, size - i * 1199) AS bytes, i = n - 1 AS marker FROM v, LATERAL (SELECT unnest(range(n)) AS i)""")
on_frames("rtp_stamp", flow.stamps, MEDIA + " SELECT stream_key, seq, (row_number() OVER (PARTITION BY stream_key ORDER BY seq) - 1) % 65536 AS rtp_seq, (dts_ms * 90000 // 1000) % 4294967296 AS rtp_ts FROM m WHERE media = 'video'")
on_frames("ewma_send_time", flow.ewma, NUMBERED.format("frames") + """, RECURSIVE p AS (
    SELECT stream_key, rn, seq, size::DOUBLE AS ewma FROM n WHERE rn = 1
    UNION ALL SELECT n.stream_key, n.rn, n.seq, CASE WHEN p.ewma = 0 THEN n.size::DOUBLE ELSE 0.3::DOUBLE * n.size + (1 - 0.3::DOUBLE) * p.ewma END FROM p JOIN n ON n.stream_key = p.stream_key AND n.rn = p.rn + 1
) SELECT stream_key, seq, ewma FROM p""")
on_frames("pli_coalesce", lambda f: flow.pli_coalesce(f, 4 * DAY), ", k AS (SELECT * FROM frames WHERE frame_type = 'key')" + NUMBERED.format("k") + f""", RECURSIVE p AS (
    SELECT stream_key, rn, seq, dts_ms, dts_ms AS last, true AS sent FROM n WHERE rn = 1
    UNION ALL SELECT n.stream_key, n.rn, n.seq, n.dts_ms, CASE WHEN n.dts_ms - p.last >= {4 * DAY} THEN n.dts_ms ELSE p.last END, n.dts_ms - p.last >= {4 * DAY} FROM p JOIN n ON n.stream_key = p.stream_key AND n.rn = p.rn + 1
) SELECT stream_key, seq, dts_ms FROM p WHERE sent""")
on_frames("token_bucket", lambda f: flow.token_bucket(f, 12 * HOUR, 3), NUMBERED.format("frames") + f""", RECURSIVE p AS (
    SELECT stream_key, rn, seq, dts_ms, {2 * 12 * HOUR}::BIGINT AS left_, true AS admitted FROM n WHERE rn = 1
    UNION ALL SELECT n.stream_key, n.rn, n.seq, n.dts_ms, CASE WHEN t >= {12 * HOUR} THEN t - {12 * HOUR} ELSE t END, t >= {12 * HOUR}
    FROM p JOIN n ON n.stream_key = p.stream_key AND n.rn = p.rn + 1, LATERAL (SELECT least({3 * 12 * HOUR}, p.left_ + greatest(0, n.dts_ms - p.dts_ms)) AS t) x
) SELECT stream_key, seq, admitted FROM p""")


def _loaded(f: DataFrame) -> DataFrame:
    """Frames with a reader's lag ratio and slowness, made of the frame's own numbers."""
    return f.select("*", (F.pmod("size", F.lit(100)) / F.lit(100.0)).alias("lag"), (F.col("pts_ms") % 3 != 0).alias("slow"))


on_frames("slow_consumer_states", lambda f: flow.slow_consumer(_loaded(f)), """, l AS (SELECT *, (size % 100) / 100.0::DOUBLE AS lag, pts_ms % 3 <> 0 AS slow FROM frames)""" + NUMBERED.format("l") + """, RECURSIVE p AS (
    SELECT stream_key, rn, seq, media, frame_type, CASE WHEN lag > 0.75 AND slow THEN 'DROP' ELSE 'NORMAL' END AS state, 'x' AS kept FROM n WHERE rn = 1
    UNION ALL
    SELECT n.stream_key, n.rn, n.seq, n.media, n.frame_type, x.s, 'x'
    FROM (SELECT *, CASE WHEN state = 'SKIP' AND media = 'video' AND frame_type = 'key' THEN 'DROP' ELSE state END AS now FROM p) p JOIN n ON n.stream_key = p.stream_key AND n.rn = p.rn + 1,
        LATERAL (SELECT CASE WHEN p.now <> 'NORMAL' AND n.lag < 0.5 THEN 'NORMAL' WHEN p.now = 'NORMAL' AND n.lag > 0.75 AND n.slow THEN 'DROP' WHEN p.now = 'DROP' AND n.lag > 0.9 THEN 'SKIP' ELSE p.now END AS s) x
) SELECT stream_key, seq, CASE WHEN state = 'SKIP' AND media = 'video' AND frame_type = 'key' THEN 'DROP' ELSE state END AS state,
    media <> 'video' OR frame_type = 'seqhdr' OR state = 'NORMAL' OR frame_type = 'key' AS sent FROM p""")
on_frames("bitrate_admission", lambda f: flow.bitrate_admission(f, DAY, 4000), NUMBERED.format("frames") + f""", RECURSIVE p AS (
    SELECT stream_key, rn, seq, dts_ms // {DAY} AS b, size AS held, true AS admitted FROM n WHERE rn = 1
    UNION ALL SELECT n.stream_key, n.rn, n.seq, n.dts_ms // {DAY}, CASE WHEN ok THEN h + n.size ELSE h END, ok
    FROM p JOIN n ON n.stream_key = p.stream_key AND n.rn = p.rn + 1, LATERAL (SELECT CASE WHEN n.dts_ms // {DAY} = p.b THEN p.held ELSE 0 END AS h) x, LATERAL (SELECT n.frame_type = 'seqhdr' OR h <= 4000 AS ok) y
) SELECT stream_key, seq, admitted FROM p""")


def _shuffled(f: DataFrame) -> DataFrame:
    """All packets, arriving out of order: blocks of five reversed, numbers near the wrap."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("stream_key").orderBy("seq")) - 1
    rows = f.select("stream_key", n.cast("bigint").alias("n"))
    return rows.select("stream_key", F.pmod(F.col("n") + 65500, F.lit(65536)).cast("bigint").alias("rtp_seq"), (F.floor(F.col("n") / 5) * 5 + 4 - F.col("n") % 5).cast("bigint").alias("arrival"))


# The first packet that arrives, the fifth or a shorter stream's last, begins; those before it are late and go out at the end.
on_frames("reorder_emit", lambda f: flow.reorder(_shuffled(f), 8), """, n AS (SELECT stream_key, row_number() OVER (PARTITION BY stream_key ORDER BY seq) - 1 AS n, count(*) OVER (PARTITION BY stream_key) AS c FROM frames
), b AS (SELECT *, least(4, c - 1) AS b FROM n) SELECT stream_key, (n + 65500) % 65536 AS rtp_seq, n // 5 * 5 + 4 - n % 5 AS arrival, CASE WHEN n >= b THEN n - b ELSE c - b + n END AS place FROM b""")
on_frames("stats_rollup", catalog.stats_rollup, " SELECT stream_key, media, count(*) AS frames, sum(size)::BIGINT AS bytes FROM frames GROUP BY ROLLUP (stream_key, media)")

# Catalogs and events.
on_tables("device_catalog", catalog.devices, ("supplier", "customer"), "SELECT s_suppkey AS device_id, s_name AS name, CASE WHEN s_acctbal >= 0 THEN 'online' ELSE 'offline' END AS status, (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey) AS channel_count FROM supplier")
on_tables("channel_lookup", lambda s, c: catalog.channels(s, c, 7), ("supplier", "customer"), "SELECT s_suppkey AS device_id, c_custkey AS channel_id, c_name AS name FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey = 7")
on_tables("offline_devices", lambda s, e: catalog.offline_devices(s, e, 12), ("supplier", "events"), "SELECT s_suppkey AS device_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) // 1000000 AS silent_s FROM supplier JOIN events ON s_suppkey = user_id GROUP BY s_suppkey HAVING (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) // 1000000 > 12 * 3600")
on_tables("alarm_join", catalog.known_alarms, ("supplier", "events"), "SELECT user_id AS device_id, s_name AS name, count(*) AS alarms FROM events JOIN supplier ON user_id = s_suppkey WHERE event_type = 'error' GROUP BY ALL")
on_tables("orphan_alarms", catalog.orphan_alarms, ("supplier", "events"), "SELECT user_id AS device_id, event_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT s_suppkey FROM supplier)")
on_tables("session_states", catalog.open_sessions, ("orders",), "SELECT o_custkey AS channel_id, count(*) AS open_sessions, max(o_orderkey) AS latest_session FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
PLAYBACK = ("1996-01-01 00:00:00", "1996-03-01 00:00:00")
on_tables("playback_range", lambda o: catalog.playback(o, *PLAYBACK), ("orders",), f"SELECT o_orderkey AS session_id, epoch_us(o_orderdate) // 1000000 AS start_s FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '{PLAYBACK[0]}' AND TIMESTAMP '{PLAYBACK[1]}'")
on_tables("topology_paths", catalog.topology_paths, ("region", "nation"), "SELECT r_name AS origin, NULL::VARCHAR AS edge, r_name AS path, 0 AS hops FROM region UNION ALL SELECT r_name, n_name, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey")
on_tables("forward_plan", catalog.forward_plan, ("supplier", "region"), "SELECT s_suppkey AS stream_key, s || '://' || lower(r_name) || '/live/' || s_suppkey AS target FROM supplier, (SELECT r_name, (['rtmp', 'rtsp', 'srt', 'rtp', 'webrtc'])[r_regionkey % 5 + 1] AS s FROM region) WHERE s <> 'webrtc'")
on_tables("origin_pull_candidates", catalog.origin_pull, ("events",), "SELECT user_id, event_id FROM (SELECT *, last_value(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS live FROM events) WHERE event_type = 'view' AND coalesce(live, 0) = 0")
on_tables("stream_sessions", lambda e: catalog.intervals(e, "signup", "purchase"), ("events",), "SELECT user_id, event_id AS start_id, ts AS start_ts, end_ts, coalesce(nt = 'purchase', false) AS closed FROM (SELECT *, lead(ts) OVER w AS end_ts, lead(event_type) OVER w AS nt FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'signup'")
on_tables("lifecycle_states", lambda e: catalog.lifecycle(e, 36), ("events",), "SELECT user_id, event_id, st AS state, CASE WHEN st = 'destroying' THEN 129600 ELSE g END AS lasts_s FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 'publishing' WHEN g IS NULL OR g > 129600 THEN 'destroying' ELSE 'no_publisher' END AS st FROM (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) - epoch_us(ts)) // 1000000 AS g FROM events WHERE event_type IN ('signup', 'purchase')))")
on_tables("heartbeat_10s", lambda e: catalog.heartbeats(e, 86_400), ("events",), "SELECT user_id, epoch_us(ts) // 86400000000 * 86400 AS window_s, count(*) AS events, min(event_id) AS first_event FROM events GROUP BY 1, 2")
on_tables("event_fanout", catalog.fanout, ("events",), "SELECT endpoint, event_type, count(*) AS deliveries, max(event_id) AS last_event FROM events JOIN (VALUES ('audit', []::VARCHAR[]), ('billing', ['purchase']), ('growth', ['signup', 'purchase']), ('ops', ['error'])) t(endpoint, wanted) ON len(wanted) = 0 OR list_contains(wanted, event_type) GROUP BY ALL")
on_tables("validation_chain", catalog.validation, ("events",), "SELECT CASE WHEN value < 0 THEN 'no_negative_value' WHEN event_type NOT IN ('view', 'click', 'signup', 'purchase', 'error') THEN 'known_type' WHEN value > 90 THEN 'value_limit' WHEN event_type = 'error' THEN 'not_an_error' ELSE 'passed' END AS outcome, count(*) AS events FROM events GROUP BY 1")
on_tables("subscriber_totals", catalog.subscribers, ("events",), "SELECT user_id, count(*) AS subscribers, count(DISTINCT event_type) AS protocols FROM events GROUP BY 1")
on_tables("prometheus_long", catalog.prometheus, ("events",), "SELECT user_id, unnest(['events_total', 'errors_total', 'last_event']) AS metric, unnest([count(*), count(*) FILTER (WHERE event_type = 'error'), max(event_id)]) AS sample FROM events GROUP BY user_id")
on_tables("stream_limit", lambda e: catalog.admission(e, 10), ("events",), "SELECT day, count(*) AS refused FROM (SELECT day, event_id, step, s - least(0, min(s) OVER (PARTITION BY day ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS o FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, step, sum(step) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS step FROM events WHERE event_type IN ('signup', 'purchase')))) WHERE step = 1 AND o > 10 GROUP BY day")
on_tables("free_port", catalog.free_ports, ("orders",), "SELECT min(p) AS port, count(*) AS free FROM range(30000, 30400, 2) t(p) WHERE p NOT IN (SELECT 30000 + 2 * (o_orderkey % 200) FROM orders WHERE o_orderstatus = 'F')")


@query("codec_matrix", "SELECT s AS source, t AS target, s <> 'G729' AND t <> 'G729' AS possible FROM (SELECT unnest(['AAC', 'Opus', 'MP3', 'G711A', 'G711U', 'G722', 'G729', 'Speex']) AS s), (SELECT unnest(['AAC', 'Opus', 'MP3', 'G711A', 'G711U', 'G722', 'G729', 'Speex']) AS t)")
def _codec_matrix(spark, sf_dir):
    return catalog.codec_matrix(spark)


# Scalars.
@query("url_parts", r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path, coalesce(try_cast(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]+:(\d+)', 1), '') AS INT), 1935) AS port FROM pages")
def _url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.scheme(u).alias("scheme"), S.host(u).alias("host"), S.path(u).alias("path"), S.port(u, 1935).alias("port"))


@query("segment_path_parts", r"""WITH u AS (SELECT c_custkey, (['/live/', '/live/room/', '//live/./x/../', '/'])[c_custkey % 4 + 1] || c_name || (['.m3u8', '.v1.flv', '', '.'])[c_custkey % 5 % 4 + 1] AS u FROM customer),
    steps AS (SELECT *, list_filter(string_split(CASE WHEN c_custkey % 4 = 2 THEN replace(u, 'x/../', '') ELSE u END, '/'), lambda s: s <> '' AND s <> '.') AS steps FROM u),
    parts AS (SELECT c_custkey, steps[1] AS app, array_to_string(steps[2:], '/') AS rest FROM steps),
    dots AS (SELECT *, length(rest) - strpos(reverse(rest), '.') + 1 AS dot FROM parts WHERE strpos(rest, '.') > 0)
    SELECT c_custkey, CASE WHEN dot > 1 AND dot < length(rest) THEN app || '/' || rest[:dot - 1] END AS stream, CASE WHEN dot > 1 AND dot < length(rest) THEN rest[dot + 1:] END AS format, c_custkey * 3 AS segment,
        CASE WHEN c_custkey % 2 = 0 THEN 'seg' ELSE '' END || (c_custkey * 3) AS segment_name FROM customer LEFT JOIN dots USING (c_custkey)""")
def _segment_paths(spark, sf_dir):
    k = F.col("c_custkey")
    of = lambda xs, at: F.get(F.array(*map(F.lit, xs)), at.cast("int"))
    base = F.concat(of(("/live/", "/live/room/", "//live/./x/../", "/"), k % 4), F.col("c_name"), of((".m3u8", ".v1.flv", "", "."), k % 5 % 4))
    p = F.concat(F.lit("/live/"), F.col("c_name"), F.when(k % 2 == 0, "/seg").otherwise("/"), (k * 3).cast("string"), F.when(k % 2 == 0, ".m4s").otherwise(".ts"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.stream_path(base).alias("stream"), S.stream_parts(base)["format"].alias("format"), S.segment_number(p).alias("segment"), S.segment_parts(p)["name"].alias("segment_name"))


@query("query_params", "SELECT o_orderkey, o_custkey::VARCHAR AS token, o_orderstatus AS st, 2::BIGINT AS n FROM orders")
def _query_params(spark, sf_dir):
    q = F.concat(F.lit("token="), F.col("o_custkey").cast("string"), F.lit("&st="), F.col("o_orderstatus"), F.lit("&token=again&=x"))
    m = S.query_map(q)
    return table(spark, sf_dir, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.col("m")["token"].alias("token"), F.col("m")["st"].alias("st"), F.size("m").cast("bigint").alias("n"))


@query("size_parse", "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 5 THEN p_size * (CASE p_partkey % 7 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 WHEN 4 THEN 1024 ELSE 1 END)::BIGINT END AS bytes FROM part")
def _size_parse(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    text = F.when(k == 1, F.concat(n, F.lit("KB"))).when(k == 2, F.concat(n, F.lit(".5 mb"))).when(k == 3, F.concat(F.lit(" "), n, F.lit(" Gb "))).when(k == 4, F.concat(n, F.lit("kb"))).when(k == 5, F.concat(F.lit("x"), n)).when(k == 6, F.concat(n, F.lit("b"))).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", S.parse_size(text).alias("bytes"))


@query("ptz_checksum", "SELECT s_suppkey, 'A50F01' || printf('%02X%02X%02X%02X%02X', b::INT, z::INT, h::INT, v::INT, ((181 + b + z + h + v) % 256)::INT) AS command FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END + CASE s_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 8 END AS b, CASE s_suppkey % 7 WHEN 0 THEN 32 WHEN 1 THEN 16 ELSE 0 END AS z, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 64 END AS h, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 64 END AS v FROM supplier)")
def _ptz(spark, sf_dir):
    k = F.col("s_suppkey")
    pan = F.when(k % 3 == 1, 1).when(k % 3 == 2, -1).otherwise(0)
    tilt, zoom = F.when(k % 5 == 0, 0).when(k % 5 == 1, -1).otherwise(1), F.when(k % 7 == 0, -1).when(k % 7 == 1, 1).otherwise(0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.ptz(pan, tilt, zoom).alias("command"))


@query("json_props", r"SELECT CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k, count(*) AS events FROM events GROUP BY 1")
def _json_props(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("events"))


@query("srt_stream_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 4 = 0 AND o_custkey % 3 = 1 THEN 'publish' WHEN o_orderkey % 4 = 0 AND o_custkey % 3 = 2 THEN 'request' ELSE 'subscribe' END AS mode, 'live/' || o_custkey AS key FROM orders")
def _srt(spark, sf_dir):
    key, n, c = F.concat(F.lit("live/"), F.col("o_custkey").cast("string")), F.col("o_orderkey"), F.col("o_custkey")
    listed = F.concat(F.lit("#!::r=/"), key, F.when(c % 3 == 1, ",m=publish").when(c % 3 == 2, ",m=request,x").otherwise(",h=host"))
    text = F.when(n % 4 == 0, listed).when(n % 4 == 1, F.concat(F.lit("publish:/"), key, F.lit("?x=1"))).when(n % 4 == 2, F.concat(F.lit("subscribe:"), key)).otherwise(F.concat(F.lit("/"), key))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.srt_stream_id(text).alias("s")).select("o_orderkey", "s.mode", "s.key")


@query("feedback_mode", "SELECT stream_key, n AS subscribers, CASE WHEN n <= 50 THEN 'passthrough' WHEN n <= 70 THEN 'aggregate' ELSE 'drop' END AS mode FROM (SELECT user_id AS stream_key, count(*) AS n FROM events GROUP BY 1)")
def _feedback(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stream_key")).agg(F.count("*").alias("subscribers"))
    return n.select("*", flow.feedback_mode(F.col("subscribers"), 50, 70).alias("mode"))


@query("retry_schedule", "SELECT n_nationkey, i AS attempt, least(pow(2, least(i - 1, 4)), 30)::BIGINT AS delay_s FROM nation, LATERAL (SELECT unnest(range(1, n_nationkey % 7 + 2)) AS i)")
def _retry(spark, sf_dir):
    n = (F.col("n_nationkey") % 7 + 1).cast("int")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(flow.retry_delays(n)).alias("p", "delay_s")).select("n_nationkey", (F.col("p") + 1).cast("bigint").alias("attempt"), "delay_s")


@query("auth_cases", "SELECT p AS protocol, a AS action, c AS name, c = 'valid' AS expect_allow FROM (SELECT unnest(['rtmp', 'rtsp', 'srt', 'whip']) AS p), (SELECT unnest(['publish', 'subscribe']) AS a), (SELECT unnest(['valid', 'expired', 'wrong_secret', 'missing', 'wrong_stream', 'wrong_action']) AS c)")
def _auth_cases(spark, sf_dir):
    from .functions.auth import cases

    return cases(spark).select("protocol", "action", "name", F.col("allowed").alias("expect_allow"))


# Byte formats: frames with made-up payloads are written and read again; times are the stream's own, a hundredth as long.
def _with_payload(f: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    base = F.min("dts_ms").over(Window.partitionBy("stream_key"))
    dts = F.expr("(dts_ms - _b) div 100")
    cts = F.expr("(pts_ms - dts_ms) div 10000")
    fill = F.pmod("size", F.lit(400)).cast("int") + 1
    nal = F.when(F.col("frame_type") == "key", F.unhex(F.lit("0000000165"))).otherwise(F.unhex(F.lit("0000000141")))
    payload = F.when(F.col("media") == "video", F.concat(nal, F.repeat(F.lit("v"), fill).cast("binary"))).otherwise(F.repeat(F.lit("a"), fill).cast("binary"))
    rows = f.where("frame_type <> 'seqhdr'").withColumn("_b", base).withColumn("payload", payload)
    return rows.select("stream_key", "seq", "media", "codec", "frame_type", dts.alias("dts_ms"), F.when(F.col("media") == "video", dts + cts).otherwise(dts).alias("pts_ms"), F.octet_length("payload").cast("bigint").alias("size"), "payload")


ROUND = MEDIA + """, r AS (SELECT *, (dts_ms - min(dts_ms) OVER (PARTITION BY stream_key)) // 100 AS d, (pts_ms - dts_ms) // 10000 AS c FROM m
), q AS (SELECT stream_key::VARCHAR AS path, seq, media, frame_type, d AS dts_ms, CASE WHEN media = 'video' THEN d + c ELSE d END AS pts_ms, size % 400 + 1 + CASE WHEN media = 'video' THEN 5 ELSE 0 END AS size FROM r)"""
SHOWN = ("path", "media", "frame_type", "dts_ms", "pts_ms", "size")


def _round_trip(name: str, there_and_back, sql: str = " SELECT path, media, frame_type, dts_ms, pts_ms, size FROM q") -> None:
    on_frames(name, lambda f: there_and_back(_with_payload(f)).select(*SHOWN), ROUND + sql)


_round_trip("flv_round_trip", lambda f: flv.frames(flv.mux(f)))
_round_trip("ts_round_trip", lambda f: mpegts.frames(mpegts.joined(mpegts.mux(f))), """, k AS (SELECT path, min(seq) AS s FROM q WHERE media = 'video' AND frame_type = 'key' GROUP BY path) SELECT path, media, frame_type, dts_ms, pts_ms, size FROM q WHERE path IN (SELECT path FROM k)""")
_round_trip("ps_round_trip", lambda f: mpegps.frames(mpegps.mux(f)), """, k AS (SELECT DISTINCT path FROM q WHERE media = 'video' AND frame_type = 'key') SELECT path, media, CASE WHEN media = 'audio' THEN 'key' ELSE frame_type END AS frame_type, dts_ms, pts_ms, size FROM q WHERE path IN (SELECT path FROM k)""")
_round_trip("fmp4_round_trip", lambda f: fmp4.frames(fmp4.mux(f.withColumn("segment", F.expr("dts_ms div 1000000")))).withColumn("frame_type", F.when(F.col("media") == "audio", "inter").otherwise(F.col("frame_type"))))
on_frames("rtp_round_trip", lambda f: rtp.one_byte_descriptor(rtp.headers(rtp.packetize(_with_payload(f).where("media = 'video'"), 120)), "VP9").select("stream_key", "rtp_ts", F.octet_length("payload").cast("bigint").alias("size")), ROUND + " SELECT path::BIGINT AS stream_key, (dts_ms * 90) % 4294967296 AS rtp_ts, size FROM q WHERE media = 'video'")
on_frames("looped_source", lambda f: flv.looped(f, 2, 33).groupBy("stream_key").agg(F.count("*").alias("frames"), F.max("dts_ms").alias("last_ms"), F.max("seq").alias("last_seq")), " SELECT stream_key, 2 * count(*) AS frames, 2 * max(dts_ms) + 33 AS last_ms, 2 * max(seq) + 1 AS last_seq FROM frames GROUP BY stream_key")


LINES = """'#EXT-X-PART:DURATION=' || (duration_ms // 1000) || '.' || lpad((duration_ms % 1000)::VARCHAR, 3, '0') || ',URI="' || segment || '.' || part || '.m4s"' || CASE WHEN independent THEN ',INDEPENDENT=YES' ELSE '' END"""
on_frames("llhls_text", lambda f: playlists.llhls(segments.llhls_parts(f, PART, SEGMENT), PART), PARTS + f""", sg AS (
    SELECT stream_key, segment, string_agg({LINES}, chr(10) ORDER BY part) AS body, sum(duration_ms)::BIGINT AS ms FROM parts GROUP BY stream_key, segment QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY segment DESC) <= 4
), t AS (SELECT stream_key, ceil(max(ms) / 1000.0)::BIGINT AS target, min(segment) AS first, string_agg(body || chr(10) || '#EXTINF:' || (ms // 1000) || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') || ',' || chr(10) || segment || '.m4s', chr(10) ORDER BY segment) AS body FROM sg GROUP BY stream_key)
SELECT stream_key, concat_ws(chr(10), '#EXTM3U', '#EXT-X-VERSION:9', '#EXT-X-TARGETDURATION:' || target, '#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,PART-HOLD-BACK={3 * PART // 1000}.000,CAN-SKIP-UNTIL=' || target * 6, '#EXT-X-PART-INF:PART-TARGET={PART // 1000}.000', '#EXT-X-MEDIA-SEQUENCE:' || first, body, '') AS playlist FROM t""")
on_frames("mpd_text", lambda f: playlists.mpd(segments.dash_timeline(f, keep=5)), DASH + """, d AS (
    SELECT stream_key, segment, coalesce(lead(start_ms) OVER (PARTITION BY stream_key ORDER BY segment) - start_ms, 2000) AS d FROM dash
), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY segment DESC) <= 5
), t AS (SELECT stream_key, segment, d, (sum(d) OVER (PARTITION BY stream_key ORDER BY segment ROWS UNBOUNDED PRECEDING) - d)::BIGINT AS t FROM k)
SELECT stream_key, '<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="dynamic"><Period id="0" start="PT0S"><AdaptationSet contentType="video" mimeType="video/mp4"><SegmentTemplate timescale="1000" startNumber="' || min(segment) || '" media="v$Number$.m4s" initialization="vinit.mp4"><SegmentTimeline>'
    || string_agg('<S t="' || t || '" d="' || d || '"/>', '' ORDER BY segment) || '</SegmentTimeline></SegmentTemplate></AdaptationSet></Period></MPD>' AS mpd FROM t GROUP BY stream_key""")


@query("quality_json", None)
def _quality_json(spark, sf_dir):
    return playlists.report_json(quality.report(frames(spark, sf_dir)))


def _read_report(f: DataFrame) -> DataFrame:
    """The JSON reports' fields, read back."""
    kind = "duration_ms bigint, video struct<frame_count: bigint, fps: double, bitrate_kbps: double, keyframe_interval: double, dts_monotonic: boolean>, audio struct<frame_count: bigint, bitrate_kbps: double, dts_monotonic: boolean>"
    r = playlists.report_json(quality.report(f)).select("stream_key", F.from_json("report", kind).alias("r"))
    return r.select("stream_key", "r.duration_ms", *(F.col(f"r.{m}.{c}").alias(f"{m}_{c}") for m, cs in (("video", ("frame_count", "fps", "bitrate_kbps", "keyframe_interval", "dts_monotonic")), ("audio", ("frame_count", "bitrate_kbps", "dts_monotonic"))) for c in cs))


on_frames("quality_json_fields", _read_report, REPORT + " SELECT stream_key, duration_ms, video_frames AS video_frame_count, video_fps, video_kbps AS video_bitrate_kbps, keyframe_interval_s AS video_keyframe_interval, video_monotonic AS video_dts_monotonic, audio_frames AS audio_frame_count, audio_kbps AS audio_bitrate_kbps, audio_monotonic AS audio_dts_monotonic FROM report")


@query("webhook_payloads", "SELECT event_type AS event, count(*) AS sent, count(DISTINCT user_id) AS streams FROM events GROUP BY 1")
def _webhooks(spark, sf_dir):
    from .streaming.stateful import webhook_payload

    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("stream_key"), F.lit("rtmp").alias("protocol"), F.lit("").alias("remote_addr"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("timestamp"), F.col("props").alias("extra"))
    sent = webhook_payload(rows).select(F.from_json("value", "event string, stream_key string").alias("v"))
    return sent.groupBy("v.event").agg(F.count("*").alias("sent"), F.count_distinct("v.stream_key").alias("streams"))


on_frames("latest_headers", tracks.latest_headers, " SELECT stream_key, media, max(seq) AS seq, arg_max(size, seq) AS size FROM frames WHERE frame_type = 'seqhdr' GROUP BY ALL")
on_frames("sender_counters", tracks.sender_counters, """, s AS (SELECT *, (row_number() OVER (PARTITION BY stream_key, media ORDER BY seq) - 1 + 65500) % 65536 AS s FROM frames)
SELECT stream_key, media, count(*) AS packets, sum(size)::BIGINT AS octets, arg_max(dts_ms, seq) AS last_ms, max(s) AS highest_seq FROM s GROUP BY stream_key, media""")
on_frames("feedback_counters", tracks.feedback_counters, " SELECT stream_key, media, count(*) FILTER (WHERE frame_type = 'key') AS pli, count(*) FILTER (WHERE frame_type = 'seqhdr') AS nack, arg_max(pts_ms - dts_ms, seq) AS jitter FROM frames GROUP BY ALL")
on_frames("after_cache", lambda f: tracks.after_cache(f, segments.gops(f).where("gop_id <= 2")), GOPS + ", e AS (SELECT stream_key, max(start_ms + duration_ms) AS end_ms FROM gops WHERE gop_id <= 2 GROUP BY 1) SELECT stream_key, seq FROM frames JOIN e USING (stream_key) WHERE dts_ms > end_ms")
# The SQL gives the protocol events with even ids only; stream_info_all counts all of both.
on_tables("stream_info", lambda e: tracks.stream_info(e.where("event_type IN ('view', 'click')"), e.where("event_type IN ('view', 'error') AND event_id % 2 = 0")), ("events",), """WITH a AS (SELECT user_id, event_type AS name, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL), b AS (SELECT user_id, event_type AS name, count(*) AS n FROM events WHERE event_type IN ('view', 'error') AND event_id % 2 = 0 GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.name, b.name) AS name, coalesce(b.n, a.n) AS subscribers FROM a FULL JOIN b ON a.user_id = b.user_id AND a.name = b.name""")
on_tables("stream_info_all", lambda e: tracks.stream_info(e.where("event_type IN ('view', 'click')"), e.where("event_type IN ('view', 'error')")), ("events",), "SELECT user_id, event_type AS name, count(*) AS subscribers FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL")
on_frames("segment_lookup", lambda f: tracks.segment_lookup(segments.newest(segments.hls(f), "stream_key", "segment", 5), f.select("stream_key", F.pmod("seq", F.lit(30)).alias("number")).distinct()), HLS + """, rq AS (SELECT DISTINCT stream_key, seq % 30 AS number FROM frames), e AS (SELECT stream_key, max(segment) AS newest FROM last5 GROUP BY 1)
SELECT rq.stream_key, number, CASE WHEN l.segment IS NOT NULL THEN 'found' WHEN number > coalesce(newest, -1) THEN 'wait' ELSE 'gone' END AS answer FROM rq LEFT JOIN e USING (stream_key) LEFT JOIN last5 l ON l.stream_key = rq.stream_key AND l.segment = number""")


SESSION_STATES, SESSION_REQUESTS = ("init", "described", "announced", "ready", "playing", "recording", "closed"), ("describe", "announce", "setup", "play", "record", "pause", "teardown")


@query("session_moves", f"""WITH s AS (SELECT o_orderkey AS session, (['{"', '".join(SESSION_STATES)}'])[o_custkey % 7 + 1] AS state, (['{"', '".join(SESSION_REQUESTS)}'])[o_orderkey % 7 + 1] AS request FROM orders),
    t AS (SELECT *, CASE request WHEN 'describe' THEN 'described' WHEN 'announce' THEN 'announced' WHEN 'play' THEN 'playing' WHEN 'record' THEN 'recording' WHEN 'teardown' THEN 'closed' ELSE 'ready' END AS target FROM s)
    SELECT session, state, request, CASE WHEN CASE state WHEN 'init' THEN target IN ('described', 'announced', 'closed') WHEN 'described' THEN target IN ('ready', 'closed') WHEN 'announced' THEN target IN ('ready', 'closed') WHEN 'ready' THEN target IN ('playing', 'recording', 'closed')
        WHEN 'playing' THEN target IN ('ready', 'closed') WHEN 'recording' THEN target = 'closed' ELSE false END THEN target END AS next_state FROM t""")
def _moves(spark, sf_dir):
    of = lambda xs, c: F.get(F.array(*map(F.lit, xs)), (F.col(c) % 7).cast("int"))
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), of(SESSION_STATES, "o_custkey").alias("state"), of(SESSION_REQUESTS, "o_orderkey").alias("request"))
    return tracks.moves(steps).select("session", "state", "request", "next_state")


@query("session_expiry", """SELECT o_custkey AS session, (SELECT epoch_us(max(o_orderdate)) // 1000000 FROM orders) - max(epoch_us(o_orderdate) // 1000000) FILTER (WHERE o_orderstatus <> 'P') AS idle_s,
    (SELECT epoch_us(max(o_orderdate)) // 1000000 FROM orders) - max(epoch_us(o_orderdate) // 1000000) FILTER (WHERE o_orderstatus <> 'P') > 86400 * 200 AS expired FROM orders GROUP BY 1""")
def _expiry(spark, sf_dir):
    """Orders as steps, pending ones as refused moves; 60 s scaled to 200 days."""
    orders = table(spark, sf_dir, "orders")
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    steps = orders.select(F.col("o_custkey").alias("session"), at.alias("at_s"), F.when(F.col("o_orderstatus") != "P", "ready").alias("next_state"))
    now = steps.agg(F.max("at_s").alias("now_s"))  # one row
    return tracks.expired(steps, F.lit(now.first()[0]), 86_400 * 200)


from . import server_queries  # noqa: E402,F401  registers its queries
