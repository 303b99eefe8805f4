"""Registered queries of the server's own view (`operators/server.py`), and the texts and segments that go with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import catalog, segments, server
from .plans.frames import FRAMES_SQL, frames, table
from .functions import scalars as S
from .queries import DAY, HLS, PART, PARTS, ROUND, SEGMENT, _with_payload, on_frames, on_tables, query
from .sources import rtp

TIMEOUT = DAY // 2
STREAMS = f""", newest AS (SELECT max(dts_ms) AS t FROM frames), st AS (
    SELECT stream_key, min(dts_ms) AS first_ms, max(dts_ms) AS last_ms, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE media = 'video') AS video_frames, count(*) FILTER (WHERE media = 'audio') AS audio_frames,
        CASE WHEN (SELECT t FROM newest) - max(dts_ms) > {TIMEOUT} THEN 'destroying' ELSE 'publishing' END AS state FROM frames GROUP BY 1)"""
on_frames("streams_listed", lambda f: server.listed(server.streams(f, TIMEOUT)), STREAMS + " SELECT * FROM st WHERE state <> 'destroying'")


@query("stream_details", "WITH " + FRAMES_SQL + STREAMS + """, rq AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE (c_custkey % 200)::VARCHAR END AS key FROM customer)
    SELECT request_id, CASE WHEN key = '' THEN 400 WHEN stream_key IS NULL THEN 404 ELSE 200 END AS status, st.* FROM rq LEFT JOIN st ON key = stream_key::VARCHAR AND state <> 'destroying'""")
def _details(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.concat(F.lit("/api/v1/streams/"), F.when(k % 10 == 0, "").otherwise((k % 200).cast("string")), F.when((k % 10 != 0) & (k % 3 == 0), "/kick").otherwise(""))
    return server.details(server.streams(frames(spark, sf_dir), TIMEOUT), table(spark, sf_dir, "customer").select(k.alias("request_id"), path.alias("path")))


@query("server_stats", "SELECT (SELECT count(DISTINCT user_id) FROM events) AS streams, count(*) FILTER (WHERE o_orderstatus <> 'F') AS connections FROM orders")
def _stats(spark, sf_dir):
    return server.totals(server.streams(frames(spark, sf_dir), TIMEOUT), catalog.sessions(table(spark, sf_dir, "orders")))


@query("server_metrics", "WITH " + FRAMES_SQL + STREAMS + f""", m AS (SELECT * FROM frames WHERE frame_type <> 'seqhdr'), gf AS (
    SELECT *, sum((media = 'video' AND frame_type = 'key')::INT) OVER (PARTITION BY stream_key ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS gop_id FROM m
), cached AS (SELECT stream_key, sum(n)::BIGINT AS gop FROM (SELECT stream_key, gop_id, count(*) AS n FROM gf WHERE gop_id > 0 GROUP BY stream_key, gop_id QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY gop_id DESC) <= 2) GROUP BY 1
), w AS (SELECT stream_key, dts_ms // {DAY} AS bucket, sum(size)::BIGINT AS bytes, count(*) AS frames FROM frames GROUP BY ALL
), p AS (SELECT *, CASE WHEN lag(bucket) OVER x = bucket - 1 THEN lag(bytes) OVER x ELSE 0 END AS before FROM w WINDOW x AS (PARTITION BY stream_key ORDER BY bucket)
), rate AS (SELECT stream_key, arg_max((bytes + before) * 8 / {2.0 * DAY}::DOUBLE, bucket) AS kbps, arg_max(frames, bucket) * 1000 / {float(DAY)}::DOUBLE AS fps FROM p GROUP BY 1
), own AS (SELECT * FROM st LEFT JOIN rate USING (stream_key) LEFT JOIN cached USING (stream_key) WHERE state <> 'destroying')
SELECT 'server_streams_active' AS metric, NULL::BIGINT AS stream_key, NULL::VARCHAR AS protocol, count(*)::DOUBLE AS sample FROM st
UNION ALL SELECT 'server_connections_active', NULL, NULL, count(*)::DOUBLE FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'server_uptime_seconds', NULL, NULL, (max(last_ms) - min(first_ms)) / 1000.0::DOUBLE FROM st
UNION ALL SELECT 'stream_bytes_in_total', stream_key, NULL, bytes::DOUBLE FROM own UNION ALL SELECT 'stream_video_frames_total', stream_key, NULL, video_frames::DOUBLE FROM own
UNION ALL SELECT 'stream_audio_frames_total', stream_key, NULL, audio_frames::DOUBLE FROM own UNION ALL SELECT 'stream_bitrate_kbps', stream_key, NULL, kbps FROM own
UNION ALL SELECT 'stream_fps', stream_key, NULL, fps FROM own UNION ALL SELECT 'stream_uptime_seconds', stream_key, NULL, (last_ms - first_ms) / 1000.0::DOUBLE FROM own
UNION ALL SELECT 'stream_gop_cache_frames', stream_key, NULL, coalesce(gop, 0)::DOUBLE FROM own
UNION ALL SELECT 'stream_subscribers', user_id, event_type, count(*)::DOUBLE FROM events WHERE user_id IN (SELECT stream_key FROM own) GROUP BY ALL""")
def _metrics(spark, sf_dir):
    readers = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stream_key"), F.col("event_type").alias("protocol")).agg(F.count("*").alias("n"))
    return server.metrics(frames(spark, sf_dir), readers, catalog.sessions(table(spark, sf_dir, "orders")), TIMEOUT, DAY)


@query("flv_audio", "SELECT codec, CASE WHEN codec IN ('AAC', 'MP3') THEN 'pass' ELSE 'transcode' END AS action FROM (SELECT unnest(['AAC', 'Opus', 'MP3', 'G711A', 'G711U', 'G722', 'G729', 'Speex']) AS codec)")
def _flv_audio(spark, sf_dir):
    from .model import codecs

    return codecs(spark).where("media = 'audio'").select("codec", server.flv_audio(F.col("codec")).alias("action"))


@query("stream_claims", "WITH " + FRAMES_SQL + STREAMS + """, rq AS (SELECT o_orderkey AS n, o_custkey % 400 AS stream_key FROM orders)
    SELECT n, rq.stream_key, CASE WHEN st.stream_key IS NULL AND row_number() OVER (PARTITION BY rq.stream_key ORDER BY n) = 1 THEN 'created' ELSE 'found' END AS answer FROM rq LEFT JOIN st ON st.stream_key = rq.stream_key AND state <> 'destroying'""")
def _claims(spark, sf_dir):
    return server.claim(server.streams(frames(spark, sf_dir), TIMEOUT), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), (F.col("o_custkey") % 400).alias("stream_key")))


@query("shared_readers", """WITH s AS (SELECT user_id AS stream_key, CASE WHEN event_id % 2 = 0 THEN 'flv' ELSE 'ts' END AS format, event_id AS n, CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END AS step FROM events),
    t AS (SELECT *, sum(step) OVER (PARTITION BY stream_key, format ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM s),
    r AS (SELECT *, (s - least(0, min(s) OVER (PARTITION BY stream_key, format ORDER BY n ROWS UNBOUNDED PRECEDING)))::BIGINT AS readers FROM t),
    b AS (SELECT *, coalesce(lag(readers) OVER (PARTITION BY stream_key, format ORDER BY n), 0) AS before FROM r)
    SELECT stream_key, format, n, readers, CASE WHEN before = 0 AND readers > 0 THEN 'started' WHEN before > 0 AND readers = 0 THEN 'ended' END AS event FROM b""")
def _shared(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("stream_key"), F.when(F.col("event_id") % 2 == 0, "flv").otherwise("ts").alias("format"), F.col("event_id").alias("n"), F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(-1).alias("step"))
    return server.shared(rows, "stream_key", "format")


on_tables("action_rules", lambda e: e.groupBy(server.rule_of(F.when(F.col("event_type") == "signup", "publish").when(F.col("event_type") == "view", "subscribe").otherwise(F.col("event_type"))).alias("rule")).agg(F.count("*").alias("events")), ("events",), "SELECT CASE event_type WHEN 'signup' THEN 'publish' WHEN 'view' THEN 'subscribe' END AS rule, count(*) AS events FROM events GROUP BY 1")
on_tables("relay_latency", lambda e: server.latency_histogram(e.select(F.col("event_type").alias("protocol"), (F.col("value") / 10.0).alias("seconds"))), ("events",), """WITH b AS (SELECT unnest(['0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1', '2.5', '5', '10', '+Inf']) AS le)
    SELECT event_type AS protocol, le, count(*) FILTER (WHERE le = '+Inf' OR value / 10.0::DOUBLE <= try_cast(le AS DOUBLE)) AS n FROM events, b GROUP BY ALL""")
on_tables("relay_counters", lambda e: server.relay_counters(e.select(F.when(F.col("event_id") % 2 == 0, "push").otherwise("pull").alias("direction"), F.col("event_type").alias("protocol"), F.round(F.col("value") * 100).cast("bigint").alias("bytes"), F.when(F.col("value") < 5, "refused").alias("error"))), ("events",), """SELECT CASE WHEN event_id % 2 = 0 THEN 'push' ELSE 'pull' END AS direction, event_type AS protocol, count(*) AS transfers,
    coalesce(sum(round(value * 100)::BIGINT) FILTER (WHERE value >= 5), 0)::BIGINT AS bytes, count(*) FILTER (WHERE value < 5) AS errors FROM events GROUP BY ALL""")


@query("auth_totals", "SELECT 48::BIGINT AS total, 40::BIGINT AS passed, 8::BIGINT AS failed")
def _auth_totals(spark, sf_dir):
    """The probes of the matrix; those with a wrong secret end in an error here."""
    from .functions.auth import cases

    return server.probe_totals(cases(spark).select("allowed", (F.col("name") == "valid").alias("expect_allow"), F.when(F.col("name") == "wrong_secret", "refused").alias("error")))


on_frames("window_durations", lambda f: server.window_durations(segments.newest(segments.hls(f), "stream_key", "segment", 5), 6000), HLS + """, nth AS (SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY segment) AS n FROM last5)
SELECT stream_key, greatest(max(duration_ms), 6000) AS max_ms, round(coalesce(avg(duration_ms) FILTER (WHERE n > 2), arg_max(duration_ms, segment)))::BIGINT AS stable_ms FROM nth GROUP BY 1""")


@query("device_sessions_closed", "SELECT o_orderkey AS session_id, CASE WHEN o_custkey % 50 = 7 THEN 'closed' ELSE CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'playing' ELSE 'inviting' END END AS state FROM orders WHERE o_custkey % 100 = 7 OR o_custkey % 100 = 8")
def _closed(spark, sf_dir):
    rows = catalog.sessions(table(spark, sf_dir, "orders")).withColumn("device_id", F.col("channel_id") % 50).withColumn("key", F.col("channel_id") % 100)
    both = server.sessions_of(rows, "key", 7).unionByName(server.sessions_of(rows, "key", 8))
    return server.close_of_device(both, 7).select("session_id", "state")


#: A parameter set of 1280x720, High, level 3.1, and an AudioSpecificConfig of AAC-LC, 44100 Hz, stereo.
SPS, ASC = bytes.fromhex("6764001facd9405005bb011000000300100000030320f1831960"), b"\x12\x10"


@query("codec_report", """WITH h AS (SELECT s_suppkey AS k FROM supplier)
    SELECT k AS stream_key, CASE WHEN k % 4 = 3 THEN 'VP9' ELSE 'H264' END AS video_codec, CASE WHEN k % 4 < 2 THEN 'High' END AS profile, CASE WHEN k % 4 < 2 THEN '3.1' END AS level, CASE WHEN k % 4 < 2 THEN '1280x720' END AS resolution, k % 4 <> 2 AS video_match,
        CASE WHEN k % 3 = 0 THEN 'Opus' ELSE 'AAC' END AS audio_codec, CASE WHEN k % 3 <> 0 THEN 44100 END AS sample_rate, CASE WHEN k % 3 <> 0 THEN 2 END AS channels, true AS audio_match FROM h""")
def _codec_report(spark, sf_dir):
    """Suppliers as streams: a bare parameter set, one among NAL units, one that can't be read, and VP9; AAC or Opus."""
    k = F.col("s_suppkey")
    kind = k % 4
    video = F.struct(F.lit("video").alias("media"), F.when(kind == 3, "VP9").otherwise("H264").alias("codec"), F.when(kind == 0, F.lit(SPS)).when(kind == 1, F.concat(F.lit(b"\0\0\0\1\x09\x10\0\0\0\1"), F.lit(SPS), F.lit(b"\0\0\0\1\x68\xee"))).otherwise(F.lit(b"\x67\x64")).alias("payload"))
    audio = F.struct(F.lit("audio").alias("media"), F.when(k % 3 == 0, "Opus").otherwise("AAC").alias("codec"), F.when(k % 3 == 0, F.lit(b"")).otherwise(F.lit(ASC)).alias("payload"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("stream_key"), F.posexplode(F.array(video, audio)).alias("seq", "h")).select("stream_key", "seq", "h.*")
    return server.codec_report(rows)


# RTP of every codec, there and back, and initialisation segments.
VIDEO, AUDIO = ("H264", "H265", "VP8", "VP9", "AV1"), ("AAC", "Opus", "MP3", "G711A", "G711U", "G722", "G729", "Speex")


def _as_codec(f, codec: str):
    """Frames with a payload that the codec's reader tells keys by."""
    fill = F.repeat(F.lit("v"), F.pmod("size", F.lit(400)).cast("int")).cast("binary")
    heads = {"H264": (b"\0\0\0\1\x65", b"\0\0\0\1\x41"), "H265": (b"\0\0\0\1\x26\1", b"\0\0\0\1\2\1"), "VP8": (b"\x10", b"\x11"), "VP9": (b"\x82", b"\x86"), "AV1": (b"\x12\0\x0a\1\0\x32", b"\x12\0\x32")}
    key, other = heads.get(codec, (b"a", b"a"))
    return f.withColumn("payload", F.concat(F.when(F.col("frame_type") == "key", F.lit(key)).otherwise(F.lit(other)), fill))


def _rtp(codec: str, media: str):
    def run(f):
        rows = _as_codec(_with_payload(f).where(F.col("media") == media), codec)
        got = rtp.depacketized(rtp.headers(rtp.packetized(rows, codec, 120)), codec)
        return got.select("stream_key", "au_id", "rtp_ts", "frame_type", F.octet_length("payload").cast("bigint").alias("size"))

    return run


#: Bytes in front of a frame's filling, for a key and for other frames.
HEADS = {"H264": (5, 5), "H265": (6, 6), "VP8": (1, 1), "VP9": (1, 1), "AV1": (6, 3)} | dict.fromkeys(AUDIO, (1, 1))
for _codec in (*VIDEO, *AUDIO):
    _media, _clock = ("video" if _codec in VIDEO else "audio"), rtp.CLOCKS[_codec]
    # The VP9 descriptor as written has no bit that tells keys from other frames, so all come back as keys.
    _type = "'inter'" if _media == "audio" else "'key'" if _codec == "VP9" else "frame_type"
    on_frames(f"rtp_round_trip_{_codec.lower()}", _rtp(_codec, _media), ROUND + f""" SELECT path::BIGINT AS stream_key, row_number() OVER (PARTITION BY path ORDER BY seq) - 1 AS au_id, (dts_ms * {_clock} // 1000) % 4294967296 AS rtp_ts, {_type} AS frame_type,
        size % 400 + CASE WHEN frame_type = 'key' THEN {HEADS[_codec][0]} ELSE {HEADS[_codec][1]} END AS size FROM q WHERE media = '{_media}'""")

on_tables("fmp4_descriptions", lambda s: _descriptions(s), ("supplier",), """SELECT s_suppkey::VARCHAR AS path, t AS track_no, CASE WHEN t = 1 THEN 'avc1' ELSE 'mp4a' END AS entry, CASE WHEN t = 1 THEN 1280 + s_suppkey % 3 END AS width, CASE WHEN t = 1 THEN 720 END AS height, CASE WHEN t = 2 THEN 2 END AS channels, CASE WHEN t = 2 THEN 44100 END AS sample_rate,
    CASE WHEN t = 1 THEN '0164001FFFE1001A6764001FACD9405005BB011000000300100000030320F183196001000268EE' ELSE '1210' END AS config FROM supplier, (SELECT unnest([1, 2]) AS t)""")


def _descriptions(suppliers):
    """Suppliers as streams of H.264 and AAC: initialisation segments written and read again."""
    from .functions import codecs
    from .sources import fmp4

    k = F.col("s_suppkey")
    width, height = (1280 + k % 3).cast("int"), F.lit(720)
    video = fmp4.video_entry("H264", width, height, codecs.avc_config(F.lit(SPS), F.lit(b"\x68\xee")))
    audio = fmp4.audio_entry("AAC", F.lit(44_100), F.lit(2), F.lit(ASC))
    files = suppliers.select(k.cast("string").alias("path"), fmp4.init_segment(video=video, audio=audio, audio_scale=44_100, width=width, height=height).alias("content"))
    return fmp4.descriptions(fmp4.boxes(files)).withColumn("config", F.hex("config")).withColumns({c: F.col(c).cast("int") for c in ("track_no", "width", "height", "channels", "sample_rate")})


@query("rtcp_round_trip", """SELECT s_suppkey AS stream_key, CASE s_suppkey % 3 WHEN 0 THEN 'SR' WHEN 1 THEN 'RR' ELSE 'BYE' END AS kind, s_suppkey AS ssrc, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 7 END AS packets, CASE WHEN s_suppkey % 3 < 2 AND s_suppkey % 2 = 0 THEN s_suppkey + 1 END AS about,
    CASE WHEN s_suppkey % 3 < 2 AND s_suppkey % 2 = 0 THEN s_suppkey * 3 END AS jitter FROM supplier""")
def _rtcp(spark, sf_dir):
    k = F.col("s_suppkey")
    none, even = F.lit(None).cast("bigint"), k % 2 == 0
    rows = table(spark, sf_dir, "supplier").select(k.alias("stream_key"), F.when(k % 3 == 0, "SR").when(k % 3 == 1, "RR").otherwise("BYE").alias("kind"), k.alias("ssrc"), k.cast("decimal(20,0)").alias("ntp_time"), (k * 90).alias("rtp_time"), (k * 7).alias("packets"), (k * 100).alias("octets"),
        F.when(even, k + 1).alias("about"), F.lit(3).alias("fraction_lost"), k.alias("lost"), k.alias("highest_seq"), (k * 3).alias("jitter"))
    packets = rtp.build_rtcp(rows).withColumn("idx", F.lit(0))
    reports = rtp.rtcp(packets).select("stream_key", "kind", "ssrc", "packets", F.when(F.col("block").isNotNull(), F.col("about")).alias("about"), F.when(F.col("block").isNotNull(), F.col("jitter")).alias("jitter"))
    return reports.unionByName(rtp.goodbyes(packets).select("stream_key", F.lit("BYE").alias("kind"), "ssrc", none.alias("packets"), none.alias("about"), none.alias("jitter")))


on_frames("llhls_full_segments", lambda f: server_segments(f), PARTS + " SELECT stream_key, segment, count(*) AS parts, string_agg(repeat(chr((97 + part % 26)::INT), (bytes % 50)::INT), '' ORDER BY part) AS payload FROM parts GROUP BY stream_key, segment")


def server_segments(f):
    parts = segments.llhls_parts(f, PART, SEGMENT)
    filled = F.repeat(F.char((97 + F.col("part") % 26).cast("bigint")), (F.col("bytes") % 50).cast("int")).cast("binary")
    return segments.full_segments(parts.select("stream_key", "segment", "part", filled.alias("payload"))).withColumn("payload", F.col("payload").cast("string"))


on_frames("next_blocking_requests", lambda f: _blocking(f), PARTS + """, pl AS (SELECT n_nationkey * 1000 + i AS player, i AS stream_key, n_nationkey % 30 AS lm, n_nationkey % 4 AS lp FROM nation, (SELECT unnest(range(0, 40)) AS i)
), nw AS (SELECT stream_key, max(segment) AS m FROM parts GROUP BY 1), np AS (SELECT stream_key, m, max(part) AS p FROM parts JOIN nw USING (stream_key) WHERE segment = m GROUP BY ALL)
SELECT player, CASE WHEN m IS NULL THEN lm + 1 WHEN lm < m OR lm = m AND lp < p THEN lm ELSE m END::BIGINT AS msn, CASE WHEN m IS NULL THEN 0 WHEN lm < m OR lm = m AND lp < p THEN lp + 1 ELSE p + 1 END::BIGINT AS part FROM pl LEFT JOIN np USING (stream_key)""")


def _blocking(f):
    """Players of forty streams, each at another place."""
    from .sources import texts

    parts = segments.llhls_parts(f, PART, SEGMENT).select(F.col("stream_key").cast("string").alias("path"), F.col("segment").alias("msn"), "part")
    k = F.col("k")
    players = f.sparkSession.range(25).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i")).select((k * 1000 + F.col("i")).alias("player"), F.col("i").cast("string").alias("path"), (k % 30).alias("last_msn"), (k % 4).alias("last_part"))
    return texts.next_request_of(parts, players)


@query("sdp_round_trip", """SELECT s_suppkey::VARCHAR AS path, t AS m, CASE WHEN t = 1 THEN 'video' ELSE 'audio' END AS media, CASE WHEN t = 1 THEN 96 ELSE 101 + (s_suppkey % 20)::INT END AS payload_type, CASE WHEN t = 1 THEN 'H264' ELSE 'OPUS' END AS codec,
    CASE WHEN t = 1 THEN 90000 ELSE 48000 END AS clock_rate, CASE WHEN t = 2 THEN (1 + s_suppkey % 2)::INT END AS channels, CASE WHEN t = 1 THEN 'packetization-mode=1' ELSE '' END AS fmtp, t - 1 AS track FROM supplier, (SELECT unnest([1, 2]) AS t)""")
def _sdp(spark, sf_dir):
    from .sources import texts

    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("m"), (1 + k % 2).cast("int").alias("n"), (101 + k % 20).cast("int").alias("pt"))
    video = F.col("m") == 1
    tracks_ = rows.select("path", "m", F.when(video, "video").otherwise("audio").alias("media"), F.when(video, 96).otherwise(F.col("pt")).alias("payload_type"), F.when(video, "H264").otherwise("opus").alias("codec"), F.when(video, 90_000).otherwise(48_000).alias("clock_rate"), F.when(~video, F.col("n")).alias("channels"), F.when(video, "packetization-mode=1").alias("fmtp"))
    back = texts.sdp(texts.build_sdp(tracks_))
    return back.select("path", F.col("m").cast("int").alias("m"), "media", "payload_type", "codec", "clock_rate", "channels", F.coalesce("fmtp", F.lit("")).alias("fmtp"), texts.track_id(F.col("control")).alias("track"))


@query("codec_strings", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'avc1.64001f' WHEN 2 THEN 'hvc1.1.6.L120.B0' ELSE 'avc1.640028' END AS video, CASE s_suppkey % 5 WHEN 0 THEN 'mp4a.40.2' WHEN 1 THEN 'mp4a.40.5' WHEN 2 THEN 'opus' WHEN 3 THEN 'mp4a.40.34' ELSE 'mp4a.40.2' END AS audio FROM supplier""")
def _codec_strings(spark, sf_dir):
    """With a record, without one, H265 and AV1; AAC-LC, HE-AAC, Opus, MP3, and AAC without a configuration."""
    k = F.col("s_suppkey")
    of = lambda n, xs: F.get(F.array(*(F.lit(x) for x in xs)), (k % n).cast("int"))
    record = F.when(k % 4 == 0, F.lit(b"\x01\x64\x00\x1f\xff")).otherwise(F.lit(b""))
    config = F.when(k % 5 == 0, F.lit(ASC)).when(k % 5 == 1, F.lit(b"\x2b\x92")).otherwise(F.lit(b""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.video_codec_string(of(4, ("H264", "H264", "H265", "AV1")), record).alias("video"), S.audio_codec_string(of(5, ("AAC", "AAC", "Opus", "MP3", "AAC")), config).alias("audio"))
